"""Token files: exact round trip by key, and the hash index on its own."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import token_files

Tokenizer = pytest.importorskip("tokenizers").Tokenizer
P = pytest.importorskip("public_tokenizers")


def test_perfect_hash():
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64)
    columns = {name: np.arange(5000) for name, _ in token_files.FIELDS}
    part = token_files.IndexPart(b"".join(token_files.index_bytes(one, two, columns)))
    assert sorted(part.hasher.slots(one, two)) == list(range(5000))
    known, found = part.find(one, two)
    assert known.all() and (found["first"] == np.arange(5000)).all()
    assert not part.find(two, one)[0].any()
    assert not token_files.IndexPart(b"".join(token_files.index_bytes(one[:0], two[:0], {n: one[:0] for n, _ in token_files.FIELDS}))).find(one, two)[0].any()
    with pytest.raises(ValueError):
        token_files.PerfectHash.build(one[[0, 0]], two[[0, 0]])


def test_round_trip(spark):
    rng = random.Random(1)
    given = [(i * 3, "Été lorem ipsum " * rng.randint(0, 60)) for i in range(400)]
    given += [(9, "again"), (9, "again"), (12, None), (None, "no id"), (None, None), (1, "x" * 20_000), (2, "a <|endoftext|> b")]
    given += [(600, f"hot {i % 5}") for i in range(300)]
    rng.shuffle(given)
    path = P.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(a, b, 0) for a, b in given], "doc_id long, text string, shard int")
    rows = token_files.encode_and_read(docs, path).collect()
    plain = Tokenizer.from_file(path)
    want = Counter()
    for doc_id, text in given:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want[(doc_id, len(ids) // 4, zlib.crc32(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at, last = 0, -1
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        assert (-1 if r.doc_id is None else r.doc_id) >= last
        last = -1 if r.doc_id is None else r.doc_id
    assert token_files.encode_and_read(docs.limit(0), path).count() == 0


def test_folder_is_resolved_as_spark_resolves_it(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    folder = str(tmp_path / "a b")
    keys = token_files.write_token_files(docs, P.path("word_bpe_49k.json"), folder)
    assert len(list((tmp_path / "a b").glob("shard-*.bin"))) >= 1
    assert {r.doc_id for r in token_files.read_documents(keys, folder).collect()} == {1, 2}
    assert token_files.shared_uri(spark, folder) == token_files.shared_uri(spark, f"file:{folder}") == f"file://{folder}"
    # a file system of Spark's alone
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.none.link./x", f"file:{tmp_path}")
    with pytest.raises(ValueError, match="viewfs"):
        token_files.write_token_files(docs, P.path("word_bpe_49k.json"), "viewfs://none/x")
