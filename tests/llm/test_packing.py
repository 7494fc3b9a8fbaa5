"""Packing: every piece has one place, sequences are gapless, the reduction is sound."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from folioflow.llm import packing, tokens

P = pytest.importorskip("public_tokenizers")


def fewest(items, capacity):
    """Bins of an optimal packing, by trying all."""
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            place(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1 :])
        place(i + 1, rooms + [capacity - items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    for _ in range(150):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        fixed, left = packing.reduce_instance(dict(Counter(items)), 20)
        rest = [n for n, c in left.items() for _ in range(c)]
        assert sorted([n for p in fixed for n in p.lengths * p.count] + rest) == sorted(items)
        assert sum(p.count for p in fixed) + fewest(sorted(rest, reverse=True), 20) == fewest(items, 20)


def plain_best_fit(items, capacity):
    rooms = []
    for n in sorted(items, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_best_fit_by_counts_equals_best_fit_by_piece():
    rng = random.Random(4)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
        patterns = packing.best_fit(dict(Counter(items)), 30)
        assert sorted(30 - sum(p.lengths) for p in patterns for _ in range(p.count)) == plain_best_fit(items, 30)


def test_piece_encoder_equals_library():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|ENDOFTEXT|>", "<|startoftext|>x", "<|endof", "", " ", "a  b\n\n c\t\td 's 'S don't DON'T", "İA̋ é ΣΑΣ 中 x <|endoftext|> y", "x" * 900, "½ ²x 10"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc, plain = tokens.PieceEncoder(P.path(name)), Tokenizer.from_file(P.path(name))
        for text in texts + ["".join(p) for p in combinations(texts, 2)]:
            ids = plain.encode(text, add_special_tokens=False).ids
            assert enc.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_pack(spark):
    given = [(1, "word " * 3000), (2, None), (3, ""), (4, "same text"), (4, "same text"), (None, "x y z"), (5, "<|endoftext|> x")]
    given += [(10 + i, "lorem ipsum " * (i % 97)) for i in range(300)]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumnsRenamed({})
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path).collect()
    enc = tokens.PieceEncoder(path)
    want = Counter()
    for doc_id, text in given:
        ids = enc.whole(text or "") + (2).to_bytes(4, "little")
        first = len(ids) // 4 % 1024 or 1024
        ends = list(range(first, len(ids) // 4 + 1, 1024))
        for piece, (start, stop) in enumerate(zip([0, *ends], ends)):
            want[(doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= len(plain_best_fit([r.length for r in rows], 1024))
    assert packing.pack(docs.limit(0), path).count() == 0
