import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import points, retrieval, snapshots
from folioflow.operators.chunking import chunk_documents
from folioflow.operators.snapshots import SnapshotTable
from folioflow.plans import views
from folioflow.plans.queries import QUERIES
from folioflow.sources.files import names_in, write_new

SF_DIR = "/root/testdata/sf0.001"


def made(spark, tmp_path, buckets=4):
    return SnapshotTable.create(spark, str(tmp_path / "t"), "doc_id", "point_id", buckets)


def rows(spark, *given):
    return spark.createDataFrame(given, "doc_id string, point_id string, v int")


def state(df):
    return {(r.doc_id, r.point_id): r.v for r in df.collect()}


def test_random_writes_equal_a_dictionary(spark, tmp_path):
    rng, table, want = random.Random(1), made(spark, tmp_path), {}
    assert table.read().count() == 0
    for step in range(14):
        some = [(f"d{rng.randrange(12)}", f"p{rng.randrange(6)}", 100 * step + i) for i in range(rng.randint(1, 15))]
        kind = rng.choice(["upsert", "append", "delete docs", "delete points", "replace", "compact"])
        if kind in ("upsert", "append"):
            table.upsert(spark.createDataFrame([(*r, r[2]) for r in some], "doc_id string, point_id string, v int, seq int"), "seq", append=kind == "append")
            want |= {r[:2]: r[2] for r in some}
        elif kind == "delete docs":
            table.delete(rows(spark, *some[:3]).select("doc_id"))
            want = {k: v for k, v in want.items() if k[0] not in {r[0] for r in some[:3]}}
        elif kind == "delete points":
            table.delete(rows(spark, *some).select("doc_id", "point_id"))
            want = {k: v for k, v in want.items() if k not in {r[:2] for r in some}}
        elif kind == "replace":
            table.replace(rows(spark, *some), order="v")
            want = {k: v for k, v in want.items() if k[0] not in {r[0] for r in some}} | {r[:2]: r[2] for r in some}
        else:
            table.compact()
            assert all(len(ws) == 1 for b, ws in table.snapshot().live.items() if b in table.snapshot().layered)
        assert state(table.read()) == want, kind
    table.compact()
    table.vacuum(keep=1)
    assert state(SnapshotTable(spark, table.path).read()) == want and len(table.versions()) == 1


def test_readers_see_one_version(spark, tmp_path):
    table = made(spark, tmp_path)
    table.upsert(rows(spark, ("a", "1", 1), ("b", "2", 2)))
    before, number = table.read(), table.snapshot().version
    table.upsert(rows(spark, ("a", "1", 10)))
    table.delete(rows(spark, ("b", "2", 0)).select("doc_id"))
    assert state(before) == state(table.read(number)) == {("a", "1"): 1, ("b", "2"): 2}
    assert state(table.read()) == {("a", "1"): 10}


def test_of_two_writers_one_fails(spark, tmp_path):
    table = made(spark, tmp_path)
    old = table.snapshot()
    table.upsert(rows(spark, ("a", "1", 1)))
    with pytest.raises(FileExistsError):
        table._next(old, {}, None, set())
    with pytest.raises(FileExistsError):
        write_new(spark, f"{table.path}/versions/0000000000.json", "x")
    assert state(table.read()) == {("a", "1"): 1} and not [n for n in names_in(spark, f"{table.path}/versions") if n[0] == "_"]


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_on_the_key_need_no_exchange(spark, tmp_path):
    table = made(spark, tmp_path, 4)
    many = spark.range(4000).selectExpr("concat('d', id % 50) as doc_id", "concat('p', id) as point_id", "cast(id as int) as v")
    table.upsert(many)
    table.upsert(many.filter("v % 3 = 0"), append=True)
    docs = SnapshotTable.create(spark, str(tmp_path / "docs"), "doc_id", buckets=4)
    docs.upsert(many.select("doc_id").distinct().withColumn("status", F.lit("ready")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval.filter_searchable(table.read(), docs.read())
        text = plan(found).split("Initial Plan")[0]
        assert "Exchange" not in text and text.count("Bucketed: true") == 2 and found.count() == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    one = rows(spark, ("d7", "p7", 0))
    table.delete(one.select("doc_id"))
    bucket = one.select(F.pmod(F.hash("doc_id"), F.lit(4))).first()[0]
    last = max(w for ws in table.snapshot().live.values() for w in ws)
    assert [b for b, ws in table.snapshot().live.items() if last in ws] == [bucket]


def test_stored_collection_search_and_reindex(spark, tmp_path):
    path, rng = str(tmp_path / "c"), np.random.default_rng(2)
    points.create_collection(spark, path, 4, "dot", buckets=4)
    vectors = rng.normal(size=(60, 4)).round(3)
    given = [(f"d{i % 6}_{i // 6}", f"d{i % 6}", "u", [float(x) for x in v]) for i, v in enumerate(vectors)]
    stored = spark.createDataFrame(given, "chunk_id string, doc_id string, user_id string, vector array<float>")
    points.save_points(spark, path, stored.withColumn("point_id", F.col("chunk_id")))
    asked = spark.createDataFrame([("q", "u", [1.0, -1.0, 0.5, 2.0], 5)], "query_id string, user_id string, vector array<float>, top_k int")
    got = [r.chunk_id for r in points.search_points(spark, path, asked).orderBy("rank").collect()]
    score = lambda v: np.float32(v).astype(float) @ np.array([1.0, -1.0, 0.5, 2.0])
    assert got == [g[0] for g in sorted(given, key=lambda g: (-round(score(g[3]), 6), g[0]))[:5]]
    with pytest.raises(Exception, match="vector size"):
        points.save_points(spark, path, stored.withColumns({"point_id": F.col("chunk_id"), "vector": F.array(F.lit(1.0).cast("float"))}))


def test_reindex_embeds_only_changed_chunks(spark, tmp_path):
    path, calls = str(tmp_path / "c"), tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def provider():
        import os
        import uuid

        def embed(texts):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(t.replace("\n", " ") for t in texts))
            return np.array([[float(len(t)), 1.0] for t in texts])

        return embed

    def asked():
        found = [line for f in calls.iterdir() for line in f.read_text().split("\n")]
        for f in calls.iterdir():
            f.unlink()
        return sorted(found)

    def chunks(texts):
        docs = spark.createDataFrame([(d, "u", "f", t) for d, t in texts.items()], "doc_id string, user_id string, filename string, text string")
        return chunk_documents(docs, size=12)

    def index(texts, docs=None):
        return points.reindex_stored(spark, path, chunks(texts), provider, docs)

    points.create_collection(spark, path, 2, buckets=4)
    first = {"a": "\n1. one one\n2. two two\n3. same it\n4. same it", "b": "\n1. other", "c": "\n1. third"}
    assert index(first)["failed"] == 0
    done = asked()
    assert done and set(done) == {r.text for r in chunks(first).collect()}
    # one chunk goes in front, so all others move; only the new text is embedded, and b and c are left alone
    version = points.SnapshotTable(spark, path).snapshot()
    counts = index({"a": "\n0. zero it\n1. one one\n2. two two\n3. same it\n4. same it"})
    assert asked() == ["0. zero it"] and counts["embedded"] == 1 and counts["chunks"] == 5
    now = {r.chunk_id: (r.text, list(r.vector)) for r in points.load_points(spark, path).collect()}
    assert len(now) == 7 and all(v == [len(t), 1.0] for t, v in now.values()) and now["a_1"][0] == "1. one one"
    assert sum(ws != version.live.get(b) for b, ws in points.SnapshotTable(spark, path).snapshot().live.items()) == 1
    # a document without chunks loses its points, a failed call leaves all as it was
    gone = spark.createDataFrame([("b",)], "doc_id string")
    points.reindex_stored(spark, path, chunks(first).limit(0), provider, gone)
    assert {r.doc_id for r in points.load_points(spark, path).collect()} == {"a", "c"}

    def down():
        def fail(texts):
            raise RuntimeError("quota")
        return fail

    counts = points.reindex_stored(spark, path, chunks({"a": "\n1. new text"}), down, min_wait=0, max_wait=0)
    assert counts["failed"] == 1 and points.load_points(spark, path).count() == 6
    assert not names_in(spark, f"{path}/work")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given test tables")
def test_collection_of_a_larger_corpus_has_more_buckets(spark, monkeypatch):
    """A bucket is one task of a write or join, so its size must not follow the corpus."""
    assert [snapshots.buckets_for(n) for n in (None, 0, 600 << 20, 60000 << 20)] == [8, 8, 10, 938]
    monkeypatch.setattr(snapshots, "BUCKET_BYTES", views.text_point_bytes(spark, SF_DIR) // 11)
    made, create = [], points.create_collection
    monkeypatch.setattr(points, "create_collection", lambda *a, **k: made.append(k["buckets"]) or create(*a, **k))
    few = QUERIES["collection_reindex"](spark, SF_DIR)
    assert made == [12] and few.count() == few.select("chunk_id").distinct().count() > 0
