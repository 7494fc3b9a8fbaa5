import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow.operators import documents, merge, points
from folioflow.schemas import STATUS_EVENTS


def table(spark, path):
    return sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect())


def kv(spark, **pairs):
    return spark.createDataFrame(list(pairs.items()), "k string, v int")


def test_bucketed_table_upsert_and_delete(spark, tmp_path):
    path = str(tmp_path / "t")
    merge.upsert_table(spark, path, kv(spark, a=1, b=2, c=3), "k", buckets=4)
    for _ in range(2):
        merge.upsert_table(spark, path, kv(spark, b=20, d=4), "k", buckets=4)
    assert table(spark, path) == [("a", 1), ("b", 20), ("c", 3), ("d", 4)]
    merge.delete_from_table(spark, path, kv(spark, a=0, b=0, c=0), "k", buckets=4)
    assert table(spark, path) == [("d", 4)]
    merge.delete_from_table(spark, path, kv(spark, d=0), "k", buckets=4)
    merge.upsert_table(spark, path, kv(spark, z=9), "k", buckets=4)
    assert table(spark, path) == [("z", 9)]


def test_a_key_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "t")
    twice = kv(spark, a=1, b=2).union(kv(spark, a=1))
    merge.upsert_table(spark, path, twice, "k", buckets=8)
    assert table(spark, path) == [("a", 1), ("b", 2)]
    # The count of the first write holds for all later ones.
    merge.upsert_table(spark, path, twice, "k", buckets=64)
    assert table(spark, path) == [("a", 1), ("b", 2)]
    merge.delete_from_table(spark, path, kv(spark, a=0), "k", buckets=3)
    assert table(spark, path) == [("b", 2)]
    current = kv(spark, a=0, z=9)
    got = merge.put_rows(current, kv(spark, a=1).union(kv(spark, a=2)), "k", "v").collect()
    assert sorted((r["k"], r["v"]) for r in got) == [("a", 2), ("z", 9)]


def test_ordered_upsert_keeps_newer_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in (5, 3, 7, 7):
        merge.upsert_table(spark, path, kv(spark, a=v), "k", order="v", buckets=2)
    assert table(spark, path) == [("a", 7)]


def test_latest_by_key_combines_before_the_shuffle(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as k", "id as v")
    newest = merge.latest_by_key(rows, "k", "v")
    got = {r["k"]: r["v"] for r in newest.collect()}
    assert got["hot"] == 2997 and len(got) == 2001
    assert "partial_max_by" in newest._jdf.queryExecution().executedPlan().toString()


def test_points_operators(spark):
    def pts(*rows):
        return spark.createDataFrame(rows, "point_id string, doc_id string, v int")

    stored = pts(("1", "a", 1), ("2", "a", 2), ("3", "b", 3))
    incoming = spark.createDataFrame([("2", "a", 21, 1), ("2", "a", 22, 2), ("4", "c", 4, 1)],
                                     "point_id string, doc_id string, v int, seq int")
    once = points.upsert_points(stored, incoming, "seq")
    assert sorted(map(tuple, once.collect())) == [("1", "a", 1), ("2", "a", 22), ("3", "b", 3), ("4", "c", 4)]
    assert sorted(map(tuple, points.upsert_points(once, incoming, "seq").collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, points.delete_points(stored, incoming).collect())) == [("1", "a", 1), ("3", "b", 3)]
    assert sorted(map(tuple, points.reindex_docs(stored, pts(("9", "a", 9))).collect())) == [("3", "b", 3), ("9", "a", 9)]


def test_collection_checks_vector_size(spark, tmp_path):
    path = str(tmp_path / "c")
    assert points.create_collection(spark, path, 3, "manhattan") == {"dim": 3, "metric": "cosine"}
    assert points.create_collection(spark, path, 9, "dot") == {"dim": 3, "metric": "cosine"}
    bad = spark.createDataFrame([("c1", [1.0])], "chunk_id string, vector array<float>")
    with pytest.raises(Exception, match="vector size is not 3: c1"):
        bad.select(points.checked_vector(3)).collect()


def test_intake_rules(spark):
    at = datetime(2024, 1, 1)
    limit = documents.MAX_FILE_SIZE
    asked = [("u", "a.pdf", 10, None, at), ("u", "b.pdf", limit, "application/pdf", at), ("u", "c.pdf", limit + 1, None, at),
             ("u", "d.png", 5, "image/png", at), (None, "e.pdf", 5, None, at), ("u", "", 5, None, at), ("u", "g.pdf", 0, None, at)]
    df = spark.createDataFrame(asked, "user_id string, filename string, file_size long, mime_type string, upload_time timestamp_ntz")
    ok = documents.register_uploads(df).orderBy("filename").collect()
    assert [r["filename"] for r in ok] == ["a.pdf", "b.pdf"] and ok[0]["mime_type"] == "application/pdf"
    assert ok[0]["doc_id"].startswith("doc_") and len(ok[0]["doc_id"]) == 36
    assert ok[0]["storage_path"] == f"raw/u/{ok[0]['doc_id']}/a.pdf"
    assert documents.rejected_uploads(df).count() == 5
    assert documents.register_uploads(df).orderBy("filename").collect() == ok


def test_preferred_version(spark):
    names = ["x/BILLS-118hr7rs.pdf", "x/BILLS-118hr7enr.pdf", "y/BILLS-118hr8eh.pdf", "y/BILLS-118hr8zz.pdf", "y/other.pdf"]
    got = documents.select_preferred_version(spark.createDataFrame([(n,) for n in names], "path string"))
    assert sorted((r["bill"], r["path"]) for r in got.collect()) == [("7", names[1]), ("8", names[2])]


def test_status_patch_and_listing(spark):
    at = datetime(2024, 1, 1)
    asked = [("u1", f"f{i}.pdf", 10, None, at + timedelta(hours=i)) for i in range(8)] + [("u2", "z.pdf", 1, None, at)]
    uploads = spark.createDataFrame(asked, "user_id string, filename string, file_size long, mime_type string, upload_time timestamp_ntz")
    docs = documents.new_documents(documents.register_uploads(uploads))
    ids = {r["filename"]: r["doc_id"] for r in docs.select("metadata.filename", "doc_id").collect()}
    events = spark.createDataFrame(
        [(1, ids["f0.pdf"], "u1", "ocr_processing", at, None), (2, ids["f0.pdf"], "u1", "ocr_failed", at, "boom"),
         (3, "doc_none", "u1", "indexed", at, None)], STATUS_EVENTS)
    new = {r["doc_id"]: r for r in documents.update_status(docs, events).collect()}
    assert len(new) == 9 and new[ids["f0.pdf"]]["status"] == "ocr_failed" and new[ids["f0.pdf"]]["error_message"] == "boom"
    assert new[ids["f1.pdf"]]["status"] == "uploaded"
    assert [r["metadata"]["filename"] for r in documents.list_for_user(docs, "u1", 3).collect()] == ["f7.pdf", "f6.pdf", "f5.pdf"]
    assert documents.list_by_user(docs, 2).count() == 3
    got = documents.documents_get(docs, events.select("doc_id").distinct()).collect()
    assert sorted(r["user_id"] is None for r in got) == [False, True]
    done = spark.createDataFrame([(ids["f1.pdf"], "success", None)], "doc_id string, status string, page_count int")
    patched = {r["doc_id"]: r for r in documents.patch_extracted(docs, done).collect()}[ids["f1.pdf"]]
    assert patched["metadata"]["page_count"] == 1 and patched["status"] == "ocr_completed"
    assert patched["metadata"]["filename"] == "f1.pdf" and patched["ocr_result_path"].startswith("processed/doc_")


def test_lifecycle_of_a_hot_document(spark):
    rng, at = random.Random(2), datetime(2024, 1, 1)
    states = ["uploaded", "ocr_processing", "ocr_completed", "indexing", "indexed", "ready"]
    events = [(i, "hot" if i % 3 else f"d{i % 5}", "u", rng.choice(states), at + timedelta(minutes=rng.randint(0, 5000)), None)
              for i in range(900)]
    got = documents.lifecycle_check(spark.createDataFrame(events, STATUS_EVENTS))
    expected, last = [], {}
    for e in sorted(events, key=lambda e: (e[4], e[0])):
        before = last.get(e[1])
        if before and before != e[3] and f"{before}>{e[3]}" not in documents.TRANSITIONS:
            expected.append((e[1], e[0], before, e[3]))
        last[e[1]] = e[3]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_run_outcomes(spark):
    log = spark.createDataFrame([("x", "1", "success", None, 5.0), ("x", "2", "success", None, 7.0), ("x", "3", "failed", "e", 1.0)],
                                "stage string, unit_id string, status string, error string, duration_ms double")
    got = {r["status"]: (r["units"], r["errors"], r["p50_ms"]) for r in documents.run_outcomes(log).collect()}
    assert got == {"success": (2, 0, 5.0), "failed": (1, 1, 1.0)}


def test_reindex_removes_documents_without_chunks(spark):
    stored = spark.createDataFrame([("1", "a"), ("2", "b")], "point_id string, doc_id string")
    docs = spark.createDataFrame([("a",)], "doc_id string")
    assert [tuple(r) for r in points.reindex_docs(stored, stored.limit(0), docs).collect()] == [("2", "b")]
