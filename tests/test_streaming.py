import os

import pytest
from pyspark.sql import functions as F

from folioflow.functions import messages
from folioflow.operators import documents, embedding, newest, points
from folioflow.plans.queries import QUERIES
from folioflow.schemas import EXTRACTED, STATUS_EVENTS
from folioflow.sources import raw
from folioflow.streaming import jobs, lifecycle
from tests.test_extract_embed import FILES, write_files

SF_DIR = "/root/testdata/sf0.001"


def test_files_flow_to_ready_documents(spark, tmp_path):
    source = write_files(tmp_path / "in", FILES)
    out, status, collection = (str(tmp_path / n) for n in ("out", "status", "collection"))

    def run():
        jobs.stream_extract(raw.stream_raw_files(spark, source), out, status, str(tmp_path / "c1"))
        extracted = spark.readStream.schema(EXTRACTED).parquet(f"{out}/extracted/*")
        jobs.stream_index(extracted, collection, status, str(tmp_path / "c2"), embedding.hashing_embedder(16), 16)
        return {r["doc_id"]: r["status"] for r in jobs.read_status(spark, status).collect()}

    assert run() == {"doc_a": "ready", "doc_b": "ocr_failed", "doc_c": "ready"}
    before = points.load_points(spark, collection).count()
    sent = spark.read.parquet(f"{out}/messages").select(messages.decode_event(F.col("data"), ).alias("m"))
    assert {r["m"]["doc_id"] for r in sent.collect()} == {"doc_a", "doc_c"}
    write_files(tmp_path / "in", {"raw/u3/doc_d/new.pdf": b"fresh text"})
    assert run()["doc_d"] == "ready"
    assert points.load_points(spark, collection).count() == before + 1


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given test tables")
def test_queries_stream_a_folder_of_files(spark, tmp_path):
    """A larger table is a folder of part files under the same name."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(30)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["stream_extract"](spark, str(tmp_path)).count() == 30
    assert QUERIES["stream_index"](spark, str(tmp_path)).count() == docs.filter("text <> ''").count()


def test_failing_provider_marks_documents(spark, tmp_path):
    spark.createDataFrame([("d", "u", "f", "p", "some text", 1, "success", None, [9])], EXTRACTED).write.parquet(str(tmp_path / "in"))

    def down():
        def fail(texts):
            raise RuntimeError("quota")
        return fail

    stream = spark.readStream.schema(EXTRACTED).parquet(str(tmp_path / "in"))
    jobs.stream_index(stream, str(tmp_path / "col"), str(tmp_path / "status"), str(tmp_path / "c"), down, 4, min_wait=0, max_wait=0)
    row = jobs.read_status(spark, str(tmp_path / "status")).first()
    assert (row["status"], row["error_message"]) == ("index_failed", "quota")


def test_status_and_dedupe_over_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    data = spark.range(300).selectExpr(
        "id as event_id", "concat('d', id % 7) as doc_id", "'u' as user_id", "concat('s', id % 4) as status",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(pmod(id * 37, 300) as int)) as updated_at",
        "cast(null as string) as error_message")
    data.repartition(4).write.parquet(source)
    data.repartition(2).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(STATUS_EVENTS).option("maxFilesPerTrigger", 2).parquet(source)

    jobs.stream_status(stream(), str(tmp_path / "status"), str(tmp_path / "c1"))
    got = {r["doc_id"]: r["event_id"] for r in newest.read_newest(spark, str(tmp_path / "status"), "doc_id", jobs.EVENT_ORDER).collect()}
    expected = data.groupBy("doc_id").agg(F.max_by("event_id", F.struct("updated_at", "event_id")).alias("e"))
    assert got == {r["doc_id"]: r["e"] for r in expected.collect()}

    timed = stream().withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    jobs.append_files(jobs.dedupe_events(timed, ["event_id"]), str(tmp_path / "once"), str(tmp_path / "c2"))
    once = spark.read.parquet(str(tmp_path / "once"))
    assert once.count() == 300 and once.select("event_id").distinct().count() == 300


def test_upload_requests(spark, tmp_path):
    docs = spark.createDataFrame([("doc_1", "u", "raw/u/doc_1/f.pdf")], "doc_id string, user_id string, storage_path string")
    asked = spark.createDataFrame([("/complete/doc_1/",), ("/complete/doc_2",), ("/complete/x",)], "path string")
    got = {r["doc_id"]: (r["reject_reason"], r["data"] is None) for r in jobs.upload_messages(asked, docs).collect()}
    assert got == {"doc_1": (None, False), "doc_2": ("Document doc_2 not found", True), "x": ("Invalid document ID", True)}


def size_of(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    table, order = tmp_path / "status", ["at", "n"]
    rows = lambda lo, hi, at: spark.range(lo, hi).selectExpr("concat('d', id) as doc_id", f"{at} as at", "id as n", "uuid() as payload")
    written = []
    for batch, (lo, hi) in enumerate([(0, 100), (0, 20_000), (100, 200), (0, 100)]):
        before = size_of(tmp_path)
        newest.append_batch(rows(lo, hi, batch), str(table), "w", batch, "doc_id", order)
        written.append(size_of(tmp_path) - before)
        assert len(list((table / "log" / "writer=w" / f"batch={batch}").glob("*.parquet"))) == 1
    assert max(written[0], written[2], written[3]) < 1.2 * min(written[0], written[2], written[3]) < written[1] / 20
    state = lambda: {r["doc_id"]: r["at"] for r in newest.read_newest(spark, str(table), "doc_id", order).collect()}
    want = {f"d{i}": 3 if i < 100 else 2 if i < 200 else 1 for i in range(20_000)}
    assert state() == want
    newest.append_batch(rows(0, 100, 0), str(table), "w", 0, "doc_id", order)
    assert state() == want
    assert newest.compact(spark, str(table), "doc_id", order) == newest.compact(spark, str(table), "doc_id", order) == 1
    assert state() == want
    # a replay of a folded batch is not read, a new batch of any writer is
    newest.append_batch(rows(0, 100, 9), str(table), "w", 0, "doc_id", order)
    assert state() == want
    newest.append_batch(rows(5, 6, 4), str(table), "v", 0, "doc_id", order)
    newest.vacuum(spark, str(table))
    assert [d.name for d in (table / "log").glob("*/*")] == ["batch=0"] and state() == want | {"d5": 4}
    assert newest.compact(spark, str(table), "doc_id", order) == 2 and state() == want | {"d5": 4}


def test_replayed_batch_changes_no_status(spark, tmp_path):
    status = str(tmp_path / "status")
    put = lambda step, batch, name: jobs._set_status(
        spark.createDataFrame([("d", "u")], "doc_id string, user_id string"), status, step, batch, "w",
        F.lit(name), F.lit(None).cast("string"),
    )
    now = lambda: jobs.read_status(spark, status).first()["status"]
    put(jobs.EXTRACTED, 0, "ocr_failed")
    put(jobs.EXTRACTED, 1, "ocr_completed")
    put(jobs.INDEXED, 0, "ready")
    assert now() == "ready"
    put(jobs.EXTRACTING, 0, "ocr_processing")
    put(jobs.EXTRACTED, 0, "ocr_failed")
    assert now() == "ready"


def test_lifecycle_stream(spark, tmp_path):
    rows = [
        (1, "a", "uploaded", "01 00:00"), (2, "a", "ocr_processing", "01 01:00"), (2, "a", "ocr_processing", "01 01:00"),
        (3, "a", "ready", "01 02:00"), (4, None, "uploaded", "01 00:30"), (5, None, "indexed", "01 03:00"),
        (6, "b", "uploaded", "01 00:00"), (7, "c", "uploaded", "01 00:10"),
    ]
    later = [
        (8, "a", "uploaded", "01 01:30"), (9, "c", "ocr_processing", "03 00:00"), (10, "d", "uploaded", "03 00:00"), (11, "a", "ready", "03 12:00"),
    ]
    schema = "event_id long, doc_id string, status string, time string"
    base = str(tmp_path)

    def feed(data):
        df = spark.createDataFrame(data, schema).selectExpr("event_id", "doc_id", "status", "to_timestamp(concat('2024-01-', time)) as updated_at")
        df.coalesce(1).write.mode("append").parquet(f"{base}/in")
        events = spark.readStream.schema(df.schema).parquet(f"{base}/in")
        jobs.append_files(lifecycle.watch_documents(events, "1 day", "3 days"), f"{base}/out", f"{base}/check")
        found = spark.read.parquet(f"{base}/out").collect()
        return sorted(((r.kind, r.doc_id, r.event_id, r.from_status, r.to_status) for r in found), key=str)

    first = [("impossible", "a", 3, "ocr_processing", "ready"), ("impossible", None, 5, "uploaded", "indexed")]
    assert feed(rows) == sorted(first, key=str)
    # the late event changes nothing, the gap of c is found by its next event
    second = first + [("late", "a", 8, "ready", "uploaded"), ("stuck", "c", 7, "uploaded", None)]
    assert feed(later) == sorted(second, key=str)
    # once the watermark has passed, timers find who stands still
    third = second + [("stuck", "b", 6, "uploaded", None), ("stuck", None, 5, "indexed", None), ("stuck", "c", 9, "ocr_processing", None), ("stuck", "d", 10, "uploaded", None)]
    assert feed([(12, "z", "ready", "09 00:00")]) == sorted(third, key=str)


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    data = spark.range(400).selectExpr(
        "id as event_id", "nullif(concat('d', id % 9), 'd4') as doc_id", "'u' as user_id",
        "element_at(array('uploaded','ocr_processing','ocr_completed','ready'), cast(1 + (id div 9 * 3 + id div 31) % 4 as int)) as status",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as updated_at", "cast(null as string) as error_message",
    )
    for i in range(4):  # files in the order of time
        data.filter(f"event_id div 100 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(STATUS_EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.append_files(lifecycle.watch_documents(events, "30 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.filter("kind <> 'impossible'").count() == 0
    got = sorted(map(str, found.select("doc_id", "event_id", "from_status", "to_status").collect()))
    assert got == sorted(map(str, documents.lifecycle_check(data).collect())) and "None" in str(got)
