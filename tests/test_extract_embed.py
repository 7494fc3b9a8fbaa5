import os
import subprocess
import sys

import numpy as np
import pyarrow as pa

from folioflow.operators import embedding, extract, points
from folioflow.plans.incremental import refresh
from folioflow.plans.stages import StageConfig, main, run_stages
from folioflow.sources import raw, stages
from folioflow.streaming import jobs


def write_files(root, files):
    for name, content in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    return str(root)


FILES = {
    "raw/u1/doc_a/one.pdf": "page one\fpage two\f".encode() + b"x" * 150,
    "raw/u1/doc_b/two.pdf": b"\xff\xfe broken",
    "raw/u2/doc_c/three.pdf": b"\n1. clause " * 100,
    "raw/u2/doc_c/notes.txt": b"ignored",
}


def test_scan_manifest_extract(spark, tmp_path):
    files = raw.scan_raw_files(spark, write_files(tmp_path, FILES))
    assert files.count() == 3
    manifest = raw.file_manifest(files, "legal/")
    assert "content" not in manifest._jdf.queryExecution().executedPlan().toString()
    assert {r["object_key"] for r in manifest.collect()} == {"legal/one.pdf", "legal/two.pdf", "legal/three.pdf"}
    got = {r["doc_id"]: r for r in extract.extract_documents(files).collect()}
    assert got["doc_a"]["text"].startswith("page one\n\npage two\n\nxxx") and got["doc_a"]["page_count"] == 3
    assert got["doc_b"]["status"] == "failed" and got["doc_b"]["text"] == "" and got["doc_b"]["page_count"] == 0
    assert "codec" in got["doc_b"]["error"] and got["doc_c"]["user_id"] == "u2"


def test_join_pages(spark):
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, ""), ("e", 1, "")],
                                  "doc_id string, page_no int, text string")
    assert sorted(map(tuple, extract.join_pages(pages).collect())) == [("d", "a\n\nb\n\n", 3, [1, 4, 6]), ("e", "", 1, [0])]
    assert sorted(map(tuple, extract.join_pages(pages, True).collect())) == [("d", "a\n\nb", 3, [1, 4, 4]), ("e", "", 1, [0])]


def test_json_stage_keeps_broken_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"doc_id": "a", "page_count": 1}\n{broken\n')
    got = stages.read_stage(spark, str(tmp_path), fmt="json").collect()
    assert sorted((r["doc_id"] is None, r["_corrupt_record"]) for r in got) == [(False, None), (True, "{broken")]


def test_embedding_keeps_order_and_batches(spark):
    rows = spark.range(1000).selectExpr("id", "concat('word', id) as text").repartition(3)

    def provider():
        def embed(texts):
            assert len(texts) <= 100
            return np.array([[float(t[4:]), 1.0] for t in texts])
        return embed

    got = embedding.embed_chunks(rows, provider).collect()
    assert len(got) == 1000 and all(r["vector"] == [float(r["id"]), 1.0] for r in got)


def test_retry_then_failed_rows(spark):
    def flaky():
        calls = {"n": 0}

        def embed(texts):
            calls["n"] += 1
            if calls["n"] < 3:
                raise RuntimeError("busy")
            return np.ones((len(texts), 2))
        return embed

    def dead():
        def embed(texts):
            raise RuntimeError("down")
        return embed

    rows = spark.range(5).selectExpr("cast(id as string) as text").coalesce(1)
    ok = embedding.embed_chunks(rows, flaky, min_wait=0, max_wait=0).collect()
    assert {r["status"] for r in ok} == {"success"}
    bad = embedding.embed_chunks(rows, dead, min_wait=0, max_wait=0).collect()
    assert [(r["status"], r["vector"], r["error"]) for r in bad] == [("failed", None, "down")] * 5


def test_waits_grow_and_are_bounded(monkeypatch):
    waits = []
    monkeypatch.setattr(embedding.time, "sleep", waits.append)

    def fail(texts):
        raise ValueError

    try:
        embedding.call_with_retry(fail, [], 7, 2.0, 30.0)
    except ValueError:
        pass
    assert waits == [2.0, 2.0, 4.0, 8.0, 16.0, 30.0]


def test_run_stages(spark, tmp_path):
    source = write_files(tmp_path / "in", FILES)
    cfg = StageConfig(source, str(tmp_path / "out"), dim=32, buckets=4)
    counts = run_stages(spark, cfg)
    assert counts["extract"] == {"total": 3, "success": 2, "failed": 1}
    assert counts["analyze"]["total_docs"] == 3
    first = {r["point_id"] for r in points.load_points(spark, cfg.path("collection")).collect()}
    assert counts["embed"]["chunks"] == counts["embed"]["indexed"] == len(first)
    run_stages(spark, cfg, stages=("embed",))
    again = points.load_points(spark, cfg.path("collection"))
    assert {r["point_id"] for r in again.collect()} == first and again.count() == len(first)
    assert spark.read.parquet(cfg.path("run_log/*")).count() == 3 + len(first)
    main(["--input", source, "--output", str(tmp_path / "cli"), "--ocr-only"])
    assert spark.read.parquet(str(tmp_path / "cli/extracted")).count() == 3


def test_second_run_does_only_what_changed(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def note(kind):
        import os
        import uuid

        open(os.path.join(folder, f"{kind}-{uuid.uuid4().hex}"), "w").close()

    def extractor(content):
        note("extract")
        return extract.plain_text_pages(content)

    def provider():
        inner = embedding.hashing_embedder(16)()

        def embed(texts):
            for _ in texts:
                note("embed")
            return inner(texts)

        return embed

    def run(**settings):
        cfg = StageConfig(source, str(tmp_path / "out"), dim=16, buckets=4, extractor=extractor, provider=provider, **settings)
        counts = refresh(spark, cfg)
        done = [f.name.split("-")[0] for f in calls.iterdir()]
        for f in calls.iterdir():
            f.unlink()
        stored = {(r.doc_id, r.text) for r in points.load_points(spark, cfg.path("collection")).collect()}
        return counts, done.count("extract"), done.count("embed"), stored, spark.read.json(cfg.path("analysis/summary")).first()

    source = write_files(tmp_path / "in", FILES)
    counts, extracted, embedded, stored, summary = run()
    assert (counts["changed"], extracted) == (3, 3) and embedded == len(stored) == counts["embedded"] and summary.total_docs == 3
    assert run()[:4] == ({"files": 3, "changed": 0, "removed": 0, "extracted": 0, "chunks": 0, "embedded": 0}, 0, 0, stored)
    write_files(tmp_path / "in", {"raw/u9/doc_n/n.pdf": b"a new one", "raw/u2/doc_c/three.pdf": FILES["raw/u2/doc_c/three.pdf"] + b"\n2. one more clause"})
    (tmp_path / "in/raw/u1/doc_a/one.pdf").unlink()
    counts, extracted, embedded, later, summary = run()
    assert (counts["changed"], counts["removed"], extracted) == (2, 1, 2) and summary.total_docs == 3
    assert {d for d, _ in later} == {"doc_c", "doc_n"} and embedded <= 2
    assert not (tmp_path / "out/work").exists()
    # other settings embed all again
    counts, extracted, embedded, _, _ = run(size=100)
    assert (counts["changed"], extracted) == (0, 0) and embedded == counts["embedded"] > 2


def test_command_starts_in_a_fresh_process(tmp_path):
    source = write_files(tmp_path / "in", FILES)
    script = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "run_stages.py")
    command = [sys.executable, script, "--input", source, "--output", str(tmp_path / "out"), "--mode", "fixed", "--dim", "8", "--metric", "dot", "--buckets", "2"]
    done = subprocess.run(command, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "'indexed': " in done.stdout, done.stderr[-2000:]
    manifest = sorted((tmp_path / "out/collection/versions").glob("0*.json"))[-1].read_text()
    assert '"metric": "dot"' in manifest and '"dim": 8' in manifest and '"buckets": 2' in manifest


def test_files_are_listed_and_read_in_tasks(spark, tmp_path):
    """The same files as Spark's reader, dealt by the cores and not by the number of files."""
    for i in range(900):
        write_files(tmp_path, {f"raw/u{i % 3}/d{i}/{'_' * (i == 7)}f{i}.{'txt' if i == 5 else 'pdf'}": b"x" * (i + 1)})
    write_files(tmp_path, {"top.pdf": b"t", "_hidden/a.pdf": b"a"})
    expected = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(str(tmp_path))
    found = raw.read_files(spark, str(tmp_path))
    assert found.schema == expected.schema
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    listed = raw.list_files(spark, str(tmp_path))
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, expected.drop("content").collect()))
    assert raw.list_files(spark, str(tmp_path / "ra*"), "*.{txt,doc}").count() == 1
    write_files(tmp_path, {"empty.pdf": b""})  # Spark's reader leaves it out
    assert [r["content"] for r in raw.read_files(spark, str(tmp_path)).filter("length = 0").collect()] == [b""]


def test_extractor_holds_the_texts_of_few_files(spark):
    files = pa.RecordBatch.from_pydict({"path": [f"gs://b/u/d/{i}.pdf" for i in range(1000)], "content": [b"a\fb"] * 1000})
    made = list(extract._extract_batches(extract.plain_text_pages)(iter([files])))
    assert max(b.num_rows for b in made) <= extract.FILES_AT_ONCE and sum(b.num_rows for b in made) == 1000
    assert made[0].column(1)[0].as_py() == "a\n\nb"


def test_polling_picks_up_each_file_once(spark, tmp_path):
    source, table = write_files(tmp_path / "in", FILES), str(tmp_path / "seen")
    for _ in range(2):
        jobs.poll_files(spark, source, table)
    seen = spark.read.parquet(table)
    known = {r["path"] for r in raw.list_files(spark, source).collect()}
    assert sorted(r["path"] for r in seen.collect()) == sorted(known) and known
    write_files(tmp_path / "in", {"raw/u9/doc_n/n.pdf": b"a new one"})
    jobs.poll_files(spark, source, table)
    assert spark.read.parquet(table).count() == len(known) + 1
