"""The batch flow for inputs that change: every run does only what changed since the last one that was finished.

``state/`` holds what a rerun needs: the files with their fingerprints, the extracted rows and the reports, as tables with
snapshots. The files are noted last, so a run that was lost is simply done again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.operators import embedding, extract, points, quality
from folioflow.operators.chunking import chunk_documents
from folioflow.operators.snapshots import SnapshotTable
from folioflow.plans.stages import StageConfig
from folioflow.sources.files import delete_folder, names_in, read_text, write_new
from folioflow.sources.raw import read_files
from folioflow.sources.stages import write_summary


def refresh(spark: SparkSession, cfg: StageConfig, files: DataFrame | None = None) -> dict:
    """Extract new and changed files, forget removed ones, and bring report, summary and collection up to date.

    A file has changed if its length or time has (or its content, if ``files`` has no such columns); contents of files
    older than the oldest changed one are not read. Of the documents concerned only chunks with a new text are embedded;
    other chunk settings or another gate concern all documents. If an embedding fails the run raises and nothing is
    noted. Returns the counts of files, changed, removed and extracted ones, chunks and embedded chunks.
    """
    if files is None:
        files = read_files(spark, cfg.input, cfg.glob)
    known = SnapshotTable.create(spark, cfg.path("state/files"), "path", buckets=cfg.buckets)
    extracted = SnapshotTable.create(spark, cfg.path("state/extracted"), "doc_id", "source_path", cfg.buckets)
    reports = SnapshotTable.create(spark, cfg.path("state/report"), "doc_id", "filename", cfg.buckets)
    points.create_collection(spark, cfg.path("collection"), cfg.dim, cfg.metric, cfg.buckets)
    work = cfg.path(f"work/{uuid.uuid4().hex}")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    try:
        dated = "modificationTime" in files.columns
        mark = F.concat_ws("/", "length", F.unix_micros("modificationTime")) if dated else F.sha2("content", 256)
        listed = stored(files.select("path", mark.alias("mark"), *(["modificationTime"] if dated else [])), "listed")
        before = known.read() if known.snapshot().live else spark.createDataFrame([], "path string, mark string")
        changed = stored(listed.join(before, ["path", "mark"], "left_anti"), "changed")
        gone = stored(before.join(listed, "path", "left_anti").select("path"), "gone")
        counts = {"files": listed.count(), "changed": changed.count(), "removed": gone.count()}
        if dated and counts["changed"]:
            files = files.filter(F.col("modificationTime") >= F.lit(changed.agg(F.min("modificationTime")).first()[0]))

        outcome = extract.run_extractor(files.join(changed.select("path"), "path", "left_semi"), cfg.extractor)
        fresh = stored(extract.with_path_parts(outcome), "fresh") if counts["changed"] else None
        concerned = extract.with_path_parts(_as_outcome(gone)).select("doc_id", "source_path")
        if counts["removed"]:
            extracted.delete(concerned)
        if fresh is not None:
            extracted.upsert(fresh)
            concerned = concerned.unionByName(fresh.select("doc_id", "source_path"))
        docs = stored(concerned.select("doc_id").distinct(), "documents")
        counts["extracted"] = fresh.count() if fresh is not None else 0
        if counts["changed"] or counts["removed"]:
            reports.replace(quality.doc_quality(extracted.read(keys=docs)), docs)
        counts |= _embed(spark, cfg, extracted, docs, bool(counts["changed"] or counts["removed"]))

        if counts["removed"]:
            known.delete(gone)
        if counts["changed"]:
            known.upsert(changed.select("path", "mark"))
        if reports.snapshot().live:
            write_summary(quality.cost_estimate(quality.corpus_summary(reports.read())), cfg.path("analysis/summary"))
        return counts
    finally:
        delete_folder(spark, work)
        if not names_in(spark, cfg.path("work")):
            delete_folder(spark, cfg.path("work"))


def _as_outcome(paths: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return paths.select("path", *[nothing.alias(c) for c in ("text", "page_count", "status", "error", "page_ends")])


def _embed(spark: SparkSession, cfg: StageConfig, extracted: SnapshotTable, docs: DataFrame, any_change: bool) -> dict:
    """Index the documents anew, all of them if they were indexed with other settings."""
    settings = json.dumps({"mode": cfg.mode, "size": cfg.size, "overlap": cfg.overlap, "gate": cfg.gate})
    numbers = names_in(spark, cfg.path("state/settings"))
    same = bool(numbers) and read_text(spark, cfg.path(f"state/settings/{numbers[-1]}")) == settings
    if not extracted.snapshot().live or (same and not any_change):
        return {"chunks": 0, "embedded": 0}
    rows = extracted.read(keys=docs) if same else extracted.read()
    if not same:
        docs = rows.select("doc_id").unionByName(docs)
    if cfg.gate:
        rows = quality.quality_gate(rows, enabled=True)
    chunks = chunk_documents(extract.filter_indexable(rows), cfg.mode, cfg.size, cfg.overlap, pages=True)
    provider = cfg.provider or embedding.hashing_embedder(cfg.dim)
    counts = points.reindex_stored(spark, cfg.path("collection"), chunks, provider, docs, **cfg.embed_options)
    if counts["failed"]:
        raise RuntimeError(f"{counts['failed']} chunks were not embedded; the run can be repeated")
    if not same:
        write_new(spark, cfg.path(f"state/settings/{len(numbers):010d}.json"), settings)
    return {"chunks": counts["chunks"], "embedded": counts["embedded"]}
