"""The batch flow: extract -> analyze -> embed, each stage written once and read back.

    spark-submit run_stages.py --input raw/ --output processed/ [--resume | --embed-only ...]
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from folioflow import schemas
from folioflow.operators import embedding, extract, points, quality
from folioflow.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_documents
from folioflow.operators.documents import run_log
from folioflow.operators.snapshots import BUCKETS
from folioflow.sources.files import delete_folder
from folioflow.sources.raw import read_files
from folioflow.sources.stages import read_stage, spread, write_stage, write_summary

STAGES = ("extract", "analyze", "embed")


@dataclass
class StageConfig:
    """Paths and settings of one run. Paths may be of any Hadoop file system."""

    input: str
    output: str
    glob: str = "*.pdf"
    fmt: str = "parquet"
    mode: str = "clause"
    size: int = CHUNK_SIZE
    overlap: int = CHUNK_OVERLAP
    dim: int = 256
    metric: str = "cosine"
    buckets: int = BUCKETS
    partitions: int | None = None
    gate: bool = False
    extractor: extract.Extractor = extract.plain_text_pages
    provider: Callable | None = None
    embed_options: dict = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.output.rstrip('/')}/{name}"


def run_stages(
    spark: SparkSession, cfg: StageConfig, stages: tuple[str, ...] = STAGES, files: DataFrame | None = None
) -> dict[str, dict]:
    """Run the chosen stages in order and return their counts.

    ``files`` replaces the scan of ``cfg.input`` by a table of the same columns.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    runs = {"extract": _extract, "analyze": _analyze, "embed": _embed}
    return {
        name: runs[name](spark, cfg, files) if name == "extract" else runs[name](spark, cfg)
        for name in STAGES
        if name in stages
    }


def _extract(spark: SparkSession, cfg: StageConfig, files: DataFrame | None) -> dict:
    if files is None:
        files = read_files(spark, cfg.input, cfg.glob)
    outcome_path = cfg.path("extract_outcome")
    seen = Observation("extract")
    outcome = extract.run_extractor(files, cfg.extractor).observe(
        seen,
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") != "success").alias("failed"),
    )
    # Files are read and extracted once; table and run records come from this copy.
    outcome.write.mode("overwrite").parquet(outcome_path)
    done = spark.read.parquet(outcome_path)
    write_stage(extract.with_path_parts(done), cfg.path("extracted"), cfg.fmt)
    write_stage(run_log(done, "extract", "path"), cfg.path("run_log/extract"))
    delete_folder(spark, outcome_path)
    return dict(seen.get)


def _analyze(spark: SparkSession, cfg: StageConfig) -> dict:
    extracted = spread(read_stage(spark, cfg.path("extracted"), schemas.EXTRACTED, cfg.fmt))
    write_stage(quality.doc_quality(extracted), cfg.path("analysis/doc_report"), cfg.fmt)
    report = read_stage(spark, cfg.path("analysis/doc_report"), schemas.DOC_REPORT, cfg.fmt)
    summary = quality.cost_estimate(quality.corpus_summary(report))
    write_summary(summary, cfg.path("analysis/summary"))
    row = spark.read.schema(summary.schema).json(cfg.path("analysis/summary")).first()
    if row["total_docs"] == 0:
        return {"total_docs": 0, "message": "no documents found, check the extract output"}
    return row.asDict()


def _embed(spark: SparkSession, cfg: StageConfig) -> dict:
    extracted = spread(read_stage(spark, cfg.path("extracted"), schemas.EXTRACTED, cfg.fmt))
    if cfg.gate:
        extracted = quality.quality_gate(extracted, enabled=True)
    chunks = chunk_documents(extract.filter_indexable(extracted), cfg.mode, cfg.size, cfg.overlap, pages=True)
    if cfg.partitions:
        # Only chunk text moves here; worthwhile when the provider is the slow part.
        chunks = chunks.repartition(cfg.partitions)
    provider = cfg.provider or embedding.hashing_embedder(cfg.dim)
    embedded_path = cfg.path("embedded")
    seen = Observation("embed")
    embedding.run_embedder(chunks, provider, **cfg.embed_options).observe(
        seen, F.count("*").alias("chunks"), F.count("vector").alias("indexed")
    ).write.mode("overwrite").parquet(embedded_path)
    done = spark.read.parquet(embedded_path)
    collection = cfg.path("collection")
    points.create_collection(spark, collection, cfg.dim, cfg.metric, cfg.buckets)
    points.save_points(spark, collection, points.build_points(done))
    checkpoint = embedding.embed_checkpoint(done.filter("vector is not null"))
    write_stage(checkpoint, cfg.path("checkpoint"), cfg.fmt)
    write_stage(run_log(done, "embed", "chunk_id"), cfg.path("run_log/embed"))
    delete_folder(spark, embedded_path)
    return dict(seen.get)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--glob", default="*.pdf")
    parser.add_argument("--format", default="parquet", choices=["parquet", "json"])
    parser.add_argument("--mode", default="clause", choices=["clause", "fixed", "recursive"])
    parser.add_argument("--size", type=int, default=CHUNK_SIZE, help="characters of a chunk")
    parser.add_argument("--overlap", type=int, default=CHUNK_OVERLAP)
    parser.add_argument("--dim", type=int, default=256)
    parser.add_argument("--metric", default="cosine", choices=points.METRICS)
    parser.add_argument("--buckets", type=int, default=BUCKETS, help="of the collection, at its first write")
    parser.add_argument("--partitions", type=int)
    parser.add_argument("--gate", action="store_true", help="keep flagged documents out of the index")
    only = parser.add_mutually_exclusive_group()
    only.add_argument("--resume", action="store_true", help="do only what changed since the last run with --resume")
    only.add_argument("--ocr-only", action="store_const", const=("extract",), dest="stages")
    only.add_argument("--analyze-only", action="store_const", const=("analyze",), dest="stages")
    only.add_argument("--embed-only", action="store_const", const=("embed",), dest="stages")
    only.add_argument("--skip-analyze", action="store_const", const=("extract", "embed"), dest="stages")
    args = parser.parse_args(argv)

    from folioflow.session import build_session

    cfg = StageConfig(
        args.input, args.output, glob=args.glob, fmt=args.format, mode=args.mode, size=args.size, overlap=args.overlap,
        dim=args.dim, metric=args.metric, buckets=args.buckets, partitions=args.partitions, gate=args.gate,
    )
    if args.resume:
        from folioflow.plans.incremental import refresh

        print("refresh", refresh(build_session(), cfg))
        return
    for stage, counts in run_stages(build_session(), cfg, args.stages or STAGES).items():
        print(stage, counts)


if __name__ == "__main__":
    main()
