"""Stage tables on shared storage: Parquet by default, JSON lines on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from folioflow.schemas import EXTRACTED


def read_stage(
    spark: SparkSession, path: str, schema: T.StructType = EXTRACTED, fmt: str = "parquet"
) -> DataFrame:
    """Read a stage with its fixed schema; broken JSON lines land in ``_corrupt_record``."""
    reader = spark.read.schema(schema)
    if fmt == "json":
        schema = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
        reader = (
            spark.read.schema(schema)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
        )
    return reader.format(fmt).load(path)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Overwrite the output of a stage and return its path."""
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def write_summary(summary: DataFrame, path: str) -> str:
    """The one-row corpus summary as a single JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan of very few splits over all cores before CPU-heavy work.

    A large input has more splits than the cluster has cores and is returned as it is, without
    a shuffle. For plain scans only (counting splits plans the scan but runs no job).
    """
    if scan.isStreaming:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
