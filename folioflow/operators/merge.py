"""Keyed put / patch / delete on tables, and the bucketed Parquet table behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

BUCKETS = 64


def latest_by_key(rows: DataFrame, key: str, order: str | list[str]) -> DataFrame:
    """The newest row of every key.

    ``max_by`` combines inside each task before the shuffle, so a key that holds a
    third of all rows sends one row per task.
    """
    order = [order] if isinstance(order, str) else order
    whole = F.struct(*rows.columns)
    newest = rows.groupBy(F.col(key).alias("_key")).agg(
        F.max_by(whole, F.struct(*order)).alias("_row")
    )
    return newest.select("_row.*")


def put_rows(
    current: DataFrame, incoming: DataFrame, key: str, order: str | list[str] | None = None
) -> DataFrame:
    """Insert or replace by key. Of several incoming rows of a key the one last in ``order`` is put,
    any one without an order."""
    incoming = latest_by_key(incoming, key, order) if order else incoming.dropDuplicates([key])
    kept = current.join(incoming.select(key), key, "left_anti")
    return kept.select(*current.columns).unionByName(incoming.select(*current.columns))


def delete_rows(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key), key, "left_anti").select(*current.columns)


def with_bucket(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _folder(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def table_exists(spark: SparkSession, path: str) -> bool:
    system, folder = _folder(spark, path)
    return system.exists(folder)


def _has_buckets(spark: SparkSession, path: str) -> bool:
    """False before the first write and after the last row was deleted."""
    system, pattern = _folder(spark, f"{path}/bucket=*")
    return bool(system.globStatus(pattern))


def _bucket_count(spark: SparkSession, path: str, buckets: int) -> int:
    """The table's own bucket count, noted at its first write: a key always has the same bucket."""
    note = f"{path}/_buckets"
    if table_exists(spark, note):
        return spark.read.schema("buckets int").parquet(note).first()["buckets"]
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(note)
    return buckets


def _rewrite_buckets(rows: DataFrame, path: str) -> None:
    """Replace the buckets present in ``rows`` and leave the others alone.

    Tasks write beside the table and old files go only when all of them are done, so the
    table may be read by the same job and a lost executor costs its tasks, not data.
    Rebalancing gathers small buckets in one task and splits large ones over many.
    """
    rows.hint("rebalance", "bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("bucket").parquet(path)


def _touched(rows: DataFrame) -> list[int]:
    """Bucket numbers present in ``rows``: at most ``BUCKETS`` integers."""
    return [r["bucket"] for r in rows.select("bucket").distinct().collect()]


def upsert_table(
    spark: SparkSession, path: str, incoming: DataFrame, key: str,
    order: str | list[str] | None = None, buckets: int = BUCKETS,
) -> None:
    """Insert or replace ``incoming`` in the bucketed table at ``path``.

    Buckets are a hash of the key, hence even; only buckets that receive rows are read
    (partition pruning) and rewritten. ``order`` picks the winner among incoming
    rows of one key and keeps a stored row that is newer. ``buckets`` counts at the first write only.
    """
    new = with_bucket(incoming, key, _bucket_count(spark, path, buckets))
    if not _has_buckets(spark, path):
        _rewrite_buckets(latest_by_key(new, key, order) if order else new.dropDuplicates([key]), path)
        return
    touched = _touched(new)
    old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
    if order:
        merged = latest_by_key(old.unionByName(new), key, order)
    else:
        merged = put_rows(old, new, key)
    _rewrite_buckets(merged, path)


def delete_from_table(
    spark: SparkSession, path: str, keys: DataFrame, key: str, buckets: int = BUCKETS
) -> None:
    if not _has_buckets(spark, path):
        return
    gone = with_bucket(keys.select(key), key, _bucket_count(spark, path, buckets))
    touched = _touched(gone)
    old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
    seen = Observation()
    kept = delete_rows(old, gone, key).observe(seen, F.collect_set("bucket").alias("buckets"))
    _rewrite_buckets(kept, path)
    # A bucket that lost its last row has no counterpart in what was written.
    for bucket in set(touched) - set(seen.get["buckets"]):
        system, folder = _folder(spark, f"{path}/bucket={bucket}")
        system.delete(folder, True)
