"""Order over a whole table without gathering a key: range partitions, and sums carried from one to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.llm.common import written

LEAST_ROWS = 10_000  # a range holds about so many rows at least


def dealt_by_range(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows (cheap to read again) in ranges of ``order``, stored, with the number of their range as ``_p``.

    A frequent value is cut into several ranges if a later column of ``order`` differs within it. There are four
    times as many ranges as shuffle partitions, so that ranges dealt by hash later on still spread evenly.
    """
    most = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(most, df.count() // LEAST_ROWS))
    return written(df.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()), "ranges")


def with_running(
    ranged: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column], about: DataFrame | None = None
) -> DataFrame:
    """``ranged`` with a column per name in ``sums``: the total of its value over earlier rows of the same ``by``.

    ``by`` must be free of nulls and a prefix of what the table was dealt by (or empty: the whole table); ``order`` is
    the rest. Windows stay within one range of one key; what earlier ranges hold comes from a table with one
    row per range and key, to which the columns of ``about`` (one row per key) are joined on the way.
    """
    keys = ["_p", *by]
    parts = ranged.groupBy(*keys).agg(*[F.sum(v).alias(f"_in_{n}") for n, v in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, *[F.coalesce(F.sum(f"_in_{n}").over(earlier), F.lit(0)).alias(f"_to_{n}") for n in sums])
    if about is not None:
        parts = parts.join(about, list(by), "left")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_at_{n}") for n, v in sums.items()])
    totals = {n: F.col(f"_to_{n}") + F.col(f"_at_{n}") for n in sums}
    return counted.join(parts, keys).withColumns(totals).drop("_p", *[f"_{x}_{n}" for n in sums for x in ("to", "at")])
