"""Column helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.session import work_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What stands between words of the two kinds in use.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def words(text: Column, between: str = BLANKS) -> Column:
    """array<string>: the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between, -1), "")


def lower_words(text: Column, between: str = BLANKS) -> Column:
    """``words`` with A-Z in lower case and nothing else changed (``lower`` would change É as well).

    ``translate`` costs far more than ``lower``, so only words beyond ASCII go through it.
    """

    def lowered(word: Column) -> Column:
        return F.when(is_ascii(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))

    text = F.coalesce(text, F.lit(""))
    return F.when(is_ascii(text), words(F.lower(text), between)).otherwise(
        F.transform(words(text, between), lowered)
    )


def no_longs() -> Column:
    """An empty array<long> whose items Spark knows to be set, which keeps sorting primitive."""
    return F.slice(F.array(F.lit(0).cast("long")), 1, 0)


def shingle_hashes(tokens: Column, size: int) -> Column:
    """array<long>: a 64-bit hash of every ``size`` consecutive tokens, in text order."""
    last = F.size(tokens) - size
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(size)])
        ),
    ).otherwise(no_longs())


def prefix_sums(lengths: Column) -> Column:
    """Running totals of an array<int>, in a number of passes that is the logarithm of its size."""
    passes = F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)))).cast("int")
    steps = F.when(passes > 0, F.sequence(F.lit(0), passes - 1)).otherwise(F.array().cast("array<int>"))

    def add(sums: Column, step: Column) -> Column:
        return let(
            F.call_function("shiftleft", F.lit(1), step),
            lambda gap: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - gap), F.lit(0))),
        )

    return F.aggregate(steps, lengths, add)


def matches(text: Column, pattern: str) -> Column:
    """array<struct(start, end, found)>: leftmost non-overlapping matches, in code points.

    The pattern must not match the empty string. Positions come from the lengths of the
    matches and of what ``split`` leaves between them. Texts without a match cost one search.
    """
    kind = "array<struct<start:int,end:int,found:string>>"

    def place(found: Column) -> Column:
        return let(
            F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap)),
            lambda g: let(
                prefix_sums(F.transform(found, lambda m, i: F.length(m) + F.get(g, i))),
                lambda ends: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("found")
                    ),
                ),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    return let(
        found,
        lambda f: F.when(F.size(f) > 0, place(f)).otherwise(F.array().cast(kind)),
    ).cast(kind)


def label_spans(spans: Column) -> Column:
    """``kind:start:end`` of an array<struct(start, order, kind, end)>, comma-joined in order."""
    return F.array_join(
        F.transform(
            F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def as_spans(found: Column, kind: str, order: int) -> Column:
    """Matches as array<struct(start, order, kind, end)>, which sorts by start, then by kind as listed."""
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), m["end"].alias("end")
        ),
    )


SPAN_ARRAY = "array<struct<start:int,order:int,kind:string,end:int>>"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the folder all executors share, read back: lineage ends there."""
    spark: SparkSession = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Bound the Arrow batches that hold whole texts by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


BROADCAST_ROWS = 1_000_000


def without_rows(docs: DataFrame, bad: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows that (doc_id, _row) of ``bad`` name; ``_row`` is the xxhash64 of the text.

    Up to ``broadcast_rows`` names (17 bytes each) are broadcast, so that texts stay where they are;
    more are joined by shuffle.
    """
    named = written(bad.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_text")).distinct(), "dropped")
    side = F.broadcast(named) if named.count() <= broadcast_rows else named
    same = (F.xxhash64(F.col("text")) == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return docs.join(side, same, "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
