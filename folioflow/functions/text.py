"""Text metrics and labels as JVM-side column expressions.

The reference results come from Python string methods. Java regular expressions
define white space, letters and digits more narrowly, so the classes are spelled
out here and every metric agrees with Python for any Unicode text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What str.isspace() accepts, as the inside of a regex class ...
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
# ... and as plain characters for trimming.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u1680\u2028\u2029\u202f\u205f\u3000"
)
WORD = f"[^{SPACE}]+"
CLEAN_RUN = rf"[a-zA-Z0-9 \p{{L}}\p{{N}}{SPACE}]+"

# Quality thresholds and the cost model.
MIN_TEXT_CHARS = 100
MAX_NOISE_MILLI = 400
CHUNK_SIZE = 500
CHUNK_ESTIMATE_FACTOR = 1.1
CHARS_PER_TOKEN = 4.0
USD_PER_MILLION_TOKENS = 0.02

# Display label of each document state. The three failure states
# share one label; an unknown state shows as a fresh upload.
STATUS_LABELS = {
    "uploaded": "Uploaded",
    "ocr_processing": "Processing",
    "ocr_completed": "OCR Done",
    "indexing": "Indexing",
    "indexed": "Ready",
    "ready": "Ready",
    "failed": "Failed",
    "ocr_failed": "Failed",
    "index_failed": "Failed",
}


def running_sums(lengths: Column) -> Column:
    """Running totals of an array<int> in as many passes as the logarithm of its size."""
    doublings = F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)))).cast("int")
    steps = F.when(doublings > 0, F.sequence(F.lit(0), doublings - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        steps, lengths,
        lambda sums, step: F.transform(
            sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), step)), F.lit(0))
        ),
    )


def count_at_most(items: Column, value: Column) -> Column:
    """How many of the ascending ``items`` are not above ``value``: a search by halves, bit by bit of the count."""
    top = F.floor(F.log2(F.greatest(F.size(items), F.lit(1)))).cast("int")

    def widen(count: Column, bit: Column) -> Column:
        more = count + F.call_function("shiftleft", F.lit(1), bit)
        fits = F.coalesce(F.get(items, more - 1) <= value, F.lit(False))
        return F.when(fits, more).otherwise(count)

    return F.aggregate(F.sequence(top, F.lit(0), F.lit(-1)), F.lit(0), widen)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def noise_chars(text: Column) -> Column:
    """Characters that are neither alphanumeric nor white space."""
    return F.length(F.regexp_replace(text, CLEAN_RUN, ""))


def with_ratio_milli(rows: DataFrame, part: str, whole: str, name: str) -> DataFrame:
    """Add ``part / whole`` in thousandths, rounded as Python rounds the double.

    Away from ties this is plain integer rounding. On a tie the binary double lies
    a little above or below the decimal value (or exactly on it, then half-even);
    splitting it into two 26-bit halves makes that difference exact.
    """
    value = F.col(part) / F.col(whole).cast("double")
    whole_col, down = F.col(whole).cast("long"), F.col("_down")
    scaled = F.col("_value") * F.lit(134217729.0)
    gap = F.col("_high") * 2000.0 - (down * 2 + 1) + (F.col("_value") - F.col("_high")) * 2000.0
    return (
        rows.withColumns(
            {"_value": value, "_down": F.floor(F.col(part).cast("long") * 1000 / whole_col)}
        )
        .withColumns(
            {
                "_high": scaled - (scaled - F.col("_value")),
                "_rest": (F.col(part).cast("long") * 1000 - down * whole_col) * 2 - whole_col,
            }
        )
        .withColumn("_gap", F.when(F.col("_rest") == 0, gap).otherwise(F.col("_rest")))
        .withColumn(
            name,
            F.when(F.col("_gap") > 0, down + 1)
            .when(F.col("_gap") < 0, down)
            .otherwise(down + down % 2),
        )
        .drop("_value", "_down", "_high", "_rest", "_gap")
    )


def est_chunks(text_length: Column, size: int = CHUNK_SIZE) -> Column:
    return F.greatest(
        F.lit(1), (text_length / F.lit(size) * F.lit(CHUNK_ESTIMATE_FACTOR)).cast("int")
    )


def citation_snippet(text: Column) -> Column:
    return F.concat(F.substring(text, 1, 200), F.lit("..."))


def percent_label(score: Column, digits: int = 0) -> Column:
    """``0.853`` -> ``85%`` (or ``85.3%``), halves rounded up."""
    unit = 10**digits
    shown = (F.floor(score * 100 * unit + 0.5) / unit).cast(f"decimal(12,{digits})")
    return F.concat(shown.cast("string"), F.lit("%"))


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.8, "High").when(score >= 0.6, "Medium").otherwise("Low")


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, status), F.lit("Uploaded"))
