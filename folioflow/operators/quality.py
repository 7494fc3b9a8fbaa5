"""Document quality report and corpus summary, all native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions import text as tx


def doc_quality(extracted: DataFrame) -> DataFrame:
    """One report row per document; failed or empty documents get zeros.

    The three regex-based measures are computed once each in a narrow projection, the
    derived columns read them, and the text itself leaves the plan right after.
    """
    usable = (F.col("status") == "success") & (F.col("text") != "")
    measured = extracted.select(
        "doc_id", "user_id", "filename", F.col("status").alias("ocr_status"), "page_count",
        F.coalesce(usable, F.lit(False)).alias("usable"),
        F.when(usable, F.length("text")).alias("chars"),
        F.when(usable, tx.word_count(F.col("text"))).alias("words"),
        F.when(usable, tx.noise_chars(F.col("text"))).alias("noise"),
    )
    chars = F.col("chars")
    rated = tx.with_ratio_milli(measured, "noise", "chars", "milli").withColumn(
        "milli", F.coalesce("milli", F.lit(0))
    )
    usable = F.col("usable")
    noise_ratio = F.col("milli") / F.lit(1000.0)
    is_empty = ~usable | (chars < tx.MIN_TEXT_CHARS)
    is_noisy = F.col("milli") > tx.MAX_NOISE_MILLI
    percent = F.rint(noise_ratio * 100).cast("int").cast("string")
    reason = (
        F.when(~usable, F.concat(F.lit("ocr_failed: "), F.coalesce("ocr_status", F.lit("None"))))
        .when(is_empty & is_noisy, "empty_and_noisy")
        .when(is_empty, F.concat(F.lit("too_short ("), chars.cast("string"), F.lit(" chars)")))
        .when(is_noisy, F.concat(F.lit("high_noise ("), percent, F.lit("% non-alnum)")))
    )
    return rated.select(
        "doc_id", "user_id", "filename", "ocr_status", "page_count",
        F.coalesce(chars, F.lit(0)).alias("text_length"),
        F.coalesce("words", F.lit(0)).alias("word_count"),
        noise_ratio.alias("noise_ratio"),
        F.when(usable, tx.est_chunks(chars)).otherwise(0).alias("est_chunks"),
        is_empty.alias("is_empty"),
        is_noisy.alias("is_noisy"),
        (is_empty | is_noisy).alias("needs_review"),
        reason.alias("review_reason"),
    )


def _exact_percentile(name: str, share: float) -> Column:
    """The smallest value that ``share`` of all rows do not exceed. Tasks count equal values, so
    the state is as large as there are different lengths, whatever the number of rows."""
    return F.expr(f"percentile_disc({share}) within group (order by {name})").cast("int")


def corpus_summary(report: DataFrame) -> DataFrame:
    """Raw corpus totals: one row, one pass, partial aggregation in every task."""
    ok = F.col("ocr_status") == "success"
    return report.agg(
        F.count("*").alias("total_docs"),
        F.count_if(ok).alias("success_docs"),
        F.count_if(F.col("ocr_status") != "success").alias("failed_docs"),
        F.count_if("needs_review").alias("needs_review_docs"),
        F.coalesce(F.sum("page_count"), F.lit(0)).alias("total_pages"),
        F.avg("page_count").alias("avg_pages_per_doc"),
        F.avg("text_length").alias("avg_text_length"),
        _exact_percentile("text_length", 0.5).alias("p50_text_length"),
        _exact_percentile("text_length", 0.95).alias("p95_text_length"),
        F.avg("word_count").alias("avg_word_count"),
        # Thousandths add up exactly, whatever order the tasks finish in.
        (F.avg(F.rint(F.col("noise_ratio") * 1000).cast("long")) / 1000).alias("avg_noise_ratio"),
        F.coalesce(F.sum("est_chunks"), F.lit(0)).alias("est_total_chunks"),
        F.coalesce(F.sum("text_length"), F.lit(0)).alias("total_chars"),
    )


def cost_estimate(summary: DataFrame, chars_from_mean: bool = False) -> DataFrame:
    """The 15 presented figures of the corpus summary, zeros for an empty corpus.

    Tokens come from the exact character total. ``chars_from_mean`` takes the mean
    over *all* documents times the successful ones instead, which undercounts as
    soon as documents failed.
    """
    chars = F.col("total_chars").cast("double")
    if chars_from_mean:
        chars = F.coalesce("avg_text_length", F.lit(0.0)) * F.col("success_docs")
    tokens = chars / tx.CHARS_PER_TOKEN
    rate = F.col("success_docs") / F.greatest(F.col("total_docs"), F.lit(1)) * 100

    def rounded(name: str, digits: int):
        return F.round(F.coalesce(name, F.lit(0.0)), digits).alias(name)

    return summary.select(
        "total_docs", "success_docs", "failed_docs", "needs_review_docs",
        F.round(rate, 1).alias("success_rate_pct"),
        "total_pages",
        rounded("avg_pages_per_doc", 1),
        rounded("avg_text_length", 0),
        F.coalesce("p50_text_length", F.lit(0)).alias("p50_text_length"),
        F.coalesce("p95_text_length", F.lit(0)).alias("p95_text_length"),
        rounded("avg_word_count", 0),
        rounded("avg_noise_ratio", 3),
        "est_total_chunks",
        F.round(tokens, 0).alias("est_total_tokens"),
        F.round(tokens / 1_000_000 * tx.USD_PER_MILLION_TOKENS, 4).alias("est_cost_usd"),
    )


def user_breakdown(report: DataFrame) -> DataFrame:
    return (
        report.groupBy("user_id")
        .agg(
            F.count("*").alias("doc_count"),
            F.sum("est_chunks").alias("est_chunks"),
            F.count_if("needs_review").alias("flagged"),
        )
        .orderBy(F.desc("doc_count"), "user_id")
    )


def status_counts(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy("status").agg(F.count("*").alias("docs"))


def filter_flagged(report: DataFrame) -> DataFrame:
    """The review list: every flagged document.

    Read ``report`` back from its written stage: on an unwritten one Spark pushes the filter
    down to the text and computes every measure again for it.
    """
    return (
        report.filter("needs_review")
        .select("doc_id", "filename", "ocr_status", "text_length", "noise_ratio", "review_reason")
    )


def quality_gate(extracted: DataFrame, enabled: bool = False) -> DataFrame:
    """Documents that go on to chunking; with the gate on, those that need review stay behind.

    The flags follow from the document's own row, so no text is joined with the report.
    """
    if not enabled:
        return extracted
    usable = F.coalesce((F.col("status") == "success") & (F.col("text") != ""), F.lit(False))
    measured = extracted.withColumns(
        {"_chars": F.when(usable, F.length("text")), "_noise": F.when(usable, tx.noise_chars(F.col("text")))}
    )
    rated = tx.with_ratio_milli(measured, "_noise", "_chars", "_milli")
    fine = usable & (F.col("_chars") >= tx.MIN_TEXT_CHARS) & (F.col("_milli") <= tx.MAX_NOISE_MILLI)
    return rated.filter(fine).select(*extracted.columns)
