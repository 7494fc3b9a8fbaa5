from folioflow.operators import extract, quality
from pyspark.sql import functions as F, types as T

from folioflow.schemas import EXTRACTED as WHOLE

EXTRACTED = T.StructType(WHOLE.fields[:8])


def report_of(spark, *texts, status="success"):
    data = [(f"d{i}", "u", "f", "p", t, 1, status, None) for i, t in enumerate(texts)]
    got = quality.doc_quality(spark.createDataFrame(data, EXTRACTED)).orderBy("doc_id").collect()
    return got


def test_thresholds_and_reasons(spark):
    texts = ["a" * 99, "a" * 100, "a" * 60 + "#" * 40, "a" * 59 + "#" * 41, "#" * 60, "", None]
    got = report_of(spark, *texts)
    assert [r["review_reason"] for r in got] == [
        "too_short (99 chars)", None, None, "high_noise (41% non-alnum)", "empty_and_noisy",
        "ocr_failed: success", "ocr_failed: success",
    ]
    assert [r["noise_ratio"] for r in got] == [0, 0, 0.4, 0.41, 1.0, 0, 0]
    assert [r["est_chunks"] for r in got] == [1, 1, 1, 1, 1, 0, 0]
    assert report_of(spark, "long enough " * 20, status="failed")[0]["review_reason"] == "ocr_failed: failed"


def test_percent_in_reason_rounds_half_even(spark):
    got = report_of(spark, "a" * 119 + "#" * 81, "a" * 117 + "#" * 83)
    assert [r["review_reason"] for r in got] == [
        f"high_noise ({0.405:.0%} non-alnum)", f"high_noise ({0.415:.0%} non-alnum)",
    ]


def test_summary_and_empty_corpus(spark):
    data = [("a", "u1", "f", "p", "x" * 1000, 2, "success", None), ("b", "u1", "f", "p", "", 0, "failed", "e"),
            ("c", "u2", "f", "p", "y" * 3000, 4, "success", None)]
    docs = spark.createDataFrame(data, EXTRACTED)
    report = quality.doc_quality(docs)
    summary = quality.corpus_summary(report)
    row = quality.cost_estimate(summary).first()
    assert (row["total_docs"], row["success_docs"], row["failed_docs"], row["needs_review_docs"]) == (3, 2, 1, 1)
    assert row["success_rate_pct"] == 66.7 and row["est_total_tokens"] == 1000.0
    legacy = quality.cost_estimate(summary, chars_from_mean=True).first()
    assert legacy["est_total_tokens"] == round(4000 / 3 * 2 / 4, 0)
    assert [tuple(r) for r in quality.user_breakdown(report).collect()] == [("u1", 2, 2, 1), ("u2", 1, 6, 0)]

    empty = quality.cost_estimate(quality.corpus_summary(quality.doc_quality(docs.limit(0)))).first()
    assert set(empty.asDict().values()) == {0}


def test_percentiles_are_exact(spark):
    report = spark.range(40_001, numPartitions=4).select(
        F.lit("success").alias("ocr_status"), F.lit(False).alias("needs_review"), F.lit(1).alias("page_count"),
        (F.col("id") * F.col("id") % 100_003).cast("int").alias("text_length"), F.lit(1).alias("word_count"),
        F.lit(0.0).alias("noise_ratio"), F.lit(1).alias("est_chunks"),
    )
    lengths = sorted(i * i % 100_003 for i in range(40_001))
    row = quality.corpus_summary(report).first()
    assert (row["p50_text_length"], row["p95_text_length"]) == (lengths[20_000], lengths[38_000])


def test_report_has_no_python_and_reads_few_columns(spark):
    plan = quality.doc_quality(spark.createDataFrame([], EXTRACTED))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_gate_and_counts(spark):
    data = [("a", "u", "f", "p", "x" * 200, 1, "success", None), ("b", "u", "f", "p", "##", 1, "success", None),
            ("c", "u", "f", "p", "", 0, "failed", "e")]
    docs = spark.createDataFrame(data, EXTRACTED)
    assert quality.quality_gate(docs).count() == 3
    gated = quality.quality_gate(docs, enabled=True)
    assert [r["doc_id"] for r in gated.collect()] == ["a"] and gated.columns == docs.columns
    assert "Join" not in gated._jdf.queryExecution().executedPlan().toString()
    assert tuple(extract.extraction_counts(docs).first()) == (3, 2, 1)
    assert extract.filter_indexable(docs).count() == 2
