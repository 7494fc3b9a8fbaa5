import uuid

from pyspark.sql import functions as F

from folioflow.functions import ids, messages, paths, text as tx

TEXTS = [
    "plain words here", "  leading and wide 　 spaces\n", "café naïve 你好", "!!! ### ---",
    "a\x1cb\x1dc\x85d\x0be", "\U0001d518 math ² Ⅰ ½", "﻿mark​zero", "", "\t\n ",
]


def test_text_measures_agree_with_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select(
        "t", tx.word_count(F.col("t")).alias("w"), tx.noise_chars(F.col("t")).alias("n"),
        tx.strip(F.col("t")).alias("s"), F.length("t").alias("l"),
    ).collect()
    for r in got:
        assert r["w"] == len(r["t"].split())
        assert r["n"] == sum(1 for c in r["t"] if not c.isalnum() and not c.isspace())
        assert r["s"] == r["t"].strip()
        assert r["l"] == len(r["t"])


def test_ratio_rounds_like_python(spark):
    pairs = [(n, whole) for whole in (1, 3, 7, 16, 48, 80, 400, 2000, 999983) for n in range(0, whole + 1, max(1, whole // 400))]
    df = spark.createDataFrame(pairs, "n int, whole int")
    got = tx.with_ratio_milli(df, "n", "whole", "m").collect()
    assert all(r["m"] / 1000 == round(r["n"] / r["whole"], 3) for r in got)


def test_labels(spark):
    df = spark.createDataFrame([("indexed", 0.853), ("ocr_failed", 0.6), ("strange", 0.05)], "s string, x double")
    got = df.select(
        tx.status_label(F.col("s")), tx.confidence_band(F.col("x")), tx.percent_label(F.col("x")),
        tx.percent_label(F.col("x"), 1),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Ready", "High", "85%", "85.3%"), ("Failed", "Medium", "60%", "60.0%"), ("Uploaded", "Low", "5%", "5.0%"),
    ]


def test_point_id_is_uuid5(spark):
    names = [f"doc_{i}_{i * 7}" for i in range(200)] + ["üß_0", ""]
    got = spark.createDataFrame([(n,) for n in names], "c string").select("c", ids.point_id(F.col("c")).alias("p"))
    assert all(r["p"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["c"])) for r in got.collect())


def test_path_parts(spark):
    cases = {
        "gs://b/raw/u/d/f.pdf": ("u", "d", "f.pdf"),
        "/x/raw/u/d/sub/f.pdf": ("u", "d", "f.pdf"),
        "/no/marker/f.pdf": ("unknown", "marker", "f.pdf"),
        "f.pdf": ("unknown", "unknown", "f.pdf"),
        "raw/u": ("unknown", "raw", "u"),
        "": ("unknown", "unknown", "unknown"),
        "a/raw/u/d": ("u", "d", "d"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = df.select("p", paths.path_parts(F.col("p")).alias("x")).select("p", "x.*").collect()
    assert {r["p"]: (r["user_id"], r["doc_id"], r["filename"]) for r in got} == cases


def test_messages_round_trip_and_replies(spark):
    df = spark.createDataFrame([("doc_1", "u" * 90, "raw/u/doc_1/f.pdf")], "doc_id string, user_id string, storage_path string")
    sent = df.select(messages.encode_event(**{c: F.col(c) for c in df.columns}).alias("data"))
    assert "\n" not in sent.first()["data"]
    assert sent.select(messages.decode_event(F.col("data")).alias("m")).select("m.*").first() == df.first()
    broken = spark.createDataFrame([("%%%",)], "data string")
    assert broken.select(messages.decode_event(F.col("data")).alias("m")).first()["m"] is None

    replies = ['{"answer": "yes", "reasoning": "r"}', '{"answer": "yes"}', '{"reasoning": "r"}', "no json", "[1]"]
    got = spark.createDataFrame([(r,) for r in replies], "raw string").select(messages.parse_answer(F.col("raw")).alias("a"))
    statuses = [(r["a"]["status"], r["a"]["reasoning"], r["a"]["raw"]) for r in got.collect()]
    assert statuses == [
        ("success", "r", None), ("success", "", None), ("failed", "r", None),
        ("failed", "", "no json"), ("failed", "", None),
    ]
