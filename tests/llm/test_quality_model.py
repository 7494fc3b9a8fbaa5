"""Positive-unlabelled model: held-out accuracy on the given table, and the edges."""

import os
import zlib

import pytest

from folioflow.llm import quality_model

SF_DIR = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = quality_model.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(scored) > 500
    good = [r.score for r in scored if r.quality == 1]
    bad = [r.score for r in scored if r.quality == 0]
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    right = sum(r.predicted == r.quality for r in scored) / len(scored)
    kept = sum(g >= 0.7 for g in good) / len(good)
    print("auc", above, "accuracy", right, "good kept", kept)
    assert above > 0.97 and right > 0.93 and kept > 0.95
    for r in scored:
        assert zlib.crc32(str(r.doc_id).encode()) % 4 == 2


def test_edges(spark):
    docs = spark.createDataFrame(
        [(i, "the cat and the dog of it. " * 9, 0.5) for i in range(8)] + [(20, "!!! ### " * 40, 0.1)] * 3
        + [(30, None, 0.0), (31, "", 0.0), (None, "x", 0.0), (32, "the long text of it, " * 40_000, 0.0), (33, "x" * 300_000, 0.0)],
        "doc_id long, text string, score double",
    )
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(20, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.score_documents(docs, labels).collect()
    assert len(rows) == 16 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 20}) == 1
    assert {r.score for r in quality_model.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.score_documents(docs.limit(0), labels).count() == 0


def test_fit_converges_to_tested_weights(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(1, 1, (300, 3)), rng.normal(-1, 1, (500, 3))])
    positive = np.arange(800) < 100
    rows = spark.createDataFrame([([float(v) for v in r], bool(p)) for r, p in zip(x, positive)], "x array<double>, positive boolean")
    model = quality_model.fit(rows)
    assert model.converged and 0.2 < model.prior < 0.6
    design = quality_model._design(x, np.array(model.mean), np.array(model.deviation))
    z = design @ np.array(model.weights)
    loss = lambda v: np.logaddexp(0, v)
    assert loss(z).mean() - model.prior * loss(z[positive]).mean() >= 0
    objective = lambda w: loss(design @ w).mean() - model.prior * (design[positive] @ w).mean() + quality_model.RIDGE * w @ w / 2
    best = objective(np.array(model.weights))
    for _ in range(50):
        near = np.array(model.weights) + rng.normal(0, 0.05, len(model.weights))
        bracket = loss(design @ near).mean() - model.prior * loss((design @ near)[positive]).mean()
        assert bracket < 0 or objective(near) >= best - 1e-4
