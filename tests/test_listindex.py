import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import retrieval
from folioflow.operators.listindex import ListIndex, nearest_lists, unit


def points(spark, vectors, start=0):
    rows = [(f"c{start + i}", f"d{i % 7}", "u", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, user_id string, vector array<float>")


def queries(spark, vectors):
    rows = [(f"q{i}", "u", [float(x) for x in v], 5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "query_id string, user_id string, vector array<float>, top_k int")


def hits(df):
    return {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in df.collect()}


def test_index_is_kept_up_to_date(spark, tmp_path):
    rng = np.random.default_rng(1)
    groups = rng.normal(size=(6, 16))
    vectors = np.concatenate([g + 0.3 * rng.normal(size=(60, 16)) for g in groups])
    first, rest = points(spark, vectors[:200]), points(spark, vectors[200:], 200)
    index = ListIndex.create(spark, str(tmp_path / "i"), first, lists=4, buckets=4)
    before = index.centres()
    old_search = index.search(queries(spark, vectors[:3]), probes=4)
    index.insert(rest)
    assert np.array_equal(index.centres(), before) and sum(index.sizes().values()) == 360
    everything = points(spark, vectors)
    asked = queries(spark, vectors[::9])
    exact = retrieval.knn(everything, asked)
    assert hits(index.search(asked, probes=4)) == hits(exact)
    # a search begun before the insert sees the state of then
    assert {r.chunk_id for r in old_search.collect()} <= {f"c{i}" for i in range(200)}

    large = max(index.sizes().values())
    assert index.split(limit=50) >= 3 and max(index.sizes().values()) <= 50 < large
    sizes = index.sizes()
    assert sum(sizes.values()) == 360 and len(index.centres()) == len(sizes)
    assert hits(index.search(asked, probes=len(sizes))) == hits(exact)
    share = retrieval.recall(index.search(asked, probes=4), exact).first()
    assert share.recall >= 0.9 and share.exact_hits == 5 * 40

    # a replaced point leaves its old list
    index.insert(points(spark, -vectors[:5]))
    assert sum(index.sizes().values()) == 360
    found = hits(index.search(queries(spark, -vectors[:1]), probes=len(sizes)))
    assert found["q0", 1][0] == "c0" and found["q0", 1][1] == pytest.approx(1)


def test_equal_vectors_cannot_be_split(spark, tmp_path):
    one = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "list int, vector array<double>")
    index = ListIndex.create(spark, str(tmp_path / "i"), points(spark, np.ones((40, 4))), centres=one, buckets=2)
    assert index.split(limit=10) == 0 and index.sizes() == {0: 40}


def test_given_centres(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors, centres = rng.normal(size=(80, 8)), rng.normal(size=(5, 8))
    given = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, vector array<double>")
    index = ListIndex.create(spark, str(tmp_path / "i"), points(spark, vectors), centres=given, buckets=2)
    want = nearest_lists(vectors.astype(np.float32).astype(float), unit(centres), 1)[:, 0]
    got = {r.chunk_id: r._list for r in index.points.read().select("chunk_id", "_list").collect()}
    assert got == {f"c{i}": n for i, n in enumerate(want)}
    assert index.points.read().filter(F.col("_list").isNull()).count() == 0
