import os
import shutil
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioflow.operators import answers, retrieval
from folioflow.plans.queries import QUERIES

DIM, SF_DIR = 12, "/root/testdata/sf0.001"


def make(spark, n=700, m=40, seed=1):
    """Points with a third of them equal copies and one tenant holding most of them."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, DIM)).astype(np.float32)
    vectors[: n // 3] = vectors[0]
    tenant = ["hot" if i % 3 else f"u{i % 7}" for i in range(n)]
    pts = [(f"c{i}", f"d{i % 20}", tenant[i], i % 5, f"text {i}", vectors[i].tolist()) for i in range(n)]
    qs = [(f"q{j}", ["hot", "u0", "u3", "nobody"][j % 4], 1 + j % 20,
           [None, [], ["d1", "d2", "d3"]][j % 3], rng.normal(size=DIM).astype(np.float32).tolist()) for j in range(m)]
    qs[0] = ("q0", "hot", 9, None, vectors[0].tolist())
    points = spark.createDataFrame(pts, "chunk_id string, doc_id string, user_id string, label int, text string, vector array<float>")
    queries = spark.createDataFrame(qs, "query_id string, user_id string, top_k int, doc_ids array<string>, vector array<float>")
    return points.repartition(5), queries, pts, qs


def brute(pts, qs, metric, threshold, tenant=True):
    out = []
    for qid, user, k, docs, vec in qs:
        q, scored = np.array(vec, dtype=np.float64), []
        for cid, doc, owner, _, _, pv in pts:
            if (tenant and owner != user) or (docs and doc not in docs):
                continue
            p = np.array(pv, dtype=np.float64)
            s = {"dot": q @ p, "cosine": q @ p / np.sqrt((q @ q) * (p @ p)), "euclidean": np.sqrt(((q - p) ** 2).sum())}[metric]
            s = round(float(s), 6)
            if threshold is None or (s <= threshold if metric == "euclidean" else s >= threshold):
                scored.append((s if metric == "euclidean" else -s, cid))
        out += [(qid, rank, cid, abs(s) if metric == "euclidean" else -s) for rank, (s, cid) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(hits):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in hits.collect())


def close(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert np.allclose([x[3] for x in a], [x[3] for x in b], atol=2e-6)


def test_knn_equals_brute_force(spark):
    points, queries, pts, qs = make(spark)
    for metric, threshold in (("cosine", None), ("dot", 0.5), ("euclidean", 5.0)):
        expected = brute(pts, qs, metric, 0.0 if threshold is None else threshold)
        close(found(retrieval.knn(points, queries, metric=metric, threshold=threshold)), expected)


def test_block_join_gives_the_same_hits(spark):
    points, queries, pts, qs = make(spark)
    blocks = retrieval.knn(points, queries, way="blocks", point_block=50, query_block_size=4)
    close(found(blocks), brute(pts, qs, "cosine", 0.0))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_small_blocks_send_rows_no_more_often(spark):
    points, queries, *_ = make(spark)
    cells = retrieval.cell_counts(points, queries, ["user_id"], point_block=2).collect()
    assert {r["query_cells"] for r in cells} == {1}  # any number of questions that a task can hold
    assert max(r["point_cells"] for r in cells) == retrieval.CELLS


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given test tables")
def test_more_questions_than_may_be_broadcast(spark, tmp_path):
    """The registered searches take every vector as a question, however many there are."""
    n = retrieval.MAX_BROADCAST_QUERIES + 104
    vectors = np.random.default_rng(5).normal(size=(n, 4)).astype(np.float32)
    table = pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32())),
                      "label": pa.array([i % 10 for i in range(n)], pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    for name in ("documents", "events"):
        shutil.copy(f"{SF_DIR}/{name}.parquet", tmp_path)
    for name in ("filter_eq", "collection_search", "filter_in", "knn_cosine", "filter_range", "knn_dot", "score_threshold", "knn_euclidean"):
        asked = QUERIES[name](spark, str(tmp_path)).agg(F.count_distinct("query_id")).first()[0]
        assert asked > 1000, name


def test_broadcast_scan_moves_no_vectors(spark, tmp_path):
    points, queries, *_ = make(spark, n=50)
    points.write.parquet(str(tmp_path / "p"))
    plan = retrieval.knn(spark.read.parquet(str(tmp_path / "p")), queries)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "hashpartitioning(query_id" in exchanges[0]
    assert "WindowGroupLimit" in plan[plan.index("hashpartitioning(query_id") :]  # below the exchange: before the shuffle


def test_no_tenant_and_fixed_k(spark):
    points, queries, pts, qs = make(spark, n=120, m=6)
    flat = [(q, u, 4, None, v) for q, u, _, _, v in qs]
    close(found(retrieval.knn(points, queries.drop("doc_ids"), top_k=4, tenant=None)), brute(pts, flat, "cosine", 0.0, tenant=False))
    assert retrieval.knn(points, queries.limit(0)).count() == 0


def test_filters(spark):
    points, queries, *_ = make(spark, n=60)
    spec = [("label", "gt", 1), ("label", "lte", 3), ("user_id", "eq", "hot"), ("doc_id", "in", [])]
    got = retrieval.apply_filters(points, spec).collect()
    assert got and all(r["label"] in (2, 3) and r["user_id"] == "hot" for r in got)
    assert retrieval.apply_filters(points, [("doc_id", "in", ["d1"])]).filter("doc_id <> 'd1'").count() == 0


def test_approximate_search(spark):
    points, queries, pts, qs = make(spark)
    model = retrieval.fit_lists(points, lists=6)
    listed = retrieval.assign_lists(points, model)
    exact = retrieval.knn(points, queries)
    close(found(retrieval.knn_approx(listed, model, queries, probes=6, point_block=64, query_block_size=8)), found(exact))
    some = retrieval.knn_approx(listed, model, queries, probes=3)
    report = retrieval.recall(some, exact).first()
    assert report["exact_hits"] == exact.count() and 0.3 < report["recall"] <= 1.0


def test_query_checks(spark):
    asked = [("a", "text", "u", None), ("b", "", "u", 3), ("c", "t", None, 3), ("d", "t", "u", 0), ("e", "t", "u", 1), ("f", "t", "u", 20), ("g", "t", "u", 21)]
    df = spark.createDataFrame(asked, "query_id string, query_text string, user_id string, top_k int")
    got = {r["query_id"]: (r["top_k"], r["reject_reason"] is None) for r in retrieval.check_queries(df).collect()}
    assert got == {"a": (5, True), "b": (3, False), "c": (3, False), "d": (0, False), "e": (1, True), "f": (20, True), "g": (21, False)}


def test_answers(spark):
    hits = spark.createDataFrame(
        [("q1", 2, "c2", "d2", "two {query}", 0.5), ("q1", 1, "c1", "d1", "o" * 300, 0.9)],
        "query_id string, rank int, chunk_id string, doc_id string, text string, score double")
    queries = spark.createDataFrame([("q1", "why {context}?"), ("q2", "none")], "query_id string, query_text string")
    context = answers.build_context(hits).first()["context"]
    assert context == f"[Document 1]\n{'o' * 300}\nSource: d1, Page: N/A\n\n[Document 2]\ntwo {{query}}\nSource: d2, Page: N/A\n"
    cited = answers.build_citations(hits).first()["citations"]
    assert [c["chunk_id"] for c in cited] == ["c1", "c2"] and cited[0]["text"] == "o" * 200 + "..." and cited[1]["text"] == "two {query}..."
    confidence = {r["query_id"]: r["confidence"] for r in answers.answer_confidence(queries, hits).collect()}
    assert confidence == {"q1": 0.7, "q2": 0.0}
    prompts = {r["query_id"]: r["prompt"] for r in answers.build_prompts(queries, answers.build_context(hits)).collect()}
    assert context in prompts["q1"] and "why {context}?" in prompts["q1"] and "QUESTION\nnone\n" in prompts["q2"]

    def provider():
        return lambda texts: ['{"answer": "ok", "reasoning": "r"}' if "why" in t else "not json" for t in texts]

    def down():
        def fail(texts):
            raise RuntimeError("offline")
        return fail

    table = answers.build_prompts(queries, answers.build_context(hits))
    replies = answers.complete_prompts(table, provider)
    got = {r["query_id"]: r for r in answers.assemble_results(queries, hits, replies, "stub").collect()}
    assert got["q1"]["answer"] == "ok" and got["q1"]["confidence"] == 0.7 and len(got["q1"]["citations"]) == 2
    assert got["q1"]["metadata"] == {"chunks_retrieved": "2", "model": "stub"} and got["q1"]["status"] == "success"
    assert got["q2"]["status"] == "failed" and got["q2"]["citations"] == [] and got["q2"]["confidence"] == 0.0
    lost = answers.complete_prompts(table, down, min_wait=0, max_wait=0).collect()
    assert {(r["raw"], r["error"]) for r in lost} == {(None, "offline")}
    failed = spark.createDataFrame([("q1", None, "rate limit")], "query_id string, raw string, error string")
    told = {r["query_id"]: r for r in answers.assemble_results(queries, hits, failed, "stub").collect()}
    assert told["q1"]["status"] == "failed" and told["q1"]["error"] == "rate limit"


def test_scoring_holds_few_scores_and_texts_at_a_time():
    """Block by block, in any order of blocks, the best of all points, in little memory however many are scored."""
    rng, n, m = np.random.default_rng(8), 8192, 1024
    vectors, asked = rng.normal(size=(n, 8)).round(1), rng.normal(size=(m, 8)).round(1)
    names = [f"c{i:05d}" for i in rng.permutation(n)]
    block = pa.table({"chunk_id": names, "doc_id": names, "vector": pa.array(vectors.tolist(), pa.list_(pa.float32()))})
    top_k = rng.integers(1, 6, m)
    questions = {"number": np.arange(m), "vector": asked, "top_k": top_k, "doc_ids": {}}
    scorer = retrieval.BlockScorer("dot", None, ["chunk_id"])
    step = retrieval._POINTS_AT_ONCE
    tracemalloc.start()
    for i in range(0, n, step):
        scorer.add(block.slice(i, step), questions)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    got = {}
    for r in scorer.best.to_pylist():
        got.setdefault(r["number"], []).append((-r["near"], r["chunk_id"]))
    exact = np.round(asked @ vectors.astype(np.float32).astype(np.float64).T, 6)
    for q in range(0, m, 50):
        assert sorted(got[q]) == sorted(zip(-exact[q], names))[: top_k[q]]
