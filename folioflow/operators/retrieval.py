"""Filtered top-k retrieval for a whole table of questions at once.

Scores are matrix products over blocks of vectors inside the tasks; what leaves a
task is at most top_k rows per question, never a pair list. Two ways share that block
step and give the same hits; the caller says which:

* ``way="broadcast"``, for few questions (a bounded fetch proves it, more are refused): the
  question block is broadcast and the points are scanned where they lie, with no shuffle of vectors;
* ``way="blocks"``, for any number: points and questions are cut into cells by hash within each
  tenant, so a tenant with a third of all points is just more cells. Rows are sent once for each cell they meet, so
  a cell takes as many as fit a task, and is scored block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

DEFAULT_TOP_K = 5
MIN_TOP_K, MAX_TOP_K = 1, 20
RAG_THRESHOLD = 0.7

# Questions that may be broadcast: 4096 vectors of 1536 values are about 50 MB.
MAX_BROADCAST_QUERIES = 4096
POINT_BLOCK = 8192
QUERY_BLOCK = 2048
# Scores held at a time: 256 questions x 2048 points x 8 bytes is 4 MB, a few copies of it included 20 MB.
_SCORED_AT_ONCE, _POINTS_AT_ONCE = 256, 2048
# A cell holds so many bytes of vectors of each side, or so many rows if these are more; a tenant of several blocks
# of points is cut into so many cells for the sake of the cores.
CELL_BYTES, CELL_ROWS, CELLS = 16 << 20, 8192, 16
PAYLOAD = ("chunk_id", "doc_id")

_OPS = {
    "eq": lambda c, v: c == v,
    "in": lambda c, v: c.isin(list(v)) if v else F.lit(True),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


def apply_filters(points: DataFrame, filters: list[tuple]) -> DataFrame:
    """AND of (field, operator, value) conditions; an empty ``in`` list filters nothing."""
    conditions = [_OPS[op](F.col(field), value) for field, op, value in filters]
    return points.filter(reduce(Column.__and__, conditions)) if conditions else points


def filter_searchable(points: DataFrame, documents: DataFrame) -> DataFrame:
    """Points of documents whose status says they can be searched."""
    open_docs = documents.filter(F.col("status").isin("ready", "indexed")).select("doc_id")
    return points.join(open_docs, "doc_id", "left_semi")


def check_queries(queries: DataFrame) -> DataFrame:
    """``queries`` with the default top_k filled in and a reject_reason (null = valid)."""
    def missing(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == "")

    k = F.coalesce("top_k", F.lit(DEFAULT_TOP_K))
    reason = F.when(missing("query_text") | missing("user_id"), "Missing required fields").when(
        ~k.between(MIN_TOP_K, MAX_TOP_K), "top_k out of range"
    )
    return queries.withColumn("top_k", k).withColumn("reject_reason", reason)


class BlockScorer:
    """Best points per question within blocks that pass through one task."""

    def __init__(self, metric: str, threshold: float | None, payload: list[str]):
        self.metric, self.threshold, self.payload = metric, threshold, payload
        self.best = None
        self.floor = np.empty(0)  # by question number: what a score must reach to be among the best so far

    def closeness(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Rounded score, negated for distances: larger is always nearer."""
        product = q @ p.T
        if self.metric == "dot":
            return np.round(product, 6)
        q2, p2 = (q * q).sum(axis=1)[:, None], (p * p).sum(axis=1)[None, :]
        if self.metric == "euclidean":
            square = np.maximum(q2 + p2 - 2 * product, 0)
            # The expansion loses digits for near copies; those are subtracted directly.
            close = square < 1e-4 * (q2 + p2)
            for row in np.flatnonzero(close.any(axis=1)):
                gap = p[close[row]] - q[row]
                square[row, close[row]] = (gap * gap).sum(axis=1)
            return -np.round(np.sqrt(square), 6)
        length = np.sqrt(q2) * np.sqrt(p2)
        np.divide(product, length, out=product, where=length > 0)
        product[~(length > 0)] = 0
        return np.round(product, 6, out=product)

    def add(self, block: pa.Table, queries: dict) -> None:
        """Score one block of points (any order) against one block of questions."""
        block = block.sort_by("chunk_id").combine_chunks()
        self.add_sorted(block, as_matrix(block.column("vector")), queries)

    def add_sorted(self, block: pa.Table, vectors: np.ndarray, queries: dict) -> None:
        """The same for points in chunk_id order with their vectors as a matrix."""
        docs = block.column("doc_id").combine_chunks().dictionary_encode() if queries["doc_ids"] else None
        for start in range(0, len(queries["number"]), _SCORED_AT_ONCE):
            part = slice(start, start + _SCORED_AT_ONCE)
            self._add_part(block, vectors, docs, queries, part)

    def _add_part(self, block, vectors, docs, queries, part) -> None:
        near = self.closeness(queries["vector"][part], vectors)
        if self.threshold is not None:
            bound = -self.threshold if self.metric == "euclidean" else self.threshold
            near[near < bound] = -np.inf
        numbers = queries["number"][part]
        self.floor = np.r_[self.floor, np.full(max(0, numbers.max() + 1 - len(self.floor)), -np.inf)]
        near[near < self.floor[numbers][:, None]] = -np.inf
        if docs is not None:
            code_of = {name: code for code, name in enumerate(docs.dictionary.to_pylist())}
            codes = docs.indices.to_numpy(zero_copy_only=False)
            for row, number in enumerate(queries["number"][part].tolist()):
                if number in queries["doc_ids"]:
                    wanted = np.zeros(len(code_of), dtype=bool)
                    wanted[[code_of[d] for d in queries["doc_ids"][number] if d in code_of]] = True
                    near[row, ~wanted[codes]] = -np.inf
        ks = queries["top_k"][part]
        kmax = int(ks.max())
        keep = near > -np.inf
        if near.shape[1] > kmax:
            cut = near.shape[1] - kmax
            keep &= near >= np.partition(near, cut, axis=1)[:, cut][:, None]
        qi, pi = np.nonzero(keep)
        if not len(qi):
            return
        # Points are in chunk_id order, so the point position breaks ties.
        order = np.lexsort((pi, -near[qi, pi], qi))
        qi, pi = qi[order], pi[order]
        kept = rank_in_group(qi) < ks[qi]
        qi, pi = qi[kept], pi[kept]
        found = block.select(self.payload).take(pa.array(pi))
        found = found.append_column("number", pa.array(numbers[qi]))
        found = found.append_column("near", pa.array(near[qi, pi]))
        found = found.append_column("top_k", pa.array(ks[qi]))
        self._merge(found)

    def _merge(self, found: pa.Table) -> None:
        # Only the names, not the texts, of all rows are sorted.
        both = found if self.best is None else pa.concat_tables([self.best, found])
        order = pc.sort_indices(
            both.select(["number", "near", "chunk_id"]),
            [("number", "ascending"), ("near", "descending"), ("chunk_id", "ascending")],
        ).to_numpy()
        number, near, top_k = (both.column(c).to_numpy()[order] for c in ("number", "near", "top_k"))
        rank = rank_in_group(number)
        self.best = both.take(pa.array(order[rank < top_k])).combine_chunks()
        last = rank == top_k - 1
        self.floor[number[last]] = near[last]
        pa.default_memory_pool().release_unused()

    def rows(self, query_ids: list[str], schema: pa.Schema) -> pa.Table:
        if self.best is None:
            return schema.empty_table()
        near = self.best.column("near").to_numpy()
        score = -near if self.metric == "euclidean" else near
        # 0.0 + x turns a negative zero into zero.
        columns = {"score": pa.array(0.0 + score), "top_k": self.best.column("top_k").cast("int32")}
        columns["query_id"] = pa.array([query_ids[i] for i in self.best.column("number").to_pylist()])
        for name in self.payload:
            columns[name] = self.best.column(name)
        return pa.table([columns[f.name] for f in schema], schema=schema)


def as_matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else None
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def rank_in_group(sorted_keys: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of equal keys."""
    n = len(sorted_keys)
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if n else np.array([], int)
    return np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))


def query_block(table: pa.Table, numbers: np.ndarray) -> dict:
    """Question vectors, limits and (only where given) document lists of one block."""
    lists = table.column("doc_ids").to_pylist()
    return {
        "number": numbers,
        "vector": as_matrix(table.column("vector")),
        "top_k": table.column("top_k").to_numpy().astype(np.int64),
        "doc_ids": {n: docs for n, docs in zip(numbers.tolist(), lists) if docs},
    }


def _prepared(queries: DataFrame, tenant: str | None, top_k: int | None) -> DataFrame:
    k = F.col("top_k") if "top_k" in queries.columns and top_k is None else F.lit(top_k)
    docs = F.col("doc_ids") if "doc_ids" in queries.columns else F.lit(None)
    return queries.select(
        "query_id",
        (F.col(tenant) if tenant else F.lit("")).alias("_tenant"),
        F.coalesce(k, F.lit(DEFAULT_TOP_K)).cast("int").alias("top_k"),
        docs.cast("array<string>").alias("doc_ids"),
        "vector",
    )


def _reason(tenant: str = "_tenant") -> Column:
    return (
        F.when(F.col("vector").isNull(), "no vector")
        .when(F.col("top_k") < MIN_TOP_K, "top_k out of range")
        .when(F.col(tenant).isNull(), "no tenant")
    )


def rejected_questions(queries: DataFrame, top_k: int | None = None, tenant: str | None = "user_id") -> DataFrame:
    """(query_id, reject_reason) of the questions that ``knn`` and ``knn_approx`` leave out."""
    asked = _prepared(queries, tenant, top_k).withColumn("reject_reason", _reason())
    return asked.filter("reject_reason is not null").select("query_id", "reject_reason")


def _hit_schema(points: DataFrame, payload: list[str]) -> T.StructType:
    fields = [T.StructField("query_id", T.StringType()), T.StructField("top_k", T.IntegerType()),
              T.StructField("score", T.DoubleType())]
    return T.StructType(fields + [points.schema[c] for c in payload])


def _arrow_schema(spark_schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)


def _scan_with_broadcast(points, rows, tenant, payload, metric, threshold) -> DataFrame:
    """Score every point where it is stored against the broadcast question block."""
    spark = points.sparkSession
    schema = _hit_schema(points, payload)
    out = _arrow_schema(schema)
    table = pa.Table.from_pydict(
        {
            "vector": pa.array([r["vector"] for r in rows], pa.list_(pa.float32())),
            "top_k": pa.array([r["top_k"] for r in rows], pa.int32()),
            "doc_ids": pa.array([r["doc_ids"] for r in rows], pa.list_(pa.string())),
        }
    )
    by_tenant: dict[str, list[int]] = {}
    for number, row in enumerate(rows):
        by_tenant.setdefault(row["_tenant"], []).append(number)
    blocks = {t: query_block(table.take(ns), np.array(ns)) for t, ns in by_tenant.items()}
    shared = spark.sparkContext.broadcast((blocks, [r["query_id"] for r in rows]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        question_blocks, query_ids = shared.value
        scorer = BlockScorer(metric, threshold, payload)
        slices = (b.slice(i, _POINTS_AT_ONCE) for b in batches for i in range(0, b.num_rows, _POINTS_AT_ONCE))
        for batch in slices:
            whole = pa.Table.from_batches([batch])
            codes = batch.column("_tenant").dictionary_encode()
            numbers = codes.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(codes.dictionary.to_pylist()):
                if name in question_blocks:
                    inside = whole if len(codes.dictionary) == 1 else whole.filter(pa.array(numbers == code))
                    scorer.add(inside, question_blocks[name])
        yield from scorer.rows(query_ids, out).to_batches()

    key = F.col(tenant) if tenant else F.lit("")
    if tenant:  # as many values as there are questions at most
        points = points.filter(F.col(tenant).isin(list(by_tenant)))
    needed = list(dict.fromkeys([*payload, "chunk_id", "doc_id", "vector"]))
    return points.filter("vector is not null").select(key.alias("_tenant"), *needed).mapInArrow(
        scan, schema
    )


def cell_counts(points: DataFrame, queries: DataFrame, keys: list[str], point_block: int = POINT_BLOCK) -> DataFrame:
    """Into how many cells the points and the questions of each key are cut."""

    def full(rows: str) -> Column:
        return F.ceil(F.col(rows) / F.greatest(F.lit(CELL_ROWS), F.floor(CELL_BYTES / (4 * F.col("dim")))))

    held = points.groupBy(*keys).agg(F.count("*").alias("n"), F.greatest(F.max(F.size("vector")), F.lit(1)).alias("dim"))
    return held.join(queries.groupBy(*keys).agg(F.count("*").alias("m")), keys).select(
        *keys,
        F.greatest(full("n"), F.least(F.ceil(F.col("n") / point_block), F.lit(CELLS))).cast("int").alias("point_cells"),
        full("m").cast("int").alias("query_cells"),
    )


def _block_join(points, queries, keys, payload, metric, threshold, point_block, query_block_size):
    """Meet every cell of questions with every cell of points of the same key in one task group.

    A row is sent as often as the other side has cells, so cells are as large as a task can hold; inside, blocks of
    ``query_block_size`` questions and ``point_block`` points are scored one after the other.
    """
    schema = _hit_schema(points, payload)
    out = _arrow_schema(schema)
    sizes = cell_counts(points, queries, keys, point_block)

    def cell_of(column: str, cells: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(cells)).cast("int")

    def every(cells: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(cells) - 1))

    needed = list(dict.fromkeys([*payload, "chunk_id", "doc_id", "vector"]))
    cells = [*keys, "_pc", "_qc"]
    left = points.join(sizes, keys).select(
        *keys, cell_of("chunk_id", "point_cells").alias("_pc"), every("query_cells").alias("_qc"), *needed
    )
    right = queries.join(sizes, keys).select(
        *keys, every("point_cells").alias("_pc"), cell_of("query_id", "query_cells").alias("_qc"),
        "query_id", "top_k", "doc_ids", "vector",
    )

    def score(ps: pa.Table, qs: pa.Table) -> pa.Table:
        if not ps.num_rows or not qs.num_rows:
            return out.empty_table()
        step = min(point_block, _POINTS_AT_ONCE)
        ps = ps.sort_by("chunk_id").combine_chunks()
        blocks = [ps.slice(i, step) for i in range(0, ps.num_rows, step)]
        matrices = [as_matrix(b.column("vector")) for b in blocks]
        found = []
        for i in range(0, qs.num_rows, query_block_size):
            asked, scorer = qs.slice(i, query_block_size), BlockScorer(metric, threshold, payload)
            questions = query_block(asked, np.arange(asked.num_rows))
            for block, vectors in zip(blocks, matrices):
                scorer.add_sorted(block, vectors, questions)
            found.append(scorer.rows(asked.column("query_id").to_pylist(), out))
        return pa.concat_tables(found)

    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(score, schema)


def _ranked(hits: DataFrame, metric: str, most: int | None = None) -> DataFrame:
    """Hits within their question's top_k. ``most`` is the largest top_k, if known: as a literal it lets
    every task drop what cannot be among the best before the shuffle."""
    best_first = F.asc("score") if metric == "euclidean" else F.desc("score")
    order = Window.partitionBy("query_id").orderBy(best_first, "chunk_id")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    if most is not None:
        ranked = ranked.filter(F.col("rank") <= most)
    return ranked.filter("rank <= top_k").drop("top_k")


def _bound(metric: str, threshold: float | None) -> float | None:
    return 0.0 if threshold is None and metric != "euclidean" else threshold


def knn(
    points: DataFrame,
    queries: DataFrame,
    metric: str = "cosine",
    threshold: float | None = None,
    top_k: int | None = None,
    tenant: str | None = "user_id",
    filters: list[tuple] = (),
    payload: tuple[str, ...] = PAYLOAD,
    way: str = "broadcast",
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
    point_block: int = POINT_BLOCK,
    query_block_size: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact top-k: (query_id, rank, score, payload ...).

    ``way`` is "broadcast" for up to ``max_broadcast_queries`` questions or "blocks" for any number. Questions without a
    vector or tenant, or with a top_k below 1, have no hits; ``rejected_questions`` lists them.

    A question sees only points of its own ``tenant`` value and, if it brings
    ``doc_ids``, only those documents. ``threshold`` is a lower bound for
    similarities (0 if not given) and an upper bound for distances. Scores are compared
    with six digits; equal scores rank by chunk_id.
    """
    payload = list(dict.fromkeys(["chunk_id", *payload]))
    points = apply_filters(points, list(filters))
    threshold = _bound(metric, threshold)
    asked = _prepared(queries, tenant, top_k).filter(_reason().isNull())
    if way == "broadcast":
        # The bounded fetch never brings more than the limit to the driver.
        rows = asked.limit(max_broadcast_queries + 1).collect()
        if len(rows) > max_broadcast_queries:
            raise ValueError(f"more than {max_broadcast_queries} questions: use way='blocks'")
        hits = _scan_with_broadcast(points, rows, tenant, payload, metric, threshold)
        return _ranked(hits, metric, max((r["top_k"] for r in rows), default=0))
    if way != "blocks":
        raise ValueError(f"no such way: {way}")
    keyed = points.filter("vector is not null").withColumn("_tenant", F.col(tenant) if tenant else F.lit(""))
    hits = _block_join(keyed, asked, ["_tenant"], payload, metric, threshold, point_block, query_block_size)
    return _ranked(hits, metric, _largest_top_k(asked))


def _largest_top_k(asked: DataFrame) -> int:
    return asked.agg(F.max("top_k")).first()[0] or 0


def fit_lists(points: DataFrame, lists: int, seed: int = 7, iterations: int = 10):
    """K-means over unit vectors; the model is ``lists`` centres, whatever the data size."""
    from pyspark.ml.clustering import KMeans

    return KMeans(k=lists, seed=seed, maxIter=iterations, featuresCol="unit", predictionCol="_list").fit(
        _with_unit(points).select("unit")
    )


def _with_unit(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    dense = rows.withColumn("_dense", array_to_vector(F.col("vector").cast("array<double>")))
    return Normalizer(inputCol="_dense", outputCol="unit").transform(dense).drop("_dense")


def assign_lists(points: DataFrame, model) -> DataFrame:
    """Points with the number of their nearest centre in ``_list``."""
    return model.transform(_with_unit(points)).drop("unit")


def save_lists(listed: DataFrame, path: str) -> None:
    """Store the points by list: assigned once, and lists no question probes are not read."""
    listed.hint("rebalance", "_list").write.mode("overwrite").partitionBy("_list").parquet(path)


def knn_approx(
    listed_points: DataFrame,
    model,
    queries: DataFrame,
    probes: int = 4,
    metric: str = "cosine",
    threshold: float | None = None,
    top_k: int | None = None,
    tenant: str | None = "user_id",
    payload: tuple[str, ...] = PAYLOAD,
    point_block: int = POINT_BLOCK,
    query_block_size: int = QUERY_BLOCK,
) -> DataFrame:
    """Top-k among the ``probes`` lists nearest to each question, re-scored exactly.

    Lists are found by ``assign_lists`` (store them with ``save_lists``); probing all of them
    gives the exact result.
    A crowded list is cut into blocks like a crowded tenant.
    """
    payload = list(dict.fromkeys(["chunk_id", *payload]))
    centres = np.array(model.clusterCenters())
    asked = _prepared(queries, tenant, top_k).filter(_reason().isNull())
    probes = min(probes, len(centres))

    from folioflow.operators.listindex import nearest_lists

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            lists = nearest_lists(as_matrix(table.column("vector")), centres, probes)
            repeated = table.take(pa.array(np.repeat(np.arange(len(lists)), probes)))
            yield from repeated.append_column(
                "_list", pa.array(lists.ravel().astype(np.int32))
            ).to_batches()

    schema = T.StructType([*asked.schema.fields, T.StructField("_list", T.IntegerType())])
    probed = asked.mapInArrow(nearest, schema)
    # List numbers are few; as values they keep the scan from lists that no question probes.
    wanted = [r["_list"] for r in probed.select("_list").distinct().collect()]
    listed_points = listed_points.filter(F.col("_list").isin(wanted))
    keyed = listed_points.filter("vector is not null").withColumn(
        "_tenant", F.col(tenant) if tenant else F.lit("")
    )
    hits = _block_join(
        keyed, probed, ["_tenant", "_list"], payload, metric, _bound(metric, threshold),
        point_block, query_block_size,
    )
    return _ranked(hits, metric, _largest_top_k(asked))


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, one row."""
    found = approx.select("query_id", "chunk_id").withColumn("found", F.lit(1))
    return exact.join(found, ["query_id", "chunk_id"], "left").agg(
        F.count("*").alias("exact_hits"),
        F.count("found").alias("found_hits"),
        (F.count("found") / F.greatest(F.count("*"), F.lit(1))).alias("recall"),
    )


def format_hits(hits: DataFrame) -> DataFrame:
    """(query_id, rank, chunk_id, text, score, metadata) as the search tool returns them."""
    return hits.select(
        "query_id", "rank", "chunk_id", "text", "score",
        F.struct("doc_id", "user_id", "filename").alias("metadata"),
    )
