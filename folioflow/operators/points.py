"""The vector table: typed points with a version-5 UUID per chunk."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folioflow.functions import ids
from folioflow.operators import merge, retrieval
from folioflow.operators.embedding import Provider, embed_chunks
from folioflow.operators.snapshots import BUCKETS, SnapshotTable
from folioflow.sources.files import delete_folder

METRICS = ("cosine", "euclidean", "dot")


def metric_or_default(distance: str) -> str:
    return distance if distance in METRICS else "cosine"


def create_collection(
    spark: SparkSession, path: str, dim: int, distance: str = "cosine", buckets: int = BUCKETS
) -> dict:
    """Record size, metric and bucket count of a new collection; an existing one is returned as it is.

    Points lie in buckets of their doc_id, beside the documents if these are bucketed alike.
    """
    made = SnapshotTable.create(spark, path, "doc_id", "point_id", buckets, dim=dim, metric=metric_or_default(distance))
    return made.snapshot().meta


def checked_vector(dim: int) -> Column:
    """The vector, or a task error that names the point with the wrong size."""
    wrong = F.concat(F.lit(f"vector size is not {dim}: "), F.col("chunk_id"))
    return F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(wrong))


def build_points(embedded: DataFrame) -> DataFrame:
    """Points of all successfully embedded chunks, payload as plain columns; the page is null where it isn't known."""
    page = F.col("page_number") if "page_number" in embedded.columns else F.lit(None).cast("int")
    return embedded.filter(F.col("vector").isNotNull()).select(
        ids.point_id(F.col("chunk_id")).alias("point_id"),
        "chunk_id", "doc_id", "user_id", "filename", "chunk_index", page.alias("page_number"), "text", "vector",
    )


def upsert_points(current: DataFrame, incoming: DataFrame, seq: str | None = None) -> DataFrame:
    """Insert or replace by point id; with ``seq`` the last write of an id wins."""
    if seq:
        incoming = merge.latest_by_key(incoming, "point_id", seq)
    return merge.put_rows(current, incoming, "point_id")


def delete_points(current: DataFrame, keys: DataFrame) -> DataFrame:
    return merge.delete_rows(current, keys, "point_id")


def reindex_docs(current: DataFrame, rebuilt: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Replace all points of the rebuilt documents.

    Points of chunks that no longer exist go as well; a plain upsert keeps them. ``docs``
    (doc_id) names the documents, so that one without any chunks left loses its points too; by
    default they are those of the ``rebuilt`` rows.
    """
    docs = (rebuilt if docs is None else docs).select("doc_id").distinct()
    kept = current.join(docs, "doc_id", "left_anti").select(*current.columns)
    return kept.unionByName(rebuilt.select(*current.columns))


def save_points(
    spark: SparkSession, path: str, incoming: DataFrame, dim: int | None = None, order: str | None = None, append: bool = False
) -> None:
    """Upsert into the stored collection at ``path`` (made with ``dim`` if there is none): of the rows of one point the
    last in ``order`` wins. ``append`` adds a layer instead of merging, which costs only the incoming rows."""
    table = SnapshotTable(spark, path)
    if not table.exists():
        create_collection(spark, path, dim)
    ready = incoming.withColumn("vector", checked_vector(table.snapshot().meta["dim"]))
    table.upsert(ready, order, append=append)


def load_points(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return SnapshotTable(spark, path).read(version)


def search_points(
    spark: SparkSession, path: str, queries: DataFrame, documents: SnapshotTable | None = None, **options
) -> DataFrame:
    """Exact top-k in the stored collection by its own metric (see ``retrieval.knn``).

    With the stored ``documents`` only those that can be searched; where these have as many buckets of doc_id
    the vectors stay in their tasks.
    """
    table = SnapshotTable(spark, path)
    snap = table.snapshot()
    points = table.read(snap.version)
    if documents is not None:
        points = retrieval.filter_searchable(points, documents.read())
    return retrieval.knn(points, queries, metric=snap.meta["metric"], **options)


def delete_stored(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Delete points of the stored collection by doc_id, or by doc_id and point_id if ``keys`` has both."""
    SnapshotTable(spark, path).delete(keys)


def reindex_stored(
    spark: SparkSession, path: str, chunks: DataFrame, provider: Callable[[], Provider], docs: DataFrame | None = None,
    **embed_options,
) -> dict:
    """Replace all points of the chunks' documents (or of ``docs``), embedding only texts that are new to their document.

    A chunk whose text the document had before, under whatever id, keeps that vector. Only the buckets of these documents
    are read. Returns how many chunks there were, how many were embedded and how many failed; if any failed, the
    stored points stay as they are.
    """
    table = SnapshotTable(spark, path)
    snap = table.snapshot()
    named = (chunks if docs is None else docs).select("doc_id").distinct()
    if snap.live:
        digest = F.sha2("text", 256).alias("_digest")
        had = table.read(snap.version, named).select("doc_id", digest, F.col("vector").alias("_vector"))
        first = Window.partitionBy("doc_id", "_digest").orderBy(F.lit(1))
        had = had.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    else:
        had = spark.createDataFrame([], "doc_id string, _digest string, _vector array<float>")
    work = f"{path}/work/{uuid.uuid4().hex}"
    try:
        dealt = chunks.withColumn("_digest", F.sha2("text", 256)).repartition(snap.buckets, "doc_id")
        dealt.join(had, ["doc_id", "_digest"], "left").drop("_digest").write.parquet(f"{work}/matched")
        matched = spark.read.parquet(f"{work}/matched")
        embed_chunks(matched.filter("_vector is null").drop("_vector"), provider, **embed_options).write.parquet(f"{work}/embedded")
        embedded = spark.read.parquet(f"{work}/embedded")
        counts = embedded.agg(F.count("*").alias("embedded"), F.count_if(F.col("vector").isNull()).alias("failed")).first().asDict()
        if not counts["failed"]:
            kept = matched.filter("_vector is not null").withColumnRenamed("_vector", "vector")
            whole = embedded.drop("status", "error").unionByName(kept)
            ready = build_points(whole).withColumn("vector", checked_vector(snap.meta["dim"]))
            table.replace(ready, named)
        return {"chunks": matched.count()} | counts
    finally:
        delete_folder(spark, work)
