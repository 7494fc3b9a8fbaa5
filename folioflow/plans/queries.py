"""The registered queries: one entry per operator, each over whole given tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow import schemas
from folioflow.functions import ids, messages, paths, text as tx
from folioflow.operators import (
    answers, chunking, documents, embedding, extract, newest, points, quality, retrieval,
)
from folioflow.operators.listindex import ListIndex
from folioflow.operators.snapshots import SnapshotTable, buckets_for
from folioflow.plans import views
from folioflow.plans.stages import StageConfig, run_stages
from folioflow.session import work_dir
from folioflow.sources import raw, stages
from folioflow.sources.files import file_system
from folioflow.streaming import jobs, lifecycle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Similarity of hashed texts runs lower than that of a trained model.
TEXT_THRESHOLD = 0.3


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- scans, sources, sinks ----------------------------------------------------------


@query
def scan_raw_files(spark, sf):
    files = raw.read_files(spark, views.stored_files(spark, sf), "*.pdf")
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "length",
        F.length("content").alias("bytes_read"), F.sha2("content", 256).alias("digest"),
    )


@query
def file_manifest(spark, sf):
    return raw.file_manifest(raw.list_files(spark, views.stored_files(spark, sf), "*.pdf"))


@query
def parse_storage_path(spark, sf):
    given = views.extracted(spark, sf).select(F.col("source_path").alias("path")).unionByName(
        views.table(spark, sf, "pages").select(F.col("url").alias("path"))
    )
    return given.select("path", paths.path_parts(F.col("path")).alias("p")).select("path", "p.*")


@query
def scan_extracted(spark, sf):
    path = stages.write_stage(views.extracted(spark, sf), work_dir(spark, "extracted"), "json")
    return stages.read_stage(spark, path, schemas.EXTRACTED, "json").select(
        "doc_id", "user_id", "page_count", "status", "error", F.md5("text").alias("text_md5")
    )


@query
def scan_parquet_stage(spark, sf):
    path = stages.write_stage(views.extracted(spark, sf), work_dir(spark, "extracted"))
    return stages.read_stage(spark, path).select(
        "doc_id", "user_id", "page_count", "status", "error", F.md5("text").alias("text_md5")
    )


@query
def write_extracted(spark, sf):
    done = extract.extract_documents(views.raw_files(spark, sf))
    path = stages.write_stage(done, work_dir(spark, "extracted"))
    return stages.read_stage(spark, path).select("doc_id", "source_path", "page_count", "status")


@query
def write_doc_report(spark, sf):
    report = quality.doc_quality(views.extracted(spark, sf, busy=True))
    path = stages.write_stage(report, work_dir(spark, "report"), "json")
    return stages.read_stage(spark, path, schemas.DOC_REPORT, "json").drop("_corrupt_record")


@query
def write_checkpoint(spark, sf):
    done = embedding.embed_checkpoint(views.text_points(spark, sf))
    path = stages.write_stage(done, work_dir(spark, "checkpoint"), "json")
    return stages.read_stage(spark, path, schemas.CHECKPOINT, "json").select(
        "chunk_id", "doc_id", "user_id", "filename", "chunk_index", "status", F.md5("text").alias("text_md5")
    )


@query
def write_summary(spark, sf):
    summary = cost_estimate(spark, sf)
    path = stages.write_summary(summary, work_dir(spark, "summary"))
    return spark.read.schema(summary.schema).json(path)


@query
def register_uploads(spark, sf):
    return documents.register_uploads(views.upload_requests(spark, sf))


@query
def rejected_uploads(spark, sf):
    return documents.rejected_uploads(views.upload_requests(spark, sf))


@query
def select_preferred_version(spark, sf):
    return documents.select_preferred_version(views.bill_files(spark, sf))


# ---- projections and filters --------------------------------------------------------


@query
def flatten_struct(spark, sf):
    report = views.extracted(spark, sf).select(
        "doc_id",
        F.struct(
            F.length("text").alias("chars"), F.col("page_count").alias("pages"),
            F.struct("status", "error").alias("outcome"),
        ).alias("s"),
    )
    return report.select("doc_id", "s.chars", "s.pages", F.col("s.outcome.status").alias("ocr_status"))


@query
def filter_indexable(spark, sf):
    return extract.filter_indexable(views.extracted(spark, sf)).select(
        "doc_id", "user_id", "page_count", F.length("text").alias("chars")
    )


@query
def filter_failed(spark, sf):
    path = stages.write_stage(views.outcome(spark, sf), work_dir(spark, "extracted"))
    return extract.filter_failed(stages.read_stage(spark, path))


def _stored_report(spark, sf):
    report = quality.doc_quality(views.extracted(spark, sf, busy=True))
    path = stages.write_stage(report, work_dir(spark, "report"))
    return stages.read_stage(spark, path, schemas.DOC_REPORT)


@query
def filter_flagged(spark, sf):
    return quality.filter_flagged(_stored_report(spark, sf))


@query
def filter_searchable(spark, sf):
    known = documents.update_status(views.documents_meta(spark, sf), views.status_events(spark, sf))
    return retrieval.filter_searchable(views.vector_points(spark, sf), known).select(
        "chunk_id", "doc_id", "user_id"
    )


@query
def null_defaults(spark, sf):
    joined = views.table(spark, sf, "documents").join(views.table(spark, sf, "labels"), "doc_id", "left")
    pages = F.when(F.col("quality") == 1, F.ceil(F.col("n_chars") / 1800.0).cast("int"))
    return joined.select(
        F.concat(F.lit("doc_"), "doc_id").alias("doc_id"),
        F.coalesce(pages, F.lit(1)).alias("page_count"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).alias("chars"),
        F.coalesce(F.col("toxic").cast("int"), F.lit(-1)).alias("toxic"),
        F.coalesce(F.when(F.col("quality").isNotNull(), F.col("source")), F.lit("unknown")).alias("user_id"),
    )


# ---- extraction ---------------------------------------------------------------------


@query
def extract_documents(spark, sf):
    return extract.extract_documents(views.raw_files(spark, sf)).select(
        "doc_id", "user_id", "filename", "source_path", "page_count", "status",
        F.col("error").isNotNull().alias("has_error"), F.md5("text").alias("text_md5"),
    )


@query
def join_pages(spark, sf):
    return extract.join_pages(views.pages_text(spark, sf)).select(
        "doc_id", "page_count", F.length("text").alias("chars"), F.md5("text").alias("text_md5")
    )


@query
def extraction_counts(spark, sf):
    return extract.extraction_counts(views.outcome(spark, sf))


# ---- chunking -----------------------------------------------------------------------


@query
def split_clauses(spark, sf):
    return views.extracted(spark, sf, busy=True).select(
        "doc_id", F.posexplode(chunking.split_clauses(F.col("text"))).alias("part_no", "part")
    )


@query
def chunk_clauses(spark, sf):
    return views.chunks(spark, sf).select("doc_id", "chunk_index", "text")


@query
def chunk_fixed(spark, sf):
    return views.chunks(spark, sf, mode="fixed").select("doc_id", "chunk_index", "text")


@query
def chunk_recursive(spark, sf):
    return views.chunks(spark, sf, mode="recursive").select("doc_id", "chunk_index", "text")


@query
def chunk_mode(spark, sf):
    both = [
        views.chunks(spark, sf, mode=mode).groupBy("doc_id").agg(
            F.lit(mode).alias("mode"), F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest")
        )
        for mode in ("clause", "fixed")
    ]
    return both[0].unionByName(both[1])


@query
def chunk_ids(spark, sf):
    return views.chunks(spark, sf).select("chunk_id", "doc_id", "chunk_index")


@query
def explode_chunks(spark, sf):
    return views.chunks(spark, sf)


@query
def chunk_counts(spark, sf):
    return chunking.chunk_counts(extract.filter_indexable(views.extracted(spark, sf, busy=True)))


@query
def chunk_links(spark, sf):
    return views.chunks(spark, sf, links=True).select("chunk_id", "prev_chunk_id", "next_chunk_id")


@query
def chunk_pages(spark, sf):
    """The page on which each chunk begins, lines being the pages, for both ways of chunking."""
    both = [
        views.chunks(spark, sf, mode=mode, pages=True).select(F.lit(mode).alias("mode"), "chunk_id", "page_number")
        for mode in ("clause", "fixed")
    ]
    return both[0].unionByName(both[1])


@query
def chunk_clause_meta(spark, sf):
    return views.chunks(spark, sf, clause_meta=True).select(
        "chunk_id", "clause_number", "section_type", "parent_section"
    )


# ---- scalar functions ---------------------------------------------------------------


@query
def text_length(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.length("text").alias("text_length"))


@query
def word_count(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", tx.word_count(F.col("text")).alias("word_count")
    )


@query
def noise_ratio(spark, sf):
    counted = views.extracted(spark, sf, busy=True).select(
        "doc_id", tx.noise_chars(F.col("text")).alias("noise"),
        F.greatest(F.length("text"), F.lit(1)).alias("chars"),
    )
    rated = tx.with_ratio_milli(counted, "noise", "chars", "milli")
    return rated.select("doc_id", (F.col("milli") / F.lit(1000.0)).alias("noise_ratio"))


@query
def est_chunks(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", tx.est_chunks(F.length("text")).alias("est_chunks")
    )


@query
def quality_flags(spark, sf):
    return quality.doc_quality(views.extracted(spark, sf, busy=True)).select(
        "doc_id", "is_empty", "is_noisy", "needs_review"
    )


@query
def review_reason(spark, sf):
    return quality.doc_quality(views.extracted(spark, sf, busy=True)).select("doc_id", "review_reason")


@query
def point_id(spark, sf):
    return views.chunks(spark, sf).select("chunk_id", ids.point_id(F.col("chunk_id")).alias("point_id"))


@query
def citation_snippet(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", tx.citation_snippet(F.col("text")).alias("snippet")
    )


@query
def percent_label(spark, sf):
    score = F.col("noise_ratio")
    return noise_ratio(spark, sf).select(
        "doc_id", tx.percent_label(score).alias("label"), tx.percent_label(score, 1).alias("label_1")
    )


@query
def status_label(spark, sf):
    return views.status_events(spark, sf).select(
        "event_id", "status", tx.status_label(F.col("status")).alias("label")
    )


def _event_data(spark, sf):
    return views.extracted(spark, sf).select(
        "doc_id",
        F.when(F.length("text") < 100, F.col("filename")).otherwise(
            messages.encode_event(
                doc_id=F.col("doc_id"), user_id=F.col("user_id"), storage_path=F.col("source_path")
            )
        ).alias("data"),
    )


@query
def encode_event(spark, sf):
    return _event_data(spark, sf)


@query
def decode_event(spark, sf):
    sent = _event_data(spark, sf).select(F.col("doc_id").alias("sent_id"), "data")
    return sent.select("sent_id", messages.decode_event(F.col("data")).alias("m")).select("sent_id", "m.*")


@query
def parse_answer_json(spark, sf):
    return answers.parse_replies(views.replies(spark, sf))


# ---- quality report and aggregates --------------------------------------------------


@query
def doc_quality(spark, sf):
    return quality.doc_quality(views.extracted(spark, sf, busy=True))


@query
def corpus_summary(spark, sf):
    summary = quality.corpus_summary(quality.doc_quality(views.extracted(spark, sf, busy=True)))
    return summary.withColumns(
        {c: F.round(c, 6) for c in
         ("avg_pages_per_doc", "avg_text_length", "avg_word_count", "avg_noise_ratio")}
    )


@query
def cost_estimate(spark, sf):
    return quality.cost_estimate(quality.corpus_summary(quality.doc_quality(views.extracted(spark, sf, busy=True))))


@query
def user_breakdown(spark, sf):
    return quality.user_breakdown(quality.doc_quality(views.extracted(spark, sf, busy=True)))


@query
def status_counts(spark, sf):
    return quality.status_counts(views.outcome(spark, sf))


@query
def quality_gate(spark, sf):
    docs = views.extracted(spark, sf)
    passed = quality.quality_gate(docs, enabled=True)
    return passed.select("doc_id", "user_id", "page_count")


# ---- embedding and the vector table -------------------------------------------------


def _nonzero(rows: DataFrame, key: str) -> DataFrame:
    slots = rows.select(key, F.posexplode("vector").alias("slot", "weight"))
    return slots.filter("weight <> 0").select(
        key, "slot", F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


@query
def embed_chunks(spark, sf):
    return _nonzero(
        embedding.embed_chunks(views.chunks(spark, sf), embedding.hashing_embedder(views.DIM)), "chunk_id"
    )


@query
def embed_query(spark, sf):
    return _nonzero(views.embedded_questions(spark, sf), "query_id")


@query
def embed_checkpoint(spark, sf):
    return embedding.embed_checkpoint(views.text_points(spark, sf))


@query
def build_points(spark, sf):
    return views.text_points(spark, sf).select(
        "point_id", "chunk_id", "doc_id", "user_id", "filename", "chunk_index", "text",
        F.size("vector").alias("dim"),
    )


def _labelled_points(spark, sf):
    """Stored points and a rewrite of the labelled documents: two versions, some of it new."""
    stored = views.vector_points(spark, sf).select(
        ids.point_id(F.col("chunk_id")).alias("point_id"), "chunk_id", "doc_id",
        F.col("label").alias("value"),
    )
    labels = views.table(spark, sf, "labels")
    version = F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")
    chunk = F.concat(F.lit("c"), (F.col("doc_id") * 2).cast("string"))
    incoming = labels.select("doc_id", "quality", "toxic", version).select(
        ids.point_id(chunk).alias("point_id"), chunk.alias("chunk_id"),
        F.concat(F.lit("doc_"), (F.col("doc_id") % 50).cast("string")).alias("doc_id"),
        (100 * F.col("seq") + 10 * F.col("quality") + F.col("toxic")).cast("int").alias("value"),
        "seq",
    )
    return stored, incoming


@query
def upsert_points(spark, sf):
    stored, incoming = _labelled_points(spark, sf)
    return points.upsert_points(stored, incoming, "seq")


@query
def upsert_points_stored(spark, sf):
    """The same through the stored table: write, upsert, upsert again."""
    stored, incoming = _labelled_points(spark, sf)
    table = SnapshotTable.create(spark, work_dir(spark, "points"), "point_id", buckets=8)
    table.upsert(stored)
    for _ in range(2):
        table.upsert(incoming, order="seq")
    return table.read().select(*stored.columns)


@query
def delete_points(spark, sf):
    stored, incoming = _labelled_points(spark, sf)
    return points.delete_points(stored, incoming)


@query
def reindex_doc(spark, sf):
    """Clause chunks replaced by fixed-size chunks for documents with a good quality label."""
    columns = ["chunk_id", "doc_id", "user_id", "chunk_index", "text"]
    stored = views.chunks(spark, sf).select(*columns)
    good = views.table(spark, sf, "labels").filter("quality = 1").select(
        F.concat(F.lit("doc_"), "doc_id").alias("doc_id")
    )
    rebuilt = views.chunks(spark, sf, mode="fixed").join(good, "doc_id", "left_semi").select(*columns)
    return points.reindex_docs(stored, rebuilt, docs=good)


def _stored_collection(spark, sf, metric):
    """All vector points in a stored collection with that metric, with their document table bucketed alike."""
    path, vectors = work_dir(spark, "collection"), views.vector_points(spark, sf)
    dim, held = vectors.select(F.max(F.size("vector")), F.sum(F.size("vector"))).first()
    buckets = buckets_for(4 * (held or 0))
    points.create_collection(spark, path, dim, metric, buckets=buckets)
    points.save_points(spark, path, vectors.withColumn("point_id", ids.point_id(F.col("chunk_id"))))
    known = documents.update_status(views.documents_meta(spark, sf), views.status_events(spark, sf))
    docs = SnapshotTable.create(spark, work_dir(spark, "documents"), "doc_id", buckets=buckets)
    docs.upsert(known.select("doc_id", "status"))
    return path, docs


@query
def collection_search(spark, sf):
    """Search by the collection's own metric, among documents that can be searched."""
    path, docs = _stored_collection(spark, sf, "euclidean")
    return points.search_points(spark, path, views.vector_queries(spark, sf), docs, threshold=1.3, way="blocks")


@query
def collection_delete(spark, sf):
    """What is left after documents, and then single points, were deleted."""
    path, docs = _stored_collection(spark, sf, "cosine")
    points.delete_stored(spark, path, docs.read().filter("status = 'ocr_failed'").select("doc_id"))
    points.delete_stored(spark, path, points.load_points(spark, path).filter("label = 3").select("doc_id", "point_id"))
    return points.load_points(spark, path).select("point_id", "chunk_id", "doc_id", "label")


@query
def collection_reindex(spark, sf):
    """``reindex_doc`` in the stored collection: texts a document had before keep their vectors."""
    path = work_dir(spark, "collection")
    points.create_collection(spark, path, views.DIM, buckets=buckets_for(views.text_point_bytes(spark, sf)))
    points.save_points(spark, path, views.text_points(spark, sf))
    good = views.table(spark, sf, "labels").filter("quality = 1").select(
        F.concat(F.lit("doc_"), "doc_id").alias("doc_id")
    )
    rebuilt = views.chunks(spark, sf, mode="fixed", pages=True).join(good, "doc_id", "left_semi")
    points.reindex_stored(spark, path, rebuilt, embedding.hashing_embedder(views.DIM), docs=good)
    return points.load_points(spark, path).select("chunk_id", "doc_id", "user_id", "chunk_index", "text")


@query
def create_collection(spark, sf):
    """Vector sizes found in the stored collection against its recorded size and metric."""
    path = work_dir(spark, "collection")
    dim = views.vector_points(spark, sf).select(F.max(F.size("vector")).alias("d")).first()["d"]
    points.create_collection(spark, path, dim, "cosine")
    kept = points.create_collection(spark, path, dim + 1, "dot")
    ready = views.vector_points(spark, sf).withColumn("vector", points.checked_vector(kept["dim"]))
    return ready.groupBy(F.size("vector").alias("dim")).agg(
        F.count("*").alias("points"), F.lit(kept["metric"]).alias("metric")
    )


# ---- retrieval ----------------------------------------------------------------------


def _knn(spark, sf, **options):
    """All vectors are questions: their number grows with the table, so they are not broadcast."""
    return retrieval.knn(
        views.vector_points(spark, sf), views.vector_queries(spark, sf), way="blocks", **options
    )


@query
def knn_cosine(spark, sf):
    return _knn(spark, sf)


@query
def knn_cosine_blocks(spark, sf):
    """The same cut into many small blocks."""
    return _knn(spark, sf, point_block=256, query_block_size=128)


@query
def knn_rejected(spark, sf):
    """Questions that a search leaves out, with the reason."""
    asked = views.vector_queries(spark, sf).withColumns(
        {
            "top_k": (F.col("vec_id") % 20 - 2).cast("int"),
            "vector": F.when(F.col("label") != 4, F.col("vector")),
            "user_id": F.when(F.col("label") != 5, F.col("user_id")),
        }
    )
    return retrieval.rejected_questions(asked)


@query
def knn_dot(spark, sf):
    queries = views.vector_queries(spark, sf).withColumn("top_k", (1 + F.col("vec_id") % 20).cast("int"))
    return retrieval.knn(views.vector_points(spark, sf), queries, metric="dot", way="blocks")


@query
def knn_euclidean(spark, sf):
    return _knn(spark, sf, metric="euclidean", threshold=1.3)


@query
def filter_eq(spark, sf):
    return _knn(spark, sf, filters=[("label", "eq", 3)], threshold=0.1)


@query
def filter_in(spark, sf):
    number = F.col("vec_id") % 50
    docs = F.array(*[F.concat(F.lit("doc_"), ((number + i) % 50).cast("string")) for i in range(10)])
    queries = views.vector_queries(spark, sf).withColumn(
        "doc_ids",
        F.when(F.col("label") % 2 == 0, docs).when(F.col("label") == 1, F.array().cast("array<string>")),
    )
    return retrieval.knn(views.vector_points(spark, sf), queries, way="blocks")


@query
def filter_range(spark, sf):
    return _knn(spark, sf, filters=[("label", "gt", 2), ("label", "lte", 7)])


@query
def score_threshold(spark, sf):
    return _knn(spark, sf, threshold=0.2)


@query
def top_k_bounds(spark, sf):
    asked = views.table(spark, sf, "conversations").select(
        F.concat_ws("_", F.lit("q"), "conv_id", "turn").alias("query_id"),
        F.col("text").alias("query_text"),
        F.when(F.col("role") == "user", F.concat(F.lit("u"), "conv_id")).otherwise("bot").alias("user_id"),
        F.when(F.col("conv_id") % 30 != 7, (F.col("conv_id") % 30).cast("int")).alias("top_k"),
    )
    return retrieval.check_queries(asked).select("query_id", "user_id", "top_k", "reject_reason")


def _text_hits(spark, sf):
    return retrieval.knn(
        views.text_points(spark, sf), views.embedded_questions(spark, sf), threshold=TEXT_THRESHOLD,
        payload=("chunk_id", "doc_id", "user_id", "filename", "text", "page_number"),
    )


@query
def format_hits(spark, sf):
    return retrieval.format_hits(_text_hits(spark, sf)).select(
        "query_id", "rank", "chunk_id", "text", "score", "metadata.*"
    )


def _list_index(spark, sf, **options):
    """All vector points in a list index, half of them inserted after it was made."""
    stored = views.vector_points(spark, sf)
    later = F.col("label") % 2 == 1
    index = ListIndex.create(spark, work_dir(spark, "lists"), stored.filter(~later), buckets=8, **options)
    index.insert(stored.filter(later))
    return index


@query
def knn_approx(spark, sf):
    """The nearest lists alone, the first vectors of the table being the centres."""
    centres = views.table(spark, sf, "embeddings").filter("vec_id < 16").select(
        F.col("vec_id").alias("list"), F.col("embedding").alias("vector")
    )
    return _list_index(spark, sf, centres=centres).search(views.vector_queries(spark, sf), probes=6)


@query
def knn_approx_all_lists(spark, sf):
    """Probing every list must give the exact hits, also after crowded lists were split."""
    index = _list_index(spark, sf, lists=8)
    index.split(limit=max(index.sizes().values()) - 1)
    return index.search(views.vector_queries(spark, sf), probes=len(index.centres()))


# ---- answers ------------------------------------------------------------------------


@query
def build_context(spark, sf):
    return answers.build_context(_text_hits(spark, sf))


@query
def build_citations(spark, sf):
    cited = answers.build_citations(_text_hits(spark, sf))
    return cited.select("query_id", F.posexplode("citations").alias("position", "c")).select(
        "query_id", "position", "c.*"
    )


@query
def answer_confidence(spark, sf):
    found = answers.answer_confidence(views.questions(spark, sf), _text_hits(spark, sf))
    return found.withColumn("confidence", F.round("confidence", 6))


@query
def confidence_band(spark, sf):
    return _text_hits(spark, sf).select(
        "query_id", "rank", tx.confidence_band(F.col("score")).alias("band"),
        tx.percent_label(F.col("score")).alias("label"),
    )


@query
def build_prompts(spark, sf):
    return answers.build_prompts(views.questions(spark, sf), answers.build_context(_text_hits(spark, sf)))


@query
def clause_prompts(spark, sf):
    return answers.clause_prompts(views.chunks(spark, sf))


@query
def compare_prompts(spark, sf):
    """Each chunk against the one before it in its document."""
    pairs = views.chunks(spark, sf, before=True).filter("prev_text is not null")
    return answers.compare_prompts(pairs.select("chunk_id", F.col("prev_text").alias("clause_a"), F.col("text").alias("clause_b")))


def counting_completer():
    """Stand-in for a chat model: a JSON reply that states the size of the prompt."""

    def complete(prompts: list[str]) -> list[str]:
        return [json.dumps({"answer": f"prompt of {len(p)} characters"}) for p in prompts]

    return complete


@query
def complete_prompts(spark, sf):
    return answers.parse_replies(
        answers.complete_prompts(build_prompts(spark, sf), counting_completer)
    )


@query
def assemble_results(spark, sf):
    # Hits feed the prompts, the citations and the confidence: found once, read thrice.
    path = stages.write_stage(_text_hits(spark, sf), work_dir(spark, "hits"))
    hits, asked = spark.read.parquet(path), views.questions(spark, sf)
    prompts = answers.build_prompts(asked, answers.build_context(hits))
    results = answers.assemble_results(
        asked, hits, answers.complete_prompts(prompts, counting_completer), model="counting"
    )
    return results.select(
        "query_id", "query", "answer", F.size("citations").alias("citations"), "reasoning",
        F.round("confidence", 6).alias("confidence"),
        F.element_at("metadata", "chunks_retrieved").alias("chunks_retrieved"),
        F.element_at("metadata", "model").alias("model"), "status",
    )


# ---- document table -----------------------------------------------------------------

_FLAT = [
    "doc_id", "user_id", "status", "metadata.filename", "metadata.file_size", "metadata.page_count",
    "storage_path", "ocr_result_path", "created_at", "updated_at", "error_message",
]


@query
def documents_put(spark, sf):
    known = views.documents_meta(spark, sf)
    again = views.table(spark, sf, "labels").select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"))
    replaced = known.join(again, "doc_id", "left_semi").withColumns(
        {"status": F.lit("ready"), "retry_count": F.lit(1)}
    )
    extra = views.uploaded_documents(spark, sf)
    return documents.documents_put(known, replaced.unionByName(extra)).select(*_FLAT, "retry_count")


@query
def documents_get(spark, sf):
    wanted = views.status_events(spark, sf).select("doc_id").distinct()
    return documents.documents_get(views.documents_meta(spark, sf), wanted).select(*_FLAT)


@query
def update_status(spark, sf):
    return documents.update_status(
        views.documents_meta(spark, sf), views.status_events(spark, sf)
    ).select(*_FLAT)


@query
def patch_nested(spark, sf):
    return documents.patch_extracted(
        views.documents_meta(spark, sf), views.extracted(spark, sf)
    ).select(*_FLAT)


@query
def list_by_user(spark, sf):
    return documents.list_by_user(views.uploaded_documents(spark, sf)).select(
        "user_id", "position", "doc_id", "created_at"
    )


@query
def list_for_user(spark, sf):
    return documents.list_for_user(views.uploaded_documents(spark, sf), "u3").select(
        "doc_id", "user_id", "created_at"
    )


@query
def list_all_for_user(spark, sf):
    return documents.list_for_user(views.uploaded_documents(spark, sf), "u3", limit=None).select(
        "doc_id", "user_id", "created_at"
    )


@query
def recent_uploads(spark, sf):
    return documents.recent_uploads(views.uploaded_documents(spark, sf)).select(
        "doc_id", "user_id", "created_at"
    )


@query
def documents_delete(spark, sf):
    gone = views.table(spark, sf, "labels").select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"))
    return documents.documents_delete(views.documents_meta(spark, sf), gone).select(*_FLAT)


@query
def lifecycle_check(spark, sf):
    return documents.lifecycle_check(views.status_events(spark, sf))


# ---- streams and runs ---------------------------------------------------------------


def _stream(spark, sf, name):
    """A given table, one file or a folder of files, as a stream of its files."""
    path = f"{sf}/{name}.parquet"
    reader = spark.readStream.schema(views.table(spark, sf, name).schema)
    system, place = file_system(spark, path)
    if system.getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query
def stream_uploads(spark, sf):
    base = work_dir(spark, "uploads")
    request = F.when(
        F.col("event_type") == "error", F.concat(F.lit("/complete/"), "user_id")
    ).otherwise(F.concat(F.lit("/complete/doc_"), "user_id", F.lit("/")))
    requests = _stream(spark, sf, "events").select("event_id", request.alias("path"))
    labelled = views.table(spark, sf, "labels").select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"))
    known = views.documents_meta(spark, sf).join(labelled, "doc_id", "left_semi")
    jobs.stream_uploads(requests, known, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@query
def stream_extract(spark, sf):
    base = work_dir(spark, "extract")
    files = views.raw_files_from(_stream(spark, sf, "documents"))
    jobs.stream_extract(files, f"{base}/out", f"{base}/status", f"{base}/checkpoint")
    done = spark.read.parquet(f"{base}/out/extracted").select(
        "doc_id", "page_count", F.md5("text").alias("text_md5")
    )
    status = jobs.read_status(spark, f"{base}/status").select("doc_id", "user_id", "status")
    sent = spark.read.parquet(f"{base}/out/messages").select("doc_id", "data")
    return done.join(status, "doc_id").join(sent, "doc_id", "left")


@query
def stream_index(spark, sf):
    base = work_dir(spark, "index")
    docs = views.extracted_from(spark, _stream(spark, sf, "documents"))
    points.create_collection(spark, f"{base}/collection", views.DIM, buckets=buckets_for(views.text_point_bytes(spark, sf)))
    jobs.stream_index(
        docs, f"{base}/collection", f"{base}/status", f"{base}/checkpoint",
        embedding.hashing_embedder(views.DIM), views.DIM,
    )
    stored = points.load_points(spark, f"{base}/collection").groupBy("doc_id").agg(
        F.count("*").alias("points"), F.sum(F.length("text")).alias("chars")
    )
    status = jobs.read_status(spark, f"{base}/status").select("doc_id", "status")
    return status.join(stored, "doc_id", "left")


@query
def stream_status(spark, sf):
    base = work_dir(spark, "status")
    events = views.status_events_from(spark, _stream(spark, sf, "events"))
    jobs.stream_status(events, f"{base}/table", f"{base}/checkpoint")
    newest.compact(spark, f"{base}/table", "doc_id", jobs.EVENT_ORDER)
    return newest.read_newest(spark, f"{base}/table", "doc_id", jobs.EVENT_ORDER).select(
        "doc_id", "event_id", "status", "updated_at", "error_message"
    )


@query
def stream_lifecycle(spark, sf):
    """Impossible changes, and documents that stood still for a day, found as the events stream in."""
    base = work_dir(spark, "lifecycle")
    events = views.status_events_from(spark, _stream(spark, sf, "events"))
    jobs.append_files(lifecycle.watch_documents(events, "1 day"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query
def stream_dedupe(spark, sf):
    """Every event delivered twice; one of each is kept."""
    base = work_dir(spark, "dedupe")
    events = views.status_events_from(spark, _stream(spark, sf, "events"))
    delivered = events.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    timed = delivered.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    jobs.append_files(
        jobs.dedupe_events(timed, ["event_id"]), f"{base}/out", f"{base}/checkpoint"
    )
    return spark.read.parquet(f"{base}/out").select("event_id", "doc_id", "status")


@query
def poll_trigger(spark, sf):
    """New files are picked up once, however often the job is started."""
    base, folder = work_dir(spark, "poll"), views.stored_files(spark, sf)
    for _ in range(2):
        jobs.poll_files(spark, folder, f"{base}/out", "*.pdf")
    return spark.read.parquet(f"{base}/out").select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "length"
    )


@query
def run_outcomes(spark, sf):
    outcome = extract.run_extractor(views.raw_files(spark, sf))
    log = documents.run_log(outcome, "extract", "path")
    return documents.run_outcomes(log).select(
        "stage", "status", "units", "errors",
        (F.col("p95_ms") >= F.col("p50_ms")).alias("quantiles_ordered"),
    )


def _event_log(spark, sf):
    """Run records made of the given events: value is the duration."""
    return views.table(spark, sf, "events").select(
        F.when(F.col("event_type").isin("view", "error"), "extract").otherwise("embed").alias("stage"),
        F.col("event_id").cast("string").alias("unit_id"),
        F.when(F.col("event_type") == "error", "failed").when(
            F.col("event_type") == "signup", "timeout").otherwise("success").alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.col("value").alias("duration_ms"), F.col("ts").cast("date").alias("day"),
    )


@query
def run_log_stats(spark, sf):
    return documents.run_outcomes(_event_log(spark, sf))


@query
def run_quantiles(spark, sf):
    """Outcomes from the stored sketches of every day: counts, and whether the quantiles are as near as promised."""
    path = stages.write_stage(documents.run_sketches(_event_log(spark, sf), "day"), work_dir(spark, "sketches"))
    merged = documents.outcomes_of(spark.read.parquet(path))
    both = _event_log(spark, sf).join(merged, ["stage", "status"])
    within = lambda name, share: F.max(
        F.when(F.col("below_" + name) <= share * F.col("n") + F.col("slack"), 1).otherwise(0)
        * F.when(F.col("upto_" + name) >= share * F.col("n") - F.col("slack"), 1).otherwise(0)
    ).alias(f"{name}_within")
    ranks = both.groupBy("stage", "status", "units", "errors").agg(
        F.count("duration_ms").alias("n"), (1 + documents.RANK_ERROR * F.count("duration_ms")).alias("slack"),
        *[F.count_if(F.col("duration_ms") < F.col(f"{p}_ms")).alias(f"below_{p}") for p in ("p50", "p95")],
        *[F.count_if(F.col("duration_ms") <= F.col(f"{p}_ms")).alias(f"upto_{p}") for p in ("p50", "p95")],
    )
    return ranks.groupBy("stage", "status", "units", "errors").agg(within("p50", 0.5), within("p95", 0.95))


@query
def run_all_stages(spark, sf):
    """Extract, analyze and embed on all documents; the counts each stage reports."""
    base = work_dir(spark, "run")
    cfg = StageConfig(input="", output=base, dim=views.DIM, buckets=buckets_for(views.text_point_bytes(spark, sf)))
    run_stages(spark, cfg, files=views.raw_files(spark, sf))
    done = spark.read.parquet(cfg.path("extracted")).groupBy("user_id").agg(
        F.count("*").alias("docs"), F.sum("page_count").alias("pages")
    )
    report = spark.read.parquet(cfg.path("analysis/doc_report")).groupBy("user_id").agg(
        F.count_if("needs_review").alias("flagged")
    )
    stored = points.load_points(spark, cfg.path("collection")).groupBy("user_id").agg(
        F.count("*").alias("points"), F.sum(F.length("text")).alias("chars")
    )
    return done.join(report, "user_id").join(stored, "user_id", "left")
