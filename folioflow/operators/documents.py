"""The document table: intake, status changes, listings, lifecycle checks, run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.functions import ids, paths
from folioflow.operators.merge import delete_rows, latest_by_key, put_rows

MAX_FILE_SIZE = 50 * 1024 * 1024
DEFAULT_MIME = "application/pdf"
LIST_LIMIT = 100

# Status changes the flow can produce, as "from>to".
TRANSITIONS = (
    "uploaded>ocr_processing",
    "ocr_processing>ocr_completed",
    "ocr_processing>ocr_failed",
    "ocr_completed>indexing",
    "indexing>indexed",
    "indexing>index_failed",
    "indexed>ready",
)


def check_uploads(requests: DataFrame) -> DataFrame:
    """Requests (user_id, filename, file_size, mime_type, upload_time) with a reject_reason."""
    def missing(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == "")

    mime = F.coalesce("mime_type", F.lit(DEFAULT_MIME))
    no_size = F.coalesce(F.col("file_size"), F.lit(0)) == 0
    reason = (
        F.when(missing("user_id") | missing("filename") | no_size, "Missing required fields")
        .when(~F.contains(mime, F.lit("pdf")), "Only PDF files are supported")
        .when(F.col("file_size") > MAX_FILE_SIZE, "File size must be less than 50MB")
    )
    return requests.withColumn("mime_type", mime).withColumn("reject_reason", reason)


def register_uploads(requests: DataFrame) -> DataFrame:
    """Accepted requests with doc_id, storage_path and status ``uploaded``.

    Ids are derived from the request, so a repeated intake gives the same rows. Requests of one user for one file at
    one time are one upload, the largest of them.
    """
    doc_id = ids.upload_doc_id(F.col("user_id"), F.col("filename"), F.col("upload_time"))
    accepted = check_uploads(requests).filter("reject_reason is null").withColumn("doc_id", doc_id)
    return (
        latest_by_key(accepted, "doc_id", ["file_size", "mime_type"])
        .select(
            "doc_id", "user_id", "filename", "file_size", "mime_type", "upload_time",
            F.concat_ws("/", F.lit("raw"), "user_id", "doc_id", "filename").alias("storage_path"),
            F.lit("uploaded").alias("status"),
        )
    )


def rejected_uploads(requests: DataFrame) -> DataFrame:
    return check_uploads(requests).filter("reject_reason is not null")


def new_documents(accepted: DataFrame) -> DataFrame:
    """Full document records of accepted uploads."""
    nothing = F.lit(None)
    return accepted.select(
        "doc_id", "user_id", "status",
        F.struct(
            "filename", "file_size", "mime_type", "upload_time",
            nothing.cast("int").alias("page_count"), nothing.cast("string").alias("language"),
            F.create_map().cast("map<string,string>").alias("custom"),
        ).alias("metadata"),
        "storage_path",
        nothing.cast("string").alias("ocr_result_path"),
        nothing.cast("string").alias("layout_result_path"),
        nothing.cast("string").alias("chunks_path"),
        F.col("upload_time").alias("created_at"),
        F.col("upload_time").alias("updated_at"),
        nothing.cast("string").alias("error_message"),
        F.lit(0).alias("retry_count"),
    )


def select_preferred_version(files: DataFrame) -> DataFrame:
    """Per bill the file with the most wanted version; other names are ignored."""
    rank = paths.bill_version_rank(F.col("path"))
    bills = files.select(
        paths.bill_number(F.col("path")).alias("bill"), "path", rank.alias("rank")
    ).filter("rank > 0")
    return bills.groupBy("bill").agg(
        F.min_by("path", F.struct("rank", "path")).alias("path"), F.min("rank").alias("rank")
    )


def documents_put(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    return put_rows(documents, incoming, "doc_id", "updated_at")


def documents_get(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted doc_id; columns are null where no record exists."""
    return wanted.select("doc_id").join(documents, "doc_id", "left")


def documents_delete(documents: DataFrame, keys: DataFrame) -> DataFrame:
    return delete_rows(documents, keys, "doc_id")


def latest_status(events: DataFrame) -> DataFrame:
    """Newest event per document, later event id winning on equal times."""
    return latest_by_key(events, "doc_id", ["updated_at", "event_id"])


def update_status(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Patch status and updated_at by the newest event, error_message only if one is given."""
    new = latest_status(events).select(
        "doc_id", F.col("status").alias("_status"), F.col("updated_at").alias("_at"),
        F.col("error_message").alias("_error"),
    )
    return (
        documents.join(new, "doc_id", "left")
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "updated_at": F.coalesce("_at", "updated_at"),
                "error_message": F.coalesce(F.nullif("_error", F.lit("")), "error_message"),
            }
        )
        .select(*documents.columns)
    )


def patch_extracted(documents: DataFrame, extracted: DataFrame) -> DataFrame:
    """Set metadata.page_count (1 if unknown), ocr_result_path and status of extracted documents."""
    done = extracted.filter("status = 'success'").select(
        "doc_id", F.coalesce("page_count", F.lit(1)).alias("_pages")
    )
    hit = F.col("_pages").isNotNull()
    path = F.concat(F.lit("processed/"), F.col("doc_id"), F.lit("/ocr_result.json"))
    pages = F.coalesce("_pages", F.col("metadata.page_count"))
    return (
        documents.join(done, "doc_id", "left")
        .withColumns(
            {
                "metadata": F.col("metadata").withField("page_count", pages),
                "ocr_result_path": F.when(hit, path).otherwise(F.col("ocr_result_path")),
                "status": F.when(hit, "ocr_completed").otherwise(F.col("status")),
            }
        )
        .select(*documents.columns)
    )


def list_for_user(documents: DataFrame, user_id: str, limit: int | None = LIST_LIMIT) -> DataFrame:
    """One user's documents, newest first; ``limit=None`` gives all of them unordered."""
    mine = documents.filter(F.col("user_id") == user_id)
    return mine if limit is None else mine.orderBy(F.desc("created_at"), "doc_id").limit(limit)


def list_by_user(documents: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The newest ``limit`` documents of every user.

    The rank filter is pushed into each task before the shuffle, so a user with a third of all
    documents sends ``limit`` rows per task.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "doc_id")
    return documents.withColumn("position", F.row_number().over(newest)).filter(
        F.col("position") <= limit
    )


def recent_uploads(documents: DataFrame, limit: int = 10) -> DataFrame:
    return documents.orderBy(F.desc("created_at"), "doc_id").limit(limit)


def lifecycle_check(events: DataFrame, slice_unit: str = "hour") -> DataFrame:
    """Status changes that the flow cannot produce: (doc_id, event_id, from_status, to_status).

    Repeating the current status is allowed (redelivery). The previous status is looked
    up within time slices of a document, and only the last status of each slice is carried to
    the next one, so a document with very many events is spread over its slices. Events without a doc_id are
    one document.
    """
    sliced = events.select(
        "doc_id", "event_id", "status", "updated_at",
        F.date_trunc(slice_unit, "updated_at").alias("slice"),
    )
    moment = F.struct("updated_at", "event_id")
    last = sliced.groupBy("doc_id", "slice").agg(F.max_by("status", moment).alias("last_status"))
    before = last.select(
        "doc_id", "slice",
        F.lag("last_status").over(Window.partitionBy("doc_id").orderBy("slice")).alias("before_slice"),
    )
    inside = Window.partitionBy("doc_id", "slice").orderBy("updated_at", "event_id")
    change = F.concat_ws(">", "from_status", "status")
    before = before.select(F.col("doc_id").alias("_doc"), F.col("slice").alias("_slice"), "before_slice")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("slice").eqNullSafe(F.col("_slice"))
    return (
        sliced.withColumn("inside", F.lag("status").over(inside))
        .join(before, same)
        .withColumn("from_status", F.coalesce("inside", "before_slice"))
        .filter(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("status")))
        .filter(~change.isin(*TRANSITIONS))
        .select("doc_id", "event_id", "from_status", F.col("status").alias("to_status"))
    )


def run_log(outcome: DataFrame, stage: str, unit: str) -> DataFrame:
    """Run records of the rows an extract or embed stage produced."""
    millis = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000
    return outcome.select(
        F.lit(stage).alias("stage"), F.col(unit).alias("unit_id"), "status", "error",
        "start_time", "end_time", millis.alias("duration_ms"),
    )


def run_outcomes(log: DataFrame) -> DataFrame:
    """Units, errors and duration quantiles per stage and status."""
    return log.groupBy("stage", "status").agg(
        F.count("*").alias("units"),
        F.count("error").alias("errors"),
        F.percentile_approx("duration_ms", 0.5).alias("p50_ms"),
        F.percentile_approx("duration_ms", 0.95).alias("p95_ms"),
    )


# Items that a sketch keeps on its lowest level. Ranks read from any merge of sketches are off by
# less than RANK_ERROR of all values (99 % confidence).
SKETCH_SIZE, RANK_ERROR = 1_000, 0.006


def run_sketches(log: DataFrame, *by: str) -> DataFrame:
    """Units, errors and a mergeable sketch of the durations per stage and status (and ``by``, a day say), to be stored
    per batch."""
    return log.groupBy(*by, "stage", "status").agg(
        F.count("*").alias("units"),
        F.count("error").alias("errors"),
        F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), SKETCH_SIZE).alias("durations"),
    )


def outcomes_of(sketches: DataFrame) -> DataFrame:
    """``run_outcomes`` over any number of stored ``run_sketches``: a period costs its batches, not its runs."""
    merged = sketches.groupBy("stage", "status").agg(
        F.sum("units").alias("units"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("durations", SKETCH_SIZE).alias("_d")
    )
    known = F.kll_sketch_get_n_double("_d") > 0
    at = lambda share: F.when(known, F.kll_sketch_get_quantile_double("_d", F.lit(share)))
    return merged.select("stage", "status", "units", "errors", at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))
