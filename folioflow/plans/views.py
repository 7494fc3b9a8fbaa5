"""The stage tables derived from the given test tables, over all of their rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.functions.text import CHUNK_SIZE, running_sums
from folioflow.operators.chunking import chunk_documents
from folioflow.operators.documents import new_documents, register_uploads
from folioflow.operators.embedding import embed_chunks, embed_queries, hashing_embedder
from folioflow.operators.extract import extract_documents, filter_indexable
from folioflow.operators.points import build_points
from folioflow.session import work_dir
from folioflow.sources.stages import spread

DIM = 256

# Documents with clause markers, noise and short texts mixed in; an empty text is a failed one. All texts are read whole.
# The same text runs in Spark and (through ``oracles``) in DuckDB.
TEXT_CASE = """case when length(text) < 60 then {mask}
  when doc_id % 4 = 0 then replace(text, chr(10), concat(chr(10), '1. '))
  when doc_id % 4 = 1 then replace(text, chr(10), concat(chr(10), '(a) '))
  when doc_id % 4 = 2 then replace(text, chr(10), concat(chr(10), 'Section 3 '))
  else replace(text, chr(10), concat(chr(10), ' 2.1 ')) end"""

EXTRACTED = """select concat('doc_', cast(doc_id as string)) as doc_id, source as user_id,
  concat('file_', cast(doc_id as string), '.pdf') as filename,
  concat('gs://bucket/raw/', source, '/doc_', cast(doc_id as string),
         '/file_', cast(doc_id as string), '.pdf') as source_path,
  {text} as text,
  case when coalesce(text, '') = '' then 0 else cast(ceil(n_chars / 1800.0) as int) end as page_count,
  case when coalesce(text, '') = '' then 'failed' else 'success' end as status,
  case when coalesce(text, '') = '' then 'no text' end as error
from {table}"""

STATUS_EVENTS = """select event_id, concat('doc_', cast(user_id as string)) as doc_id,
  concat('u', cast(user_id % 7 as string)) as user_id,
  case event_type when 'signup' then 'uploaded' when 'view' then 'ocr_processing'
    when 'click' then 'ocr_completed' when 'purchase' then 'indexed' else 'ocr_failed' end as status,
  ts as updated_at, case when event_type = 'error' then props end as error_message
from {table}"""

UPLOAD_REQUESTS = """select case when o_orderstatus <> 'P' then concat('u', cast(o_custkey % 7 as string))
    when o_orderkey % 2 = 0 then concat('u', cast(o_custkey as string)) end as user_id,
  concat('order_', cast(o_orderkey as string), '.pdf') as filename,
  case when o_orderkey % 50 = 3 then 0 else cast(floor(o_totalprice * 150) as bigint) end as file_size,
  case o_orderpriority when '1-URGENT' then 'image/png' when '5-LOW' then null
    when '2-HIGH' then 'application/x-pdf' else 'application/pdf' end as mime_type,
  o_orderdate as upload_time
from {table}"""

BILL_FILES = """select concat('bills/', c_name, '/BILLS-118hr', cast(o_custkey as string),
    case o_orderpriority when '1-URGENT' then 'rs' when '2-HIGH' then 'rfs' when '3-MEDIUM' then 'eh'
      when '4-NOT SPECIFIED' then 'enr' else 'xx' end, '.pdf') as path
from {table}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, query: str, source: DataFrame, **parts: str) -> DataFrame:
    return spark.sql(query.format(table="{source}", **parts), source=source)


def extracted_from(spark: SparkSession, documents: DataFrame) -> DataFrame:
    text = TEXT_CASE.format(mask="regexp_replace(text, '[a-z]', '#')")
    return _sql(spark, EXTRACTED, documents, text=text)


def extracted(spark: SparkSession, sf_dir: str, busy: bool = False) -> DataFrame:
    """``busy`` is for CPU-heavy readers: a scan of few splits is spread over the cores."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    return extracted_from(spark, spread(documents) if busy else documents)


def raw_files_from(documents: DataFrame) -> DataFrame:
    """Files as a binary scan shows them; lines are pages, some contents are not UTF-8."""
    text = F.encode(F.replace("text", F.lit("\n"), F.lit("\f")), "utf-8")
    broken = F.col("doc_id") % 37 == 5
    return documents.select(
        F.concat_ws(
            "/", F.lit("gs://bucket/raw"), "source", F.concat(F.lit("doc_"), "doc_id"),
            F.concat(F.lit("file_"), "doc_id", F.lit(".pdf")),
        ).alias("path"),
        F.when(broken, F.concat(F.unhex(F.lit("FF")), text)).otherwise(text).alias("content"),
    )


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_files_from(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the built-in extractor makes of the raw files; those that are not UTF-8 fail."""
    return extract_documents(raw_files(spark, sf_dir))


def stored_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with all raw files as files, in a folder per user."""
    folder = work_dir(spark, "raw")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        there = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                user, _, name = path.split("/")[-3:]
                if user not in there:
                    system.create_dir(f"{place}/{user}", recursive=True)
                    there.add(user)
                with system.open_output_stream(f"{place}/{user}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    made = raw_files(spark, sf_dir).filter("content is not null").mapInArrow(put, "files long")
    made.agg(F.sum("files")).collect()
    return folder


def line_ends(text: Column) -> Column:
    """Where each line of a text ends: the lines taken as pages."""
    return F.transform(running_sums(F.transform(F.split(text, "\n", -1), lambda line: F.length(line) + 1)), lambda n: n - 1)


def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, text): the lines of each document as its pages."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("doc_id"),
        F.posexplode(F.split("text", "\n", -1)).alias("page_no", "text"),
    )


def chunks(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    docs = filter_indexable(extracted(spark, sf_dir, busy=True))
    if options.get("pages"):
        docs = docs.withColumn("page_ends", line_ends(F.col("text")))
    return chunk_documents(docs, **options)


def text_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_points(embed_chunks(chunks(spark, sf_dir, pages=True), hashing_embedder(DIM)))


def text_point_bytes(spark: SparkSession, sf_dir: str) -> int:
    """About how many bytes ``text_points`` has: all texts and the vectors of their chunks."""
    chars = table(spark, sf_dir, "documents").agg(F.sum("n_chars")).first()[0] or 0
    return chars + chars * 4 * DIM // CHUNK_SIZE


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a question of one of the users."""
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), "item_id").alias("query_id"),
        F.col("text").alias("query_text"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("user_id"),
        F.lit(5).alias("top_k"),
    )


def embedded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_queries(questions(spark, sf_dir), hashing_embedder(DIM)).drop("status", "error")


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All given embeddings as points; label 0, 3, 6 and 9 share the largest user."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), "vec_id").alias("chunk_id"),
        F.concat(F.lit("doc_"), (F.col("vec_id") % 50).cast("string")).alias("doc_id"),
        F.concat(F.lit("u"), (F.col("label") % 3).cast("string")).alias("user_id"),
        "label",
        F.col("embedding").alias("vector"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All given embeddings as questions."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("q"), "vec_id").alias("query_id"),
        F.concat(F.lit("u"), (F.col("label") % 3).cast("string")).alias("user_id"),
        F.col("vec_id"), "label",
        F.col("embedding").alias("vector"),
    )


def status_events_from(spark: SparkSession, events: DataFrame) -> DataFrame:
    return _sql(spark, STATUS_EVENTS, events)


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_events_from(spark, table(spark, sf_dir, "events"))


def upload_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, UPLOAD_REQUESTS, table(spark, sf_dir, "orders"))


def uploaded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document records of all accepted uploads."""
    return new_documents(register_uploads(upload_requests(spark, sf_dir)))


def documents_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh record (status uploaded) for every given document."""
    uploads = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("doc_id"),
        F.col("source").alias("user_id"),
        F.concat(F.lit("file_"), "doc_id", F.lit(".pdf")).alias("filename"),
        F.col("n_chars").alias("file_size"),
        F.lit("application/pdf").alias("mime_type"),
        F.expr(
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))"
        ).alias("upload_time"),
        F.concat_ws(
            "/", F.lit("raw"), "source", F.concat(F.lit("doc_"), "doc_id"),
            F.concat(F.lit("file_"), "doc_id", F.lit(".pdf")),
        ).alias("storage_path"),
        F.lit("uploaded").alias("status"),
    )
    return new_documents(uploads)


def bill_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return _sql(spark, BILL_FILES, joined.select("c_name", "o_custkey", "o_orderpriority"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies made of the given conversations: JSON, JSON without answer, plain text."""
    turn = table(spark, sf_dir, "conversations")
    good = F.to_json(F.struct(F.col("text").alias("answer"), F.col("role").alias("reasoning")))
    partial = F.to_json(F.struct(F.col("role").alias("reasoning")))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    return turn.select(
        F.concat_ws("_", F.lit("q"), "conv_id", "turn").alias("query_id"),
        F.when(kind == 0, F.col("text")).when(kind == 1, partial).otherwise(good).alias("raw"),
    )
