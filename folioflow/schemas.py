"""Fixed schemas of every stage table. Nothing is inferred on read."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
)
_TS = T.TimestampNTZType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RAW_FILES = _table(
    ("path", _S), ("modificationTime", T.TimestampType()), ("length", _L), ("content", T.BinaryType())
)

EXTRACTED = _table(
    ("doc_id", _S), ("user_id", _S), ("filename", _S), ("source_path", _S),
    ("text", _S), ("page_count", _I), ("status", _S), ("error", _S),
    # Where each page ends in the text, in characters.
    ("page_ends", T.ArrayType(_I)),
)

DOC_REPORT = _table(
    ("doc_id", _S), ("user_id", _S), ("filename", _S), ("ocr_status", _S), ("page_count", _I),
    ("text_length", _I), ("word_count", _I), ("noise_ratio", _D), ("est_chunks", _I),
    ("is_empty", _B), ("is_noisy", _B), ("needs_review", _B), ("review_reason", _S),
)

CHUNKS = _table(
    ("chunk_id", _S), ("doc_id", _S), ("user_id", _S), ("filename", _S),
    ("chunk_index", _I), ("text", _S),
)

CHECKPOINT = T.StructType(CHUNKS.fields + [T.StructField("status", _S, True)])

VECTOR = T.ArrayType(T.FloatType())

POINTS = _table(
    ("point_id", _S), ("chunk_id", _S), ("doc_id", _S), ("user_id", _S), ("filename", _S),
    ("chunk_index", _I), ("page_number", _I), ("text", _S), ("vector", VECTOR),
)

# Layout information is declared by the data model but no stage produces it.
LAYOUT_BLOCK = _table(
    ("block_type", _S), ("text", _S), ("bbox", T.ArrayType(_D)),
    ("confidence", _D), ("page_number", _I),
)

CHUNK_METADATA = _table(
    ("doc_id", _S), ("chunk_index", _I), ("page_number", _I), ("section_type", _S),
    ("bbox", T.ArrayType(_D)), ("confidence", _D), ("clause_number", _S),
    ("parent_section", _S), ("custom", T.MapType(_S, _S)),
)

QUERIES = _table(
    ("query_id", _S), ("query_text", _S), ("user_id", _S), ("doc_ids", T.ArrayType(_S)),
    ("filters", T.MapType(_S, _S)), ("top_k", _I),
)

CITATION = _table(
    ("doc_id", _S), ("chunk_id", _S), ("text", _S), ("page_number", _I), ("confidence", _D)
)

RESULTS = _table(
    ("query_id", _S), ("query", _S), ("answer", _S), ("citations", T.ArrayType(CITATION)),
    ("confidence", _D), ("reasoning", _S), ("metadata", T.MapType(_S, _S)),
)

DOCUMENT_METADATA = _table(
    ("filename", _S), ("file_size", _L), ("mime_type", _S), ("upload_time", _TS),
    ("page_count", _I), ("language", _S), ("custom", T.MapType(_S, _S)),
)

DOCUMENTS_META = _table(
    ("doc_id", _S), ("user_id", _S), ("status", _S), ("metadata", DOCUMENT_METADATA),
    ("storage_path", _S), ("ocr_result_path", _S), ("layout_result_path", _S),
    ("chunks_path", _S), ("created_at", _TS), ("updated_at", _TS),
    ("error_message", _S), ("retry_count", _I),
)

UPLOAD_EVENT = _table(("doc_id", _S), ("user_id", _S), ("storage_path", _S))
INDEX_EVENT = _table(("doc_id", _S), ("user_id", _S), ("ocr_result_path", _S))

STATUS_EVENTS = _table(
    ("event_id", _L), ("doc_id", _S), ("user_id", _S), ("status", _S),
    ("updated_at", _TS), ("error_message", _S),
)

RUN_LOG = _table(
    ("stage", _S), ("unit_id", _S), ("status", _S), ("error", _S),
    ("start_time", T.TimestampType()), ("end_time", T.TimestampType()), ("duration_ms", _D),
)

# The states of a document and of a run.
DOCUMENT_STATUSES = (
    "uploaded", "ocr_processing", "ocr_completed", "ocr_failed",
    "indexing", "indexed", "index_failed", "ready", "failed",
)
RUN_STATUSES = ("pending", "running", "success", "failed", "timeout")
