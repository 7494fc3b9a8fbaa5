"""Text extraction: file bytes -> text, one row per file, failures kept as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions.paths import path_parts
from folioflow.functions.text import running_sums

Extractor = Callable[[bytes], list[str]]

_OUT = (
    "path string, text string, page_count int, status string, error string, page_ends array<int>, "
    "start_time timestamp, end_time timestamp"
)
PAGE_GAP = "\n\n"  # between two pages of a text
FILES_AT_ONCE = 64  # files of a batch whose texts a task holds


def plain_text_pages(content: bytes) -> list[str]:
    """Built-in extractor: UTF-8 text with form feeds between pages."""
    return content.decode("utf-8").split("\f")


def _extract_batches(extractor: Extractor) -> Callable[[Iterator], Iterator]:
    stamp = pa.timestamp("us", tz="UTC")
    schema = pa.schema(
        [
            ("path", pa.string()), ("text", pa.string()), ("page_count", pa.int32()),
            ("status", pa.string()), ("error", pa.string()), ("page_ends", pa.list_(pa.int32())),
            ("start_time", stamp), ("end_time", stamp),
        ]
    )

    def extract_one(path: str, content: bytes) -> tuple:
        start = time.time_ns() // 1000
        try:
            pages = extractor(content)
            ends = [n - len(PAGE_GAP) for n in accumulate(len(p) + len(PAGE_GAP) for p in pages)]
            row = (PAGE_GAP.join(pages), len(pages), "success", None, ends)
        except Exception as exc:  # any broken file becomes a failed row
            row = ("", 0, "failed", str(exc), None)
        return (path, *row, start, time.time_ns() // 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, FILES_AT_ONCE) for b in batches for i in range(0, b.num_rows, FILES_AT_ONCE)):
            rows = [
                extract_one(p.as_py(), c.as_py()) for p, c in zip(part.column(0), part.column(1))
            ]
            yield pa.record_batch(
                [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema
            )

    return run


def run_extractor(files: DataFrame, extractor: Extractor = plain_text_pages) -> DataFrame:
    """Extraction outcome per file, with start and end time of the work.

    The scan already yields one split per file group; file bytes are never shuffled.
    """
    return files.select("path", "content").mapInArrow(_extract_batches(extractor), _OUT)


def extract_documents(files: DataFrame, extractor: Extractor = plain_text_pages) -> DataFrame:
    """The extracted table: path parts plus text, page count, status and error."""
    return with_path_parts(run_extractor(files, extractor))


def with_path_parts(outcome: DataFrame) -> DataFrame:
    parts = path_parts(F.col("path"))
    return outcome.select(
        parts["doc_id"].alias("doc_id"),
        parts["user_id"].alias("user_id"),
        parts["filename"].alias("filename"),
        F.col("path").alias("source_path"),
        "text", "page_count", "status", "error", "page_ends",
    )


def join_pages(pages: DataFrame, only_with_text: bool = False) -> DataFrame:
    """One row per document from (doc_id, page_no, text): pages joined by a blank line, and where each ends.

    ``only_with_text`` leaves empty pages out of the text but still counts them; such a page ends where the
    one before it does.
    """
    kept = F.transform("pages", lambda p: p["text"])
    size = lambda p: F.length(p["text"]) + len(PAGE_GAP)
    if only_with_text:
        kept = F.filter(kept, lambda t: t != "")
        length = lambda p: F.when(p["text"] != "", size(p)).otherwise(F.lit(0))
    else:
        length = lambda p: F.when(p["text"].isNotNull(), size(p)).otherwise(F.lit(0))
    ends = F.transform(running_sums(F.transform("pages", length)), lambda n: F.greatest(n - len(PAGE_GAP), F.lit(0)))
    gathered = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pages"))
    return gathered.select(
        "doc_id", F.array_join(kept, PAGE_GAP).alias("text"), F.size("pages").alias("page_count"), ends.alias("page_ends")
    )


def count_when(condition: Column) -> Column:
    return F.count_if(condition)


def extraction_counts(extracted: DataFrame) -> DataFrame:
    """total, success and failed in one pass."""
    ok = F.col("status") == "success"
    return extracted.agg(
        F.count("*").alias("total"),
        count_when(ok).alias("success"),
        (F.count("*") - count_when(ok)).alias("failed"),
    )


def filter_indexable(extracted: DataFrame) -> DataFrame:
    return extracted.filter("status = 'success' and text is not null and text <> ''")


def filter_failed(extracted: DataFrame) -> DataFrame:
    return extracted.filter("status = 'failed'").select("doc_id", "source_path", "error")
