"""Text -> vector in batches, through a pluggable provider.

A provider factory is called once per task (clients do not travel) and returns a
function ``list[str] -> 2-d array`` that keeps the order of its texts. Batches
stream through the task; a partition is never held as a whole.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from folioflow.schemas import VECTOR

Provider = Callable[[list[str]], np.ndarray]

BATCH_SIZE = 100
ATTEMPTS = 3
MIN_WAIT, MAX_WAIT = 2.0, 30.0
KNOWN_TOKENS = 50_000  # tokens whose places a task remembers, about 10 MB


def hashing_embedder(dim: int = 256) -> Callable[[], Provider]:
    """Deterministic built-in provider: signed token hashing, then length 1.

    Digits 1-4 of a token's MD5 choose the slot, digit 5 the sign.
    """

    def connect() -> Provider:
        known: dict[str, tuple[int, float]] = {}
        places: dict[tuple[int, float], tuple[int, float]] = {}

        def place(token: str) -> tuple[int, float]:
            digest = hashlib.md5(token.encode()).hexdigest()
            found = int(digest[:4], 16) % dim, 1.0 if digest[4] < "8" else -1.0
            return places.setdefault(found, found)  # one object per place, not per token

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                if len(known) > KNOWN_TOKENS:
                    known.clear()
                cells, signs = [], []
                for token in text.lower().split():
                    found = known.get(token) or known.setdefault(token, place(token))
                    cells.append(found[0])
                    signs.append(found[1])
                out[row] = np.bincount(np.array(cells, dtype=np.int64), signs, minlength=dim)
            length = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return np.divide(out, length, out=out, where=length > 0)

        return embed

    return connect


def call_with_retry(
    call: Callable, texts: list[str], attempts: int, min_wait: float, max_wait: float
):
    """Call a provider; wait 2, 4, 8 ... seconds (bounded) between attempts."""
    for attempt in range(1, attempts + 1):
        try:
            return call(texts)
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(min(max(2.0 ** (attempt - 1), min_wait), max_wait))


def run_embedder(
    rows: DataFrame,
    provider: Callable[[], Provider],
    text_col: str = "text",
    batch_size: int = BATCH_SIZE,
    attempts: int = ATTEMPTS,
    min_wait: float = MIN_WAIT,
    max_wait: float = MAX_WAIT,
) -> DataFrame:
    """``rows`` plus vector, status, error and the times of the batch call.

    A batch whose last attempt fails gives rows with status ``failed`` and no vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = provider()
        stamp = pa.timestamp("us", tz="UTC")
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                n = part.num_rows
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                begun = time.time_ns() // 1000
                try:
                    found = call_with_retry(embed, texts, attempts, min_wait, max_wait)
                    vectors, error = np.asarray(found, dtype=np.float32), None
                    if vectors.ndim != 2 or len(vectors) != n:
                        raise ValueError(f"provider returned {vectors.shape} for {n} texts")
                    offsets = np.arange(n + 1, dtype=np.int32) * vectors.shape[1]
                    column = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
                except Exception as exc:
                    column, error = pa.nulls(n, pa.list_(pa.float32())), str(exc)
                done = time.time_ns() // 1000
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns, column,
                        pa.array(["success" if error is None else "failed"] * n, pa.string()),
                        pa.array([error] * n, pa.string()),
                        pa.array([begun] * n, stamp), pa.array([done] * n, stamp),
                    ],
                    names=[*part.schema.names, "vector", "status", "error", "start_time", "end_time"],
                )

    schema = T.StructType(
        rows.schema.fields
        + [
            T.StructField("vector", VECTOR), T.StructField("status", T.StringType()),
            T.StructField("error", T.StringType()), T.StructField("start_time", T.TimestampType()),
            T.StructField("end_time", T.TimestampType()),
        ]
    )
    return rows.mapInArrow(run, schema)


def embed_chunks(rows: DataFrame, provider: Callable[[], Provider], **options) -> DataFrame:
    """``rows`` plus vector, status and error. Use ``text_col`` for other tables.

    Providers cost money and may differ between calls: write the result once and
    read it back rather than running two actions on it.
    """
    return run_embedder(rows, provider, **options).drop("start_time", "end_time")


def embed_queries(queries: DataFrame, provider: Callable[[], Provider], **options) -> DataFrame:
    """The same provider on the question table."""
    return embed_chunks(queries, provider, text_col="query_text", **options)


def embed_checkpoint(points: DataFrame) -> DataFrame:
    """What was indexed, without vectors: read from the written points, not re-embedded."""
    return points.select(
        "chunk_id", "doc_id", "user_id", "filename", "chunk_index", "text",
        F.lit("indexed").alias("status"),
    )
