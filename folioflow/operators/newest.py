"""The newest row per key from appended batches: writing costs what the batch holds, whatever the table holds.

``log/writer=W/batch=N`` has the batches of each writer. Readers take the newest row of every key; compaction, run apart,
folds the batches into ``base/v=K`` and then writes ``compacted/K.json``, which says up to which batch of each
writer they are in it. A batch that is written again replaces itself, and once folded it is not read any more.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from folioflow.operators.merge import latest_by_key
from folioflow.sources.files import delete_folder, names_in, read_text, write_new

FILE_ROWS = 1_000_000  # rows of a batch that go into one file


def append_batch(rows: DataFrame, path: str, writer: str, batch: int, key: str, order: str | list[str]) -> None:
    """Write the newest row per key of a batch; a small batch is one file."""
    files = 1 + rows.count() // FILE_ROWS
    latest_by_key(rows, key, order).coalesce(files).write.mode("overwrite").parquet(f"{path}/log/writer={writer}/batch={batch}")


def _compacted(spark: SparkSession, path: str) -> tuple[int, dict[str, int]]:
    """The newest compaction: its number (0: none yet) and the last batch of each writer that is in it."""
    numbers = sorted(int(n.split(".")[0]) for n in names_in(spark, f"{path}/compacted") if n[0].isdigit())
    if not numbers:
        return 0, {}
    return numbers[-1], json.loads(read_text(spark, f"{path}/compacted/{numbers[-1]:010d}.json"))


def _batches(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Batches that are written completely."""
    writers = [n.removeprefix("writer=") for n in names_in(spark, f"{path}/log") if n.startswith("writer=")]
    found = [(w, n) for w in writers for n in names_in(spark, f"{path}/log/writer={w}") if n.startswith("batch=")]
    return [
        (w, int(n.removeprefix("batch="))) for w, n in found if "_SUCCESS" in names_in(spark, f"{path}/log/writer={w}/{n}")
    ]


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame | None, int, dict[str, int], int]:
    """All rows that count, the compaction they start from, the last batch of each writer, and the number of open batches."""
    number, folded = _compacted(spark, path)
    batches = [(w, n) for w, n in _batches(spark, path) if n > folded.get(w, -1)]
    folders = [f"{path}/log/writer={w}/batch={n}" for w, n in batches]
    if number:
        folders.append(f"{path}/base/v={number}")
    last = dict(folded)
    for w, n in batches:
        last[w] = max(n, last.get(w, -1))
    return (spark.read.parquet(*folders) if folders else None), number, last, len(batches)


def read_newest(spark: SparkSession, path: str, key: str, order: str | list[str]) -> DataFrame:
    """The newest row of every key, all of its columns."""
    rows = _parts(spark, path)[0]
    if rows is None:
        raise FileNotFoundError(f"nothing was written to {path}")
    return latest_by_key(rows, key, order)


def compact(spark: SparkSession, path: str, key: str, order: str | list[str]) -> int:
    """Fold all batches into a new base; returns its number. Readers and writers may go on meanwhile."""
    rows, number, last, open_batches = _parts(spark, path)
    if not open_batches:
        return number
    latest_by_key(rows, key, order).write.mode("overwrite").parquet(f"{path}/base/v={number + 1}")
    write_new(spark, f"{path}/compacted/{number + 1:010d}.json", json.dumps(last))
    return number + 1


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete batches that are folded and bases before the newest; not while a reader is at work on them."""
    number, folded = _compacted(spark, path)
    for writer, batch in _batches(spark, path):
        if batch <= folded.get(writer, -1):
            delete_folder(spark, f"{path}/log/writer={writer}/batch={batch}")
    for name in names_in(spark, f"{path}/base"):
        if int(name.removeprefix("v=")) < number:
            delete_folder(spark, f"{path}/base/{name}")
