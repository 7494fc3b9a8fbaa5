"""Best-fit packing of token sequences after a dominance reduction of the instance.

The instance is the number of pieces of each length, at most ``capacity`` numbers whatever
the size of the corpus. It is reduced and packed as such; every piece then finds its place from its
length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm.common import bounded_batches, written

CAPACITY = 1024
END_ID = 2
RANK_BLOCKS = 256  # blocks in which the pieces of one length are ranked


@dataclass
class Pattern:
    """``count`` sequences of the same lengths, in the order of their places."""

    count: int
    lengths: list[int]


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sets of pieces that no other choice for their largest piece can beat, and the pieces left.

    For the largest length j, with the lengths left beside it: (1) nothing fits, {j} is fixed;
    (2) the largest partner k fills the sequence, {j, k} dominates every other set; (3) no two pieces fit
    beside j, so the largest partner dominates; (4) no three fit and the largest partner fits together
    with the largest piece that can be the smaller of two, so these two dominate. Each rule is applied to as
    many pieces at once as have the same choice. Lengths without a rule are set aside.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                chosen = _dominating(left, j, capacity)
                if chosen is None:
                    break
                need = {n: chosen.count(n) for n in set(chosen)}
                # Rules 3 and 4 look at the smallest pieces, so what holds for one need not hold for all.
                times = min(left[n] // k for n, k in need.items())
                fixed.append(Pattern(times, chosen))
                for n, k in need.items():
                    left[n] -= times * k
                    if not left[n]:
                        del left[n]
                changed = True
    return fixed, left


def _dominating(left: dict[int, int], j: int, capacity: int) -> list[int] | None:
    others = dict(left)
    others[j] -= 1
    sizes = sorted(n for n, c in others.items() if c > 0)
    room = capacity - j
    fitting = [n for n in sizes if n <= room]
    if not fitting:
        return [j]
    largest = fitting[-1]
    if largest == room:
        return [j, largest]
    smallest: list[int] = []
    for n in fitting:
        smallest += [n] * min(3 - len(smallest), others[n])
        if len(smallest) == 3:
            break
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return [j, largest]
    if len(smallest) < 3 or sum(smallest) > room:
        # The smaller of two partners is at most half of the room.
        lesser = [n for n in fitting if 2 * n < room or 2 * n == room and others[n] > 1]
        if lesser and largest + lesser[-1] <= room and (largest != lesser[-1] or others[largest] > 1):
            return [j, largest, lesser[-1]]
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest pieces first: each goes to the fullest sequence that has room for it."""
    by_room: dict[int, list[Pattern]] = {}

    def put(pattern: Pattern) -> None:
        if pattern.count:
            by_room.setdefault(capacity - sum(pattern.lengths), []).append(pattern)

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            rooms = [r for r in by_room if r >= n]
            if rooms:
                room = min(rooms)
                group = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
            else:
                room, group = capacity, Pattern(todo, [])
            each = room // n
            full = min(group.count, todo // each)
            put(Pattern(full, group.lengths + [n] * each))
            todo -= full * each
            if full < group.count:
                part = min(todo, each)
                if part:
                    put(Pattern(1, group.lengths + [n] * part))
                    todo -= part
                rest = group.count - full - (1 if part else 0)
                if group.lengths:
                    put(Pattern(rest, group.lengths))
    return [p for group in by_room.values() for p in group]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first_rank, count, first_sequence, offset): where the pieces of a length go, rank by rank."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern in patterns:
        offset = 0
        for n in pattern.lengths:
            first = ranks.get(n, 0)
            rows.append((n, first, pattern.count, sequence, offset))
            ranks[n] = first + pattern.count
            offset += n
        sequence += pattern.count
    return rows


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of the token ids of (doc_id, text): only what is longer than ``capacity`` is cut.

    All pieces of a document but its first have ``capacity`` tokens; the first has the rest.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from folioflow.llm.tokens import encoder

        tok = encoder(path)
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                ids = memoryview((tok.encode(text) if text else b"") + end)
                total = len(ids) // 4
                stop = total % capacity or capacity
                start = piece = 0
                while start < total:
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cut, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``.

    A null text is an empty one and gives one piece that holds the end id; repeated rows are packed each for
    itself; an empty table gives no rows; other columns are not read. A text of any length is encoded whole in its task
    and cut there; pieces of equal length take their places in the order of their block, id and number. The driver sees the number of pieces per
    length (at most ``capacity`` rows) and the table of places, whose size follows from those lengths and not
    from the corpus. Ranks within a length come from counts per block and a numbering inside each block,
    so that a length with a third of all pieces is spread over all blocks.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    pieces = written(
        cut_pieces(docs, path, capacity, end_id).withColumn(
            "block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_BLOCKS)).cast("int")
        ),
        "pieces",
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan_sequences(counts, capacity))
    where = spark.createDataFrame(
        table, "length long, first_rank long, count long, first_sequence long, offset long"
    )
    per_block = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = per_block.withColumn(
        "before",
        F.expr(
            "coalesce(sum(n) over (partition by length order by block"
            " rows between unbounded preceding and 1 preceding), 0)"
        ),
    ).select("length", "block", "before")
    ranked = pieces.withColumn(
        "_in_block",
        F.expr("row_number() over (partition by length, block order by doc_id, piece, ids_crc32) - 1"),
    ).join(F.broadcast(before), ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("_in_block"))
    # The places of a length cover its ranks without overlap: one match for every piece.
    spot = F.broadcast(where.withColumnRenamed("length", "_length"))
    found = ranked.join(
        spot,
        (F.col("length") == F.col("_length"))
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("first_rank") + F.col("count")),
    )
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        "offset",
    )
