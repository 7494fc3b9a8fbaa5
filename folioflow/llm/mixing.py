"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, again and again up to ``repeats`` times. A copy finishes at
the virtual time (source words up to and with it) / (target of its source), so all sources are served in proportion
to their targets. The copies of all sources are sorted by that time over the whole table, and the mix ends where its
words reach the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.common import words, written
from folioflow.llm.ranges import dealt_by_range, with_running

WEIGHTS = (1, 2, 3)  # of the sources in code-point order, repeating
REPEATS = 3
SOURCE = ["_unnamed", "_source"]  # a source without nulls; the null source comes last
QUEUE = ["_order", "doc_id", "size", "_row"]


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source key, shuffled place) of every row, stored; texts are read once and go no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        "doc_id",
        word_count(F.col("text")).alias("size"),
        F.col("source").isNull().alias("_unnamed"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), text)), 1, 16).alias("_order"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return written(found, "mix-records")


def source_targets(recs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, budget: int | None = None) -> tuple[DataFrame, int]:
    """(source key, source_size, target) per source and the budget, by default the words of all documents.

    Targets share the budget by weight. Those above ``repeats`` times their source's size stop there and the excess is
    shared among the others by weight, until none is above. One row of sums a round comes to the driver.
    """
    sizes = written(recs.groupBy(*SOURCE).agg(F.sum("size").alias("source_size")), "mix-sources")
    ranked = with_running(dealt_by_range(sizes, *SOURCE), [], SOURCE, {"_rank": F.lit(1)})
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int"))
    ranked = written(ranked.withColumn("_weight", weight), "mix-weights")
    full = repeats * F.col("source_size")
    if budget is None:
        budget = sizes.agg(F.sum("source_size")).first()[0] or 0
    rate, free = 0.0, None
    while True:
        above = full < F.lit(rate) * F.col("_weight")
        r = ranked.agg(
            F.sum(F.when(above, full).otherwise(0)).alias("fixed"),
            F.sum(F.when(above, 0).otherwise(F.col("_weight"))).alias("weight"),
        ).first()
        if not r["weight"] or r["weight"] == free:
            break
        free = r["weight"]
        rate = (budget - r["fixed"]) / free
    target = F.least(full.cast("double"), F.lit(rate) * F.col("_weight"))
    return ranked.select(*SOURCE, "source_size", target.alias("target")), budget


def queue_documents(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, budget: int | None = None) -> tuple[DataFrame, int]:
    """Every row with the size and target of its source and ``_before``, the words of the source queued ahead of it."""
    recs = records(docs)
    targets, budget = source_targets(recs, weights, repeats, budget)
    ranged = dealt_by_range(recs, *SOURCE, *QUEUE)
    return written(with_running(ranged, SOURCE, QUEUE, {"_before": F.col("size")}, targets), "mix-queue"), budget


def serve(queue: DataFrame, budget: int, repeats: int = REPEATS) -> DataFrame:
    """The mix in order: _row, doc_id, source key, copy, finish, position (words before it) and words.

    The copy that reaches its source's target is cut there, and the one that reaches the budget is cut there.
    """
    last = F.floor("target")
    copy = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy")
    started = F.col("copy") * F.col("source_size") + F.col("_before")
    copies = (
        queue.filter("size > 0 and target >= 1")
        .select("*", copy)
        .withColumn("_start", started)
        .filter(F.col("_start") < last)
        .withColumn("words", F.least(F.col("size"), last - F.col("_start")))
        .withColumn("finish", (F.col("_start") + F.col("words")) / F.col("target"))
        .select("_row", "doc_id", *SOURCE, "_order", "copy", "finish", "words")
    )
    order = ["finish", *SOURCE, "copy", "_order", "_row"]
    placed = with_running(dealt_by_range(copies, *order), [], order, {"position": F.col("words")})
    return placed.filter(F.col("position") < budget).withColumn("words", F.least(F.col("words"), budget - F.col("position")))


def mix_documents(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, budget: int | None = None) -> DataFrame:
    """Every row of (doc_id, text, source) with size, source_size, target, taken and copies.

    ``taken`` are the words the mix takes of the row, repeats counted: ``copies`` copies, of which the last may be cut;
    never more than ``repeats`` times its size. The words taken of a source are its target rounded down, so the mix falls
    short of the budget by less than one word a source (or by what ``repeats`` times all words lack).
    A null text has no words, and a row without words is taken 0 times. Rows with a null source are one source,
    the last. Null and repeated ids are rows like others; of equal rows any one may be the one that is cut. An empty table
    gives no rows, other columns are ignored, texts of any length are counted whole. The shuffle is a hash of id and
    text, so reruns agree.

    A source of any size is cut into ranges of its queue; no window holds more than one range, and texts
    are not shuffled.
    """
    queue, budget = queue_documents(docs, weights, repeats, budget)
    taken = serve(queue, budget, repeats).groupBy("_row").agg(F.sum("words").alias("taken"), F.count("*").alias("copies"))
    return queue.join(taken, "_row", "left").select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"),
    )
