"""Benchmark decontamination as a prefix-filtered set join of shingles.

A window of a benchmark item is the set of its shingles. A document can only contain the window if it
contains the window's rarest shingle, so that one is the necessary prefix (containment of 1 leaves a
prefix of one), and the shingle's place in the window fixes where the window would have to
start. What remains is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.common import NOT_WORD, let, lower_words, shingle_hashes, without_rows, written

WINDOW = 10
SHINGLE = 3
# Benchmark windows up to this many are broadcast (about 250 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 100_000
# The filter of shingle hashes has 24 bits a shingle, which lets 4 % of other places through; from 2^18 bits (32 KB) to
# 2^26 (8 MB, for 2.8 million shingles; beyond, more places pass and are told apart by the join).
LEAST_BITS, MOST_BITS, BITS_EACH = 18, 26, 24

PLACE = "struct<size:int,at:int,h:bigint,context:array<string>,begin:int>"


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words): every run of ``window`` words of an item, or all its words if they are fewer."""
    tokens = items.select(F.col("item_id"), lower_words(F.col("text"), NOT_WORD).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return tokens.filter(F.size("w") > 0).select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("words")
    )


def _shingles(words: Column) -> Column:
    """Hashes of a window's shingles; a window of one or two words is one shingle of that size."""
    return (
        F.when(F.size(words) >= SHINGLE, shingle_hashes(words, SHINGLE))
        .when(F.size(words) == 2, shingle_hashes(words, 2))
        .otherwise(shingle_hashes(words, 1))
    )


def filter_size(shingles: int) -> int:
    """Bits of the filter, as a power of two."""
    return min(max(LEAST_BITS, (BITS_EACH * shingles - 1).bit_length()), MOST_BITS)


def _filter_bits(hashes: DataFrame, size: int) -> DataFrame:
    """One row with ``bits``: an array<long> of 2^size bits in which the low bits of every hash are marked."""
    cells = 1 << (size - 6)
    place = F.col("h").bitwiseAND(F.lit((1 << size) - 1))
    marked = hashes.groupBy(F.shiftright(place, 6).alias("cell")).agg(
        F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("mask")
    )
    every = hashes.sparkSession.range(cells).withColumnRenamed("id", "cell")
    return (
        every.join(marked, "cell", "left")
        .groupBy()
        .agg(F.sort_array(F.collect_list(F.struct("cell", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))).alias("c"))
        .select(F.transform("c", lambda x: x["mask"]).alias("bits"))
    )


def _hits(docs: DataFrame, hashes: DataFrame, sizes: list[int], around: int) -> DataFrame:
    """(doc_id, _row, n_words, h, at, context): places of documents whose shingle may be among ``hashes``.

    The filter leaves out most places inside the row of the document; ``context`` holds the words
    from ``around`` before the place to ``around`` after it, so that no text has to be fetched again.
    """
    size = filter_size(hashes.count())
    bits = _filter_bits(hashes, size).scalar()

    def marked(h: Column, cells: Column) -> Column:
        cell = F.get(cells, F.shiftright(h.bitwiseAND(F.lit((1 << size) - 1)), 6).cast("int"))
        return F.getbit(cell, h.bitwiseAND(F.lit(63)).cast("int")) == 1

    def places_of(w: Column, size: int):
        def of(hs: Column) -> Column:
            every = F.when(F.size(hs) > 0, F.sequence(F.lit(0), F.size(hs) - 1)).otherwise(
                F.array().cast("array<int>")
            )
            begin = lambda i: F.greatest(i - around, F.lit(0))
            return F.transform(
                F.filter(every, lambda i: marked(F.get(hs, i), F.col("_bits"))),
                lambda i: F.struct(
                    F.lit(size).alias("size"),
                    i.alias("at"),
                    F.get(hs, i).alias("h"),
                    F.slice(w, begin(i) + 1, 2 * around + 1).alias("context"),
                    begin(i).alias("begin"),
                ),
            ).cast(f"array<{PLACE}>")

        return of

    def places(w: Column) -> Column:
        # The first item stands for the row itself, so that rows without a place are kept as well.
        row = F.struct(
            F.lit(0).alias("size"), F.lit(-1).alias("at"), F.xxhash64("doc_id", "_row").alias("h"),
            F.array().cast("array<string>").alias("context"), F.lit(0).alias("begin"),
        )
        found = [F.array(row.cast(PLACE))]
        found += [let(shingle_hashes(w, size), places_of(w, size)) for size in sizes]
        return F.concat(*found)

    tokens = docs.select("doc_id", "_row", F.col("text"), bits.alias("_bits"))
    found = let(lower_words(F.col("text"), NOT_WORD), lambda w: F.struct(F.size(w).alias("n"), places(w).alias("p")))
    return tokens.select("doc_id", "_row", found.alias("f")).select(
        # The outer form keeps Spark from testing the array's size, and so from making it, twice.
        "doc_id", "_row", F.col("f.n").cast("long").alias("n_words"), F.explode_outer("f.p").alias("p")
    ).select("doc_id", "_row", "n_words", "p.*")


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside windows), item_ids (sorted as strings).

    Null and empty texts have no words, so a document without them has no hit and an item without
    them no window. Documents with one doc_id and the same text are one row's worth of
    evidence each and come out once per input row; items that repeat count once per item_id; a
    null item_id is no item. Empty tables give no rows, or documents without hits. Other columns are not
    read. Two passes over the texts: the first counts how often the benchmark's shingles occur in
    the corpus, the second looks for the rarest of each window. No text is shuffled.
    """
    items = items.filter(F.col("item_id").isNotNull())
    # The same passage in many items is looked for once.
    windows = written(
        item_windows(items, window)
        .groupBy("words")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
        .withColumn("window", F.xxhash64("words"))
        .withColumn("hashes", _shingles(F.col("words"))),
        "windows",
    )
    stats = windows.agg(
        F.count("*").alias("n"), F.collect_set(F.least(F.size("words"), F.lit(SHINGLE))).alias("sizes")
    ).first()
    keep_local = F.broadcast if stats["n"] <= broadcast_windows else (lambda df: df)
    sizes = sorted(stats["sizes"]) or [SHINGLE]
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_row"))

    # Corpus counts of the benchmark's shingles.
    known = written(windows.select(F.explode("hashes").alias("h")).distinct(), "shingles")
    seen = _hits(docs, known, sizes, 0).filter("at >= 0").select("h")
    counted = written(seen.join(keep_local(known), "h", "left_semi").groupBy("h").agg(F.count("*").alias("n")), "rarity")
    ranked = (
        windows.select("words", "window", "items", F.posexplode("hashes").alias("offset", "h"))
        .join(counted, "h", "left")
        .groupBy("words", "window", "items")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("rarest"))
        # A window with a shingle that no document has is nowhere.
        .filter("rarest.n > 0")
    )
    prefix = written(
        ranked.select(
            F.col("rarest.h").alias("h"), F.col("rarest.offset").alias("offset"), "words", "window", "items",
            F.least(F.size("words"), F.lit(SHINGLE)).alias("size"),
        ),
        "prefix",
    )

    # Candidates: positional bounds first, then the words themselves.
    hits = _hits(docs, prefix.select("h"), sizes, window)
    start = F.col("at") - F.col("offset")
    length = F.size("words")
    checked = hits.join(
        keep_local(prefix),
        ["h", "size"],
        "left",
    ).withColumn(
        "ok",
        F.coalesce(
            (start >= 0)
            & (start + length <= F.col("n_words"))
            & (F.slice("context", F.greatest(start - F.col("begin"), F.lit(0)) + 1, F.greatest(length, F.lit(0))) == F.col("words")),
            F.lit(False),
        ),
    )
    spans = F.when(F.col("ok"), F.struct(start.alias("s"), (start + length).alias("e")))
    per_text = checked.groupBy("doc_id", "_row", "n_words").agg(
        F.collect_set(spans).alias("spans"),
        F.array_sort(
            F.array_distinct(F.flatten(F.collect_set(F.when(F.col("ok"), F.col("items")))))
        ).alias("item_ids"),
        F.count_if(F.col("at") < 0).cast("int").alias("copies"),
    )
    return per_text.select(
        "doc_id", "_row", "n_words", covered_words(F.col("spans")).alias("n_hit"), "item_ids",
        F.explode_outer(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, columns as they came.

    The rejected ids are broadcast if they are few (see ``without_rows``); texts are then
    not shuffled.
    """
    bad = find_contamination(docs, items, **options).filter("n_hit > 0").select("doc_id", "_row")
    return without_rows(docs, bad)


def digest(found: DataFrame) -> DataFrame:
    """Per document the counts, and the ids of the items found as one hash."""
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def covered_words(spans: Column) -> Column:
    """Number of places inside any of the spans (start, end), which may overlap."""

    def step(acc: Column, s: Column) -> Column:
        return F.struct(
            (acc["n"] + F.greatest(s["e"] - F.greatest(s["s"], acc["done"]), F.lit(0))).cast("int").alias("n"),
            F.greatest(acc["done"], s["e"]).alias("done"),
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("done"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"].cast("long"))
