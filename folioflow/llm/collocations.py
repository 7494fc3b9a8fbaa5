"""Phrases whose words keep together, from suffixes sorted by multikey three-way quicksort.

A suffix pointer stands for up to five words from one place on. Words are 64-bit hashes (checked to be one to one). Leading
words are counted over the whole table first, one word and then two, and suffixes that start infrequently go no
further; the others are routed by their words into ranges. There the quicksort splits the pointers word by word into
smaller, equal and larger ones: the size of an equal part is the count of its phrase, and parts below the least count
are abandoned. Phrases cut by the border of a range are given out with what the range has, and added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.llm.common import BROADCAST_ROWS, bounded_batches, written

LONGEST = 5  # words of a phrase at most
KNOWN_WORDS = 400_000  # words a task remembers before it starts anew
SLICE = 4 << 20  # bytes of text that are cut into words at a time
PLACES = 1 << 20  # suffixes that are spelled out at a time
FILTER_BITS = 1 << 26  # the filters of frequent words and pairs have 8 MB at most
RANGE_ROWS = 1_000_000  # suffixes of a range, about
H = [f"h{i}" for i in range(1, LONGEST + 1)]
GRAM = ", ".join(f"{h} long" for h in H)

# What ends a piece, and what stands between words.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
_TABLE = bytes.maketrans(BREAKS + BLANKS, b"\n" * len(BREAKS) + b" " * len(BLANKS))
_BREAK = b"\xff"  # a token of its own, which no text in UTF-8 holds


class Words(dict):
    """Word to number in a task, 0 for the end of a piece, with a 64-bit hash of language and word for each number."""

    def __init__(self, lang: str, seed: int):
        super().__init__({_BREAK: 0})
        self.prefix, self.seed = lang.encode() + b"\0", seed
        self.hashes: list[int] = [0]

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = number = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(self.prefix + word, self.seed) or 1)
        return number

    def hashed(self) -> np.ndarray:
        return np.array(self.hashes, np.uint64)

    def numbers(self, text: bytes) -> np.ndarray:
        """The words of texts joined by line ends, as numbers; A-Z in lower case."""
        text = text.lower().translate(_TABLE).replace(b"\n", b" " + _BREAK + b" ")
        found, start = [np.zeros(1, np.int32)], 0
        while start < len(text):
            stop = len(text)
            if stop - start > SLICE:
                stop = text.rfind(b" ", start, start + SLICE)
                if stop <= start:
                    stop = text.find(b" ", start + SLICE)
                stop = len(text) if stop < 0 else stop + 1
            found.append(np.array(list(map(self.__getitem__, text[start:stop].split())), np.int32))
            start = stop
        found.append(np.zeros(LONGEST, np.int32))
        return np.concatenate(found)


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two: multiply, fold, multiply."""
    x = first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def holds(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which hashes are in a filter: all that were put there, and few others."""
    place = hashed & np.uint64(64 * len(bits) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def filter_of(rows: DataFrame, count: int) -> np.ndarray:
    """A bit for the hash (h1, or h1 and h2) of every row: 16 bits a row, up to a fixed size."""
    size = 1 << min(max(10, (16 * count - 1).bit_length()), FILTER_BITS.bit_length() - 1)
    pairs = "h2" in rows.columns

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashed = frame["h1"].to_numpy().astype(np.uint64)
            if pairs:
                hashed = mixed(hashed, frame["h2"].to_numpy().astype(np.uint64))
            place = hashed & np.uint64(size - 1)
            yield pd.DataFrame({"cell": (place >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (place & np.uint64(63))).astype(np.int64)})

    found = rows.mapInPandas(cells, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[found["cell"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint64)
    return bits


def by_language(docs: DataFrame, seed: int, found: Callable, schema: str, frame_end: Callable | None = None) -> DataFrame:
    """``found(words, numbers)`` of every batch of texts of one language, as rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Words] = {}
        for frame in frames:
            for lang, texts in frame.groupby("lang", sort=False)["text"]:
                words = known.setdefault(lang, Words(lang, seed))
                yield from found(words, words.numbers(b"\n".join(texts)))
                if sum(map(len, known.values())) > KNOWN_WORDS:
                    yield from frame_end(known) if frame_end else ()
                    known.clear()
        if frame_end:
            yield from frame_end(known)

    return docs.mapInPandas(run, schema)


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def count_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """(h1, lang, word, n) of every word, stored, and the seed under which no two words have one hash."""
    for seed in range(8):

        def counted(words: Words, numbers: np.ndarray) -> Iterator[pd.DataFrame]:
            if not hasattr(words, "counts"):
                words.counts = np.zeros(0, np.int64)
            more = np.bincount(numbers, minlength=len(words.hashes))
            more[: len(words.counts)] += words.counts
            words.counts = more
            return iter(())

        def given(known: dict[str, Words]) -> Iterator[pd.DataFrame]:
            for lang, words in known.items():
                spelled = list(words)[1:]
                yield pd.DataFrame(
                    {"h1": words.hashed()[1:].view(np.int64), "lang": lang, "word": spelled, "n": words.counts[1:]}
                )

        parts = by_language(docs, seed, counted, "h1 long, lang string, word binary, n long", given)
        sums = parts.groupBy("h1").agg(
            F.min(F.struct("lang", "word")).alias("_first"), F.max(F.struct("lang", "word")).alias("_last"), F.sum("n").alias("n")
        )
        found = written(sums, "words")
        if not found.filter("_first != _last").limit(1).count():
            return found.select("h1", "_first.lang", "_first.word", "n"), seed
    raise ValueError("word hashes collide under every seed")


def count_pairs(docs: DataFrame, seed: int, frequent: DataFrame, least: int) -> DataFrame:
    """(h1, h2, n) of every two words in a row that occur ``least`` times, stored."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(frequent.select("h1"), frequent.count()))

    def counted(words: Words, numbers: np.ndarray) -> Iterator[pd.DataFrame]:
        hashed = words.hashed()
        usual = holds(bits.value, hashed) & (hashed != 0)
        both = usual[numbers[:-1]] & usual[numbers[1:]]
        codes = numbers[:-1][both].astype(np.int64) * len(hashed) + numbers[1:][both]
        codes, n = np.unique(codes, return_counts=True)
        signed = hashed.view(np.int64)
        yield pd.DataFrame({"h1": signed[codes // len(hashed)], "h2": signed[codes % len(hashed)], "n": n})

    parts = by_language(docs, seed, counted, "h1 long, h2 long, n long")
    return written(parts.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "pairs")


def suffixes(docs: DataFrame, seed: int, pairs: DataFrame) -> DataFrame:
    """(h1 to h5, n, task): three to five words from a place on, stored; 0 beyond the piece or an infrequent pair.

    Equal suffixes of a batch are one row with their number.
    """
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(pairs.select("h1", "h2"), pairs.count()))

    def found(words: Words, numbers: np.ndarray) -> Iterator[pd.DataFrame]:
        hashed = words.hashed()
        for start in range(0, len(numbers) - LONGEST, PLACES):
            h = hashed[numbers[start : start + PLACES + LONGEST]]
            usual = holds(bits.value, mixed(h[:-1], h[1:])) & (h[:-1] != 0) & (h[1:] != 0)
            size = min(PLACES, len(h) - LONGEST)
            open_, columns = usual[:size] & usual[1 : size + 1], []
            at = np.flatnonzero(open_)
            columns = [h[at], h[at + 1], h[at + 2]]
            more = np.ones(len(at), bool)
            for k in range(3, LONGEST):
                more &= usual[at + k - 1]
                columns.append(np.where(more, h[at + k], np.uint64(0)))
            # Equal rows lie together in the order of their hash; the rows themselves are compared.
            code = columns[0]
            for c in columns[1:]:
                code = mixed(code, c)
            order = np.argsort(code)
            rows = np.stack([c[order] for c in columns])
            new = np.ones(len(order), bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            firsts = np.flatnonzero(new)
            n = np.diff(np.append(firsts, len(order)))
            yield pd.DataFrame({**{c: r[firsts].view(np.int64) for c, r in zip(H, rows)}, "n": n})

    parts = by_language(docs, seed, found, f"{GRAM}, n long")
    return written(parts.withColumn("task", F.spark_partition_id()), "suffixes")


def quicksorted(columns: list[np.ndarray], n: np.ndarray, least: int, shortest: int = 3) -> Iterator[tuple[int, int, int]]:
    """(a row of the phrase, words of it, count) by multikey three-way quicksort of pointers to rows.

    All phrases of ``shortest`` words or more whose rows are all here and weigh ``least`` or more, and those that hold the
    first or the last row in order, which may go on elsewhere, whatever they weigh.
    """
    open_parts = [(np.arange(len(n)), 0, True, True)]
    while open_parts:
        pointers, depth, first, last = open_parts.pop()
        if not len(pointers) or (not first and not last and n[pointers].sum() < least):
            continue
        keys = columns[depth][pointers]
        middle = len(keys) // 2
        pivot = sorted((keys[0], keys[middle], keys[-1]))[1]
        smaller, larger = pointers[keys < pivot], pointers[keys > pivot]
        equal = pointers[keys == pivot]
        open_parts.append((smaller, depth, first, last and not len(larger) and not len(equal)))
        open_parts.append((larger, depth, first and not len(smaller) and not len(equal), last))
        first, last = first and not len(smaller), last and not len(larger)
        if pivot == 0:
            continue
        size = int(n[equal].sum())
        if size >= least or first or last:
            if depth + 1 >= shortest:
                yield int(equal[0]), depth + 1, size
            if depth + 1 < len(columns):
                open_parts.append((equal, depth + 1, first, last))


def count_phrases(rows: DataFrame, least: int) -> DataFrame:
    """(h1 to h5, n) of every phrase of three words or more that occurs ``least`` times."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [frame[[*H, "n"]].to_numpy(np.int64) for frame in frames]
        if not sum(map(len, parts)):
            return
        table = np.concatenate(parts).T
        found = np.array(list(quicksorted([np.ascontiguousarray(c) for c in table[:-1]], table[-1], least)), np.int64).reshape(-1, 3)
        for i in range(0, len(found), 100_000):
            at, words, size = found[i : i + 100_000].T
            yield pd.DataFrame({**{h: np.where(words > k, table[k][at], 0) for k, h in enumerate(H)}, "n": size})

    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    routed = rows.repartitionByRange(ranges, *H, "task").mapInPandas(counted, f"{GRAM}, n long")
    return routed.groupBy(*H).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def count_grams(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Every phrase of one to five words that occurs ``least`` times (h1 to h5, n, k, lang and word where k = 1), and the
    words of each language (lang, total)."""
    texts = prepared(docs)
    bounded_batches(docs.sparkSession)
    words, seed = count_words(texts)
    frequent = words.filter(F.col("n") >= least)
    pairs = count_pairs(texts, seed, frequent, least)
    phrases = count_phrases(suffixes(texts, seed, pairs), least)
    zero = F.lit(0).cast("long")
    wide = lambda df: df.withColumns({h: zero for h in H if h not in df.columns}).select(*H, "n")
    longer = wide(pairs).unionByName(phrases).withColumns({"lang": F.lit(None).cast("string"), "word": F.lit(None).cast("binary")})
    grams = frequent.withColumns({h: zero for h in H[1:]}).select(*H, "n", "lang", "word").unionByName(longer)
    grams = grams.withColumn("k", sum((F.when(F.col(h) != 0, 1).otherwise(0) for h in H), F.lit(0)))
    return written(grams, "grams"), written(words.groupBy("lang").agg(F.sum("n").alias("total")), "languages")


def _score(a: Column, total: Column, left: Column, right: Column) -> Column:
    """floor(1000 a total / (left right)) without rounding: products have up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function(
        "div", wide(a) * wide(total) * F.lit(1000).cast("decimal(4,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")
    )


def mine_phrases(docs: DataFrame, least: int = 100, top: int | None = 2_000) -> DataFrame:
    """The best phrases of every language of (text, lang): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z only) and split into pieces and words; a phrase has two to five words of one piece and occurs
    a >= ``least`` times, overlaps included. Of its cuts into two parts the one with the lowest score
    floor(1000 a n / (l r)) counts (ties: the first), l and r being the counts of the parts and n the words of the language.
    Phrases within a longer one that occurs as often are dropped. Ranked by score, count, then phrase in byte order.
    A null language is ``und``, a null text empty; repeated rows count again; an empty table has no phrases; other
    columns are ignored; texts of any length are counted whole, SLICE bytes at a time.
    """
    grams, totals = count_grams(docs, least)
    long_ = grams.filter("k > 1").select(*[F.col(h).alias(f"g{h}") for h in H], "k", F.col("n").alias("a"))
    spelled = F.array(*[f"g{h}" for h in H])
    cuts = long_.select("*", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    skip = F.when(F.col("side") == 0, 0).otherwise(F.col("cut"))
    stop = F.when(F.col("side") == 0, F.col("cut")).otherwise(F.col("k"))
    parts = cuts.withColumns(
        {h: F.when(skip + i < stop, F.get(spelled, skip + i)).otherwise(F.lit(0).cast("long")) for i, h in enumerate(H)}
    ).join(grams.drop("k", "word"), H)
    whole = [f"g{h}" for h in H]
    # A part as frequent as the whole, and one word shorter, is always within it. Longer ones follow from these.
    within = parts.filter((stop - skip == F.col("k") - 1) & (F.col("k") > 2) & (F.col("n") == F.col("a")))
    within = written(within.select(*H).distinct(), "phrases-within")
    count = lambda i, side: F.max(F.when((F.col("cut") == i) & (F.col("side") == side), F.col("n")))
    scored = parts.groupBy(*whole, "k", "a").agg(
        F.max(F.when((F.col("cut") == 1) & (F.col("side") == 0), F.col("lang"))).alias("lang"),
        *[count(i, side).alias(f"{name}{i}") for i in range(1, LONGEST) for side, name in enumerate("lr")],
    )
    scored = scored.toDF(*H, *scored.columns[LONGEST:]).join(within, H, "left_anti")
    few = F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals
    scored = scored.join(few, "lang")
    cut = F.array_min(
        F.filter(
            F.array(
                *[
                    F.struct(
                        _score(F.col("a"), F.col("total"), F.col(f"l{i}"), F.col(f"r{i}")).alias("score"), F.lit(i).alias("cut"),
                        F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r"),
                    )
                    for i in range(1, LONGEST)
                ]
            ),
            lambda c: c["l"].isNotNull(),
        )
    )
    scored = scored.withColumn("_cut", cut).select(*H, "k", "lang", "a", F.col("total").alias("n"), "_cut.score", "_cut.l", "_cut.r")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    if top is not None:
        # Phrases with the count and score of the last one stay until they are spelled.
        scored = scored.withColumn("_rank", F.rank().over(best)).filter(F.col("_rank") <= top).drop("_rank")
    scored = written(scored, "phrases")
    words = grams.filter("k = 1").select(F.col("h1").alias("h"), F.col("word").cast("string").alias("word"))
    spelled = scored.select(*H, F.posexplode(F.expr(f"slice(array({', '.join(H)}), 1, k)")).alias("at", "h")).join(words, "h")
    spelled = spelled.groupBy(*H).agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("_words"))
    named = scored.join(spelled, H).withColumn("phrase", F.array_join(F.col("_words.word"), " "))
    named = named.withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    if top is not None:
        named = named.filter(F.col("rank") <= top)
    return named.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
