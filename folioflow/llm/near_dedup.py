"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A document's set is that of its word shingles, as 64-bit hashes. The sketch is its ``KEEP`` smallest values.
2. Documents with the same set are one class from here on, however many there are.
3. Inverted lists are keyed by runs of ``RUN`` consecutive retained values. Two sets of the similarity asked for
   share such a run with near certainty, sets of up to ``KEEP`` values always (the smallest are keyed by each
   value as well), while a passage that many documents share rarely makes one.
4. A list gives the pairs of its most central class with each other one, never all pairs. The sketch of the union,
   made of the two sketches, estimates the similarity and leaves out what cannot be near.
5. The exact similarity of the full sets decides. Linked classes become components.
6. What the stars can have missed lies between components that still share lists. These classes go through an exact
   prefix join of their full sets: rarest values first, as many as a near set must share one of, with bounds on
   size and position. First each value's class with the fewest rarer values (in a group of variants the one least
   changed) meets the others; what that links is one component before all others meet. There, sets whose parity
   bits differ in more places than near sets can differ in values make no pair, so a group of many loose variants gives few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.common import BROADCAST_ROWS, let, lower_words, shingle_hashes, without_rows, written
from folioflow.llm.components import components

WORDS = 3
LEAST = 85  # per cent
KEEP = 32
RUN = 3
MARGIN = 0.35  # five standard deviations of an estimate from 32 values and more
PARITY_WORDS = 8  # 64 bits each; beyond some 700 values a set fills them and they leave out little
COUNTERS = 18  # the rarity of a value is read from 2^18 counters, whatever the size of the corpus


def shingle_set(text: Column, size: int) -> Column:
    """Sorted array<long> of the distinct shingles; fewer words than ``size`` are one shingle."""

    def of(w: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= size, F.array_distinct(shingle_hashes(w, size))).when(F.size(w) > 0, whole).otherwise(
            F.slice(whole, 1, 0)
        )

    return F.sort_array(let(lower_words(text), of))


def sketches(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, _row, n_shingles, set_id, sketch) of every row, ``_row`` being a hash of the text; ``set_id`` is null without shingles.

    Sets are told apart by their size, a hash of all values and the two smallest values.
    """
    made = let(
        shingle_set(F.col("text"), size),
        lambda s: F.struct(
            F.size(s).cast("long").alias("n_shingles"),
            F.when(
                F.size(s) > 0,
                F.struct(
                    F.size(s).alias("n"), F.xxhash64(s).alias("all"), F.get(s, F.lit(0)).alias("v1"),
                    F.coalesce(F.get(s, F.lit(1)), F.lit(0).cast("long")).alias("v2"),
                ),
            ).alias("set_id"),
            F.slice(s, 1, KEEP).alias("sketch"),
        ),
    )
    doc_id, row = F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_row")
    return docs.select(doc_id, row, made.alias("m")).select("doc_id", "_row", "m.*")


def _classes(rows: DataFrame) -> DataFrame:
    """(class, first_id, n, sketch, set_id): one row per distinct set; ``class`` is a number, no hash, once it is stored."""
    return (
        rows.filter("set_id is not null")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("first_id"), F.first("sketch").alias("sketch"))
        .withColumn("class", F.monotonically_increasing_id())
        .withColumn("n", F.col("set_id.n"))
    )


def sizes_without_run(least: int) -> int:
    """The largest size of a wholly retained set that can be near another one and share no run with it.

    A value of one set alone breaks up to RUN of its runs, and one of the other set alone RUN - 1.
    """
    most = 0
    for m in range(1, KEEP + 1):
        for n in range(m, m * 100 // least + 1):
            both = -(-(m + n) * least // (100 + least))
            runs = m - RUN + 1 - RUN * (m - both) - (RUN - 1) * (n - both)
            if both <= m and (m, n) != (both, both) and runs < 1:
                most = max(most, n)
    return most


def _lists(classes: DataFrame, least: int) -> DataFrame:
    """(run, class, n): the inverted lists of runs of retained values, of small sets of single ones as well."""
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("sketch") - RUN, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("sketch", i + k) for k in range(RUN)]),
    )
    if small := sizes_without_run(least):
        single = F.transform("sketch", lambda v: F.xxhash64(F.lit("value"), v))
        runs = F.when(F.col("n") <= small, F.concat(runs, single)).otherwise(runs)
    # A smaller set can be near no other one: a single value more or less is too much.
    can = F.col("n") * 100 >= (F.col("n") + 1) * least
    return classes.filter(can).select("class", "n", F.explode_outer(runs).alias("run"))


def _alike_in_size(least: int) -> Column:
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * least


def _near(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, least: int, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are near."""
    half = lambda side: classes.select(F.col("class").alias(side), F.col("sketch").alias(f"s{side}"))

    def estimate(both: Column) -> Column:
        common = F.array_intersect(F.col("sa"), F.col("sb"))
        return F.size(F.array_intersect(both, common)) / F.size(both)

    likely = let(
        F.slice(F.sort_array(F.array_union("sa", "sb")), 1, KEEP), lambda u: estimate(u) >= least / 100 - MARGIN
    )
    kept = written(pairs.join(half("a"), "a").join(half("b"), "b").filter(likely).select("a", "b"), f"{name}-likely")
    sets = _full_sets(kept.select(F.explode(F.array("a", "b")).alias("class")).distinct(), classes, docs, size, name)
    return _exact(kept, sets, least, name)


def _full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, size: int, name: str) -> DataFrame:
    """(class, set) of the wanted classes only, from the text of one document of each."""
    wanted = written(wanted.join(classes.select("class", "first_id"), "class"), f"{name}-wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(side, F.col("doc_id") == F.col("first_id"))
        .select("class", shingle_set(F.col("text"), size).alias("set"))
        # Two texts may have one id: the set must be the one of the class.
        .join(classes.select("class", "set_id"), "class")
        .filter((F.size("set") == F.col("set_id.n")) & (F.xxhash64("set") == F.col("set_id.all")))
        .select("class", "set"),
        f"{name}-sets",
    )


def _exact(pairs: DataFrame, sets: DataFrame, least: int, name: str) -> DataFrame:
    """The pairs whose full sets are near."""
    full = lambda side: sets.select(F.col("class").alias(side), F.col("set").alias(f"f{side}"))
    common = F.size(F.array_intersect("fa", "fb"))
    near = let(common, lambda i: i * 100 >= (F.size("fa") + F.size("fb") - i) * least)
    return written(pairs.join(full("a"), "a").join(full("b"), "b").filter(near).select("a", "b").distinct(), name)


def _rarity(sets: DataFrame) -> DataFrame:
    """One row with ``counts``: how many values of all sets fall on each counter."""
    cell = lambda c: c.bitwiseAND(F.lit((1 << COUNTERS) - 1))
    counted = sets.select(F.explode_outer("set").alias("h")).groupBy(cell(F.col("h")).alias("cell")).agg(
        F.count("*").alias("n")
    )
    every = sets.sparkSession.range(1 << COUNTERS).withColumnRenamed("id", "cell")
    filled = every.join(counted, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))
    gathered = F.sort_array(F.collect_list(F.struct("cell", "n")))
    return written(filled.groupBy().agg(F.transform(gathered, lambda x: x["n"]).alias("counts")), "rarity")


def parity_bits(values: Column) -> list[Column]:
    """``PARITY_WORDS`` longs: every value flips one bit, so two sets differ in at least as many values as bits."""
    word = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(PARITY_WORDS - 1).cast("long"))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))

    def flipped(k: int) -> Column:
        return F.aggregate(
            values, F.lit(0).cast("long"), lambda bits, h: F.when(word(h) == k, bits.bitwiseXOR(bit(h))).otherwise(bits)
        )

    return [flipped(k).alias(f"p{k}") for k in range(PARITY_WORDS)]


def _prefixes(sets: DataFrame, least: int) -> DataFrame:
    """(class, n, at, h): the rarest values of each set, as many as a near set must share one of.

    A near set shares one of the first n - least * n + 1 values, and from the places of a shared value in
    both follows how many more can be shared.
    """
    counts = _rarity(sets).scalar()
    n = F.size("set")
    length = n - F.ceil(n * least / 100).cast("int") + 1
    order = F.transform(
        "set",
        lambda h: F.struct(
            F.get(F.col("counts"), h.bitwiseAND(F.lit((1 << COUNTERS) - 1)).cast("int")).alias("rarity"), h.alias("h")
        ),
    )
    prefix = F.slice(F.sort_array(order), F.lit(1), length)
    parts = sets.withColumn("counts", counts).select(
        "class", n.alias("n"), F.posexplode_outer(prefix).alias("at", "v")
    )
    return written(parts.withColumn("h", F.col("v.h")).drop("v"), "prefixes")


def _can_be_near(least: int) -> Column:
    """Of rows a and b that share a value: neither their sizes nor its places in both rule out that they are near."""
    both = F.ceil((F.col("na") + F.col("nb")) * least / (100 + least))
    return _alike_in_size(least) & (F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= both)


def _least_changed(rows: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of the class that has the fewest values rarer than a shared one with the others of other labels."""
    labelled = rows.select("h", "class", "n", "at").join(labels, "class")
    heads = labelled.groupBy("h").agg(F.min(F.struct("at", "class", "n", "label")).alias("head"), F.count("*").alias("c"))
    met = labelled.join(heads.filter("c > 1"), "h").filter(F.col("label") != F.col("head.label"))
    found = met.select(
        F.col("head.class").alias("a"), F.col("head.n").alias("na"), F.col("head.at").alias("ata"),
        F.col("class").alias("b"), F.col("n").alias("nb"), F.col("at").alias("atb"),
    )
    return found.filter(_can_be_near(least)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _between_components(rows: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of classes with different labels that may be near, by an exact prefix join.

    In each list the classes of its most frequent label are met by the others only, so a large component is not
    joined with itself.
    """
    rows = rows.join(labels, "class")
    each = rows.groupBy("h", "label").agg(F.count("*").alias("c"))
    main = each.groupBy("h").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"))
    mixed = rows.join(main.filter("labels > 1").select("h", "main"), "h")
    words = [f"p{k}" for k in range(PARITY_WORDS)]
    side = lambda x: mixed.select(
        "h", "main", F.col("class").alias(x), F.col("label").alias(f"l{x}"), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}"),
        *[F.col(p).alias(p + x) for p in words],
    )
    left = side("a").filter("la != main").drop("main")
    once = (F.col("lb") == F.col("main")) | (F.col("a") < F.col("b"))
    # Near sets have 100 * common >= least * union, so they differ in at most this share of both sizes.
    apart = sum((F.bit_count(F.col(p + "a").bitwiseXOR(F.col(p + "b"))) for p in words), F.lit(0))
    bits = apart * (100 + least) <= (F.col("na") + F.col("nb")) * (100 - least)
    found = left.join(side("b"), "h").filter((F.col("la") != F.col("lb")) & once & _can_be_near(least) & bits)
    return found.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, size: int = WORDS, least: int = LEAST) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id of the group), kept.

    Null and empty texts have no shingles and are linked with nothing: they are their own component.
    Repeated rows come out repeated, each with the group's id. A null doc_id names no group: such a
    row has the smallest id of its group if there is one, else null, and ``kept`` is doc_id <=> component_id.
    An empty table gives no rows; other columns are not read. Exact copies become one class by a
    combining aggregate before any list is made. The only join on which a group of copies can be a
    hot key, that of rows with their classes, is an inner join by sort-merge, which AQE splits.
    """
    grouped = _grouped(docs, size, least).select("doc_id", "n_shingles", "component_id")
    return grouped.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, size: int, least: int) -> DataFrame:
    """(doc_id, _row, n_shingles, group, component_id) of every row; ``group`` is null without shingles."""
    docs = docs.select("doc_id", "text")
    rows = written(sketches(docs, size), "sketches")
    # A class without any id is named by none; its rows are handled with the empty ones below.
    classes = written(_classes(rows), "classes")
    linkable = classes.filter("first_id is not null")
    lists = written(_lists(linkable, least), "lists")

    members = lists.groupBy("run").agg(F.count("*").alias("members")).filter("members > 1")
    shared = written(lists.join(members, "run"), "shared")
    # The head of a list is the class that shares most with others: in a group of variants the one
    # in the middle, to which most of them are near.
    central = shared.groupBy("class").agg(F.sum("members").alias("weight"))
    weighed = shared.join(central, "class")
    heads = weighed.groupBy("run").agg(F.max(F.struct("weight", "class", "n")).alias("head"))
    stars = (
        shared.join(heads, "run")
        .filter(F.col("class") != F.col("head.class"))
        .select(F.col("head.class").alias("a"), F.col("class").alias("b"), F.col("head.n").alias("na"), F.col("n").alias("nb"))
        .filter(_alike_in_size(least))
        .select("a", "b")
        .distinct()
    )
    stars = written(stars, "stars")
    links = _near(stars, linkable, docs, size, least, "near")
    first = components(links)

    labelled = shared.join(first, shared["class"] == first["node"], "left").select(
        "run", "class", "n", F.coalesce("label", "class").alias("label")
    )
    mixed = labelled.groupBy("run").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    loose = written(labelled.join(mixed.select("run"), "run").select("class", "label").distinct(), "loose")
    sets = _full_sets(loose.select("class"), linkable, docs, size, "loose")
    prefixes = _prefixes(sets, least)
    links = links.union(_exact(written(_least_changed(prefixes, loose, least), "changed"), sets, least, "near-changed"))
    second = components(links)
    apart = loose.select("class").join(second, loose["class"] == second["node"], "left").select(
        "class", F.coalesce("label", "class").alias("label")
    )
    # Written before rows are exploded: once per set, not once per value.
    bits = written(sets.select("class", *parity_bits(F.col("set"))), "bits")
    rest = written(_between_components(prefixes, apart.join(bits, "class"), least), "rest")
    more = _exact(rest, sets, least, "near-rest")
    labels = components(links.union(more))

    named = classes.join(labels, classes["class"] == labels["node"], "left").select(
        "set_id", "first_id", F.coalesce("label", "class").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    groups = written(
        named.join(smallest, "label").select("set_id", F.col("label").alias("group"), "component_id"), "groups"
    )
    with_set = (
        rows.filter("set_id is not null").drop("sketch")
        .join(groups.hint("merge"), "set_id")
        .select("doc_id", "_row", "n_shingles", "group", "component_id")
    )
    none = F.lit(None).cast("long").alias("group")
    without = rows.filter("set_id is null").select(
        "doc_id", "_row", "n_shingles", none, F.col("doc_id").alias("component_id")
    )
    return with_set.unionByName(without)


def drop_near_duplicates(docs: DataFrame, size: int = WORDS, least: int = LEAST) -> DataFrame:
    """One row of each group, that of the smallest doc_id, with all its columns.

    Of rows that share this id the one with the smallest hash of its text stays, and of rows that share the text
    as well one. A null id is larger than all others. Rows without shingles all stay. Rows that go are
    named by id and hash and broadcast if they are few; else texts are joined with them by shuffle.
    """
    grouped = written(_grouped(docs, size, least).filter("group is not null").select("doc_id", "_row", "group"), "grouped")
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    best = grouped.groupBy("group").agg(F.min(key).alias("best"))
    best = written(best.select(F.col("best.doc_id").alias("_id"), F.col("best._row").alias("_text")), "best")
    # A text belongs to one group, so the row itself and not its group, which may be large, is looked up.
    stays = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_text"))
    kept = without_rows(docs, grouped.join(best, stays, "left_anti").select("doc_id", "_row"))
    # Repeated rows are few; only they are gathered by id and text.
    again = written(
        grouped.join(best, stays, "left_semi").groupBy("doc_id", "_row").agg(F.count("*").alias("n"))
        .filter("n > 1").select("doc_id", "_row"), "repeated",
    )
    if not again.head(1):
        return kept
    once = without_rows(kept, again)
    names = again.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text")) == F.col("_text"))
    repeated = kept.join(names, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)
