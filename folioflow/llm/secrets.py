"""Secret scan: fixed patterns, plus sliding-window entropy over candidate strings."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.common import SPAN_ARRAY, as_spans, label_spans, let, matches

# The base patterns. "Either case" means A-Z and a-z, no other letter.
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

# Entropy: a window of this many characters, and the bits per character from which a
# window counts as random, for each class of characters a candidate may consist of. Letters alone are often
# words, so more is asked of them.
WINDOW = 20
CLASSES: tuple[tuple[str, str, float], ...] = (
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", r"^[A-Za-z+/_=-]+$", 3.95),
    ("0123456789abcdef", r"^[0-9a-f]+$", 3.0),
    ("0123456789ABCDEF", r"^[0-9A-F]+$", 3.0),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"", 3.65),
)
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
# A candidate is looked at only if it has a letter. The allow list names what is random by construction
# and harmless, or a placeholder. Each pattern speaks for the whole candidate: a word or prefix in one
# part of it clears no key in another.
LETTER = r"[A-Za-z]"
ALLOWED = (
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    # A placeholder's word stands by itself in the last part, and no run is as long as a window.
    r"(?i)^(?!.*[a-z0-9+]{20}).*(?<![a-z0-9+])(?:example|sample|placeholder|changeme|dummy|test)(?![a-z0-9+])[^=/]*$",
    r"(?i)^(?:.{0,19}[=/])?(?:x{4,}+|0?123456789?0?|abcdefgh(?:ijklmnopqrstuvwxyz)?|[_+/=-]++){1,64}+$",
    r"^(?:sha(?:1|256|384|512)|md5)[-=](?:[0-9a-fA-F]{32,128}|[A-Za-z0-9+/]{22,88}={0,2})$",
    # Slugs: no part mixes letters and digits, but for a short number at its end.
    r"^[A-Z]?[a-z]++(?:[-_/](?:[A-Z]?[a-z]{1,4}[0-9]{1,2}|[A-Z]?[a-z]{1,6}|[0-9]{1,6}))++$",
    r"^[A-Z]++(?:_(?:[A-Z]{1,6}|[0-9]{1,6}))++$",
)


def _bits(n: Column) -> Column:
    """n * log2(n), 0 for 0."""
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


SPANS = "array<struct<first:int,last:int>>"


def hot_windows(chars: Column, alphabet: str, least: float) -> Column:
    """array<struct(first, last)>: what the windows over ``chars`` with ``least`` bits or more cover.

    Windows that overlap or touch are one span from ``first`` to before ``last``. Counts per character are kept from window to window: the character that
    enters and the one that leaves change two counts and two terms of the sum of n * log2(n),
    from which the entropy follows as log2(W) - sum / W.
    """
    most = WINDOW * (log2(WINDOW) - least)
    state = f"struct<counts:array<int>,total:double,done:{SPANS},first:int,last:int>"
    zero = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0.0).alias("total"),
        F.array().cast(SPANS).alias("done"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    ).cast(state)

    def slot(at: Column) -> Column:
        return F.when(at >= 1, F.call_function("instr", F.lit(alphabet), F.get(chars, at - 1)) - 1)

    def slide(acc: Column, at: Column) -> Column:
        def moved(ends: Column) -> Column:
            enters, leaves = ends["enters"], ends["leaves"]
            up = F.get(acc["counts"], enters)
            down = F.get(acc["counts"], leaves)
            change = F.when(enters.eqNullSafe(leaves), F.lit(0.0)).otherwise(
                _bits(up + 1) - _bits(up) + F.coalesce(_bits(down - 1) - _bits(down), F.lit(0.0))
            )
            counts = F.transform(
                acc["counts"],
                lambda n, i: n
                + (i == enters).cast("int")
                - F.coalesce(i == leaves, F.lit(False)).cast("int"),
            )
            return let(
                acc["total"] + change,
                lambda total: let(
                    (at >= WINDOW) & (total <= most + 1e-9),
                    lambda hot: let(
                        hot & F.coalesce(at - WINDOW > acc["last"], F.lit(False)),
                        lambda apart: F.struct(
                            counts.alias("counts"),
                            total.alias("total"),
                            F.when(apart, F.array_append(acc["done"], F.struct(acc["first"], acc["last"])))
                            .otherwise(acc["done"]).alias("done"),
                            F.when(apart | (hot & acc["first"].isNull()), at - WINDOW).otherwise(acc["first"]).alias("first"),
                            F.when(hot, at).otherwise(acc["last"]).alias("last"),
                        ).cast(state),
                    ),
                ),
            )

        return let(F.struct(slot(at).alias("enters"), slot(at - WINDOW).alias("leaves")), moved)

    return F.aggregate(
        F.sequence(F.lit(1), F.size(chars)),
        zero,
        slide,
        lambda acc: F.when(acc["first"].isNull(), acc["done"]).otherwise(
            F.array_append(acc["done"], F.struct(acc["first"], acc["last"]))
        ),
    )


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with each of the sorted spans replaced by ``by(length)``; a span within an earlier one adds nothing,
    one that begins in it the part beyond."""

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], acc["done"])
        return F.struct(
            F.when(
                s["end"] > acc["done"],
                F.concat(acc["out"], F.substring(text, acc["done"] + 1, begin - acc["done"]), by(s["end"] - begin, s["start"] >= acc["done"])),
            ).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["done"], s["end"]).alias("done"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"))
    return F.aggregate(
        spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["done"] + 1, F.length(text)))
    )


def _random_parts(text: Column) -> Column:
    """Spans of candidates' random parts, those on the allow list left out."""

    def judged(m: Column) -> Column:
        word = m["found"]
        fine = ~word.rlike(LETTER)
        for pattern in ALLOWED:
            fine = fine | word.rlike(pattern)
        hot = F.array().cast(SPANS)
        for alphabet, only, least in reversed(CLASSES):
            windows = let(F.split(word, ""), lambda chars: hot_windows(chars, alphabet, least))
            hot = F.when(word.rlike(only), windows).otherwise(hot) if only else windows
        return F.transform(
            F.when(fine, F.array().cast(SPANS)).otherwise(hot),
            lambda h: F.struct(
                (m["start"] + h["first"]).alias("start"),
                F.lit(3).alias("order"),
                F.lit(KINDS[3]).alias("kind"),
                (m["start"] + h["last"]).alias("end"),
            ),
        )

    return F.flatten(F.transform(matches(text, CANDIDATE), judged)).cast(SPAN_ARRAY)


def base_spans(text: Column) -> Column:
    """array<struct(start, order, kind, end)> of the fixed patterns, unsorted."""
    value_from = f"^{ASSIGN_HEAD}"
    assign = F.filter(
        matches(text, ASSIGN), lambda m: F.length(F.regexp_replace(m["found"], value_from, "")) >= 6
    )
    access = F.filter(matches(text, ACCESS), lambda m: m["end"] - m["start"] >= 20)
    # Runs of 24 and more: the look-behind keeps a match at the start of its run.
    long_hex = matches(text, r"(?<![0-9a-f])[0-9a-f]{24,}")
    return F.concat(
        as_spans(assign, "assign", 0), as_spans(access, "access", 1), as_spans(long_hex, "hex", 2)
    ).cast(SPAN_ARRAY)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Every row with ``base`` and ``secrets``: arrays of struct(start, order, kind, end).

    ``base`` holds the matches of the fixed patterns, ``secrets`` those and the random parts of what is left when
    the base spans are cut out; both are sorted by start, then kind. Two parts of one string are two spans unless
    their windows meet. Positions count code points, ends are exclusive. One narrow projection without a shuffle.
    Null and empty texts have no secret; texts of any length are scanned whole; base spans that start at one place are
    in the order of the kinds; repeated rows are scanned alike; an empty table gives no rows. Input columns named base
    or secrets are replaced.
    """
    given = [c for c in docs.columns if c not in ("base", "secrets")]
    scanned = docs.select(*given, _both_spans(F.col("text")).alias("_s"))
    return scanned.select(*given, "_s.base", "_s.secrets")


def _both_spans(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))

    def both(base: Column) -> Column:
        # Blanks in place of the base spans part what stands beside them, and keep the positions.
        blank = replaced(text, base, lambda size, first: F.repeat(F.lit(" "), size))
        rest = let(F.when(F.size(base) > 0, blank).otherwise(text), _random_parts)
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, rest)).alias("secrets"))

    return let(F.array_sort(base_spans(text)), both)


def secret_spans(text: Column) -> Column:
    """All secret spans of a text, sorted."""
    return _both_spans(text)["secrets"]


def mask_secrets(docs: DataFrame, mask: str = "[secret]", length: str | None = None) -> DataFrame:
    """The rows with every secret in ``text`` replaced by ``mask``; overlapping spans become one.

    Rows without a secret stay as they are, null texts included. ``length`` names a column
    that is set to the length of a masked text.
    """
    text = F.col("text")
    cut = lambda spans: replaced(text, spans, lambda size, first: F.when(first, F.lit(mask)).otherwise(F.lit("")))
    masked = let(secret_spans(text), lambda s: F.when(F.size(s) > 0, cut(s)))
    made = docs.withColumn(new := _free_name(docs), masked)
    changed = {"text": F.coalesce(new, "text")}
    if length:
        changed[length] = F.coalesce(F.length(new), length).cast(docs.schema[length].dataType)
    return made.select(*[changed[c].alias(c) if c in changed else c for c in docs.columns])


def _free_name(docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    name = "_masked"
    while name in docs.columns:
        name += "_"
    return name


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id with counts per base kind, the hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(label_spans(F.col("base")), 256).alias("base_sha256"),
        label_spans(F.col("secrets")).alias("spans"),
    )
