"""Quality rules: a table of thresholds compiled into one projection, no user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.common import let, shingle_hashes, words

# Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to in that is was for it with as his on be at by had are but from or have an they which one "
    "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat "
    "de la le et les des en un du une que est pour qui dans par pas au sur se ne ce "
    "el los y que del las un por con no una su para es lo como"
).split()

# (measure, lowest, highest) a document may have; None leaves a side open.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.5, 12.0),
    ("symbol_ratio", None, 0.2),
    ("exclaim_ratio", None, 0.5),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.5),
    ("repeat_word_ratio", None, 0.5),
)


def repeat_words(tokens: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Hashes first tell whether any window repeats, and which may; only those are compared as
    strings. All steps are linear but for one sort of numbers and one of the repeated windows.
    """

    def suspects(hashes: Column) -> Column:
        # Hash and place share one number, so that plain numbers are sorted.
        bits = F.ceil(F.log2(F.size(hashes))).cast("int")
        marked = F.transform(
            hashes, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))
        )
        same = lambda x, y: F.call_function("shiftright", x.bitwiseXOR(y), bits) == 0
        mask = (F.call_function("shiftleft", F.lit(1), bits) - 1).cast("long")
        return let(F.sort_array(marked), lambda s: _repeated(s, same, lambda x: x.bitwiseAND(mask).cast("int")))

    def confirmed(places: Column) -> Column:
        texts = F.transform(
            places,
            lambda i: F.struct(
                F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(3)]).alias("w"), i.alias("at")
            ),
        )
        found = let(
            F.sort_array(texts), lambda s: _repeated(s, lambda x, y: x["w"] == y["w"], lambda x: x["at"])
        )
        return F.sort_array(found)

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda s, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - s, F.lit(3)))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    return let(
        shingle_hashes(tokens, 3),
        lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(suspects(hashes), confirmed), covered)
        ),
    ).cast("long")


def _repeated(ordered: Column, same, place) -> Column:
    """array<int>: places of the items of a sorted array that are the same as a neighbour."""
    firsts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(ordered) - 2, F.lit(0))),
        lambda i: same(F.get(ordered, i), F.get(ordered, i + 1)),
    )
    both = F.transform(firsts, lambda i: F.array(place(F.get(ordered, i)), place(F.get(ordered, i + 1))))
    return F.array_distinct(F.flatten(both))


def measures(text: Column) -> Column:
    """struct of the counts that the rules use. Null and empty texts have zero of everything."""
    text = F.coalesce(text, F.lit(""))
    stop = [form for w in dict.fromkeys(STOP_WORDS) for form in (w, w.capitalize())]

    def counted(tokens: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        joined = F.array_join(tokens, "")
        return let(
            lines,
            lambda full: F.struct(
                F.size(tokens).cast("long").alias("n_words"),
                F.length(joined).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                repeat_words(tokens).alias("n_repeat_words"),
                F.size(full).cast("long").alias("n_lines"),
                F.size(F.filter(full, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*\x{2022}]"))).alias("n_bullet_lines"),
                F.size(F.filter(full, lambda x: x.rlike(r"(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
                F.size(F.filter(tokens, lambda w: w.isin(stop))).alias("n_stop_words"),
                (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("!"), F.lit("")))).alias("n_exclaims"),
            ),
        )

    return let(words(text), counted)


def ratios(m: Column) -> dict[str, Column]:
    """The measures of the threshold table; a ratio over nothing is 0."""

    def over(part: str, whole: str) -> Column:
        return F.when(m[whole] > 0, m[part] / m[whole]).otherwise(F.lit(0.0))

    return {
        "n_words": m["n_words"],
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "exclaim_ratio": over("n_exclaims", "n_words"),
        "stop_word_ratio": over("n_stop_words", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "bullet_line_ratio": over("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": over("n_ellipsis_lines", "n_lines"),
        "repeat_word_ratio": over("n_repeat_words", "n_words"),
    }


def failed_rules(m: Column, thresholds=THRESHOLDS) -> Column:
    """array<string>: names of the rules a document breaks, in table order."""
    values = ratios(m)

    def broken(name: str, low: float | None, high: float | None) -> Column:
        value = values[name]
        outside = (value < low if low is not None else F.lit(False)) | (
            value > high if high is not None else F.lit(False)
        )
        return F.when(outside, F.lit(name))

    return F.array_compact(F.array(*[broken(*rule) for rule in thresholds]))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def apply_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Every row with ``quality`` (struct of counts), ``failed`` (rule names), ``base_failed`` and ``kept``.

    One narrow projection: nothing is shuffled, so a source with a third of all rows is no
    special case. Null and empty texts have no words and fail; repeated rows are judged
    alike, each on its own; an empty table gives no rows. Columns of the input named like
    the four results are replaced, all others are passed through.
    """
    given = [c for c in docs.columns if c not in ("quality", "failed", "base_failed", "kept")]
    verdict = let(
        measures(F.col("text")),
        lambda m: F.struct(
            m.alias("quality"), failed_rules(m, thresholds).alias("failed"), base_failed(m).alias("base_failed")
        ),
    )
    judged = docs.select(*given, verdict.alias("_verdict"))
    return judged.select(
        *given,
        "_verdict.quality", "_verdict.failed", "_verdict.base_failed",
        (~F.col("_verdict.base_failed") & (F.size("_verdict.failed") == 0)).alias("kept"),
    )


def passing(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows that break no rule, with the columns they came with."""
    ok = let(measures(F.col("text")), lambda m: ~base_failed(m) & (F.size(failed_rules(m, thresholds)) == 0))
    return docs.filter(ok)
