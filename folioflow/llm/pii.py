"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

1. Base patterns find emails, addresses, cards and phones. They always count.
2. Looser patterns give further candidates, many of them false: written-out emails, national phone numbers, digit groups
   without a check sum. A regex, a gazetteer and a context labeler vote on every candidate, base ones
   included: 1 for, -1 against, 0 abstains.
3. Expectation-maximisation over the counts of vote patterns, per kind, estimates how often each labeler is
   right and so how likely each vote pattern is a true span. It is a fold over at most 27 patterns a kind.
4. A logistic classifier is trained on these soft labels. It does not see the votes but the span and its surroundings: its
   shape, its length and digits, and the words on both sides, hashed. It decides about the looser candidates
   that overlap no base span.

All of it is column expressions and joins; the classifier is Spark's own, fitted on at most ``SAMPLE`` candidates.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.common import SPAN_ARRAY, as_spans, label_spans, let, matches, written

KINDS = ("email", "ip", "card", "phone")
# The base patterns. A look-behind holds a match to the start of its run, which
# changes no match and keeps long runs from being searched from every character; possessive groups
# keep the matcher from recursing on long texts.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_FINE = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
# Looser candidates, each kind one pattern, so that its matches do not overlap.
_AT = r"(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20|@)"
_DOT = r"(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.)"
LOOSE = {
    # Possessive: a word that is not followed by "at" or "dot" is not tried again in parts.
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9_%+-]{{1,64}}+(?:{_DOT}[a-z0-9_%+-]{{1,64}}+){{0,3}}{_AT}[a-z0-9-]{{1,63}}+(?:{_DOT}[a-z0-9-]{{2,24}}+){{0,4}}",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9.])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[1-9][0-9]{1,3}[\x20/-]{1,3}[0-9]{5,8}|00[1-9][0-9\x20-]{7,14}[0-9])(?![0-9])",
}
# Words before "at" or after it that make a written-out email of plain prose, with a plain dot.
_PROSE = r"(?i)^[a-z]+\x20at\x20[a-z]+(?:\.[a-z]+)?$|^[^\x20@\[(]+\x20at\x20(?:the|a|an|this|that|all|least|once|first|last|his|her|its|our|your|my|home|work)\b"
# Fixed values of the labelers: what a true span of a kind looks like, and the gazetteers.
STRICT = {
    "email": r"(?i)^[a-z0-9][a-z0-9._%+\x20-]*(?:@|[\[(]\x20?at\x20?[\])]|\x20at\x20).*(?:\.|dot[\])]?)\x20?[a-z]{2,}$",
    "ip": IP_FINE,
    "card": r"^[3-6][0-9\x20-]+$",
    "phone": r"^(?:\+[1-9]|\(?[2-9][0-9]{2}\)?[\x20.-][2-9]|0[1-9]|00[1-9])",
}
TOP_DOMAINS = (
    "com org net edu gov mil info biz io dev app co uk ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg se no dk fi is ee lv lt"
    " ru ua tr il in cn jp kr tw hk sg my th vn id ph au nz za ng ke eg ma br ar cl mx pe ca us eu"
).split()
NOWHERE = "localhost local test invalid example".split()
CALLING_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()
ISSUERS = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 60 62 65".split()
# First numbers of addresses that no host has.
UNROUTED = ["0", "127", *map(str, range(224, 256))]
CUE_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|from|login|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)\b",
}
CUE_AGAINST = r"(?i)\b(?:isbn|issn|version|order|invoice|serial|section|chapter|figure|table|doi|sku|id|ref)\b"
CONTEXT = 40  # characters on either side
ROUNDS = 30
DECIDE = 0.5
RIDGE = 1e-3
SAMPLE = 20_000  # candidates, those with the smallest hashes, that the classifier is fitted on
CANDIDATE = "struct<kind:string,order:int,start:int,end:int,base:boolean,regex:int,gazetteer:int,context:int,inputs:array<int>>"
# Inputs of the classifier, one of each group is on: kind, shape, word before, word after, length, digits.
GROUPS = (len(KINDS), 64, 64, 64, 5, 6)
OFFSETS = [sum(GROUPS[:i]) for i in range(len(GROUPS) + 1)]


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def base_matches(text: Column) -> list[Column]:
    """Per kind, array<struct(start, end, found)> of the base patterns' valid matches."""

    def valid(kind: str, m: Column) -> Column:
        digits = _digits(m["found"])
        if kind == "ip":
            return m["found"].rlike(IP_FINE)
        if kind == "card":
            return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
        return F.length(digits).between(9, 15)

    found = {"email": matches(text, EMAIL)}
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        found[kind] = F.filter(matches(text, pattern), partial(valid, kind))
    return [found[kind] for kind in KINDS]


def _vote(found: Column, against: Column) -> Column:
    return F.when(against, F.lit(-1)).when(found, F.lit(1)).otherwise(F.lit(0))


def gazetteer_vote(kind: str, word: Column) -> Column:
    """What the tables say of a span, looked up by its key."""
    if kind == "email":
        key = F.lower(F.regexp_extract(word, r"([A-Za-z0-9-]+)$", 1))
        host = F.lower(F.regexp_extract(word, r"(?i)(?:@|at[\])]?)\x20?([a-z0-9-]+)", 1))
        return _vote(key.isin(TOP_DOMAINS), key.isin(NOWHERE) | host.isin(NOWHERE))
    if kind == "ip":
        key = F.regexp_extract(word, r"^0*([0-9]+?)\.", 1)
        return _vote(key != "", key.isin(UNROUTED) | word.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$"))
    if kind == "card":
        digits = _digits(word)
        known = F.substring(digits, 1, 1).isin(ISSUERS) | F.substring(digits, 1, 2).isin(ISSUERS)
        return _vote(known, digits.rlike(r"^([0-9])\1+$"))
    abroad = F.regexp_extract(word, r"^(?:\+|00)([1-9][0-9]?)", 1)
    known = abroad.isin(CALLING_CODES) | F.substring(abroad, 1, 1).isin(CALLING_CODES)
    return _vote(known, word.rlike(r"555[\x20.-]?01[0-9]{2}$") | (abroad != "") & ~known)


def _inputs(kind: str, word: Column, left: Column, right: Column) -> Column:
    """array<int>: which inputs of the classifier are on."""
    bucket = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    shape = F.regexp_replace(F.regexp_replace(word, r"[0-9]+", "0"), r"[A-Za-z]+", "a")
    before = F.regexp_extract(F.lower(left), r"(\p{L}+)\P{L}*$", 1)
    after = F.regexp_extract(F.lower(right), r"^\P{L}*(\p{L}+)", 1)
    on = [
        F.lit(KINDS.index(kind)), bucket(GROUPS[1], F.lit(kind), shape), bucket(GROUPS[2], before), bucket(GROUPS[3], after),
        F.least(F.floor(F.length(word) / 8), F.lit(GROUPS[4] - 1)).cast("int"),
        F.least(F.floor(F.length(_digits(word)) / 4), F.lit(GROUPS[5] - 1)).cast("int"),
    ]
    return F.array(*[(x + offset).cast("int") for x, offset in zip(on, OFFSETS)])


def _candidates(text: Column, found: Column, kind: str, base: bool) -> Column:
    """Matches with their three votes and inputs."""

    def judged(m: Column) -> Column:
        word = m["found"]
        strict = word.rlike(STRICT[kind])
        if kind == "card":
            strict = strict & F.call_function("luhn_check", _digits(word))
        if kind == "email":
            strict = strict & ~word.rlike(_PROSE)
        begin = F.greatest(m["start"] - CONTEXT, F.lit(0))
        left, right = F.substring(text, begin + 1, m["start"] - begin), F.substring(text, m["end"] + 1, F.lit(CONTEXT))
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(KINDS.index(kind)).alias("order"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.lit(base).alias("base"),
            F.when(strict, F.lit(1)).otherwise(F.lit(-1)).alias("regex"),
            gazetteer_vote(kind, word).alias("gazetteer"),
            _vote(left.rlike(CUE_FOR[kind]), left.rlike(CUE_AGAINST)).alias("context"),
            _inputs(kind, word, left, right).alias("inputs"),
        ).cast(CANDIDATE)

    return F.transform(found, judged)


def find_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates) of every row: spans of the base patterns, and all spans with votes."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of(base: Column) -> Column:
        spans = F.concat(*[as_spans(base[k], k, i) for i, k in enumerate(KINDS)]).cast(SPAN_ARRAY)
        sure = [_candidates(text, base[k], k, True) for k in KINDS]

        def apart(m: Column) -> Column:
            return ~F.exists(spans, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))

        loose = [_candidates(text, F.filter(matches(text, p), apart), k, False) for k, p in LOOSE.items()]
        return F.struct(F.array_sort(spans).alias("base"), F.concat(*sure, *loose).alias("candidates"))

    base = F.struct(*[m.alias(k) for k, m in zip(KINDS, base_matches(text), strict=True)])
    found = docs.select("doc_id", let(base, of).alias("f"))
    return found.select("doc_id", "f.base", "f.candidates")


def exploded(found: DataFrame) -> DataFrame:
    """One row per candidate, with doc_id."""
    return found.select("doc_id", F.explode_outer("candidates").alias("c")).filter("c is not null").select("doc_id", "c.*")


def vote_counts(found: DataFrame) -> DataFrame:
    """Candidates per kind and votes: at most 27 rows a kind, combined before the shuffle."""
    return exploded(found).groupBy("kind", *LABELERS).agg(F.count("*").cast("double").alias("n"))


LABELERS = ("regex", "gazetteer", "context")
_STATE = "struct<prior:double,right:array<double>,wrong:array<double>>"


def _posterior(state: Column, votes: Column) -> Column:
    """Chance that a candidate with these votes is a true span, labelers taken as independent."""
    odds = F.ln(state["prior"] / (1 - state["prior"]))
    for i in range(len(LABELERS)):
        a, b, v = F.get(state["right"], F.lit(i)), F.get(state["wrong"], F.lit(i)), F.get(votes, F.lit(i))
        odds = odds + F.when(v == 1, F.ln(a / b)).when(v == -1, F.ln((1 - a) / (1 - b))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def reliabilities(counts: DataFrame) -> DataFrame:
    """(kind, state, patterns) after EM: share of true spans, and how often each labeler says yes to
    true and to false ones. The vote of a labeler that abstains is left out of its estimate. Estimates start from,
    and are drawn towards, labelers that are right four times in five."""
    patterns = counts.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n"))
    gathered = patterns.groupBy("kind").agg(
        F.sort_array(F.collect_list(F.struct(F.array(*LABELERS).alias("votes"), "n"))).alias("patterns")
    )
    first = F.struct(
        F.lit(0.5).alias("prior"),
        F.array(*[F.lit(0.8)] * 3).alias("right"),
        F.array(*[F.lit(0.2)] * 3).alias("wrong"),
    ).cast(_STATE)

    def total(values: Column, of) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x))

    def improve(state: Column, _: Column) -> Column:
        weighed = F.transform(
            "patterns",
            lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), _posterior(state, p["votes"]).alias("r")),
        )

        def maximise(w: Column) -> Column:
            def share(i: int, weight, yes: float, no: float) -> Column:
                says = total(w, lambda x: F.when(F.get(x["votes"], F.lit(i)) == 1, weight(x)).otherwise(F.lit(0.0)))
                voted = total(w, lambda x: F.when(F.get(x["votes"], F.lit(i)) != 0, weight(x)).otherwise(F.lit(0.0)))
                return (says + yes) / (voted + yes + no)

            true = lambda x: x["n"] * x["r"]
            false = lambda x: x["n"] * (1 - x["r"])
            return F.struct(
                ((total(w, true) + 1) / (total(w, lambda x: x["n"]) + 2)).alias("prior"),
                F.array(*[share(i, true, 4.0, 1.0) for i in range(3)]).alias("right"),
                F.array(*[share(i, false, 1.0, 4.0) for i in range(3)]).alias("wrong"),
            ).cast(_STATE)

        return let(weighed, maximise)

    state = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, improve)
    return gathered.withColumn("state", state)


def train(found: DataFrame) -> list[float] | None:
    """Weights of the span classifier, the last one its intercept; None if there is no candidate."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = written(vote_counts(found), "votes")
    if not counts.head(1):
        return None
    # One ordered partition, so that the sums are the same in every run.
    place = F.xxhash64("doc_id", "kind", "start")
    some = exploded(found).withColumn("_h", place).orderBy("_h", "kind", "start", "end").limit(SAMPLE)
    some = some.join(F.broadcast(reliabilities(counts).select("kind", "state")), "kind").withColumn(
        "r", _posterior(F.col("state"), F.array(*LABELERS))
    )
    small = written(some.select("inputs", "r").coalesce(1), "soft-labels").coalesce(1).sort("inputs", "r")
    on = F.transform(F.sequence(F.lit(0), F.lit(OFFSETS[-1] - 1)), lambda i: F.array_contains("inputs", i.cast("int")).cast("double"))
    both = small.select(
        array_to_vector(on).alias("features"),
        F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("r").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("r")).alias("weight")))).alias("y"),
    ).select("features", "y.*")
    model = LogisticRegression(weightCol="weight", regParam=RIDGE, maxIter=100, tol=1e-9, standardization=False).fit(both)
    return [*(float(w) for w in model.coefficients), float(model.intercept)]


def scan_pii(docs: DataFrame, decide: float = DECIDE) -> DataFrame:
    """(doc_id, base, spans) of every row of (doc_id, text): arrays of struct(start, order, kind, end), sorted.

    ``spans`` holds the base spans and the looser candidates that the classifier takes for true. Spans that start at one
    place are in the order of the kinds. Positions count code points, ends are exclusive. Texts of any length are
    searched whole. Texts are read once; what is kept of them is spans and votes. Null
    and empty texts have no span; repeated rows are judged alike; an empty table gives no rows. Other columns are
    not read. No step gathers the spans of a document or of a kind in more than its own row or its counts.
    """
    found = written(find_candidates(docs.select("doc_id", "text")), "pii-candidates")
    weights = train(found)

    def wanted(c: Column) -> Column:
        weight = F.array(*[F.lit(w) for w in weights])
        z = F.aggregate(c["inputs"], F.lit(weights[-1]), lambda acc, i: acc + F.get(weight, i))
        return ~c["base"] & (1 / (1 + F.exp(-z)) >= decide)

    if weights is None:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    added = F.transform(
        F.filter("candidates", wanted),
        lambda c: F.struct(c["start"].alias("start"), c["order"].alias("order"), c["kind"].alias("kind"), c["end"].alias("end")),
    ).cast(SPAN_ARRAY)
    return found.select("doc_id", "base", F.array_sort(F.array_union("base", added)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id with base counts per kind, the hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(label_spans(F.col("base")), 256).alias("base_sha256"),
        label_spans(F.col("spans")).alias("spans"),
    )
