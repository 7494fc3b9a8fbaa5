"""Mixing: targets, virtual finish times and the cut against plain Python."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from folioflow.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size long, _row int"


def targets(sizes, weights, repeats, budget):
    """Water-filling as the contract tells it: share, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: float(repeats * sizes[s]) for s in names}
        rate = (budget - sum(repeats * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        more = {s for s in free if rate * weight[s] > repeats * sizes[s]}
        if not more:
            return {s: float(repeats * sizes[s]) if s in capped else rate * weight[s] for s in names}
        capped |= more


def documents(seed, n=700):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "b", "b", "b", "b", "B", "é", "zz", "\U0001f600", "￮", None, ""])
        rows.append((i, " ".join(f"w{k}" for k in range(rng.choice([0, 1, 3, 10, 40, 200]))) + rng.choice(["", " \n", " x"]), source))
    rows += [(3, "same text", "b")] * 50 + [(None, "no id", "a")] * 3 + [(9000, None, "a"), (9001, "", None), (9002, "", "empty")]
    rows += [(9003, "tiny", "one word"), (9004, "x " * 5000, "zz")]
    return rows


def test_mix(spark, monkeypatch):
    monkeypatch.setattr("folioflow.llm.ranges.LEAST_ROWS", 20)
    given = documents(1)
    docs = spark.createDataFrame([(*r, 7, 7) for r in given], SCHEMA).repartition(5)
    for budget, weights, repeats in ((None, (1, 2, 3), 3), (10_000, (5, 1), 3), (10**6, (1, 2, 3), 3), (20_000, (1,), 1)):
        got = mixing.mix_documents(docs, weights, repeats, budget).collect()
        count = lambda t: len(WORD.findall(t or ""))
        sizes = defaultdict(int)
        for _, t, s in given:
            sizes[s] += count(t)
        all_words = sum(sizes.values())
        want = targets(sizes, weights, repeats, all_words if budget is None else budget)
        assert Counter((r.doc_id, r.size) for r in got) == Counter((d, count(t)) for d, t, _ in given)
        by = defaultdict(int)
        texts = defaultdict(list)
        for d, t, s in given:
            texts[d, count(t)].append(s)
        for r in got:
            assert 0 <= r.taken <= repeats * r.size
            owners = {s for s in texts[r.doc_id, r.size] if (sizes[s], want[s]) == (r.source_size, r.target)}
            assert owners
            by[r.source_size, r.target] += r.taken
        spread = defaultdict(int)
        for s in sizes:
            spread[sizes[s], want[s]] += int(want[s])
        assert dict(by) == {k: v for k, v in spread.items()}
        assert sum(by.values()) <= (all_words if budget is None else budget)


def test_order_is_by_finish_time_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr("folioflow.llm.ranges.LEAST_ROWS", 20)
    docs = spark.createDataFrame(documents(2), "doc_id long, text string, source string")
    queue, budget = mixing.queue_documents(docs)
    served = mixing.serve(queue, budget).orderBy("position").collect()
    assert [r.finish for r in served] == sorted(r.finish for r in served) and served[-1].finish <= 1
    position = 0
    for r in served:
        assert r.position == position and r.words > 0
        position += r.words
    # each queue is in shuffled order: words ahead of a row are those of rows with a smaller place
    rows = queue.collect()
    for r in rows[::37]:
        place = lambda x: (x._order, x.doc_id is not None, x.doc_id or 0, x.size, x._row)
        ahead = sum(x.size for x in rows if (x._unnamed, x._source) == (r._unnamed, r._source) and place(x) < place(r))
        assert r._before == ahead
    # at any time a source has its share, but for the document in service
    half = [r for r in served if r.finish <= 0.5]
    target = {(r._unnamed, r._source): r.target for r in rows}
    longest = {k: max(x.size for x in rows if (x._unnamed, x._source) == k) for k in target}
    for k in target:
        assert abs(sum(r.words for r in half if (r._unnamed, r._source) == k) - target[k] / 2) <= longest[k]
    once = Counter(mixing.mix_documents(docs).collect())
    assert once == Counter(mixing.mix_documents(docs.repartition(7, F.rand(3))).collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix_documents(docs).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
