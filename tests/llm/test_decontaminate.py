"""Decontamination against a plain-Python version of the rule."""

import hashlib
import random
import re

from folioflow.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items):
    rows = []
    for doc_id, text in docs:
        w = words(text)
        hit, named = set(), set()
        for item_id, item in items:
            i = words(item)
            if item_id is None:
                continue
            for s in range(max(len(i) - 9, 1) if i else 0):
                part = i[s : s + 10]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        named.add(str(item_id))
        names = ",".join(sorted(named))
        rows.append(
            (doc_id, len(w), len(hit), len(named), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
        )
    return sorted(rows, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "a", "Été", "x1", "9", "Word", "naïve", "tail", "red"]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "\n"]) for _ in range(n))
    items = [(i, make(rng.randint(8, 25))) for i in range(12)]
    items += [(50, items[0][1]), (51, None), (52, " .. "), (53, "lonely"), (54, "two Words"), (None, make(12))]
    items += [(9, items[1][1]), (100, make(11))]
    docs = [(i, make(rng.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, f"{make(20)} {items[i % 12][1].upper()} {make(15)}") for i in range(14)]
    docs += [(200, None), (201, ""), (202, items[1][1]), (202, items[1][1]), (203, "a lonely two words end")]
    docs += [(None, items[2][1]), (204, (items[3][1] + " ") * 40)]
    d = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, n_words int, words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        found = decontaminate.digest(decontaminate.find_contamination(d, b, broadcast_windows=limit))
        assert sorted((tuple(r) for r in found.collect()), key=str) == expected(docs, items)
    kept = decontaminate.drop_contaminated(d, b)
    clean = [r[:2] for r in expected(docs, items) if not r[5]]
    assert kept.columns == d.columns and kept.count() == len(clean)
    assert decontaminate.find_contamination(d.limit(0), b).count() == 0
    none = decontaminate.digest(decontaminate.find_contamination(d, b.limit(0))).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)


def test_filter_grows_with_the_benchmark(spark):
    from pyspark.sql import functions as F

    for n in (1_000, 30_000, 1_000_000):
        size = decontaminate.filter_size(n)
        assert 2**size >= 24 * n or size == decontaminate.MOST_BITS
    n = 30_000
    size = decontaminate.filter_size(n)
    bits = decontaminate._filter_bits(spark.range(n).select(F.xxhash64("id").alias("h")), size).first()["bits"]
    probes = [r[0] for r in spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id")).collect()]
    inside = [r[0] for r in spark.range(n).select(F.xxhash64("id")).collect()]
    marked = lambda h: bits[(h & ((1 << size) - 1)) >> 6] >> (h & 63) & 1
    assert all(map(marked, inside)) and sum(map(marked, probes)) < 0.05 * len(probes)
