"""Near duplicates against exact similarities of all pairs."""

import random
import re

from folioflow.llm import near_dedup
from folioflow.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def expected(docs, size=3, least=85):
    sets = [shingles(t, size) for _, t in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= least * len(a | sets[j]):
                group[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            smallest[root(i)] = min(doc_id, smallest.get(root(i), doc_id))
    rows = [(d, len(sets[i]), smallest.get(root(i))) for i, (d, _) in enumerate(docs)]
    return sorted(((d, n, c, d == c) for d, n, c in rows), key=str)


def test_equals_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 8, 12, 30, 80, 200]))]
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append(" ".join(text))
    passage = " ".join(rng.choice(words) for _ in range(60))
    docs += [f"{passage} {' '.join(rng.choice(words) for _ in range(20))}" for _ in range(60)]
    chain = [rng.choice(words) for _ in range(120)]
    for step in range(12):  # each near the next, the ends far apart
        docs.append(" ".join([f"c{i}" if i < 3 * step else w for i, w in enumerate(chain)]))
    docs += [None, "", " \n ", "one", "One", "one two", "É x y", "é x y", docs[0], docs[0].upper(), "A b C d", "a B c d"]
    rng.shuffle(docs)
    docs = list(enumerate(docs)) + [(3, docs[3]), (None, docs[5]), (None, "nobody else has this text")]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, n string")
    assert sorted((tuple(r) for r in near_dedup.near_duplicates(df).collect()), key=str) == expected(docs)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_small_sets_lose_no_link(spark):
    rng = random.Random(9)
    docs = []
    for i in range(150):
        base = [f"v{i}_{k}" for k in range(rng.randint(1, 8))]
        docs.append(" ".join(base))
        other = list(base)
        if rng.random() < 0.5:
            other.append("x")
        else:
            other[rng.randrange(len(other))] = "y"
        docs.append(" ".join(other))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(df, size=1, least=80).collect()), key=str)
    assert got == expected(docs, 1, 80) and sum(not r[3] for r in got) > 30


def test_retained_sets_share_a_run():
    rng = random.Random(10)
    for least in (80, 85):
        small = near_dedup.sizes_without_run(least)
        for _ in range(4000):
            pool = rng.sample(range(10**6), 40)
            a, b = set(pool[: rng.randint(small + 1, near_dedup.KEEP)]), set()
            b = set(a)
            while b and 100 * len(a & b) >= least * len(a | b):
                last, b = set(b), set(b)
                b ^= {rng.choice(pool)}
            if small < len(last) <= near_dedup.KEEP:
                runs = lambda s: {tuple(sorted(s)[i : i + 3]) for i in range(max(1, len(s) - 2))}
                assert runs(a) & runs(last)


def test_drop_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w9", "other")
    given = [(3, text), (2, near), (2, near), (None, text), (5, None), (5, None), (6, ""), (7, "short one")]
    given += [(None, "unlike all of the others here"), (8, "red green blue"), (8, "quite another text under one id")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in given], "doc_id long, text string, component_id int")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = [(2, near), (5, None), (5, None), (6, ""), (7, "short one"), *given[-3:]]
    assert sorted(map(str, [tuple(r)[:2] for r in kept.collect()])) == sorted(map(str, want))
    assert near_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    group = {}
    for a, b in edges:
        group.setdefault(a, {a})
        group.setdefault(b, {b})
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert {r.node for r in got} == linked
    by = {}
    for r in got:
        by.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, by.values())) == sorted(map(list, {tuple(sorted(group[x])) for x in linked}))
    assert all(label in nodes for label, nodes in by.items())


def test_loose_variants_are_not_met_pair_by_pair(spark, monkeypatch):
    """Variants of one text that are near to few others or to none: links as among all pairs, from few candidates."""
    rng = random.Random(12)
    counted, written = {}, near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name: counted.setdefault(name, written(df, name)))
    for edits in ([3], [1, 2, 3, 4]):
        base, docs = [f"b{i}" for i in range(150)], []
        for v in range(120):
            text = list(base)
            for place in rng.sample(range(1, 149, 3), rng.choice(edits)):
                text[place] = f"v{v}" if rng.random() < 0.7 else f"n{place}"
            docs.append((v, " ".join(text)))
        counted.clear()
        got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected(docs)
        assert counted["rest"].count() < 400


def test_parity_bits_never_say_more_than_values_differ(spark):
    rng = random.Random(13)
    sets = []
    for n in (1, 40, 400, 4000):
        one = [rng.getrandbits(63) for _ in range(n)]
        sets += [(one,), (one[n // 3 :] + [rng.getrandbits(63) for _ in range(n // 4)],)]
    bits = spark.createDataFrame(sets, "s array<long>").select("s", *near_dedup.parity_bits(near_dedup.F.col("s"))).collect()
    for a in bits:
        for b in bits:
            apart = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a[1:], b[1:]))
            assert apart <= len(set(a[0]) ^ set(b[0])) and (apart > 0 or a[0] == b[0])
