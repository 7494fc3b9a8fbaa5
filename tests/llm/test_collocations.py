"""Phrases against plain Python, the quicksort against counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from folioflow.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        found = []
        long_ = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        for p, a in long_.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * c >= 100 * a and inside(q) for q, c in long_.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "É", "Zo", "zo", "x-y", "'") for b in ("", "n", "ß", "q")]
    passage = "Once upon a time there was, of course; a Time There Was"
    rows = []
    for i in range(160):
        words = [rng.choice(vocabulary[: rng.choice([3, 10, 24])]) for _ in range(rng.choice([0, 1, 4, 30, 200]))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\r\n", "\x0b", " - ", "\xa0"]) for w in words)
        rows.append((text + (passage if i % 3 == 0 else ""), rng.choice(["en", "de", None, "und", "fr"])))
    rows += [("a a a a a a a a", "aa")] * 5 + [(None, "en"), ("", None), ("same here " * 3000, "en"), (".,;", "zz"), ("w" * 50_000, "en")]
    return rows


def test_phrases(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_ROWS", 700)
    monkeypatch.setattr(collocations, "SLICE", 5_000)
    monkeypatch.setattr(collocations, "KNOWN_WORDS", 40)
    given = texts(1)
    docs = spark.createDataFrame([(*r, 3, 4) for r in given], "text string, lang string, n long, h1 long").repartition(4)
    for least, top in ((4, 30), (20, 1000)):
        rows = collocations.mine_phrases(docs, least, top).collect()
        want = expected(given, least, top)
        assert len(rows) == len(want) > 20 and {tuple(r) for r in rows} == want
    assert collocations.mine_phrases(docs.limit(0)).count() == 0


def test_colliding_hashes_take_another_seed(spark, monkeypatch):
    plain = collocations.Words.__missing__

    def bad(self, word):
        number = plain(self, word)
        if self.seed == 0:
            self.hashes[number] = 1 + len(word) % 3
        return number

    monkeypatch.setattr(collocations.Words, "__missing__", bad)
    given = [("one two three", "en")] * 3
    docs = spark.createDataFrame(given, "text string, lang string")
    words, seed = collocations.count_words(collocations.prepared(docs))
    # workers import the module anew, so the patched class reaches them only where they are forked
    assert seed in (0, 1) and {(r.lang, bytes(r.word), r.n) for r in words.collect()} == {("en", w, 3) for w in (b"one", b"two", b"three")}


def test_quicksort():
    rng = np.random.default_rng(4)
    table = rng.integers(1, 4, (5, 3000))
    table[:, :300] = 2
    for depth in (3, 4):
        table[depth:, rng.random(3000) < 0.3] = 0
    n = rng.integers(1, 5, 3000)
    found = list(collocations.quicksorted(list(table), n, 40, 1))
    want = Counter()
    for row, weight in zip(table.T, n):
        for k in range(1, 6):
            if all(row[:k]):
                want[tuple(row[:k])] += weight
    got = {tuple(table[:k, at]): size for at, k, size in found}
    assert len(got) == len(found) and {p: c for p, c in want.items() if c >= 40}.items() <= got.items()
    rows = sorted(map(tuple, table.T))
    edges = {r[:k] for r in (rows[0], rows[-1]) for k in range(1, 6)}
    assert all(c == want[p] for p, c in got.items()) and {p for p, c in got.items() if c < 40} <= edges
    assert {p for p in edges if all(p)} <= set(got)


def test_scores_beyond_64_bits(spark):
    rows = [(10**10 + 7, 10**15 + 3, 10**12 + 1, 10**11 + 9), (10**12, 10**17 + 1, 10**12, 10**12 + 5), (100, 10**13, 100, 100), (123, 999, 456, 789)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(collocations._score(*[df[c] for c in "anlr"])).collect()]
    assert got == [1000 * a * n // (left * right) for a, n, left, right in rows]
