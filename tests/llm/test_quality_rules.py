"""Quality rules: counts against plain Python, and the edges."""

import random
import re
from collections import Counter

from folioflow.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    found = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
    return *found, len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def test_counts_and_edges(spark):
    rng = random.Random(6)
    parts = ["the", "and", "of", "é", "😀", "#", "<a>", "\n", "\n\n", " same line of words\n", "\t", "\x0b", "\xa0", "x" * 40, "- item\n", "...\n"]
    given = [None, "", " \n\t", "one", "w " * 60_000, "word" * 30_000, "\n" * 5_000, "a b c " * 40]
    given += [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 160))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(given)], "doc_id long, text string, kept int, quality string")
    got = quality_rules.apply_rules(docs.select("doc_id", "text")).collect()
    assert len(got) == len(given)
    for r in got:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, r.base_failed) == counts(given[r.doc_id])
        assert not (r.base_failed and r.kept)
    passed = quality_rules.passing(docs)
    assert passed.columns == docs.columns
    assert {r.doc_id for r in passed.collect()} == {r.doc_id for r in got if r.kept}
    assert quality_rules.passing(docs.limit(0)).count() == 0
