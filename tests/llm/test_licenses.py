"""Licence scan on a small tree whose answers are plain, and term weights against plain Python."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from folioflow.llm import licenses, queries


def terms(text):
    w = [x.lower() for x in re.split("[^A-Za-z0-9]+", text) if x]
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def cosines(texts, templates):
    """Best cosine of every text with each licence, from the definition."""
    own = [(name, terms(wording)) for name, wording in templates]
    licences = {name for name, _ in own}
    df = {t: len({name for name, v in own if t in v}) for _, v in own for t in v}

    def vector(counts):
        rarity = lambda t: math.log((len(licences) + 1) / (df[t] + 1)) + 1 if t in df else 1.0
        return {t: (1 + math.log(c)) * rarity(t) for t, c in counts.items()}

    def cosine(a, b):
        length = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return sum(x * b.get(t, 0) for t, x in a.items()) / length(a) / length(b) if a else 0

    out = {}
    for text in texts:
        scores = {name: max(cosine(vector(terms(text)), vector(v)) for n, v in own if n == name) for name in licences}
        out[text] = {name: s for name, s in scores.items() if s > 0}
    return out


def test_cosines_by_definition(spark):
    rng = random.Random(4)
    words = sorted({w for _, t in licenses.TEMPLATES for w in re.split("[^A-Za-z0-9]+", t) if w}) + ["foo", "Bar", "9", "é"]
    texts = [t for _, t in licenses.TEMPLATES] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(999, "")], "key long, text string")
    got = {}
    for r in licenses.cosines(rows, ["key"], "text", list(licenses.TEMPLATES), "test").collect():
        got.setdefault(texts[r.key], {})[r.license] = r.score
    want = cosines(texts, licenses.TEMPLATES)
    for text in texts:
        assert got.get(text, {}).keys() == want[text].keys()
        assert all(abs(got[text][n] - s) < 2e-6 for n, s in want[text].items())
    own = dict((t, n) for n, t in licenses.TEMPLATES)
    assert all(max(got[t], key=got[t].get) == n for t, n in own.items())
    full = licenses.full_texts()
    parts = [t[: len(t) * k // 4] for _, t in full for k in (1, 2, 3, 4)]
    scored = licenses.like_full_text(spark.createDataFrame(list(enumerate(parts)), "key long, whole string")).collect()
    want = cosines(parts, full)
    best = {i: max(want[p].values()) for i, p in enumerate(parts) if max(want[p].values()) >= licenses.FULL_LEAST}
    assert {r.key for r in scored} == set(best) and all(abs(r.full_score - best[r.key]) < 2e-6 for r in scored)


def test_inheritance_on_random_trees(spark):
    rng = random.Random(5)
    wording = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", None: "Licensed under the Foo Terms of ours.", "": "plain words"}
    files = []
    for i in range(400):
        folder = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))
        name = rng.choice(["LICENSE", "COPYING.txt", "x.c", "y.py", "z"]) if i % 4 == 0 else f"f{i}"
        files.append((i, f"{folder}/{name}".lstrip("/"), rng.choice(list(wording))))
    files = list({p: (i, p, kind) for i, p, kind in files}.values())
    docs = spark.createDataFrame([(i, p, wording[kind]) for i, p, kind in files], "doc_id long, path string, text string")
    got = {r.path: (r.license, r.declared_by, r.inherited_from) for r in licenses.scan_licenses(docs).collect()}
    scored = {k: max(v.values()) for k, v in cosines([w.rstrip(".") for w in wording.values()], licenses.TEMPLATES).items() if v}
    given = {}
    for i, p, kind in files:
        if kind and re.search(licenses.LICENCE_FILE, p):
            folder = p.rpartition("/")[0]
            key = (-round(scored[wording[kind].rstrip(".")], 6), kind, p)
            given[folder] = min(given.get(folder, key), key)
    for i, p, kind in files:
        if kind != "":
            assert got[p] == (kind, "text", None)
            continue
        folder = p.rpartition("/")[0]
        while folder not in given and folder:
            folder = folder.rpartition("/")[0]
        want = (given[folder][1], "directory", given[folder][2]) if folder in given else (None, None, None)
        assert got[p] == want


def test_no_cap_on_a_line(spark):
    gpl = "this work is licensed under the GNU General Public License, version 3"
    given = [
        ("a/LICENSE", "word " * 150 + gpl, "GPL-3.0-only"), ("b/x", "w " * 5_000 + "released under the MIT License " + "w " * 5_000, "MIT"),
        ("c/x", "\n".join(["one more line of words"] * 30 + [gpl] + ["and lines after it"] * 30), "GPL-3.0-only"),
        ("d/x", "x" * 60_000 + " licensed under the BSD 2-Clause License", "BSD-2-Clause"),
        ("e/x", "GNU General Public License, " + "which is a licence of some age " * 30 + ", version 2", "GPL-1.0-or-later"),
        ("f/x", "license " * 20_000, None),
    ]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(given)], "doc_id long, path string, text string")
    got = {r.path: r.license for r in licenses.scan_licenses(docs).collect()}
    assert {p: got[p] for p, _, want in given if p != "e/x"} == {p: want for p, _, want in given if p != "e/x"}


def test_names_decide_near_ties_only(spark):
    near = [("A-1.0", "licensed under the house rules of old"), ("B-1.0", "licensed under the house rules of new")]
    said = [(1, 1, "licensed under the house rules"), (2, 2, "licensed under the house rules, MIT License"), (3, 3, "licensed under the house rules of new")]
    rows = spark.createDataFrame(said, "h1 long, h2 long, statement string")
    got = {r.h1: (r.own, r.by) for r in licenses.judged_statements(rows, near).collect()}
    assert got[1] == ("A-1.0", "text") and got[3] == ("B-1.0", "text")
    near.append(("MIT", "licensed under the house rules of now"))
    got = {r.h1: (r.own, r.by) for r in licenses.judged_statements(rows, near).collect()}
    assert got[2] == ("MIT", "name") and got[1] == ("A-1.0", "text")


def test_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    gpl = "this work is licensed under the GNU General Public License, version 3."
    nc = "Licensed under CC BY-NC 4.0."
    given = [
        (1, "a/LICENSE", apache), (2, "a/x.txt", "plain words"), (3, "a/b/c/y.txt", None), (4, "a/b/LICENSE.md", gpl),
        (5, "a/b/c/d/z.txt", ""), (6, "top.txt", "nothing here"), (7, "q/own.txt", f"text\n{nc}\nmore"),
        (8, None, nc), (9, "a/b/y", "the license of life is a strange thing to say aloud in a long sentence"),
        (9, "a/b/y", "nothing"), (9, "a/b/y", "nothing"), (10, "é/ü/f", "x" * 50_000), (11, "a/b/LICENSE", "no statement"),
    ]
    docs = spark.createDataFrame([(*g, "MIT") for g in given], "doc_id long, path string, text string, license string")
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == len(given)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.path), []).append((r.license, r.declared_by, r.inherited_from))
    assert got[1, "a/LICENSE"] == [("Apache-2.0", "text", None)]
    assert got[2, "a/x.txt"] == [("Apache-2.0", "directory", "a/LICENSE")]
    assert got[3, "a/b/c/y.txt"] == [("GPL-3.0-only", "directory", "a/b/LICENSE.md")] == got[5, "a/b/c/d/z.txt"]
    assert got[6, "top.txt"] == [(None, None, None)] == got[10, "é/ü/f"]
    assert got[7, "q/own.txt"] == [("CC-BY-NC-4.0", "text", None)] == got[8, None]
    assert got[9, "a/b/y"] == [("GPL-3.0-only", "directory", "a/b/LICENSE.md")] * 3
    own = {r.doc_id: r.score for r in rows if r.doc_id in (1, 4, 7)}
    for doc_id, text in ((1, apache), (4, gpl), (7, f"text {nc}")):
        assert abs(own[doc_id] - max(cosines([text], licenses.TEMPLATES)[text].values())) < 2e-6
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


WORDINGS = (
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Released under the MIT License.", "MIT"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
)


def test_any_number_of_copies(spark):
    text = F.element_at(F.array(*[F.lit(w) for w, _ in WORDINGS]), (F.col("i") + 1).cast("int"))
    scores = {}
    for copies in (10, 1000, 100_000):
        docs = spark.range(4 * copies).select(
            F.col("id").alias("doc_id"), F.concat(F.lit("f/"), F.col("id").cast("string")).alias("path"), (F.col("id") % 4).alias("i")
        ).withColumn("text", text)
        got = licenses.scan_licenses(docs).groupBy(F.col("doc_id") % 4, "license", "declared_by", "score").count().collect()
        assert sorted(r[:3] for r in map(tuple, got)) == [(i, name, "text") for i, (_, name) in enumerate(WORDINGS)]
        assert {r["count"] for r in got} == {copies}
        scores[copies] = {r[0]: r.score for r in got}
    assert scores[10] == scores[1000] == scores[100_000]


def test_stated_is_never_inherited(spark):
    docs = spark.createDataFrame(
        [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/x", "Licensed under the Foo Terms, version 3."), (3, "a/y", "none"),
         (4, "a/z", "under the GNU General Public License."), (5, "a/w", "under the GNU Lesser General Public License, version 3")],
        "doc_id long, path string, text string",
    )
    got = {r.doc_id: (r.license, r.declared_by, r.inherited_from) for r in licenses.scan_licenses(docs).collect()}
    assert got == {
        1: ("MIT", "text", None), 2: (None, "text", None), 3: ("MIT", "directory", "a/LICENSE"),
        4: ("GPL-1.0-or-later", "text", None), 5: ("LGPL-3.0-only", "text", None),
    }


def test_query_inherits_from_upper_directories(spark, tmp_path):
    docs = [(i, "plain words", "s") for i in range(10_500, 10_520)] + [
        (12_000, "Released under the MIT License.", "s"), (10_901, "Licensed under CC BY-NC 4.0.", "s"), (12_345, "none", "s"),
        (10_512, "plain words", "t"), (21_000, "none", "s"), (10_505, "Licensed under the Apache License, Version 2.0.", "u"),
        (10_506, "none", "u"), (10_606, "none", "u"),
    ]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.path[0]): (r.license, r.inherited_from) for r in queries.QUERIES["op5_license_scan"](spark, str(tmp_path)).collect()}
    assert got[12_345, "s"] == ("MIT", "s/1/LICENSE-12000")
    assert got[10_512, "s"] == ("CC-BY-NC-4.0", "s/1/10/LICENSE-10901")
    assert got[10_506, "u"] == ("Apache-2.0", "u/1/10/105/LICENSE-10505")
    assert got[10_512, "t"] == got[21_000, "s"] == got[10_606, "u"] == (None, None)


def test_whole_texts_and_wrapped_lines(spark):
    full = dict(licenses.full_texts())
    bare = lambda name: full[name].split("\n", 4)[4]
    given = [
        ("a/LICENSE", "Copyright 2020 Somebody\n\n" + full["BSD-2-Clause"], "BSD-2-Clause"),
        ("b/COPYING", bare("GPL-2.0-only"), "GPL-2.0-only"),
        ("c/LICENSE", bare("Apache-2.0"), "Apache-2.0"),
        ("d/x.c", "/*\n * (c) Somebody\n *\n" + "".join(f" * {x}\n" for x in full["ISC"].split("\n")) + " */\nint main;", "ISC"),
        ("e/x.py", "# Under the terms of the GNU General Public License,\n# version 3.\n\ncode", "GPL-3.0-only"),
        ("f/y", "Licensed under the GNU General\nPublic License, version\n2.", "GPL-2.0-only"),
        ("g/z", "first words\nthis work is dedicated to the public\ndomain, see CC0 1.0 Universal", "CC0-1.0"),
        ("h/z", "Creative\nCommons Attribution 4.0", "CC-BY-4.0"),
        ("i/LICENSE", "nothing of it", None),
        ("j/x.py", "# a comment\n# of two lines\ncode\n\n" + "word " * 20_000, None),
    ]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(given)], "doc_id long, path string, text string")
    got = {r.path: r.license for r in licenses.scan_licenses(docs).collect()}
    assert got == {p: name for p, _, name in given}
