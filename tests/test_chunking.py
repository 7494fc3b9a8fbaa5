import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from folioflow.operators import chunking
from folioflow.operators.chunking import chunk_documents, split_clauses

MARKER = r"(?:\d+\.(?:\d+\.?)*|\(?[a-z]\)|Article\s+\d+|Section\s+\d+)"


def docs(spark, texts):
    return spark.createDataFrame([(f"d{i}", "u", "f.pdf", t) for i, t in enumerate(texts)],
                                 "doc_id string, user_id string, filename string, text string")


def texts_of(df):
    found = {}
    for r in df.orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r["doc_id"], []).append(r["text"])
    return found


def expected_clauses(text, size):
    parts, out, held = re.split(rf"(\n\s*{MARKER})", text), [], ""
    for part in [*parts, None]:
        if part is None or len(held) + len(part) > size:
            out += [held.strip()] if held.strip() else []
            held = part or ""
        else:
            held += part
    return out


EDGES = [
    "", "   \n ", "no marker at all", "\n1. start", "intro\n1.2.3 deep\n(a) x\na) y\nArticle 4 z\nSection 12 w",
    "text 1. not at line start (a) either", "A" * 700 + "\n1. " + "B" * 30, "\n1. " + " " * 600 + "\n2. end",
    "holds ﷐﷑ and\n1. more\n(b) text", "nbsp\n  3. item ٣\n٤. arabic digit",
]


def random_text(rng):
    starts = ["\n1. ", "\n(a) ", "\n  Section 3 ", "\nArticle 9 ", "\n", " ", "\n2.1.4 "]
    return "".join(rng.choice(starts) + "wé" * rng.randint(0, 150) for _ in range(rng.randint(0, 25)))


def test_split_keeps_everything(spark):
    df = docs(spark, EDGES).select("text", split_clauses(F.col("text")).alias("p"))
    for r in df.collect():
        assert r["p"] == re.split(rf"(\n\s*{MARKER})", r["text"])


def test_clause_chunks_equal_brute_force(spark):
    rng = random.Random(3)
    texts = EDGES + [random_text(rng) for _ in range(120)]
    for size in (500, 60):
        got = texts_of(chunk_documents(docs(spark, texts), size=size))
        for i, text in enumerate(texts):
            assert got.get(f"d{i}", []) == expected_clauses(text, size)


def test_fixed_chunks_properties(spark):
    rng = random.Random(5)
    repetitive = ["x" * 500, "x" * 501, "ab. " + "y" * 2000, ". " * 400, "", " \n "]
    unique = ["".join(f"{n}{rng.choice([' ', '. ', chr(10), '?', ''])}" for n in range(k * 40)) for k in range(30)]
    got = texts_of(chunk_documents(docs(spark, repetitive + unique), mode="fixed"))
    assert all(0 < len(c) <= 500 for chunks in got.values() for c in chunks)
    assert got["d0"] == ["x" * 500] and got["d1"] == ["x" * 500, "x" * 51]
    for i, text in enumerate(unique, len(repetitive)):
        covered = 0
        for chunk in got.get(f"d{i}", []):
            at = text.find(chunk)
            assert at >= 0 and not text[covered:at].strip()
            covered = max(covered, at + len(chunk))
        assert not text[covered:].strip()


def test_recursive_chunks_properties(spark):
    rng = random.Random(8)
    texts = ["", "para one.\n\npara two; still.", "z" * 900] + [random_text(rng) for _ in range(40)]
    got = texts_of(chunk_documents(docs(spark, texts), mode="recursive"))
    for i, text in enumerate(texts):
        joined = "".join("".join(c.split()) for c in got.get(f"d{i}", []))
        assert len(joined) >= len("".join(text.split()))
        assert all(c in text for c in got.get(f"d{i}", []))
    assert got["d1"] == ["para one.\n\npara two; still."] and got["d2"] == ["z" * 900]


def test_links_and_clause_meta(spark):
    text = "i" * 29 + "\nArticle 1" + "a" * 20 + "\n1.2" + "b" * 26 + "\n(c)" + "d" * 26 + "\nSection 7" + "e" * 20
    got = chunk_documents(docs(spark, [text]), size=30, links=True, clause_meta=True).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in got] == [f"d0_{i}" for i in range(len(got))]
    assert [r["prev_chunk_id"] for r in got] == [None] + [r["chunk_id"] for r in got[:-1]]
    assert [r["next_chunk_id"] for r in got] == [r["chunk_id"] for r in got[1:]] + [None]
    assert [(r["clause_number"], r["section_type"], r["parent_section"]) for r in got] == [
        (None, None, None), ("Article 1", "article", "Article 1"), ("1.2", "numbered", "Article 1"),
        ("(c)", "lettered", "Article 1"), ("Section 7", "section", "Section 7"),
    ]


def test_documents_are_chunked_once(spark):
    df = chunk_documents(docs(spark, ["a\n1. b"]))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_long_dotted_number_is_no_deep_recursion(spark):
    number = "\n1." + "1." * 50_000
    df = docs(spark, [number + " tail", "start" + number])
    parts = df.select(split_clauses(F.col("text")).alias("p")).collect()
    assert [r["p"] for r in parts] == [["", number, " tail"], ["start", number, ""]]
    kept = chunk_documents(df, clause_meta=True, links=True).orderBy("doc_id", "chunk_index").collect()
    assert "".join(r["text"] for r in kept if r["doc_id"] == "d0").startswith("1.1.")


def test_pages_by_brute_force(spark):
    rng = random.Random(12)
    given = []
    for i in range(80):
        pages = [random_text(rng)[: rng.choice([0, 3, 40, 5000])] for _ in range(rng.randint(1, 12))]
        ends, at = [], 0
        for p in pages:
            ends.append(at + len(p))
            at += len(p) + 2
        given.append((f"d{i}", "u", "f", "\n\n".join(pages), ends))
    given += [("none", "u", "f", "some text", None), ("empty", "u", "f", "some text", []), ("null", "u", "f", None, [0])]
    df = spark.createDataFrame(given, "doc_id string, user_id string, filename string, text string, page_ends array<int>")
    for mode in ("clause", "fixed", "recursive"):
        whole = chunk_documents(df, mode=mode, size=60, overlap=7, pages=True, before=True, links=True, clause_meta=True)
        plain = chunk_documents(df, mode=mode, size=60, overlap=7)
        assert sorted(map(tuple, whole.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
        found = {}
        for r in whole.orderBy("doc_id", "chunk_index").collect():
            found.setdefault(r.doc_id, []).append(r)
        for doc_id, _, _, text, ends in given:
            at = 0
            for i, r in enumerate(found.get(doc_id, [])):
                assert r.prev_text == (found[doc_id][i - 1].text if i else None)
                if not ends:
                    assert r.page_number is None
                    continue
                # chunks follow one another; clause chunks without overlap
                at = text.find(r.text, at if mode == "clause" else max(0, at - 60))
                pages = {1 + sum(e <= k for e in ends) for k in range(len(text)) if text.startswith(r.text, k)}
                assert r.page_number in pages and (mode != "clause" or r.page_number == 1 + sum(e <= at for e in ends))
                at += len(r.text) if mode == "clause" else 1


def test_many_clauses_cost_little_more_with_sections(spark):
    import time

    text = "".join(f"\nSection {i} words of it" if i % 50 == 0 else f"\n{i}. some words" for i in range(20_000))
    df = docs(spark, [text])
    seconds = {}
    for meta in (False, True, False, True):
        start = time.perf_counter()
        got = chunk_documents(df, size=12, clause_meta=meta).agg(F.count("*"), F.max("chunk_index")).first()
        seconds[meta] = time.perf_counter() - start
        assert got[0] >= 20_000
    assert seconds[True] < 2 * seconds[False] + 1


def test_search_by_halves(spark):
    from folioflow.functions.text import count_at_most, running_sums

    rng = random.Random(3)
    lists = [[], [5], [5, 5, 5]] + [sorted(rng.randint(0, 30) for _ in range(n)) for n in range(40)]
    df = spark.createDataFrame([(a, v) for a in lists for v in (-1, 0, 5, 17, 31)], "a array<int>, v int")
    for r in df.select("*", count_at_most(F.col("a"), F.col("v")).alias("n"), running_sums(F.col("a")).alias("s")).collect():
        assert r.n == sum(x <= r.v for x in r.a) and r.s == [sum(r.a[: i + 1]) for i in range(len(r.a))]


def test_pieces_of_a_large_batch_are_made_few_texts_at_a_time(spark, monkeypatch):
    texts = ["".join(f"Sentence {j} of text {i}. " for j in range(60)) if i % 7 else None for i in range(500)]
    # The function itself in place of the column it makes.
    monkeypatch.setattr(chunking.F, "arrow_udf", lambda kind: lambda function: lambda text: function)
    column = pa.array(texts, pa.string())
    for make in (chunking.fixed_chunks, chunking.recursive_chunks):
        whole = make(None)(column)
        monkeypatch.setattr(chunking, "_TEXTS_AT_ONCE", 1000)
        assert whole.equals(make(None)(column)) and len(whole) == 500
        monkeypatch.setattr(chunking, "_TEXTS_AT_ONCE", 64)
        assert len(make(None)(pa.array([], pa.string()))) == 0
