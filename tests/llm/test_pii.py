"""Base spans against plain Python, and what the labelers and the classifier make of the rest."""

import hashlib
import random
import re

from folioflow.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) < 256 for p in m[0].split("."))]
    spans += [
        (m.start(), 2, "card", m.end())
        for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))
    ]
    spans += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(spans)


def texts():
    rng = random.Random(3)
    parts = [
        "a.b@c.de", "x@y.z_w@v.u", "a@b", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.008.009.010", "4242 4242 4242 4242",
        "4111-1111-1111-1111", "4111111111111111", "1234567890123", "+1 (269) 555-3296", "+44 20 7946 0958", "+1", "+1((",
        "é", "😀", " ", "\n", "-", ".", "7", "12", "99 99", "user.name+tag@mail-1.example.co.uk", "1.2.3.4@5.6",
    ]
    fixed = [None, "", "@" * 500, "9" * 40_000, "a" * 40_000, "1." * 20_000, "a@b" + ".c" * 20_000, "+1 " * 5000]
    return fixed + ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 14))) for _ in range(400)]


def test_base_equals_brute_force(spark):
    given = texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(given)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.digest(pii.scan_pii(docs)).collect()}
    for i, text in enumerate(given):
        want = base(text or "")
        names = [f"{k}:{s}:{e}" for s, _, k, e in want]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in want) for k in pii.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest(), text
        assert set(names) <= set(got[i].spans.split(","))


def test_classifier_adds_likely_spans(spark):
    sure = [(i, f"call +1 (269) 555-{3000 + i} or mail u{i}@mail.example.com") for i in range(60)]
    loose = [(100, "call me on my phone: (269) 555-3296 today"), (101, "e-mail john.doe (at) example (dot) com now")]
    loose += [(102, "isbn order version 111 222 3333"), (103, None), (103, None)]
    docs = spark.createDataFrame(sure + loose, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.scan_pii(docs)).collect()}
    assert got[100] == "phone:21:35" and got[101] == "email:7:38"
    assert got[102] == "" and got[103] == ""
    assert pii.scan_pii(docs.limit(0)).count() == 0
    assert pii.scan_pii(docs.filter("doc_id = 103")).count() == 2


def corpus():
    rng = random.Random(8)
    made = []
    for i in range(300):
        made.append(rng.choice([
            f"call me on +49 (171) 555-{3000 + i} today", f"mail u{i}@mail.example.com or write", f"login from host 10.2.{i % 200}.7 now",
            f"card 4242 4242 4242 4242 was used {i}", f"we meet at noon and look at page {i}", f"version 3.{i}.300.{i} of the table",
            f"order 1234 5678 9012 {1000 + i} invoice", f"phone 0171 55{10000 + i} please call", f"contact john dot doe{i} at example dot com here",
        ]))
    return made


def test_candidates_beyond_the_base(spark):
    given = ["ring 0171 5550123 or 0049 171 5550123", "john dot doe at example dot com", "jane (at) shop [dot] de", "12.345.6.7", "1234-5678-9012-3456", "a@b"]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {i: [] for i in range(len(given))}
    for r in pii.exploded(pii.find_candidates(docs)).collect():
        got[r.doc_id].append((r.kind, given[r.doc_id][r.start : r.end]))
    assert {("phone", "0171 5550123"), ("phone", "0049 171 5550123")} <= set(got[0])
    assert [got[i] for i in (1, 2)] == [[("email", given[1])], [("email", given[2])]]
    assert got[3] == [("ip", given[3])] and got[4] == [("card", given[4])] and got[5] == [("email", "a@b")]


def test_em_and_fit_against_plain_python(spark):
    import numpy as np

    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    found = pii.find_candidates(docs)
    rows = pii.exploded(found).collect()
    states = {r.kind: r.state for r in pii.reliabilities(pii.vote_counts(found)).collect()}
    assert set(states) == set(pii.KINDS)
    soft = {}
    for kind in pii.KINDS:
        votes = np.array([[r.regex, r.gazetteer, r.context] for r in rows if r.kind == kind])
        prior, right, wrong = 0.5, np.full(3, 0.8), np.full(3, 0.2)

        def posterior(v):
            odds = np.log(prior / (1 - prior)) + ((v == 1) * np.log(right / wrong) + (v == -1) * np.log((1 - right) / (1 - wrong))).sum(1)
            return 1 / (1 + np.exp(-odds))

        for _ in range(pii.ROUNDS):
            r = posterior(votes)
            yes, cast = votes == 1, votes != 0
            prior = (r.sum() + 1) / (len(r) + 2)
            right = ((yes * r[:, None]).sum(0) + 4) / ((cast * r[:, None]).sum(0) + 5)
            wrong = ((yes * (1 - r)[:, None]).sum(0) + 1) / ((cast * (1 - r)[:, None]).sum(0) + 5)
        assert abs(states[kind].prior - prior) < 1e-9
        assert np.allclose(states[kind].right, right) and np.allclose(states[kind].wrong, wrong)
        soft[kind] = iter(posterior(votes))
    y = np.array([next(soft[r.kind]) for r in rows])
    x = np.zeros((len(rows), pii.OFFSETS[-1] + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        assert len(r.inputs) == 6
        x[i, list(r.inputs)] = 1
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], pii.RIDGE)
    ridge[-1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(ridge) + 1e-12 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) / len(x) + ridge * w)
    fitted = np.array(pii.train(found))
    near = lambda v: 1 / (1 + np.exp(-x @ v))
    assert np.abs(near(fitted) - near(w)).max() < 0.02


def test_classifier_reads_span_and_context(spark):
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.digest(pii.scan_pii(docs)).collect()}
    added = lambda i, t: set(spans[i].split(",")) - {f"{k}:{s}:{e}" for s, _, k, e in base(t)}
    share = lambda word, kind: [any(x.startswith(kind) for x in added(i, t)) for i, t in enumerate(corpus()) if t.startswith(word)]
    assert all(share("phone 0171", "phone")) and all(share("contact john", "email"))
    assert not any(share("we meet", "email")) and not any(share("order", "card")) and not any(share("version", "ip"))
