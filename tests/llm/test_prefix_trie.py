"""Prefix trie: node rows against plain Python, the queue against sorting."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

from folioflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string"


def expected(rows, rebuilt):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(c - int(math.fmod(c, 100)), [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}
    members = defaultdict(list)
    for c, ts in own.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += children[k] == 0
        saved[k] += (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        if k:
            children[k[:-1]] += 1
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    result = set()
    for k, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(own[c]) == len(k)))
        up = min(members[k[:-1]]) if k else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        result.add((min(cs), len(k), up, len(cs), children[k], leaves[k], saved[k], digest))
    return result


def conversations(seed, n=400):
    rng = random.Random(seed)
    texts = ["", None, "a", "bb", "é" * 5, "x" * 3000]
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randint(-300, 900), rng.randint(0, 30) * 100])
        size = rng.choice([1, 2, 3, 4, 5, 8, 12])
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(texts[: rng.choice([1, 2, 6])])) for t in range(size)]
    rows += [(5000 + i, t, "user", f"same {t}") for i in range(300) for t in range(7)]
    rows += [(6000, t, "user", f"long {t}") for t in range(150)] + [(6001, t, "user", f"long {t}") for t in range(140)]
    rows += [(77, None, "system", "first"), (77, None, "system", "first"), (None, 1, "user", "nobody"), (6100, 0, "user", None)]
    return [(*r, 9, "clash") for r in rows]


def test_nodes(spark, monkeypatch):
    monkeypatch.setattr("folioflow.llm.ranges.LEAST_ROWS", 300)
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "ENDS", 32)
    given = conversations(1)
    frame = spark.createDataFrame(given, SCHEMA).repartition(3)
    digests = prefix_trie.turn_digests(frame)
    rebuilt = prefix_trie.rebuild(digests)
    plain = digests, digests.filter("pos = 1").select("conv_id", "length")
    for (turns, convs), again, busy in ((rebuilt, True, 5), (rebuilt, True, 10**6), (plain, False, 40)):
        got = prefix_trie.build_trie(turns, convs, busy).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == expected(given, again)


def test_public_forms(spark):
    given = conversations(2, 60)
    frame = spark.createDataFrame(given, SCHEMA)
    assert {tuple(r) for r in prefix_trie.prefix_trie(frame).collect()} == expected(given, False)
    assert {tuple(r) for r in prefix_trie.rebuilt_trie(frame).collect()} == expected(given, True)
    assert prefix_trie.rebuilt_trie(frame.limit(0)).count() == 0
    # one conversation with turns that its head replaces in full: the root alone
    lonely = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = prefix_trie.rebuilt_trie(frame.filter("conv_id = 6100").selectExpr(f"{lonely}L conv_id", "turn", "role", "text")).collect()
    assert [tuple(r) for r in rows] == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]


def test_queue_spills_and_keeps_order():
    rng = random.Random(3)
    queue, kept, out = prefix_trie.SpillingQueue(items=50, block=7), [], []
    for step in range(6000):
        item = (rng.randint(step, step + 900), step)
        queue.push(item)
        kept.append(item)
        if step % 3 == 0:
            assert queue.peek() == min(kept)
            out.append(queue.pop())
            kept.remove(out[-1])
    while queue.peek():
        out.append(queue.pop())
    assert queue.spilled > 10 and len(out) == 6000 and out[2000:] == sorted(kept)
