"""Sharding: every row once, balanced bytes, gapless places, few moves when the map is edited."""

import random
import zlib
from collections import Counter, defaultdict

from folioflow.llm import sharding


def test_assign(spark, tmp_path):
    rng = random.Random(1)
    given = [(i, "é" * rng.randint(0, 400)) for i in range(2000)] + [(5, "same"), (5, "same"), (None, None), (7, None)]
    given += [(10_000 + i, "copy of one text" * 10) for i in range(1000)]
    given += [(77_777, "a row that is there very often" * 5)] * 1500 + [(None, None)] * 600
    docs = spark.createDataFrame([(a, b, 1) for a, b in given], "doc_id long, text string, shard int")
    path = str(tmp_path / "map")
    rows = sharding.assign(docs, shards=7, slots=4096).collect()
    sizes = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, *sizes(t)) for d, t in given)
    places, loads = defaultdict(list), Counter()
    for r in rows:
        places[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert set(places) == set(range(7))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads.values()) < 1.01 * min(loads.values())
    assert sharding.assign(docs.limit(0), shards=7).count() == 0

    old = sharding.first_map([r % 50 for r in range(4096)], 7)
    sharding.save_map(spark, old, path)
    assert sharding.load_map(spark, path) == old
    again = sharding.assign(docs, shards=8, slots=4096, map_path=path)
    new = sharding.load_map(spark, path)
    assert (new.version, new.shards) == (2, 8) and sharding.load_map(spark, path, 1) == old
    assert {(r.virtual_slot, r.shard) for r in again.collect()} <= set(enumerate(new.shard_of))


def test_rebalance_moves_little():
    rng = random.Random(2)
    sizes = [rng.randint(0, 1000) for _ in range(4096)]
    old = sharding.first_map(sizes, 10)
    assert sharding.rebalance(old, sizes).shard_of == old.shard_of
    grown = sharding.rebalance(old, sizes, 11)
    moved = [s for s in range(4096) if grown.shard_of[s] != old.shard_of[s]]
    assert {grown.shard_of[s] for s in moved} == {10}
    assert max(grown.loads()) < 1.05 * min(grown.loads())
    less = sharding.rebalance(grown, sizes, 10)
    assert max(less.loads()) < 1.05 * min(less.loads())
    assert all(less.shard_of[s] == grown.shard_of[s] for s in range(4096) if grown.shard_of[s] < 10)
