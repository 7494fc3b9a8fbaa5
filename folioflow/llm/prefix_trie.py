"""Prefix trie of conversations, totalled by time-forward processing.

A node is a distinct sequence of first turns. Its members follow from a count per sequence; what needs the tree (leaves,
children, parents and saved tokens of whole subtrees) is passed from nodes to their parents: nodes are sorted by
reverse level order, each takes its children's messages from a priority queue that spills to disk, and
sends its own totals on.

Nodes with the same members form one unbranched run, so runs and not nodes go through the queues, and a long
conversation is one entry. Runs with more than ``busy`` members are few and lie at the top; the subtrees under
them are the shards. Totals are made within shards first, then across the shards' roots.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.llm.common import bounded_batches, written
from folioflow.llm.ranges import dealt_by_range, with_running

BLOCK = 4_096  # turns of a conversation whose running values come from one window
ENDS = 256  # ids of an aligned block whose list is put together in one group
BUSY_NODES = 50_000  # most nodes that are taken across shards
LEAST_BUSY = 64  # members of a node that is never cut out of its shard
QUEUE_ITEMS = 200_000  # messages a queue holds before it spills a sorted run
KEY = ["depth", "k1", "k2"]
NO_ENDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # fixed value: SHA-256 of nothing


class SpillingQueue:
    """A priority queue of tuples in bounded memory: sorted runs go to unnamed temporary files."""

    def __init__(self, items: int = QUEUE_ITEMS, block: int = 1_000):
        self.items, self.block = items, block
        self.heap: list[tuple] = []
        self.runs: list[tuple[tuple, int, Iterator[tuple]]] = []
        self.spilled = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.items:
            run = self._written(sorted(self.heap))
            self.heap = []
            self.spilled += 1
            heapq.heappush(self.runs, (next(run), self.spilled, run))

    def _written(self, items: list[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()
        for i in range(0, len(items), self.block):
            pickle.dump(items[i : i + self.block], file, -1)
        file.seek(0)
        blocks = -(-len(items) // self.block)
        return (item for _ in range(blocks) for item in pickle.load(file))

    def peek(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, run))
            return item
        return heapq.heappop(self.heap)


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, m1, m2, chars, length) of every turn: place from 1, 128-bit digest of role and text, code points of
    the text, turns of its conversation.

    Turns are in the order of ``turn``, null first; equal ones in the order of their digest. Rows with a null conv_id
    belong to no conversation. No text is shuffled, and a conversation of any length is cut into ranges.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("_row"),
    )
    turns = written(turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    order = [F.col("turn").asc_nulls_first(), "digest", "_row"]
    ranged = dealt_by_range(turns, "conv_id", *order)
    placed = with_running(ranged, ["conv_id"], order, {"pos": F.lit(1)}, sizes)
    halves = [F.xxhash64(F.substring("digest", a, 16)).alias(f"m{i}") for i, a in ((1, 1), (2, 17))]
    return written(placed.select("conv_id", (F.col("pos") + 1).alias("pos"), *halves, "chars", "length"), "turn-digests")


def shared_head(conv_id: Column) -> Column:
    """Turns that conversation c takes from c - c % 100: 0 to 5. The remainder has the sign of c, as in SQL."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("int")


def rebuild(digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the head of the first of their hundred: (turns, conversations with their length).

    Conversation c has the first ``shared_head`` turns of c - c % 100 (all if fewer, none if absent), then its own
    turns after as many, if any. A conversation can come out without turns.
    """
    convs = digests.filter("pos = 1").select("conv_id", F.col("length").alias("_n"))
    leader = F.col("conv_id") - F.col("conv_id") % 100
    heads = (
        digests.filter((F.col("pos") <= 5) & (F.col("conv_id") == leader))
        .groupBy(F.col("conv_id").alias("_leader"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "m1", "m2", "chars"))).alias("_head"))
    )
    plans = convs.withColumn("_h", shared_head(F.col("conv_id"))).withColumn("_leader", leader).join(heads, "_leader", "left")
    head = F.when(F.col("_h") > 0, F.slice("_head", 1, F.greatest(F.col("_h"), F.lit(1))))
    plans = plans.withColumn("_head", head).withColumn("_base", F.coalesce(F.array_size("_head"), F.lit(0)))
    own = F.greatest(F.col("_n") - F.col("_h"), F.lit(0))
    plans = plans.select("conv_id", "_head", (F.col("_h") - F.col("_base")).alias("_by"), (F.col("_base") + own).alias("length"))
    plans = written(plans, "rebuilt")
    heads = plans.select("conv_id", "length", F.explode("_head").alias("t"))
    tails = (
        digests.drop("length")
        .filter(F.col("pos") > shared_head(F.col("conv_id")))
        .join(plans.select("conv_id", "_by", "length"), "conv_id")
        .select("conv_id", (F.col("pos") - F.col("_by")).alias("pos"), "m1", "m2", "chars", "length")
    )
    heads = heads.select("conv_id", "t.pos", "t.m1", "t.m2", "t.chars", "length")
    return heads.unionByName(tails), plans.select("conv_id", "length")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for the first d turns of every conversation: conv_id, depth, key k1 and k2, the key p1 and p2 without the last
    turn, chars of the last turn, ``upto`` (chars of all d) and ``ends``, whether the conversation ends here.

    A key is the xor of hashes of (place, turn), 128 bits. The keys of a long conversation come from blocks
    of turns, each of which adds the sums of the blocks before it.
    """
    sums = {"k1": F.bit_xor("_g1"), "k2": F.bit_xor("_g2"), "upto": F.sum("chars")}
    turns = turns.select(
        "*", F.floor((F.col("pos") - 1) / BLOCK).alias("_block"),
        F.xxhash64("pos", "m1", "m2").alias("_g1"), F.xxhash64("m2", F.lit("second"), "pos", "m1").alias("_g2"),
    )
    blocks = turns.filter(F.col("length") > BLOCK).groupBy("conv_id", "_block").agg(*[v.alias(n) for n, v in sums.items()])
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = {"k1": F.bit_xor("k1"), "k2": F.bit_xor("k2"), "upto": F.sum("upto")}
    blocks = blocks.select("conv_id", "_block", *[v.over(before).alias(f"_c{n}") for n, v in carried.items()]).filter("_block > 0")
    inside = Window.partitionBy("conv_id", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = turns.select("*", *[v.over(inside).alias(n) for n, v in sums.items()]).join(blocks, ["conv_id", "_block"], "left")
    none = F.lit(0).cast("long")
    carry = {n: F.coalesce(f"_c{n}", none) for n in sums}
    run = run.withColumns(
        {"k1": F.col("k1").bitwiseXOR(carry["k1"]), "k2": F.col("k2").bitwiseXOR(carry["k2"]), "upto": F.col("upto") + carry["upto"]}
    )
    found = run.select(
        "conv_id", F.col("pos").cast("long").alias("depth"), "k1", "k2",
        F.col("k1").bitwiseXOR(F.col("_g1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("_g2")).alias("p2"),
        "chars", "upto", (F.col("pos") == F.col("length")).alias("ends"),
    )
    zeros = [none.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "chars", "upto")]
    return written(convs.select("conv_id", *zeros, (F.col("length") == 0).alias("ends")).unionByName(found), "prefixes")


def ends_digests(found: DataFrame) -> DataFrame:
    """KEY and the SHA-256 of the ids of the conversations that end there, ascending and comma-joined.

    Ids are joined within aligned blocks of ids; nodes with several blocks are hashed block after block, one at a time
    in memory.
    """
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    ended = found.filter("ends").groupBy(*KEY, F.shiftright("conv_id", ENDS.bit_length() - 1).alias("block"))
    lists = written(ended.agg(F.array_join(ids, ",").alias("ids")), "ends")
    nodes = lists.groupBy(*KEY).agg(F.count("*").alias("blocks"), F.max("ids").alias("ids"))
    few = nodes.filter("blocks = 1").select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    many = lists.join(nodes.filter("blocks > 1").select(*KEY), KEY, "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, "block")

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        node, state = None, None
        for frame in frames:
            done = []
            for *key, _, text in frame[[*KEY, "block", "ids"]].itertuples(index=False, name=None):
                if key == node:
                    state.update(b"," + text.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = key, sha256(text.encode())
            yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*KEY, "ends_sha256"])

    return few.unionByName(many.mapInPandas(hashed, "depth long, k1 long, k2 long, ends_sha256 string"))


RUN = "conv_id long, n_convs long, top long, last long, run_upto long"
TOTALS = f"{RUN}, n_children long, n_leaves long, below long, parent_conv_id long"
ROOTS = f"{TOTALS}, is_root boolean, depth long, k1 long, k2 long, total long"


def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Time-forward processing of runs that come in reverse level order of their last nodes.

    A run takes the messages of its children from the queue, stamps the children with their parent and gives them out,
    and sends its own totals on. A shard's root is given out with its totals and the key of its parent instead.
    Rows without ``n_convs`` are totals of other shards' roots, on their way to a run that follows.
    """
    names = [c.split()[0] for c in ROOTS.split(", ")]
    fields = ["depth", "k1", "k2", "n_convs", "conv_id", "top", "run_upto", "start", "p1", "p2", "is_root", "n_children", "n_leaves", "total"]
    queue, out = SpillingQueue(), []
    for frame in frames:
        for depth, k1, k2, n, conv, top, upto, start, p1, p2, is_root, children, leaves, total in frame[fields].itertuples(
            index=False, name=None
        ):
            if n == 0:
                queue.push((-depth, k1, k2, 0, children, leaves, total))
                continue
            key, n_children, n_leaves, below = (-depth, k1, k2), 0, 0, 0
            while (head := queue.peek()) and head[:3] == key:
                _, _, _, is_run, count, more, saved, *run = queue.pop()
                n_children, n_leaves, below = n_children + count, n_leaves + more, below + saved
                if is_run:
                    out.append((*run, conv, False, 0, 0, 0, 0))
            run = (conv, n, top, depth, upto, n_children, n_leaves or 1, below)
            total = below + (n - 1) * (upto - start)
            if is_root:
                out.append((*run, None, True, top - 1, p1, p2, total))
            else:
                queue.push((1 - top, p1, p2, 1, 1, n_leaves or 1, total, *run))
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=names).astype({"parent_conv_id": "Int64"})
            out = []
    yield pd.DataFrame(out, columns=names).astype({"parent_conv_id": "Int64"})


def in_reverse_levels(runs: DataFrame) -> DataFrame:
    return runs.sortWithinPartitions(F.desc("depth"), "k1", "k2", "n_convs").mapInPandas(settle, ROOTS)


def run_totals(nodes: DataFrame, found: DataFrame, busy: int) -> DataFrame:
    """Totals of every run of nodes with the same members, as TOTALS."""
    runs = nodes.groupBy("conv_id", "n_convs").agg(
        F.max(F.struct(*KEY)).alias("_last"), F.min(F.struct("depth", "p1", "p2")).alias("_top"),
        F.max("upto").alias("run_upto"), F.min(F.col("upto") - F.col("chars")).alias("start"),
    )
    runs = runs.select("conv_id", "n_convs", "_last.*", F.col("_top.depth").alias("top"), "_top.p1", "_top.p2", "run_upto", "start")
    runs = runs.withColumns({c: F.lit(0).cast("long") for c in ("n_children", "n_leaves", "total")})
    # Fewer than (rows of found) / busy <= BUSY_NODES nodes have more than busy members.
    heavy = written(nodes.filter(F.col("n_convs") > busy).select(*KEY, F.col("conv_id").alias("_owner")), "busy-nodes")
    above = heavy.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    # The node at which a conversation leaves the busy ones is the root of a shard.
    roots = found.filter("depth = 0").unionByName(found.join(F.broadcast(above), ["depth", "p1", "p2"], "left_semi"))
    roots = roots.join(F.broadcast(heavy.select(*KEY)), KEY, "left_anti")
    roots = roots.select("conv_id", F.col("depth").alias("_cut"), F.xxhash64(*KEY).alias("_shard"))
    light = runs.filter(F.col("n_convs") <= busy).join(roots, "conv_id")
    light = light.withColumn("is_root", F.col("top") == F.col("_cut")).repartition("_shard")
    settled = written(in_reverse_levels(light), "shard-totals")

    messages = settled.filter("is_root").groupBy(*KEY).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("total").alias("total")
    )
    messages = messages.filter("depth >= 0").withColumns(
        {c: F.lit(0).cast("long") for c in ("n_convs", "conv_id", "top", "run_upto", "start", "p1", "p2")}
    )
    upper = runs.filter(F.col("n_convs") > busy).withColumn("is_root", F.col("top") == 0)
    across = in_reverse_levels(upper.unionByName(messages.withColumn("is_root", F.lit(False))).repartition(1))

    owner = heavy.select(*KEY, "_owner")
    names = [c.split()[0] for c in TOTALS.split(", ")]
    within = settled.join(F.broadcast(owner), KEY, "left").withColumn(
        "parent_conv_id", F.when(F.col("is_root"), F.col("_owner")).otherwise(F.col("parent_conv_id"))
    )
    return within.select(*names).unionByName(across.select(*names))


def build_trie(turns: DataFrame, convs: DataFrame, busy: int | None = None) -> DataFrame:
    """Every node of the trie of the given conversations (turns as of ``turn_digests``, and conv_id with length).

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless
    nodes of the subtree), saved_tokens (of the subtree: members beyond the first times the code points of a
    node's last text) and ends_sha256. No conversations give no nodes, not even a root.
    """
    bounded_batches(turns.sparkSession)
    found = prefixes(turns, convs)
    if busy is None:
        busy = max(LEAST_BUSY, found.count() // BUSY_NODES)
    sums = [F.max(c).alias(c) for c in ("chars", "upto", "p1", "p2")]
    nodes = written(found.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *sums), "nodes")
    totals = written(run_totals(nodes, found, busy), "run-totals")
    at_end = F.col("depth") == F.col("last")
    result = (
        nodes.join(ends_digests(found), KEY, "left")
        .join(totals, ["conv_id", "n_convs"])
        .withColumns(
            {
                "n_children": F.when(at_end, F.col("n_children")).otherwise(F.lit(1).cast("long")),
                "parent_conv_id": F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")),
                "saved_tokens": (F.col("n_convs") - 1) * (F.col("run_upto") - F.col("upto") + F.col("chars")) + F.col("below"),
                "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_ENDS)),
            }
        )
    )
    return result.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of (conv_id, turn, role, text) as it stands; see ``build_trie`` and ``turn_digests``.

    Null roles and texts are empty ones, texts count whole however long, repeated rows are turns of their own, other
    columns are ignored.
    """
    turns = turn_digests(conversations)
    return build_trie(turns, turns.filter("pos = 1").select("conv_id", "length"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie after every conversation has taken the head of the first of its hundred (``rebuild``)."""
    return build_trie(*rebuild(turn_digests(conversations)))
