"""Token ids as raw binary shards with a minimal perfect hash index.

Layout under one folder (all numbers little-endian):

``shard-NNNNN.bin``   32 bytes of header (magic, version u32, width u32, ids u64, documents u64), then the ids of
                      the shard's documents, ``width`` bytes each, in ascending doc_id order.
``index-NNNNN.mph``   32 bytes of header (magic, version u32, levels u32, keys u64, 0 u64), per level the number of
                      bits u64 and the bits, then per slot fingerprint u32, shard u32, first id in the shard u64,
                      number of ids u64, number of ids of all documents before u64, as five arrays.

A document's key is (doc_id, n) where n counts rows with that id from 0. The key's hash names the index part;
there every level of bits is asked in turn until one holds the key's bit; the number of bits set before it is the
slot. No two keys of the index share a slot and no slot is empty. The stored fingerprint tells a key that was
never stored from one that was, but for one in four billion.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.llm.common import bounded_batches, written
from folioflow.session import work_dir

MAGIC_IDS, MAGIC_INDEX, VERSION = b"FFTOKIDS", b"FFTOKMPH", 1
HEADER, HEADER_BYTES = "<8sIIQQ", 32
END_ID = 2
SHARD_BYTES = 32 << 20  # of text (and 16 a row) for one shard
PART_KEYS = 200_000  # most keys of one index part, on average
LEAST_PARTS = 64
SPREAD = 2.0  # bits a key on each level
LEVELS = 100


# Schemes of Hadoop paths and what Arrow calls them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def shared_uri(spark: SparkSession, folder: str) -> str:
    """The folder as Spark resolves it (a path without a scheme lies on its default file system), for use in tasks.

    Fails before anything is written if tasks cannot reach that file system through Arrow.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    scheme, rest = path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString().split(":", 1)
    if scheme not in SCHEMES:
        raise ValueError(f"token files cannot be written to {scheme}: paths, only to {', '.join(SCHEMES)}")
    return f"{SCHEMES[scheme]}://{rest.removeprefix('//')}"


def open_fs(uri: str):
    """File system and path of a folder named by ``shared_uri``."""
    from pyarrow import fs

    scheme, place = uri.split("://", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), place
    return fs.FileSystem.from_uri(f"{scheme}://{quote(place, safe='/@:')}")


def _commit(system, path: str, chunks: Iterator[bytes], attempt: str) -> None:
    """Write under a name of this attempt, then move: a lost or repeated task leaves no half file."""
    draft = f"{path}.{attempt}"
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(draft, path)


def _attempt() -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"attempt-{context.taskAttemptId()}" if context else "attempt-0"


# ---- minimal perfect hash ---------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(one: np.ndarray, two: np.ndarray, level: int, bits: int) -> np.ndarray:
    seed = _mix(np.array([level + 1], dtype=np.uint64))
    return (_mix(one ^ _mix(two + seed)) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Bit arrays, one per level; a key belongs to the first level on which no other key had its place."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.cumsum(b, dtype=np.int64) for b in levels]
        self.before = np.cumsum([0] + [int(r[-1]) for r in self.ranks])

    @classmethod
    def build(cls, one: np.ndarray, two: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(one):
            if len(levels) == LEVELS:
                raise ValueError("two keys have the same hashes")
            bits = int(len(one) * SPREAD) + 8
            place = _places(one, two, len(levels), bits)
            alone = np.bincount(place, minlength=bits) == 1
            levels.append(alone)
            left = ~alone[place]
            one, two = one[left], two[left]
        return cls(levels)

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 for a key that no level holds."""
        found = np.full(len(one), -1, dtype=np.int64)
        open_keys = np.arange(len(one))
        for level, bits in enumerate(self.levels):
            place = _places(one[open_keys], two[open_keys], level, len(bits))
            hit = bits[place]
            found[open_keys[hit]] = self.before[level] + self.ranks[level][place[hit]] - 1
            open_keys = open_keys[~hit]
        return found


def _fingerprint(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (_mix(two ^ _mix(one)) >> np.uint64(32)).astype("<u4")


FIELDS = (("shard", "<u4"), ("first", "<u8"), ("n", "<u8"), ("before", "<u8"))


def index_bytes(one: np.ndarray, two: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[bytes]:
    hasher = PerfectHash.build(one, two)
    slot = hasher.slots(one, two)
    yield struct.pack(HEADER, MAGIC_INDEX, VERSION, len(hasher.levels), len(one), 0)
    for bits in hasher.levels:
        yield struct.pack("<Q", len(bits)) + np.packbits(bits).tobytes()
    for name, kind in (("fingerprint", "<u4"), *FIELDS):
        values = _fingerprint(one, two) if name == "fingerprint" else columns[name]
        out = np.empty(len(one), dtype=kind)
        out[slot] = values.astype(kind)
        yield out.tobytes()


class IndexPart:
    """One index file in memory."""

    def __init__(self, data: bytes):
        magic, version, levels, keys, _ = struct.unpack_from(HEADER, data)
        if magic != MAGIC_INDEX or version != VERSION:
            raise ValueError("not an index file")
        at, arrays = HEADER_BYTES, []
        for _ in range(levels):
            (bits,) = struct.unpack_from("<Q", data, at)
            size = (bits + 7) // 8
            packed = np.frombuffer(data, dtype=np.uint8, count=size, offset=at + 8)
            arrays.append(np.unpackbits(packed, count=bits).astype(bool))
            at += 8 + size
        self.hasher = PerfectHash(arrays)
        self.columns = {}
        for name, kind in (("fingerprint", "<u4"), *FIELDS):
            self.columns[name] = np.frombuffer(data, dtype=kind, count=keys, offset=at)
            at += keys * int(kind[2])

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Whether each key is stored, and the fields of the stored ones."""
        slot = self.hasher.slots(one, two)
        known = slot >= 0
        known[known] = self.columns["fingerprint"][slot[known]] == _fingerprint(one[known], two[known])
        return known, {name: self.columns[name][slot[known]] for name, _ in FIELDS}


# ---- writing ------------------------------------------------------------------------------


def _keys(doc_id: Column, nth: Column) -> list[Column]:
    return [
        F.xxhash64(F.lit(1), doc_id, nth).alias("one"),
        F.xxhash64(F.lit(2), nth, doc_id, F.lit(3)).alias("two"),
    ]


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Write the payload files; (doc_id, nth, shard, first, n, before) of every row.

    Rows are dealt by ranges of (doc_id, hash of the text), so that an id with very many rows spreads over shards.
    The texts are shuffled once and encoded where they are written.
    """
    end, folder = int(end_id).to_bytes(width, "little"), shared_uri(docs.sparkSession, folder)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from folioflow.llm.tokens import encoder

        tok, shard = encoder(path, width), TaskContext.get().partitionId()
        system, place = open_fs(folder)
        name, draft = f"{place}/shard-{shard:05d}.bin", f"{place}/shard-{shard:05d}.raw.{_attempt()}"
        ids = total = 0
        last, nth, out = object(), 0, None
        system.create_dir(place, recursive=True)
        try:
            for frame in frames:
                rows = []
                for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                    doc_id = None if pd.isna(doc_id) else int(doc_id)
                    data = (tok.encode(text) if text else b"") + end
                    out = out or system.open_output_stream(draft)
                    out.write(data)
                    nth = nth + 1 if doc_id == last else 0
                    last = doc_id
                    rows.append((doc_id, nth, shard, ids, len(data) // width))
                    ids += len(data) // width
                    total += 1
                made = pd.DataFrame(rows, columns=["doc_id", "nth", "shard", "first", "n"])
                yield made.astype({"doc_id": "Int64"})
        finally:
            if out:
                out.close()
        if out:

            def chunks() -> Iterator[bytes]:
                yield struct.pack(HEADER, MAGIC_IDS, VERSION, width, ids, total)
                with system.open_input_stream(draft) as raw:
                    while part := raw.read(8 << 20):
                        yield part

            _commit(system, name, chunks(), _attempt())
            system.delete_file(draft)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = given.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    shards = max(size // SHARD_BYTES + 1, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    dealt = given.withColumn("_h", F.xxhash64("text")).repartitionByRange(int(shards), "doc_id", "_h")
    ordered = dealt.sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    records = written(
        ordered.mapInPandas(put, "doc_id long, nth long, shard int, first long, n long"), "records"
    )
    # As many rows as shards: ids before each of them.
    starts = records.groupBy("shard").agg(F.sum("n").alias("ids")).withColumn(
        "_before", F.expr("sum(ids) over (order by shard) - ids")
    )
    # Rows of one id in earlier shards; an id is in several shards only where two of them meet.
    runs = records.groupBy("doc_id", "shard").agg(F.count("*").alias("c"))
    earlier = F.expr("sum(c) over (partition by doc_id order by shard) - c")
    split = runs.withColumn("_earlier", earlier).filter("_earlier > 0").drop("c")
    split = split.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), "_earlier")
    full = records.join(F.broadcast(starts.drop("ids")), "shard").join(
        F.broadcast(split), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("shard") == F.col("_shard")), "left"
    )
    return full.select(
        "doc_id", (F.col("nth") + F.coalesce("_earlier", F.lit(0))).alias("nth"),
        "shard", "first", "n", (F.col("_before") + F.col("first")).alias("before"),
    )


def write_index(records: DataFrame, folder: str, parts: int) -> int:
    """Write the index files of the records; returns the number of keys."""
    folder = shared_uri(records.sparkSession, folder)

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        system, place = open_fs(folder)
        one, two = (frame[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("one", "two"))
        columns = {name: frame[name].to_numpy() for name, _ in FIELDS}
        _commit(system, f"{place}/index-{int(key[0]):05d}.mph", index_bytes(one, two, columns), _attempt())
        return pd.DataFrame({"keys": [len(frame)]})

    keyed = records.select(*_keys(F.col("doc_id"), F.col("nth")), "shard", "first", "n", "before")
    grouped = keyed.groupBy(F.pmod("one", F.lit(parts)).alias("part")).applyInPandas(build, "keys long")
    return written(grouped, "indexed").agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0]


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Encode (doc_id, text) into shards and index under ``folder``.

    Returns the keys (doc_id, nth) with the number of index parts. Null texts are empty ones; a null
    doc_id is a key like others and comes first; repeated rows are stored each, numbered by ``nth``; an empty table
    writes no file and returns no key. Other columns are not read. A text is encoded whole in one task, however long.
    """
    bounded_batches(docs.sparkSession)
    records = written(write_shards(docs, path, folder, end_id, width), "placed")
    parts = max(records.count() // PART_KEYS + 1, LEAST_PARTS)
    write_index(records, folder, parts)
    return records.select("doc_id", "nth", F.lit(parts).alias("parts"))


# ---- reading ------------------------------------------------------------------------------


def read_documents(keys: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents by key, from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids), and ``ids`` if asked.

    Keys (doc_id, nth, parts) meet their index part, then what was found meets its shard; both groups are
    bounded by the size of a part and of a shard. Keys that are not stored give no row.
    """
    folder = shared_uri(keys.sparkSession, folder)

    def locate(key, frame: pd.DataFrame) -> pd.DataFrame:
        system, place = open_fs(folder)
        with system.open_input_stream(f"{place}/index-{int(key[0]):05d}.mph") as f:
            part = IndexPart(f.read())
        one, two = (frame[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("one", "two"))
        known, found = part.find(one, two)
        out = pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[known]}).astype({"doc_id": "Int64"})
        return out.assign(**{name: found[name].astype(np.int64) for name, _ in FIELDS})

    def fetch(key, frame: pd.DataFrame) -> pd.DataFrame:
        system, place = open_fs(folder)
        with system.open_input_file(f"{place}/shard-{int(key[0]):05d}.bin") as f:
            magic, version, width, total, _ = struct.unpack(HEADER, f.read(HEADER_BYTES))
            if magic != MAGIC_IDS or version != VERSION:
                raise ValueError("not a shard file")
            ids = np.frombuffer(f.read(total * width), dtype={2: "<u2", 4: "<u4"}[width])
        sums, lists = [], []
        for first, n in zip(frame["first"], frame["n"], strict=True):
            own = ids[first : first + n].astype("<u4")
            sums.append(zlib.crc32(own.tobytes()))
            lists.append(own.astype(np.int64) if with_ids else None)
        out = pd.DataFrame(
            {"doc_id": frame["doc_id"], "start": frame["before"], "n_tokens": frame["n"], "ids_crc32": sums}
        ).astype({"doc_id": "Int64"})
        return out.assign(ids=lists) if with_ids else out

    keyed = keys.select("doc_id", *_keys(F.col("doc_id"), F.col("nth")), "parts")
    located = keyed.groupBy(F.pmod("one", F.col("parts")).alias("part")).applyInPandas(
        lambda key, frame: locate(key, frame), "doc_id long, shard int, first long, n long, before long"
    )
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return located.groupBy("shard").applyInPandas(lambda key, frame: fetch(key, frame), schema)


def encode_and_read(docs: DataFrame, path: str, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Write all documents to files in the shared folder and read them back by key."""
    spark: SparkSession = docs.sparkSession
    folder = work_dir(spark, "token-files")
    return read_documents(write_token_files(docs, path, folder, end_id, width), folder)
