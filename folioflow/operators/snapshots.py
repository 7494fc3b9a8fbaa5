"""Bucketed Parquet tables with snapshots: a version writes the buckets it changes, a pointer file says who holds which.

Rows lie in hash buckets of ``key`` in Spark's own bucket layout, so two tables with the same key and bucket
count are joined on it without an exchange. Every write goes to a new folder; ``versions/N.json`` then names for
each bucket the folders it consists of. Readers take one such file and see one version, whatever is written
meanwhile; a writer that finds its version taken fails. A lost driver leaves folders that no version names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from folioflow.sources.files import delete_folder, names_in, read_text, write_new

BUCKETS = 64
BUCKET_BYTES, FEWEST_BUCKETS = 64 << 20, 8
MARKS = ("w", "b")  # the partition columns: folder of the write, bucket
# Buckets are by ``key`` alone; joins on key and id may use them all the same.
_PARTIAL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def buckets_for(size: int | None) -> int:
    """Buckets of a table that will hold about ``size`` bytes: a write sorts, and a join holds, a bucket in one task."""
    return max(FEWEST_BUCKETS, -(-(size or 0) // BUCKET_BYTES))


@dataclass(frozen=True)
class Snapshot:
    """One version: ``live`` lists the folders of each bucket, ``layered`` the buckets whose folders may repeat an id."""

    version: int
    key: str
    id: str
    buckets: int
    meta: dict
    schema: dict | None = None
    live: dict[int, list[str]] = field(default_factory=dict)
    layered: tuple[int, ...] = ()

    def text(self) -> str:
        return json.dumps(self.__dict__ | {"live": {str(b): w for b, w in sorted(self.live.items())}})

    @staticmethod
    def of(text: str) -> Snapshot:
        given = json.loads(text)
        given["live"] = {int(b): w for b, w in given["live"].items()}
        return Snapshot(**given | {"layered": tuple(given["layered"])})


class SnapshotTable:
    """The table at ``path``; rows are told apart by ``key`` and ``id``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.conf.set(_PARTIAL_KEYS, "false")

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, key: str, id: str | None = None, buckets: int = BUCKETS, **meta
    ) -> SnapshotTable:
        """A new table; one that is there is returned as it is."""
        table = cls(spark, path)
        if not table.exists():
            try:
                table._record(Snapshot(0, key, id or key, buckets, meta))
            except FileExistsError:
                pass
        return table

    def exists(self) -> bool:
        return bool(self.versions())

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in names_in(self.spark, f"{self.path}/versions") if n[0].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, by default the newest."""
        number = self.versions()[-1] if version is None else version
        return Snapshot.of(read_text(self.spark, f"{self.path}/versions/{number:010d}.json"))

    def _record(self, new: Snapshot) -> Snapshot:
        write_new(self.spark, f"{self.path}/versions/{new.version:010d}.json", new.text())
        return new

    def _next(self, old: Snapshot, live: dict[int, list[str]], schema: dict | None, layered: set[int]) -> Snapshot:
        layered = tuple(sorted(b for b in layered if len(live.get(b, ())) > 1))
        return self._record(Snapshot(old.version + 1, old.key, old.id, old.buckets, old.meta, schema, live, layered))

    # ---- reading ------------------------------------------------------------------------

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a version. Bucketed by the key: joins and groups by it need no exchange.

        With ``keys`` (rows with the key column) only the rows with these keys, and only their buckets are read.
        """
        snap = self.snapshot(version)
        if keys is None:
            return self._newest(self._scan(snap), snap).drop(*MARKS)
        rows = self._newest(self._scan(snap, self._touched(snap, keys)), snap).drop(*MARKS)
        return rows.join(keys.select(snap.key).distinct(), snap.key, "left_semi")

    def _touched(self, snap: Snapshot, keys: DataFrame) -> set[int]:
        """Buckets of the keys: as many numbers as buckets at most."""
        return {r[0] for r in keys.select(self._bucket(snap)).distinct().collect()}

    def _scan(self, snap: Snapshot, buckets: set[int] | None = None) -> DataFrame:
        """The rows of all folders of a version, or of some buckets of it, with ``w`` and ``b``."""
        if not snap.live:
            schema = T.StructType.fromJson(snap.schema) if snap.schema else T.StructType()
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumns({"w": F.lit(""), "b": F.lit(0)})
        name = f"snapshot_{hashlib.md5(f'{self.path}|{snap.text()}'.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            self._register(name, snap)
        rows = self.spark.table(name)
        return rows if buckets is None else rows.filter(F.col("b").isin(sorted(buckets)))

    def _register(self, name: str, snap: Snapshot) -> None:
        """Name the folders of a version to Spark as a table in its bucket layout."""
        schema = T.StructType.fromJson(snap.schema)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(
            f"create table if not exists {name} ({columns}, w string, b int) using parquet partitioned by (w, b)"
            f" clustered by (`{snap.key}`) into {snap.buckets} buckets location '{self.path}/data'"
        )
        held = [f"partition (w='{w}', b={b})" for b, ws in snap.live.items() for w in ws]
        for i in range(0, len(held), 500):
            self.spark.sql(f"alter table {name} add if not exists {' '.join(held[i : i + 500])}")

    def _newest(self, rows: DataFrame, snap: Snapshot) -> DataFrame:
        """Of several rows of an id in layers the last written; within a bucket, without an exchange."""
        if not snap.layered:
            return rows
        order = Window.partitionBy(snap.key, snap.id).orderBy(F.desc("w"))
        return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")

    # ---- writing ------------------------------------------------------------------------

    def _bucket(self, snap: Snapshot) -> Column:
        return F.pmod(F.hash(snap.key), F.lit(snap.buckets))

    def _put(self, rows: DataFrame, snap: Snapshot) -> tuple[str, set[int]]:
        """Write rows that lie in tasks by bucket to a new folder; its name and the buckets it has."""
        mark, name = f"{snap.version + 1:010d}-{uuid.uuid4().hex[:8]}", f"write_{uuid.uuid4().hex}"
        folder = f"{self.path}/data/w={mark}"
        rows.drop(*MARKS).withColumn("b", self._bucket(snap)).write.partitionBy("b").bucketBy(snap.buckets, snap.key).format(
            "parquet"
        ).option("path", folder).saveAsTable(name)
        self.spark.sql(f"drop table {name}")
        return mark, {int(n[2:]) for n in names_in(self.spark, folder) if n.startswith("b=")}

    def _dealt(self, rows: DataFrame, snap: Snapshot, order: str | list[str] | None) -> DataFrame:
        """Incoming rows by bucket, one of each id: the last in ``order``. The one shuffle of a write."""
        by = [F.desc(c) for c in ([order] if isinstance(order, str) else order or [])]
        dealt = rows.repartition(snap.buckets, snap.key)
        spot = Window.partitionBy(snap.key, snap.id).orderBy(*(by or [F.lit(1)]))
        return dealt.withColumn("_n", F.row_number().over(spot)).filter("_n = 1").drop("_n")

    def _shape(self, rows: DataFrame, snap: Snapshot, drop: list[str]) -> tuple[DataFrame, dict]:
        rows = rows.drop(*drop)
        if snap.schema is None:
            return rows, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).jsonValue()
        names = [f["name"] for f in snap.schema["fields"]]
        return rows.select(*names), snap.schema

    def _without(self, snap: Snapshot, touched: set[int], gone: DataFrame, on: list[str]) -> tuple[str, set[int]]:
        """The rows of the touched buckets that ``gone`` does not name, written; stored rows are not shuffled."""
        kept = self._newest(self._scan(snap, touched), snap)
        return self._put(kept.join(gone.select(*on), on, "left_anti").select(*kept.columns), snap)

    def upsert(self, incoming: DataFrame, order: str | list[str] | None = None, append: bool = False, keep_order: bool = False) -> Snapshot:
        """Insert or replace by id. ``incoming`` runs once; of its rows of one id the last in ``order`` wins (without an
        order any one) and ``order`` is not stored unless ``keep_order``.

        Touched buckets are read and written anew, or with ``append`` get a further layer that readers prefer: the
        cost is that of the incoming rows, until ``compact``.
        """
        snap = self.snapshot()
        names = [order] if isinstance(order, str) else order or []
        drop = [] if keep_order else [c for c in names if not snap.schema or c not in {f["name"] for f in snap.schema["fields"]}]
        wanted = self._dealt(incoming, snap, order)
        shaped, schema = self._shape(wanted, snap, drop)
        mark, touched = self._put(shaped, snap)
        live, old = dict(snap.live), touched & set(snap.live)
        if append or not old:
            live |= {b: [*snap.live.get(b, []), mark] for b in touched}
            return self._next(snap, live, schema, {*snap.layered, *old})
        new = Snapshot(snap.version, snap.key, snap.id, snap.buckets, snap.meta, schema, {b: [mark] for b in touched})
        kept, left = self._without(snap, old, self._scan(new), [snap.key, snap.id])
        live |= {b: [kept, mark] if b in left else [mark] for b in touched}
        return self._next(snap, live, schema, set(snap.layered) - touched)

    def delete(self, keys: DataFrame) -> Snapshot:
        """Delete the rows that ``keys`` names: by the key column, and by the id if it has that column as well."""
        snap = self.snapshot()
        on = list(dict.fromkeys([snap.key, *([snap.id] if snap.id in keys.columns else [])]))
        return self._exchange(snap, keys.select(*on).distinct(), on, None)

    def replace(self, rows: DataFrame, keys: DataFrame | None = None, order: str | list[str] | None = None) -> Snapshot:
        """Put ``rows`` in place of all stored rows with the same key, or with one of ``keys``."""
        snap = self.snapshot()
        keys = (rows if keys is None else keys).select(snap.key).distinct()
        return self._exchange(snap, keys, [snap.key], self._dealt(rows, snap, order))

    def _exchange(self, snap: Snapshot, gone: DataFrame, on: list[str], rows: DataFrame | None) -> Snapshot:
        schema, mark, added = snap.schema, None, set()
        if rows is not None:
            shaped, schema = self._shape(rows, snap, [])
            mark, added = self._put(shaped, snap)
        touched = self._touched(snap, gone) & set(snap.live)
        live, kept, left = dict(snap.live), None, set()
        if touched:
            kept, left = self._without(snap, touched, gone, on)
        for b in touched | added:
            if b in touched:
                live[b] = [kept] if b in left else []
            live[b] = [*live.get(b, []), *([mark] if b in added else [])]
        layered = set(snap.layered) - touched | {b for b in added - touched if live[b] != [mark]}
        return self._next(snap, {b: ws for b, ws in live.items() if ws}, schema, layered)

    def compact(self) -> Snapshot:
        """Write the layered buckets anew, one folder each."""
        snap = self.snapshot()
        if not snap.layered:
            return snap
        layered = set(snap.layered)
        mark, _ = self._put(self._newest(self._scan(snap, layered), snap), snap)
        return self._next(snap, snap.live | {b: [mark] for b in layered}, snap.schema, set())

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions and the folders that none of these names; while nobody writes."""
        numbers = self.versions()
        used = {w for n in numbers[-keep:] for ws in self.snapshot(n).live.values() for w in ws}
        for number in numbers[:-keep]:
            delete_folder(self.spark, f"{self.path}/versions/{number:010d}.json")
        for name in names_in(self.spark, f"{self.path}/data"):
            if name.startswith("w=") and name[2:] not in used:
                delete_folder(self.spark, f"{self.path}/data/{name}")
