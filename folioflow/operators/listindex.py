"""A stored index for approximate top-k: points in lists by their nearest centre, kept up to date without a refit.

Centres and points are two tables with snapshots; ``index/N.json`` names a version of each, so a search sees one state.
New points go to the nearest of the centres that are there. A list that has grown beyond a limit is split in
two by its own points alone; the other lists stay as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from folioflow.operators import retrieval
from folioflow.operators.snapshots import SnapshotTable
from folioflow.sources.files import names_in, read_text, write_new

LISTS = 64
BUCKETS = 16


class ListIndex:
    """The index at ``path``. Centres are few (a parameter) and are held by the driver and by every task."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.points = SnapshotTable(spark, f"{self.path}/points")
        self.centre_table = SnapshotTable(spark, f"{self.path}/centres")

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, points: DataFrame, centres: DataFrame | None = None, lists: int = LISTS, buckets: int = BUCKETS
    ) -> ListIndex:
        """Index all of ``points`` (chunk_id, vector, ...) by the given ``centres`` (one vector each, in the order of
        their ``list``, from 0), or by ``lists`` centres fitted to the points."""
        if centres is None:
            fitted = retrieval.fit_lists(points.filter("vector is not null"), lists).clusterCenters()
            rows = [(i, [float(x) for x in c]) for i, c in enumerate(fitted)]
            centres = spark.createDataFrame(rows, "list int, vector array<double>")
        index = cls(spark, path)
        made = SnapshotTable.create(spark, f"{index.path}/centres", "list", buckets=1)
        made.upsert(centres.select(F.col("list").cast("int").alias("list"), F.col("vector").cast("array<double>").alias("vector")))
        SnapshotTable.create(spark, f"{index.path}/points", "_list", "chunk_id", buckets)
        index.points.upsert(index._assigned(points, index.centres()))
        index._switch()
        return index

    def _switch(self) -> None:
        """Make the newest tables the state that searches see."""
        state = {"points": self.points.snapshot().version, "centres": self.centre_table.snapshot().version}
        write_new(self.spark, f"{self.path}/index/{len(names_in(self.spark, f'{self.path}/index')):010d}.json", json.dumps(state))

    def state(self) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/index/{names_in(self.spark, f'{self.path}/index')[-1]}"))

    def centres(self, version: int | None = None) -> np.ndarray:
        """Unit vectors, one row per list."""
        rows = sorted(self.centre_table.read(version).collect(), key=lambda r: r["list"])
        return unit(np.array([r["vector"] for r in rows]))

    def _assigned(self, points: DataFrame, centres: np.ndarray) -> DataFrame:
        """Points with the number of their nearest centre (equal ones: the first) in ``_list``."""
        rows = points.drop("_list").filter("vector is not null")

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = nearest_lists(retrieval.as_matrix(pa.Table.from_batches([batch]).column("vector")), centres, 1)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(found[:, 0].astype(np.int32))], names=[*batch.schema.names, "_list"]
                    )

        return rows.mapInArrow(nearest, T.StructType([*rows.schema.fields, T.StructField("_list", T.IntegerType())]))

    def sizes(self) -> dict[int, int]:
        """Points of every list that has any; vectors are not read."""
        return {r["_list"]: r["count"] for r in self.points.read().groupBy("_list").count().collect()}

    def insert(self, points: DataFrame) -> None:
        """Insert or replace points by chunk_id. A replaced point that moves leaves its old list."""
        held = self.points.read().select("_list", "chunk_id")
        old = held.join(points.select("chunk_id"), "chunk_id", "left_semi").select("_list", "chunk_id")
        if old.head(1):
            self.points.delete(old)
        self.points.upsert(self._assigned(points, self.centres()), append=True)
        self._switch()

    def split(self, limit: int) -> int:
        """Split lists of more than ``limit`` points until none is left that can be; returns how many splits were made.

        Only such a list is read and written. Its points find their place among the two new centres; a list of
        equal vectors stays whole.
        """
        whole, splits = set(), 0
        while over := sorted(n for n, size in self.sizes().items() if size > limit and n not in whole):
            for number in over:
                rows = self.points.read(keys=self.spark.createDataFrame([(number,)], "_list int"))
                halves = unit(np.array(retrieval.fit_lists(rows, 2).clusterCenters()))
                if len(halves) < 2 or np.allclose(halves[0], halves[1]):
                    whole.add(number)
                    continue
                added = int(self.centre_table.read().count())
                numbers = F.when(F.col("_list") == 0, F.lit(number)).otherwise(F.lit(added)).cast("int")
                moved = self._assigned(rows, halves).withColumn("_list", numbers)
                self.points.replace(moved, self.spark.createDataFrame([(number,)], "_list int"))
                new = [(number, [float(x) for x in halves[0]]), (added, [float(x) for x in halves[1]])]
                self.centre_table.upsert(self.spark.createDataFrame(new, "list int, vector array<double>"))
                splits += 1
                if self.sizes().get(number, 0) == 0 or self.sizes().get(added, 0) == 0:
                    whole |= {number, added}
        if splits:
            self._switch()
        return splits

    def search(self, queries: DataFrame, probes: int = 4, **options) -> DataFrame:
        """Top-k among the ``probes`` lists nearest to each question (see ``retrieval.knn_approx``)."""
        state = self.state()
        return retrieval.knn_approx(self.points.read(state["points"]), Centres(self.centres(state["centres"])), queries, probes, **options)


class Centres:
    """Centres in the shape of a fitted model."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.rows)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def nearest_lists(vectors: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the nearest centres of every vector, nearest first, equal ones in their order."""
    gaps = (centres * centres).sum(axis=1) - 2 * (unit(vectors) @ centres.T)
    return np.argsort(np.round(gaps, 12), axis=1, kind="stable")[:, :probes]
