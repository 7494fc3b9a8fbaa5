"""Documents watched as their status events arrive: impossible changes, late events, and documents that stand still."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioflow.operators.documents import TRANSITIONS

# States in which nothing more is expected.
FINAL = ("ready", "ocr_failed", "index_failed", "failed")
PATIENCE = "1 day"
FINDINGS = "doc_id string, kind string, event_id long, from_status string, to_status string, at timestamp"
_STATE = "status string, event_id long, at timestamp"


class Watch(StatefulProcessor):
    """The last event of a document, and a timer for the moment at which it has stood still too long."""

    def __init__(self, patience: pd.Timedelta):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def _stuck(self, doc_id: str | None, last: tuple) -> dict:
        status, event_id, at = last
        return {
            "doc_id": doc_id, "kind": "stuck", "event_id": event_id, "from_status": status, "to_status": None,
            "at": pd.Timestamp(at) + self.patience,
        }

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        doc_id = None if key[0] else key[1]
        # A document's events of one batch, seldom many; in the order of their time.
        events = pd.concat(list(rows), ignore_index=True).sort_values(["updated_at", "event_id"])
        last = tuple(self.last.get()) if self.last.exists() else None
        found = []
        for at, event_id, status in events[["updated_at", "event_id", "status"]].itertuples(index=False, name=None):
            at = pd.Timestamp(at)
            seen = last and (pd.Timestamp(last[2]), last[1])
            if seen and (at, event_id) <= seen:
                if (at, event_id) < seen:
                    found.append({"doc_id": doc_id, "kind": "late", "event_id": event_id, "from_status": last[0], "to_status": status, "at": at})
                continue
            if last and last[0] not in FINAL and at > seen[0] + self.patience:
                found.append(self._stuck(doc_id, last))
            if last and last[0] != status and f"{last[0]}>{status}" not in TRANSITIONS:
                found.append({"doc_id": doc_id, "kind": "impossible", "event_id": event_id, "from_status": last[0], "to_status": status, "at": at})
            last = (status, event_id, at.to_pydatetime())
        self.last.update(last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last[0] not in FINAL:
            self.handle.registerTimer(_millis(pd.Timestamp(last[2]) + self.patience))
        yield pd.DataFrame(found, columns=[c.split()[0] for c in FINDINGS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get())
        yield pd.DataFrame([self._stuck(None if key[0] else key[1], last)])

    def close(self) -> None:
        pass


def _millis(moment: pd.Timestamp) -> int:
    moment = moment.tz_localize("UTC") if moment.tzinfo is None else moment
    return int(moment.timestamp() * 1000)


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Named state with timers needs this store; it keeps its state on disk, not in the executor's heap."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def watch_documents(events: DataFrame, patience: str = PATIENCE, delay: str = "0 seconds") -> DataFrame:
    """A stream of findings (FINDINGS) from a stream of (event_id, doc_id, status, updated_at).

    ``impossible`` is a change that the flow cannot make, ``late`` an event that comes after a later one of its document was
    seen (it changes nothing), ``stuck`` a document without an event for ``patience`` in a state that is not
    final: found by the next event, or by a timer once the watermark (``delay`` behind the newest event) has passed.
    An event delivered again right away is passed over. Events without a doc_id are watched as one document and reported
    with a null id. State is one row per document.
    """
    keep_state_in_rocksdb(events.sparkSession)
    timed = events.select(
        F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit("")).alias("doc"),
        F.col("event_id").cast("long").alias("event_id"), "status", F.col("updated_at").cast("timestamp").alias("updated_at"),
    ).withWatermark("updated_at", delay)
    return timed.groupBy("nameless", "doc").transformWithStateInPandas(
        statefulProcessor=Watch(pd.Timedelta(patience)), outputStructType=FINDINGS, outputMode="Append", timeMode="EventTime"
    )
