"""Leases of running work as state by run: beats keep a run, and a timer takes it back when they stop.

Nothing is rewritten when a run goes stale: its own timer, in event time, puts out the change.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Input: run_id, t (timestamp) and kind, one of KINDS.
KINDS = ["beat", "result", "cancel", "finish"]
CHANGES = "run_id long, at long, status string, reason string"
_STATE = "status string, until long, results boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Leases(StatefulProcessor):
    """The life of a run. A beat claims a pending run, or one not seen before, and prolongs a running one's lease.

    `result` is a beat that stores results. When the lease ends, a run with results is completed and another one
    pending again. `cancel` and `finish` end a run for good; what comes after the end is passed over.
    """

    def __init__(self, lease_ms: int):
        self.lease = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)

    def _lapse(self, until: int, results: bool) -> tuple[str, list]:
        status = "completed" if results else "pending"
        return status, [(until, status, "lease ended")]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, until, results = self.state.get() if self.state.exists() else ("pending", 0, False)
        out = []
        for at, kind in sorted(((row.at, row.kind) for row in rows), key=lambda e: (e[0], KINDS.index(e[1]))):
            if status == "running" and at > until:  # stopped and came back between two batches, or within one
                status, more = self._lapse(until, results)
                out += more
            if status in ("completed", "cancelled"):
                continue
            if kind in ("cancel", "finish"):
                status = "cancelled" if kind == "cancel" else "completed"
                out.append((at, status, kind))
                continue
            if status == "pending":
                status = "running"
                out.append((at, status, "claimed"))
            until, results = at + self.lease, results or kind == "result"
        self._timer(status, until)
        self.state.update((status, until, results))
        for change in out:
            yield Row(run_id=key[0], at=change[0], status=change[1], reason=change[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, until, results = self.state.get()
        if status == "running" and expiredTimerInfo.getExpiryTimeInMs() > until:
            status, out = self._lapse(until, results)
            self.state.update((status, until, results))
            for change in out:
                yield Row(run_id=key[0], at=change[0], status=change[1], reason=change[2])

    def _timer(self, status: str, until: int) -> None:
        """One timer a run, a millisecond after its lease."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "running":
            self.handle.registerTimer(until + 1)

    def close(self) -> None:
        pass


def lease_changes(events: DataFrame, lease_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Changes of status of a stream of events (run_id, t, kind), each once, with the time (ms) they took effect.

    Events later than the watermark are turned away. Needs Spark's RocksDB state store (see start).
    """
    known = events.select("run_id", "t", "kind", F.unix_millis("t").alias("at")).withWatermark("t", delay)
    return known.groupBy("run_id").transformWithState(Leases(lease_ms), CHANGES, "Append", "EventTime")


def start(changes: DataFrame, path: str, checkpoint: str):
    """All there is now; run again from the same checkpoint it goes on with the leases it knows."""
    spark, name = changes.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def last_status(changes: DataFrame) -> DataFrame:
    """Each run's last status and how often its lease ended. Changes at one time: the end of a lease comes first."""
    lapsed = F.col("reason") == "lease ended"
    return changes.groupBy("run_id").agg(F.max_by("status", F.struct("at", ~lapsed)).alias("status"), F.count_if(lapsed).alias("lapses"))
