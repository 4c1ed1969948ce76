"""Progress out of running work: metrics that are counted in the same pass as the work itself."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener


class Listener(StreamingQueryListener):
    """Hands on what each batch of each stream has counted: send(query's name, batch's number, metrics)."""

    def __init__(self, send: Callable[[str | None, int, dict], None]):
        self.send, self.ended = send, set()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        done = event.progress
        counted = {name: row.asDict() for name, row in done.observedMetrics.items()}
        self.send(done.name, done.batchId, {"rows": done.numInputRows} | counted)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.ended.add(str(event.runId))


def counted(rows: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """rows, a stream or a batch, with aggregates that are computed while they pass."""
    return rows.observe(name, *(c.alias(k) for k, c in metrics.items()))


@contextlib.contextmanager
def reported(spark: SparkSession, send: Callable[[str | None, int, dict], None]) -> Iterator[Listener]:
    """All streams that run meanwhile report to send; all events are delivered before it ends."""
    listener = Listener(send)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(listener)
