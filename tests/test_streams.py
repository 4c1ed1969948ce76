"""The inbox and the bars as streams over files, run to the end and taken up again."""

import json
import os
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from candlery.streaming import inbox

START = datetime(2024, 1, 1)


def alert(deployment, bar, received, action="enter", direction="Long"):
    return {"deployment_id": deployment, "bar_time": (START + timedelta(minutes=bar)).isoformat(), "received_at": (START + timedelta(minutes=received)).isoformat(), "timeframe": 60, "action": action, "direction": direction, "price": 1.5}


def put(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_inbox(spark, tmp_path):
    source, sink, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    put(source, "a.json", [alert(1, 0, 60), alert(1, 0, 61), alert(2, 0, 60), alert(1, 60, 190), alert(1, 60, 0), alert(1, 60, 120, "exit")])
    inbox.run_inbox(spark, str(source), sink, mark).awaitTermination()
    seen = lambda: sorted((r.deployment_id, r.action, int(r.bar_time.timestamp())) for r in spark.read.parquet(sink).collect())
    base = int(START.timestamp())
    first = [(1, "enter", base), (1, "exit", base + 3600), (2, "enter", base)]  # a repeat, one too late and one too early are gone
    assert [(d, a) for d, a, _ in seen()] == [(d, a) for d, a, _ in first]
    put(source, "b.json", [alert(1, 0, 65), alert(2, 120, 130)])
    inbox.run_inbox(spark, str(source), sink, mark).awaitTermination()
    assert [(d, a) for d, a, _ in seen()] == [(1, "enter"), (1, "exit"), (2, "enter"), (2, "enter")]
    batch = inbox.accepted(spark.read.schema(inbox.ALERT).json(str(source)))
    assert batch.count() == 4


def test_bars_come_once_when_closed(spark, tmp_path):
    source = tmp_path / "ticks"
    tick = lambda m, s, p: {"symbol": "S", "t": (START + timedelta(minutes=m)).isoformat(), "seq": s, "price": p, "volume": 2.0}
    put(source, "a.json", [tick(1, 2, 5.0), tick(1, 1, 4.0), tick(9, 3, 7.0), tick(14, 4, 6.0)])
    put(source, "b.json", [tick(40, 5, 9.0)])
    put(source, "c.json", [tick(70, 6, 8.0)])
    put(source, "d.json", [tick(3, 7, 100.0), tick(75, 8, 8.0)])  # the first comes two batches after its bar was closed
    for k, name in enumerate(("a.json", "b.json", "c.json", "d.json")):  # files are read in the order of their times
        os.utime(source / name, (1_700_000_000 + k, 1_700_000_000 + k))
    ticks = spark.readStream.schema("symbol string, t timestamp, seq long, price double, volume double").option("maxFilesPerTrigger", 1).json(str(source))
    query = inbox.bars_stream(ticks, 10).writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "m")).start()
    query.awaitTermination()
    minute = int(START.replace(tzinfo=timezone.utc).timestamp()) // 60
    rows = {r.bar_ts // 60_000 - minute: (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("bars").collect()}
    # The late tick is left out; bars are out up to ten minutes before the last tick.
    assert rows == {0: (4.0, 7.0, 4.0, 7.0, 6.0), 10: (6.0, 6.0, 6.0, 6.0, 2.0), 40: (9.0, 9.0, 9.0, 9.0, 2.0)}
    assert spark.table("bars").count() == 3
    assert spark.table("bars").where(F.col("high") < F.col("low")).count() == 0
