"""Paged sources, exactly-once inserts, leases, progress, cancelling and deletes: what each of them is for."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from candlery.sources import pages, payloads, sinks
from candlery.streaming import control, leases, ledger, progress

BAR = "symbol string, ts long, open double, high double, low double, close double, volume double"
MINUTE = 60_000


def bars(spark, symbol, first, n):
    return spark.createDataFrame([(symbol, (first + k) * MINUTE, *[float(first + k)] * 4, 1.0) for k in range(n)], BAR)


def times(df, symbol="B/T C"):
    return sorted(r.ts // MINUTE for r in df.where(F.col("symbol") == symbol).collect())


def files_of(path, name="page"):
    return {os.path.join(top, f): os.stat(os.path.join(top, f)).st_mtime_ns for top, _, found in os.walk(path) for f in found if f[0] not in "._"}


# -- pages


def test_backward_scan_opens_only_what_it_needs(spark, tmp_path):
    path = str(tmp_path / "pages")
    assert pages.scan(spark, path).count() == 0
    pages.save_pages(bars(spark, "B/T C", 0, 5000).union(bars(spark, "other", 0, 10)), path)
    scan = pages.scan(spark, path)
    assert times(scan) == list(range(5000)) and times(scan, "other") == list(range(10))
    broken = next(f for f in files_of(path) if "page=1/" in f)
    with open(broken, "w") as f:
        f.write("[[1, ")
    with pytest.raises(Exception, match="is not a page of klines"):
        pages.scan(spark, path).count()
    late = pages.scan(spark, path).where((F.col("ts") >= 2000 * MINUTE) & (F.col("ts") < 4500 * MINUTE) & (F.col("symbol") == "B/T C"))
    # A partition may hold several pages, so a scan of pages 2 to 4 must leave page 1 beside them closed.
    assert times(late) == list(range(2000, 4500))
    assert pages.scan(spark, path).where((F.col("ts") <= 5 * MINUTE) & F.col("symbol").isin("other", "x")).count() == 6
    assert pages.scan(spark, path).where(F.col("ts") > 10_000 * MINUTE).count() == 0


def test_slices_newest_first(tmp_path, spark):
    path = str(tmp_path / "pages")
    pages.save_pages(bars(spark, "A", 0, 5000), path)
    reader = pages.KlinePages({"path": path, "pagesPerPartition": "2"}).reader(None)
    assert [(p.number, len(p.pages)) for p in reader.partitions()] == [(2, 1), (1, 2), (0, 2)]


def run(stream, path, mark):
    q = stream.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(mark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, out, mark = str(tmp_path / "pages"), tmp_path / "out", tmp_path / "mark"
    pages.save_pages(bars(spark, "B/T C", 0, 1500), path)
    assert run(pages.stream(spark, path), out, mark) == 1500
    assert run(pages.stream(spark, path), out, mark) == 0
    pages.save_pages(bars(spark, "B/T C", 1400, 300).union(bars(spark, "new", 7, 3)), path)  # overlaps, in a page that was read in part
    assert run(pages.stream(spark, path), out, mark) == 203
    assert times(spark.read.parquet(str(out))) == list(range(1700)) and times(spark.read.parquet(str(out)), "new") == [7, 8, 9]
    resumed = pages.stream(spark, path, resume={"B/T C": 1690 * MINUTE, "gone": 5})
    assert run(resumed, tmp_path / "out2", tmp_path / "mark2") == 9 + 3


def test_source_tells_what_is_committed(spark, tmp_path):
    mark = tmp_path / "committed.json"
    pages.KlinePages({"path": str(tmp_path), "mark": str(mark)}).streamReader(None).commit({"A": 5})
    assert json.loads(mark.read_text()) == {"A": 5}


# -- ledger


def test_batches_are_in_once_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(r, "k int, v int, z string")
    assert ledger.insert_batch(rows((1, 2, "b"), (1, 1, "a"), (2, 5, "c")), "s-0", path, ["k"], ["v"])
    assert not ledger.insert_batch(rows((9, 9, "never")), "s-0", path, ["k"], ["v"])
    # A write that broke off before its entry: its rows are not read, and the next attempt takes their place.
    rows((3, 1, "half"), (4, 1, "half")).write.parquet(f"{path}/batch=s-1")
    assert {r.k for r in ledger.read(spark, path).collect()} == {1, 2}
    assert ledger.insert_batch(rows((2, 0, "late"), (3, 7, "whole")), "s-1", path, ["k"], ["v"], within="k")
    assert {tuple(r) for r in ledger.read(spark, path).collect()} == {(1, 1, "a"), (2, 5, "c"), (3, 7, "whole")}
    assert ledger.insert_batch(rows().limit(0), "s-2", path, ["k"], ["v"], within="k") and ledger.marks(ledger.read(spark, path), "z", "k") == {"a": 1, "c": 2, "whole": 3}


def test_a_stream_that_dies_after_its_write(spark, tmp_path, monkeypatch):
    source, path, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    spark.range(20).write.parquet(source)
    stream = lambda: ledger.insert_stream(spark.readStream.schema("id long").parquet(source), "s", path, ["id"], ["id"], mark)
    whole = ledger.insert_batch

    def dies(*a):
        whole(*a)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(ledger, "insert_batch", dies)
    with pytest.raises(Exception, match="lost after the write"):
        stream().awaitTermination()
    monkeypatch.setattr(ledger, "insert_batch", whole)
    before = files_of(path)
    stream().awaitTermination()  # Spark replays the batch
    assert files_of(path) == before and ledger.read(spark, path).count() == 20


# -- leases


def test_leases(spark, tmp_path):
    source, path, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def feed(*events):
        rows = spark.createDataFrame([(run, t, kind) for run, t, kind in events], "run_id long, s long, kind string").select("run_id", F.timestamp_seconds("s").alias("t"), "kind")
        rows.write.mode("append").parquet(source)
        beats = spark.readStream.schema(rows.schema).parquet(source)
        leases.start(leases.lease_changes(beats, 60_000, "0 seconds"), path, mark).awaitTermination()
        return sorted((r.run_id, r.at // 1000, r.status, r.reason) for r in spark.read.schema(leases.CHANGES).parquet(path).collect())

    first = feed((1, 100, "beat"), (2, 100, "beat"), (1, 150, "beat"), (3, 100, "result"), (4, 140, "beat"), (4, 145, "cancel"), (5, 100, "beat"), (5, 170, "beat"))
    # Time is 170: runs 2 and 3 lapsed at 160 by their timers, 5 within the batch; 1 is held until 210.
    want = [(1, 100, "running", "claimed"), (2, 100, "running", "claimed"), (2, 160, "pending", "lease ended"), (3, 100, "running", "claimed"), (3, 160, "completed", "lease ended"),
            (4, 140, "running", "claimed"), (4, 145, "cancelled", "cancel"), (5, 100, "running", "claimed"), (5, 160, "pending", "lease ended"), (5, 170, "running", "claimed")]
    assert first == want
    second = feed((1, 205, "beat"), (2, 300, "beat"), (3, 300, "beat"), (4, 300, "beat"), (5, 180, "finish"))
    # Run 1 was prolonged to 265 and has lapsed since; 2 is claimed anew; 3 and 4 have ended for good.
    assert set(second) - set(want) == {(1, 265, "pending", "lease ended"), (2, 300, "running", "claimed"), (5, 180, "completed", "finish")}
    assert len(second) == len(want) + 3
    last = {r.run_id: (r.status, r.lapses) for r in leases.last_status(spark.read.schema(leases.CHANGES).parquet(path)).collect()}
    assert last == {1: ("pending", 1), 2: ("running", 1), 3: ("completed", 1), 4: ("cancelled", 0), 5: ("completed", 1)}


# -- progress, cancelling


def test_progress_is_heard_batch_by_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(source)
    heard = []
    stream = progress.counted(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source), "seen", n=F.count("*"), top=F.max("id"))
    with progress.reported(spark, lambda *x: heard.append(x)) as listener:
        stream.writeStream.queryName("p").format("noop").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start().awaitTermination()
    assert [(name, batch, m["rows"], m["seen"]["n"], m["seen"]["top"]) for name, batch, m in heard] == [("p", k, 10, 10, 10 * k + 9) for k in range(3)]
    assert len(listener.ended) == 1


def test_cancelling_stops_the_job_and_no_other(spark):
    tracker = spark.sparkContext.statusTracker()
    endless = lambda: spark.range(10**13).where("hash(id) = 1 and hash(id + 1) = 2").count()
    began = time.time()
    runs = {"long": endless, "short": lambda: spark.range(1000).count(), "broken": lambda: spark.range(3).selectExpr("raise_error('no')").collect()}
    done = control.run_all(spark, runs, lambda: ["long", "unknown"] if time.time() - began > 3 else [], poll=0.2)
    assert time.time() - began < 60
    assert done["long"] == ("cancelled", None) and done["short"] == ("completed", 1000) and done["broken"][0] == "failed"
    for _ in range(100):
        if not tracker.getActiveJobsIds():
            break
        time.sleep(0.1)
    assert not tracker.getActiveJobsIds()


# -- deletes


def test_deletes_touch_one_symbol(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(s, t) for s in ("A", "B/1", "C") for t in range(10)], "symbol string, ts long")
    sinks.by_symbol(rows, path)
    before = files_of(path)
    assert sinks.delete_symbol(spark, path, "B/1") and not sinks.delete_symbol(spark, path, "B/1")
    assert files_of(path) == {f: t for f, t in before.items() if "symbol=B" not in f}
    sinks.delete_between(spark, path, "A", 3, 7)
    assert sorted(r.ts for r in spark.read.parquet(path).where("symbol = 'A'").collect()) == [0, 1, 2, 8, 9]
    assert {f: t for f, t in files_of(path).items() if "symbol=C" in f} == {f: t for f, t in before.items() if "symbol=C" in f}
    sinks.delete_between(spark, path, "A", 0, 99)
    assert {r.symbol for r in spark.read.parquet(path).collect()} == {"C"}


# -- payloads


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_payloads_are_read_by_field(spark, tmp_path):
    path = str(tmp_path / "rows")
    texts = ['{"a": {"b": [1, 2.5]}, "k": 7}', '{"a": {"b": [', None, "", '{"k": "x"}', '{"k": 1, "k": 2}', "3", '{"k": 9, "new": true}']
    payloads.save(spark.createDataFrame(list(enumerate(texts)), "id int, body string"), path, "body")
    rows = spark.read.parquet(path)
    got = {r.id: tuple(r)[1:] for r in rows.select("id", payloads.field("body", "$.k", "int"), payloads.field("body", "$.a.b[1]", "double"), F.col("body").isNull()).collect()}
    bad = (None, None, True)
    assert got == {0: (7, 2.5, False), 1: bad, 2: bad, 3: bad, 4: (None, None, False), 5: bad, 6: (None, None, False), 7: (9, None, False)}
    listed = payloads.listing(spark, path)
    assert listed.columns == ["id"] and "ReadSchema: struct<id:int>" in plan(listed)
    one = payloads.lookup(spark, path, "id", 7, k=("body", "$.k", "int"))
    assert one.collect() == [(7, 9)] and "ReadSchema: struct<id:int,body:struct<0:int>>" in plan(one) and "EqualTo(id,7)" in plan(one)
