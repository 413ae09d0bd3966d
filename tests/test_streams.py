"""Streams give what the batch forms and the sequential rules give."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sextant.plans import feed_queries
from sextant.sources.snapshots import manifest, read_snapshot
from sextant.streaming.alerts import alerts, alerts_sink
from sextant.streaming.changes import changes, changes_sink, newest_sink, upsert_sink

SCHEMA = "event_type string, event_id long, t string, v double"


def readings(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("event_type", F.to_timestamp("t").alias("ts"), "event_id", "v")


def streamed(spark, tmp_path, source, batches, sink):
    """Run ``source`` through a sink, a file and so a batch for each range of ids."""
    for low, high in batches:
        source.where(f"event_id BETWEEN {low} AND {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.writeStream.foreachBatch(sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()


def sequential(rows, low=25, high=75, move=5):
    """The alert rules, one reading after the other: ``(event_id, kind, action, notify)``."""
    open_now, told, found = {}, {}, []
    for series, number, when, v in rows:
        if v is None or not math.isfinite(v):
            continue
        kind = "low" if v <= low else "high" if v >= high else None
        if kind is None:
            found += [(number, k, "close", False) for k in ("low", "high") if open_now.pop((series, k), False)]
            continue
        day, value = told.get((series, kind), (None, 0.0))
        notify = when[:10] != day or abs(v - value) >= move
        was_open = open_now.get((series, kind), False)
        if notify:
            told[series, kind] = (when[:10], v)
        if notify or not was_open:
            found.append((number, kind, "update" if was_open else "open", notify))
        open_now[series, kind] = True
    return sorted(found)


def drawn(n, seed):
    draw = random.Random(seed)
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(n):
        start += dt.timedelta(minutes=draw.choice([10, 200, 900, 4000]))
        rows.append((draw.choice(["a", "a", None, "b"]), i, start.strftime("%Y-%m-%d %H:%M:%S"), draw.choice([draw.uniform(0, 100), 20.0, 24.0, 80.0, 50.0, None, float("nan")])))
    return rows


GIVEN = [
    (1, "2024-01-01 09:00:00", 50.0), (2, "2024-01-01 10:00:00", 25.0), (3, "2024-01-01 11:00:00", 21.0), (4, "2024-01-01 12:00:00", 20.0), (5, "2024-01-01 13:00:00", None),
    (6, "2024-01-02 09:00:00", 20.0), (7, "2024-01-02 10:00:00", 80.0), (8, "2024-01-02 11:00:00", 26.0), (9, "2024-01-02 12:00:00", 24.0), (10, "2024-01-02 13:00:00", 25.0), (11, "2024-01-02 14:00:00", float("nan")),
]


def test_alerts_across_batches(spark, tmp_path):
    rows = [("a", *r) for r in GIVEN] + [("b", 12, "2024-01-01 09:00:00", 75.0)]
    streamed(spark, tmp_path, readings(spark, rows), ((1, 3), (4, 7), (8, 12)), alerts_sink)
    got = sorted((r.event_id, r.kind, r.action, r.notify) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect())
    assert got == sequential(rows) == [
        (2, "low", "open", True), (4, "low", "update", True), (6, "low", "update", True), (7, "high", "open", True),
        (8, "high", "close", False), (8, "low", "close", False), (9, "low", "open", False), (10, "low", "update", True), (12, "high", "open", True),
    ]


@pytest.mark.parametrize("cuts", [[0, 300], [0, 50, 51, 120, 300]])
def test_alerts_of_drawn_readings(spark, tmp_path, cuts):
    rows, state, got = drawn(300, len(cuts)), None, []
    for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        said, after = alerts(readings(spark, rows[low:high]), state)
        got += [(r.event_id, r.kind, r.action, r.notify) for r in said.collect()]
        after.write.parquet(f"{tmp_path}/{i}")
        state = spark.read.parquet(f"{tmp_path}/{i}")
    assert sorted(got) == sequential(rows)


def test_alerts_of_nothing(spark):
    said, state = alerts(readings(spark, []))
    assert said.count() == 0 and state.count() == 0
    said, state = alerts(readings(spark, [("a", 1, "2024-01-01 00:00:00", None)]))
    assert said.count() == 0 and state.count() == 0


def test_changes_across_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.floor(F.col("value") / 20).cast("double").alias("v"))
    streamed(spark, tmp_path, source, [(400 * i, 400 * i + 399) for i in range(3)], changes_sink)
    want = changes(source, ["event_type"], ["ts", "event_id"])
    got = spark.read.parquet(str(tmp_path / "out/rows"))
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


@pytest.mark.parametrize("sink", [changes_sink, alerts_sink])
def test_ten_batches_leave_two_states(spark, tmp_path, sink):
    streamed(spark, tmp_path, readings(spark, drawn(60, 3)), [(6 * i, 6 * i + 5) for i in range(10)], sink)
    assert sorted(x.name for x in (tmp_path / "out/state").iterdir()) == ["8", "9"] and len(list((tmp_path / "out/rows").glob("batch=*"))) == 10


def test_newest_takes_rows_however_late_and_rewrites_their_days_only(spark, tmp_path):
    write = newest_sink(str(tmp_path))
    day = lambda d, h: f"2024-{d // 28 + 1:02d}-{d % 28 + 1:02d} {h:02d}:00:00"
    write(readings(spark, [("a", d, day(d, 12), float(d)) for d in range(200)]), 0)
    files = lambda: {name: x["folder"] for name, x in manifest(spark, str(tmp_path / "rows"))["parts"].items()}
    before = files()
    assert len(before) == 200
    write(readings(spark, [("a", 500, day(0, 18), 9.0), ("a", 501, day(1, 6), 9.0)]), 1)
    after = files()
    assert {x for x in after if after[x] != before[x]} == {"2024-01-01"}
    found = {r.day.isoformat(): r.v for r in read_snapshot(spark, str(tmp_path / "rows")).collect()}
    assert found["2024-01-01"] == 9.0 and found["2024-01-02"] == 1.0 and len(found) == 200


def test_upsert_sink_takes_late_and_repeated_batches(spark, tmp_path):
    write = upsert_sink(str(tmp_path / "t"), ["k"], ["t"])
    rows = lambda *x: spark.createDataFrame(list(x), "k int, t int, v string")
    write(rows((1, 5, "a"), (1, 4, "b"), (2, 1, "c")), 0)
    write(rows((1, 3, "late"), (2, 2, "d")), 1)
    write(rows((1, 3, "late"), (2, 2, "d")), 1)
    write(rows(), 2)
    assert {r.k: r.v for r in read_snapshot(spark, str(tmp_path / "t")).collect()} == {1: "a", 2: "d"}


def test_sinks_leave_no_staged_tables(spark, tmp_path, monkeypatch):
    from sextant import session

    root = tmp_path / "shared"
    monkeypatch.setattr(session, "shared_root", lambda spark: f"file://{root}")
    rows = lambda i: spark.createDataFrame([(j, i, "x") for j in range(i, i + 5)], "k int, t int, v string")
    for i in range(10):
        upsert_sink(str(tmp_path / "t"), ["k"], ["t"])(rows(i), i)
        alerts_sink(str(tmp_path / "a"))(readings(spark, drawn(20, i)), i)
    assert not list(root.iterdir())


@pytest.mark.parametrize("query", [feed_queries.str02_changes_stream, feed_queries.str03_newest_stream, feed_queries.str07_alerts_stream])
def test_stream_queries_write_to_the_shared_folder(spark, tmp_path, monkeypatch, query):
    monkeypatch.setattr(feed_queries, "shared_root", lambda spark: f"file://{tmp_path}")
    files = query(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all(str(tmp_path) in x for x in files) and list(tmp_path.glob("stream-*/checkpoint/commits"))
