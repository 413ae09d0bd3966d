"""Cooldown by pointer doubling and the parallel greedy choice, against the sequential rules."""

import random

import pytest
from pyspark.sql import functions as F

from sextant.operators import spacing
from sextant.plans import long_queries

SF = "/root/testdata/sf0.001"


def kept_times(times, gap):
    last, found = None, set()
    for t in sorted(set(times)):
        if last is None or t - last >= gap:
            last = t
            found.add(t)
    return found


def nearest(rows, gap, most):
    best = {}
    for t, d in rows:
        best[t] = min(d, best.get(t, d))
    found = []
    for t, _ in sorted(best.items(), key=lambda x: (x[1], x[0])):
        if (most is None or len(found) < most) and all(abs(t - y) >= gap for y in found):
            found.append(t)
    return set(found)


@pytest.mark.parametrize(("rows", "parts", "gap"), [(10, 3, 40), (100_000, 2, 300), (1, 4, 25)])
def test_cooldown_in_blocks(spark, rows, parts, gap):
    draw = random.Random(gap)
    events = [(draw.choice(["a", "a", "a", None, "b"]), None if draw.random() < 0.02 else draw.randrange(2500), i) for i in range(900)]
    df = spark.createDataFrame(events, "k string, s long, i long").withColumn("ts", F.timestamp_micros("s"))
    got = {r.i for r in spacing.cooldown_times(df, gap, "ts", ["k"], rows, parts).collect()}
    want = {k: kept_times([s for key, s, _ in events if key == k and s is not None], gap) for k in ("a", "b", None)}
    assert got == {i for k, s, i in events if s in want[k]}


def test_cooldown_of_nothing_and_without_gap(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "s long").withColumn("ts", F.timestamp_micros("s"))
    assert spacing.cooldown_times(df.limit(0), 5).count() == 0
    assert spacing.cooldown_times(df, 0).count() == 2 and spacing.cooldown_times(df, 1).count() == 2


def test_cooldown_of_many_events_takes_few_rounds(spark, monkeypatch):
    n, gap, names = 200_000, 1_000, []
    write = spacing.written
    monkeypatch.setattr(spacing, "written", lambda df, name: (names.append(name), write(df, name))[1])
    times = spark.range(n).select(F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(20_000_000))).alias("ts"))
    got = {r.t for r in spacing.cooldown_times(times, gap, rows=2_000).select(F.unix_micros("ts").alias("t")).collect()}
    assert got == kept_times([r.t for r in times.select(F.unix_micros("ts").alias("t")).collect()], gap)
    assert names.count("jumps") <= 9  # a hundred blocks


@pytest.mark.parametrize(("span", "most", "gap"), [(1, None, 30), (2, 15, 30), (None, 50, 7)])
def test_greedy_on_ties(spark, span, most, gap):
    draw = random.Random(gap)
    rows = [(draw.randrange(3000), draw.randrange(12) / 2) for _ in range(700)]
    df = spark.createDataFrame([*rows, (None, 1.0), (5, None), (6, float("nan"))], "s long, distance double").withColumn("ts", F.timestamp_micros("s"))
    got = {r.s for r in spacing.nearest_apart_times(df, gap, most, span=span).collect()}
    assert got == nearest(rows, gap, most)


def test_greedy_of_a_monotone_series_and_of_nothing(spark):
    rows = [(i, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "s long, distance double").withColumn("ts", F.timestamp_micros("s"))
    assert {r.s for r in spacing.nearest_apart_times(df, 10, None, span=8).collect()} == set(range(0, 400, 10))
    assert spacing.nearest_apart_times(df.limit(0), 10, 5).count() == 0


@pytest.mark.parametrize(("most", "reach", "least"), [(None, 6_000, 0), (4, 6_000, 0), (15, 1_000_000, 0), (None, 60_000, 0), (40, 60_000, 11)])
def test_greedy_thins_many_rows_before_it_holds_them(spark, monkeypatch, most, reach, least):
    n, gap, held = 20_000, 100, []
    write = spacing.written
    monkeypatch.setattr(spacing, "written", lambda df, name: (made := write(df, name), held.append(made.count()) if name == "nearest" else None)[0])
    draw = random.Random(reach)
    rows = [(draw.randrange(-reach, reach), float(draw.randrange(least, 400))) for _ in range(n)]
    df = spark.createDataFrame(rows, "s long, distance double").withColumn("ts", F.timestamp_micros("s"))
    assert {r.s for r in spacing.nearest_apart_times(df, gap, most, rows=2_000).collect()} == nearest(rows, gap, most)
    assert held and held[0] < n // 8


def test_greedy_of_a_steep_series_that_cannot_be_thinned(spark):
    rows = [(i // 2, float(i // 3)) for i in range(1200)]
    df = spark.createDataFrame(rows, "s long, distance double").withColumn("ts", F.timestamp_micros("s"))
    for most in (None, 7):
        assert {r.s for r in spacing.nearest_apart_times(df, 150, most, rows=100).collect()} == nearest(rows, 150, most)


def test_queries_do_not_depend_on_block_size(spark):
    for run, small in ((long_queries.sel01_cooldown_times, {"rows": 20, "parts": 5}), (long_queries.sel01_cooldown_times_one_series, {"rows": 33, "parts": 3}), (long_queries.sel02_nearest_times, {"span": 1})):
        assert sorted(map(repr, run(spark, SF).collect())) == sorted(map(repr, run(spark, SF, **small).collect()))
