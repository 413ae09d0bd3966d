"""Blocks, halos and scans give what plain windows give, however small the blocks."""

import re

import pytest
from pyspark.sql import functions as F

from sextant.operators import ranges
from sextant.operators.windows import Series, market_context, next_session_outcomes, price_features, sentiment_features
from sextant.plans import long_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ticks(spark):
    drawn = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)) / 10 + 200
    rows = spark.range(1500).select(F.pmod(F.xxhash64("id"), F.lit(400)).alias("t"), "id", F.when(F.col("id") % 17 != 0, drawn).alias("close"), F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("k"))
    return rows.withColumns({"open": F.col("close") + 1, "high": F.col("close") + 2, "low": F.col("close") - 2})


def everything(df, series):
    df = next_session_outcomes(market_context(price_features(df, series), series), series)
    return sentiment_features(df, series, "close").withColumns({"position": series.position(), "changed": series.changed(F.col("close"))})


@pytest.mark.parametrize(("keys", "rows", "parts"), [((), 40, 2), (("k",), 300, 50), ((), 700, 7)])
def test_blocks_equal_plain_windows(ticks, keys, rows, parts):
    series = Series(("t", "id"), keys)
    want = sorted(map(repr, everything(ticks, series).collect()))
    df = ranges.over_blocks(ticks, series, everything, back=252, ahead=60, records=["close"], rows=rows, parts=parts)
    assert sorted(map(repr, df.collect())) == want
    assert df.columns == everything(ticks, series).columns


def test_empty_and_one_row(ticks):
    series = Series(("t", "id"))
    assert ranges.over_blocks(ticks.limit(0), series, everything, 252, 60, ["close"]).count() == 0
    one = ranges.over_blocks(ticks.where("id = 1"), series, everything, 252, 60, ["close"]).collect()
    assert len(one) == 1 and one[0].position == 1 and one[0].off_record == 0 and one[0].fwd_1 is None


def test_positions_go_on_over_partitions(ticks):
    placed = ranges.positioned(ranges.in_order(ticks, ["k", "t", "id"], 9), ["k"]).collect()
    assert len(placed) == 1500
    for k in {r.k for r in placed}:
        mine = sorted((r for r in placed if r.k == k), key=lambda r: r._pos)
        assert [r._pos for r in mine] == list(range(len(mine))) and {r._size for r in mine} == {len(mine)}
        assert [(r.t, r.id) for r in mine] == sorted((r.t, r.id) for r in mine)


def test_no_task_gets_the_whole_series(spark):
    plan = long_queries.win20_position_gap_change_long(spark, SF)._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[[^\n]*", plan)
    assert windows and all("_block" in w for w in windows)


@pytest.mark.parametrize("name", ["win05_price_features_long_by_type", "win08_market_context_long", "agg13_gaps_long"])
def test_queries_do_not_depend_on_block_size(spark, name):
    run = getattr(long_queries, name)
    assert sorted(map(repr, run(spark, SF).collect())) == sorted(map(repr, run(spark, SF, rows=70, parts=5).collect()))
