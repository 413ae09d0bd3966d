"""The literal cases that the reference's own tests state, and boundary cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sextant.functions import decisions
from sextant.functions import scalars as f
from sextant.operators import selection as sel
from sextant.operators import large_stats, stats
from sextant.operators.asof import asof_days, asof_times, assert_matched, with_lag
from sextant.operators.upsert import merge, newest, same_rows
from sextant.operators.windows import Series, future_stat, next_session_outcomes, price_features, sentiment_features
from sextant.plans import event_queries, standins
from sextant.schema import DataValidationError, pick_date, pick_numeric, require, resolve, slug
from sextant.sources import delimited, feeds, sinks
from sextant.sources.snapshots import read_snapshot, write_snapshot

D = dt.date
SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_combined_table_splits(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "score_date_utc,score_value,price_date,price_open,price_high,price_low,price_close\n2024-01-06,20,2024-01-05,4700,4720,4680,4710\n2024-01-08,25,2024-01-08,4725,4750,4710,4740\n"
    )
    daily, market = delimited.parse_combined(delimited.read_text(spark, str(tmp_path / "c.csv")))
    assert [r.value for r in daily.orderBy("day").collect()] == [20, 25]
    assert market.columns == ["date", "open", "high", "low", "close"]
    assert market.where("date = '2024-01-05'").first().low == 4680


def sessions(spark):
    rows = [(D(2024, 1, 5), 4700.0, 4720.0, 4680.0, 4710.0)] + [(D(2024, 1, 8 + i), 4725.0 + i, 4750.0 + i, 4710.0 + i, 4740.0 + i) for i in range(5)]
    return frame(spark, rows, "d date, open double, high double, low double, close double")


def test_weekend_signal_enters_at_the_next_session(spark):
    scores = frame(spark, [(D(2024, 1, 6), 20.0), (D(2024, 1, 8), 25.0)], "day date, v double")
    market = next_session_outcomes(sessions(spark), Series(("d",)))
    got = asof_days(scores, market, how="inner").where("entry_date IS NOT NULL").orderBy("day").first()
    assert (got.d, got.entry_date, got.entry_price) == (D(2024, 1, 5), D(2024, 1, 8), 4725.0)
    assert got.max_drawdown_20 == pytest.approx(4710 / 4725 - 1)  # partial windows count


def test_weekend_observation_matches_the_session_before(spark):
    scores = frame(spark, [(D(2026, 7, 11), 20.0)], "day date, v double")
    prices = frame(spark, [(D(2026, 7, 9), 1.0), (D(2026, 7, 10), 2.0)], "d date, close double")
    got = with_lag(asof_days(scores, prices), "day", "d").first()
    assert (got.d, got.lag_days, got.same_day) == (D(2026, 7, 10), 1, False)


def test_unmatched_days_raise_and_later_days_match(spark):
    scores = frame(spark, [(D(2024, 1, 1), 1.0), (D(2024, 3, 1), 2.0), (None, 3.0)], "day date, v double")
    joined = asof_days(scores, sessions(spark))
    assert {r.day: r.d for r in joined.collect()} == {D(2024, 1, 1): None, D(2024, 3, 1): D(2024, 1, 12), None: None}
    with pytest.raises(DataValidationError, match="2024-01-01"):
        assert_matched(joined.where("day IS NOT NULL"), "d", "day")


def test_time_asof_never_looks_ahead(spark):
    left = frame(spark, [(1, 10), (1, 20), (2, 5), (None, 7)], "k int, t int")
    right = frame(spark, [(1, 10, "a"), (1, 15, "b"), (2, 6, "c"), (None, 1, "n")], "k int, rt int, x string")
    got = {(r.k, r.t): r.x for r in asof_times(left, right, "t", "rt", ["k"]).collect()}
    assert got == {(1, 10): "a", (1, 20): "b", (2, 5): None, (None, 7): "n"}


def test_price_history_of_420_days(spark):
    days = []
    d = D(2024, 1, 2)
    while len(days) < 420:
        if d.weekday() < 5:
            days.append(d)
        d += dt.timedelta(days=1)
    rows = [(x, 4500.0 + i, 4512.0 + i, 4492.0 + i, 4505.0 + i) for i, x in enumerate(days)]
    got = price_features(frame(spark, rows, "d date, open double, high double, low double, close double"), Series(("d",))).orderBy("d").collect()
    assert got[251].high_252 == 4756 and got[250].high_252 is None
    assert got[0].previous_close is None and got[1].gap_pct == pytest.approx((4501 / 4505 - 1) * 100)
    assert got[419].forward_1 is None and got[414].forward_5 is not None and got[415].drawdown_next_5 is None
    scores = sentiment_features(frame(spark, [(D(2025, 7, 1), 24.0), (D(2025, 7, 2), 29.0), (D(2025, 7, 3), 35.0)], "day date, v double"), Series(("day",))).orderBy("day").collect()
    assert scores[1].change_1 == 5.0 and scores[2].sma_5 is None


def test_forward_values_do_not_depend_on_rows_beyond_the_frame(spark):
    rows = [(D(2024, 1, 1) + dt.timedelta(days=i), float(i % 7)) for i in range(40)]
    make = lambda n: frame(spark, rows[:n], "d date, x double").withColumn("m", future_stat(Series(("d",)), F.col("x"), 5, "min")).orderBy("d").collect()
    assert [r.m for r in make(40)][:25] == [r.m for r in make(30)][:25]
    with pytest.raises(ValueError):
        future_stat(Series(), F.lit(1), 2, "sum")


def test_current_records():
    got = feeds.parse_record('{"current": {"score": 39.4285714285714, "rating": "fear", "timestamp": "2026-07-24T23:59:54+00:00"}}')
    assert (got["day"], got["rating"], got["value"]) == (D(2026, 7, 24), "fear", 39.4285714285714)
    got = feeds.parse_record('{"current": {"score": "51.6", "rating": "neutral", "timestamp": "2026-07-25T20:00:00Z"}}')
    assert got["value"] == 51.6 and got["source_time"].utcoffset() == dt.timedelta(0)
    for bad in ("{}", "[]", "x", '{"a": {"score": "q"}}'):
        with pytest.raises(ValueError, match="unexpected data format"):
            feeds.parse_record(bad)


def test_record_keeps_its_own_date(spark):
    text = '{"now": {"score": "51.6", "rating": "", "timestamp": "2026-07-25T23:30:00-05:00"}}'
    df = frame(spark, [(text,), ("{}",), (None,), ('{"now": {"score": "x"}}',)], "t string").select(feeds.record(F.col("t"), "now").alias("r"))
    got = [x.r for x in df.collect()]
    assert got[0].day == D(2026, 7, 25) and got[0].rating == "neutral" and got[0].source_time == dt.datetime(2026, 7, 26, 4, 30)
    assert got[1:] == [None, None, None]


def test_feed_keeps_the_newest_and_skips_bad_items(spark):
    payload = '{"now":{"score":30,"rating":"Fear","timestamp":"2024-01-03T10:00:00Z"},"past":{"data":[{"x":1704240000000,"y":10,"rating":"a"},5,"q",{"x":1704153600000,"y":200},{"x":1704153600000,"y":20,"rating":"b_c"},null]}}'
    got = {r.day: (r.value, r.rating) for r in feeds.parse_feed(frame(spark, [(payload,), (None,), ("{",)], "payload string"), "now", "past", D(2024, 1, 2)).collect()}
    assert got == {D(2024, 1, 2): (20.0, "b c"), D(2024, 1, 3): (30.0, "fear")}


def test_fetch_planner():
    """The cache must reach the last weekday of today and of the last score, and back to the first score's context."""
    d = D
    assert feeds.fetch_window(None, None, d(2025, 7, 31)) is None
    assert feeds.fetch_window((d(2025, 7, 3), d(2025, 7, 3)), (d(2024, 1, 2), d(2025, 8, 11)), d(2025, 7, 31)) is None
    assert feeds.fetch_window((d(2025, 7, 3), d(2025, 7, 3)), None, d(2025, 7, 31)) == (d(2024, 4, 9), d(2025, 8, 2))
    assert feeds.fetch_window((d(2025, 7, 3), d(2025, 7, 30)), (d(2024, 1, 2), d(2025, 7, 10)), d(2025, 7, 31)) == (d(2025, 6, 30), d(2025, 8, 2))
    assert feeds.fetch_window((d(2025, 7, 5), d(2025, 7, 6)), (d(2024, 1, 2), d(2025, 7, 4)), d(2025, 7, 6)) is None
    assert feeds.fetch_window((d(2025, 7, 5), d(2025, 7, 6)), (d(2024, 4, 12), d(2025, 7, 4)), d(2025, 7, 6)) == (d(2024, 4, 11), d(2025, 7, 8))
    assert feeds.fetch_window((d(2025, 7, 5), d(2025, 7, 6)), (d(2024, 1, 2), d(2025, 7, 4)), d(2025, 7, 6), force=True) == (d(2025, 6, 24), d(2025, 7, 8))


def test_sources_fall_back(spark):
    empty, full = spark.createDataFrame([], "a int"), frame(spark, [(1,)], "a int")

    def broken():
        raise RuntimeError("no file")

    assert feeds.first_source([("x", broken), ("y", lambda: empty), ("z", lambda: full)])[1] == "z"
    with pytest.raises(DataValidationError, match="no file"):
        feeds.first_source([("x", broken), ("y", lambda: empty)])


def test_strict_daily_file(spark, tmp_path):
    path = tmp_path / "d.csv"
    assert delimited.load_daily(spark, str(path)).count() == 0
    head = "Date,Value,Rating,Source Timestamp UTC\n"
    path.write_text(head + "2026-07-31,,fear,2026-07-31T20:00:00Z\nbad day,,x,\n")
    assert delimited.load_daily(spark, str(path)).count() == 0
    path.write_text(head + "2026-07-30,20,Extreme_Fear,2026-07-30T20:00:00Z\n2026-07-30,21,,2026-07-30T21:00:00Z\n")
    assert delimited.load_daily(spark, str(path)).first()[1:3] == (21.0, "extreme fear")
    path.write_text(head + "2026-07-30,101,fear,2026-07-30T20:00:00Z\n")
    with pytest.raises(Exception, match="bad row"):
        delimited.load_daily(spark, str(path)).collect()
    path.write_text("Day,Value\n2026-07-30,1\n")
    with pytest.raises(DataValidationError, match="header"):
        delimited.load_daily(spark, str(path))


def test_separators_roles_and_intraday(spark, tmp_path):
    path = tmp_path / "i.tsv"
    path.write_text("Date\tTime\tValue\tSite Updated\n7/29/2026\t21:04:20\t32\t15 minutes ago\n9/11/2025\t13:42:01\t53\t\n\t\t\t\n7/29/2026\t21:04:20\t132\tx\n")
    raw = delimited.read_text(spark, str(path))
    assert delimited.sniff(spark, str(path)) == "\t" and raw.columns == ["date", "time", "value", "site_updated"]
    got = delimited.standard_intraday(raw).orderBy("ts").collect()
    assert [(r.ts, r.value) for r in got] == [(dt.datetime(2025, 9, 11, 13, 42, 1), 53.0), (dt.datetime(2026, 7, 29, 21, 4, 20), 32.0)]
    assert delimited.standard_intraday(raw.drop("time")).first().ts.time() == dt.time(16)
    again = delimited.standard_intraday(raw)
    assert delimited.merge_intraday(again, again).count() == 2
    assert pick_date(raw) == "date" and pick_numeric(raw, [], ["nothing"], skip=["date"]) is None
    assert pick_numeric(raw.drop("time", "date").limit(2), [], [], skip=[]) == "value"
    assert resolve(["a", "b"], {"x": ("q", "b"), "y": ("z",)}) == {"x": "b"}
    assert slug("  Site  Updated (UTC)! ") == "site_updated_utc"
    with pytest.raises(DataValidationError, match="missing columns: q"):
        require(raw, ["date", "q"])


def test_prices_without_open_use_the_close(spark):
    raw = frame(spark, [("2024-01-05", "10", "9"), ("2024-01-05", "11", "8"), ("x", "12", "7")], "date string, close string, low string")
    assert [tuple(r) for r in delimited.parse_prices(raw).collect()] == [(D(2024, 1, 5), 11.0, 11.0, 8.0, 11.0)]


def test_ratings_alerts_regimes_at_their_bounds(spark):
    df = frame(spark, [(x,) for x in (24.0, 24.5, 25.0, 44.0, 55.0, 75.0, 76.0, None)], "v double")
    got = df.select(f.rating(F.col("v")).alias("r"), f.alert_type(F.col("v")).alias("a")).collect()
    assert [r.r for r in got] == ["extreme fear", "fear", "fear", "fear", "neutral", "greed", "extreme greed", None]
    assert [r.a for r in got] == ["low", "low", "low", "normal", "normal", "high", "high", None]
    cases = [(-0.10, 0.1, "correction"), (-0.02, 0.0, "near_high_uptrend"), (-0.05, 0.0, "uptrend_off_high"), (-0.5, -0.01, "downtrend"), (None, 1.0, None), (0.0, None, None)]
    got = frame(spark, cases, "h double, l double, want string").select(f.regime(F.col("h"), F.col("l")).alias("r"), "want").collect()
    assert all(r.r == r.want for r in got)


def test_text_formats(spark):
    df = frame(spark, [(100.0,), (0.0,), (39.4285714285714,), (39.0,), (12.5,)], "v double")
    assert [r[0] for r in df.select(f.score_text(F.col("v"))).collect()] == ["100", "0", "39.428571", "39", "12.5"]
    assert [r[0] for r in df.select(f.short_text(F.col("v"))).collect()] == ["100", "0", "39.4286", "39", "12.5"]
    assert [r[0] for r in df.select(f.half_up(F.col("v"))).collect()] == [100, 0, 39, 39, 13]
    t = dt.datetime(2024, 1, 1)
    ages = [(t, t + dt.timedelta(seconds=s)) for s in (-5, 59, 60, 120, 3600, 7200, 86400, 200000)]
    got = [r[0] for r in frame(spark, ages, "a timestamp, b timestamp").select(f.age_text(F.col("a"), F.col("b"))).collect()]
    assert got == ["a minute ago", "a minute ago", "1 minute ago", "2 minutes ago", "1 hour ago", "2 hours ago", "1 day ago", "2 days ago"]
    odd = frame(spark, [(float("nan"),), (float("inf"),), (None,), (0.1234,)], "v double").select(f.percent_text(F.col("v")), f.number_text(F.col("v"))).collect()
    assert [tuple(r) for r in odd] == [("N/A", "N/A")] * 3 + [("12.3%", "0.1")]
    assert [r[0] for r in frame(spark, [("extreme_fear",), ("",), (None,)], "t string").select(f.title(F.col("t"))).collect()] == ["Extreme Fear", "Unknown", "Unknown"]


def test_cooldown_gaps(spark):
    days = [0, 9, 10, 19, 20, 21, 40]
    events = frame(spark, [(D(2024, 1, 1) + dt.timedelta(days=x),) for x in days] + [(D(2024, 1, 1),)], "day date")
    kept = sorted((r.day - D(2024, 1, 1)).days for r in sel.apply_cooldown(events, 10).collect())
    assert kept == [0, 0, 10, 20, 40]
    assert sel.apply_cooldown(events, 0).count() == 8
    assert sel.apply_cooldown(events.limit(0), 10).count() == 0


def test_nearest_is_greedy_by_distance(spark):
    rows = [(D(2024, 1, 1), 1.0), (D(2024, 1, 5), 0.5), (D(2024, 1, 20), 2.0), (D(2024, 3, 1), 9.0)]
    got = sel.nearest_apart(frame(spark, rows, "day date, analog_distance double"), sel.AnalogSettings())
    assert sorted(r.day for r in got.collect()) == [D(2024, 1, 5), D(2024, 1, 20)]


def test_analog_branches_follow_counts(spark):
    rows = [(D(2020, 1, 1) + dt.timedelta(days=11 * i), 20.0, 0.0, -0.01, 0.01, 0.02, 0.1, "up", 0.01) for i in range(25)]
    events = frame(spark, rows, "day date, v double, chg_5 double, off_high_252 double, ret_20 double, vs_sma_200 double, vol_20 double, regime string, fwd_5 double")
    now = lambda v, sma: frame(spark, [(v, 0.0, -0.01, 0.01, sma, 0.1, "up")], "v double, chg_5 double, off_high_252 double, ret_20 double, vs_sma_200 double, vol_20 double, regime string")
    assert sel.find_analogs(events, now(20.0, 0.02))[1] == "strict"
    assert sel.find_analogs(events, now(20.0, 0.5))[1] == "relaxed"
    found, how = sel.find_analogs(events, now(30.0, 0.5))
    assert how == "nearest" and found.columns[-1] == "analog_distance"
    blank = frame(spark, [(None,) * 7], "v double, chg_5 double, off_high_252 double, ret_20 double, vs_sma_200 double, vol_20 double, regime string")
    assert sel.find_analogs(events, blank)[0].count() == 0


def test_wilson_and_bootstrap(spark):
    got = frame(spark, [(0, 0), (0, 10), (8, 10), (10, 10)], "s long, n long").select(stats.wilson_floor(F.col("s"), F.col("n"))).collect()
    assert got[0][0] is None and got[1][0] == 0.0 and got[2][0] == pytest.approx(0.4901568, abs=1e-6) and got[3][0] == pytest.approx(0.7224598, abs=1e-4)
    a, b = frame(spark, [(1.0,), (1.0,), (None,)], "x double"), frame(spark, [(0.5,), (0.5,)], "x double")
    assert tuple(stats.bootstrap_excess(a, b, 20).first()) == (0.5, 0.5)
    assert tuple(stats.bootstrap_excess(a.limit(1), b, 20).first()) == (None, None)
    assert tuple(large_stats.resampled_excess(a, b, 20).first()) == (0.5, 0.5)
    assert tuple(large_stats.resampled_excess(a.limit(1), b, 20).first()) == (None, None)


def test_bootstrap_query_takes_all_iterations(spark):
    want, got = event_queries.agg09_bootstrap_interval(spark, SF).first(), event_queries.agg09_bootstrap_numpy(spark, SF).first()
    width = want.ci_high - want.ci_low
    assert abs(got.ci_low - want.ci_low) < 0.1 * width and abs(got.ci_high - want.ci_high) < 0.1 * width
    assert got == event_queries.agg09_bootstrap_numpy(spark, SF).first()


def test_verdict_is_over_the_strict_events_where_there_are_enough(spark):
    wide = feeds.Settings(level_band=60.0, change_band=90.0, high_band=0.5, return_band=0.5, average_band=0.5)
    assert wide.analogs() == event_queries.WIDE
    strict = sel.strict_analogs(standins.signals(spark, SF), standins.current(spark, SF), event_queries.WIDE)
    n, mean = strict.agg(F.count("fwd_5"), F.avg("fwd_5")).first()
    found = event_queries.verdict(spark, SF, wide).first()
    assert n >= event_queries.WIDE.least and (found.sample, found.mean5) == (n, pytest.approx(mean))


def test_event_study_keeps_empty_groups(spark):
    rows = [(D(2024, 1, 1) + dt.timedelta(days=7 * i), 18.0 + i, -6.0, None, None, 0.01 * i if i != 1 else None, 0.02, -0.01) for i in range(4)]
    got = stats.event_study(frame(spark, rows, "day date, v double, chg_1 double, chg_3 double, chg_5 double, fwd_5 double, fwd_20 double, max_drawdown_20 double")).orderBy("ord").collect()
    assert len(got) == 19 and got[0].n == 0 and got[0].mean5 is None
    assert got[1].n == 2 and got[1].worst5 == 0.0 and got[7].n == 2


def verdict_row(spark, **change):
    base = dict(sample=40, baseline=40, win5=0.7, mean5=0.01, median5=0.01, mean20=0.02, drawdown=-0.01, excess=0.005, ci_low=0.001, ci_high=0.01, extension="Normal") | change
    schema = "sample long, baseline long, win5 double, mean5 double, median5 double, mean20 double, drawdown double, excess double, ci_low double, ci_high double, extension string"
    return decisions.decide(frame(spark, [tuple(base.values())], schema))


def test_decision_cascade(spark):
    act = lambda **x: (lambda r: (r.action, r.confidence))(verdict_row(spark, **x).first())
    assert act() == ("BUY GRADUALLY", "Moderate")
    assert act(sample=20) == ("BUY GRADUALLY", "Low")
    assert act(sample=20, extension="High")[0] == "INSUFFICIENT EVIDENCE"
    assert act(baseline=29) == ("INSUFFICIENT EVIDENCE", "Very low")
    assert act(ci_low=0.0)[0] == "HOLD / NO EXTRA BUYING"
    assert act(win5=0.4, mean5=-0.1, median5=-0.1, mean20=-0.1, excess=-0.01, ci_low=-0.02, ci_high=-0.001)[0] == "WAIT ON BUYING"
    assert act(excess=None, ci_low=None, ci_high=None)[0] == "HOLD / NO EXTRA BUYING"
    checks = decisions.checks(verdict_row(spark)).orderBy("position").collect()
    assert len(checks) == 8 and all(c.passed for c in checks)


def test_upsert_is_idempotent_and_new_rows_win_ties(spark):
    t = dt.datetime(2024, 1, 1)
    old = frame(spark, [(1, t, "old"), (2, t, "old")], "k int, ts timestamp, x string")
    new = frame(spark, [(1, t, "new"), (2, t - dt.timedelta(1), "new"), (3, t, "new")], "k int, ts timestamp, x string")
    once = merge(old, new, ["k"], ["ts"])
    assert {r.k: r.x for r in once.collect()} == {1: "new", 2: "old", 3: "new"}
    assert same_rows(once, merge(once, new, ["k"], ["ts"]))
    assert newest(old.union(new), ["k"], ["ts", "x"]).count() == 3


def test_write_only_on_change(spark, tmp_path):
    df = frame(spark, [(1, "a"), (2, None)], "k int, x string")
    path = str(tmp_path / "t")
    assert write_snapshot(df, path) and not write_snapshot(df, path)
    assert write_snapshot(read_snapshot(spark, path).union(df.limit(1)), path) and read_snapshot(spark, path).count() == 3
    assert sinks.content_digest(df) == sinks.content_digest(df.orderBy(F.desc("k"))) != sinks.content_digest(df.limit(1))
    sinks.write_text(df, str(tmp_path / "x"), "\t", ["k"])
    assert spark.read.text(str(tmp_path / "x")).count() == 3


def test_settings_ignore_unknown_keys(tmp_path):
    path = tmp_path / "s.json"
    assert feeds.Settings.load(str(path)) == feeds.Settings()
    path.write_text('{"cooldown": 5, "nothing": 1, "levels": [10, 20]}')
    assert feeds.Settings.load(str(path)).levels == (10, 20)
    path.write_text('{"horizons": [1, 5]}')
    with pytest.raises(ValueError):
        feeds.Settings.load(str(path))


def test_last_row_of_a_file_counts_and_blanks_stay(spark, tmp_path):
    (tmp_path / "d.csv").write_text("date,score\n2024-01-05,30\n2024-01-06,1\n2024-01-05,20\n")
    rows = delimited.read_text(spark, str(tmp_path / "d.csv"), place="place")
    assert {r.day: r.value for r in delimited.parse_daily(rows, "place").collect()} == {D(2024, 1, 5): 20.0, D(2024, 1, 6): 1.0}
    (tmp_path / "p.csv").write_text("date,open,close\n2024-01-05,,12\n2024-01-08,1,5\n2024-01-08,,4\n2024-01-09,3,\n")
    rows = delimited.read_text(spark, str(tmp_path / "p.csv"), place="place")
    got = {r.date: (r.open, r.high, r.close) for r in delimited.parse_prices(rows, "place").collect()}
    assert got == {D(2024, 1, 5): (None, 12.0, 12.0), D(2024, 1, 8): (None, 4.0, 4.0)}


def test_short_text_is_as_python_formats(spark):
    values = [39.4285714285714, 51.6, 0.0, 1.0, 100.0, -2.5, 123456.0, 999999.5, 1e6, 1234567.0, 0.0001, 0.000012345678, -3.2e-7, 1e12, 2.5e100, 0.5, 99999.96]
    rows = frame(spark, [(v,) for v in values], "v double").select("v", f.short_text(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == {v: f"{v:g}" for v in values}


def test_ages_and_points_of_a_page(spark):
    text = "Stock\nMarket Crypto 52\n +3 points\nupdated a minute ago, 5 hours ago"
    row = frame(spark, [(text,)], "t string").select(f.relative_age(F.col("t")), f.value_before_points(F.col("t"), r"Market Crypto"), f.value_before_points(F.col("t"), "Bond")).first()
    assert tuple(row) == ("a minute ago", "52", "")
    for text, age, points in [("", "", ""), ("ago", "", ""), ("12 Hours\n ago.", "12 Hours ago", ""), ("an hour ago", "hour ago", ""), ("5 minutes, ago; 2 days ago!", "2 days ago", ""), ("x\nStock\n\n7\n\n-12points", "", "7"),
                              ("Stock 1234\n3 points", "", ""), ("Stock 12\nno\n3 points", "", ""), ("3 points", "", ""), ("stock12\r\n+3 points", "", "12")]:
        row = frame(spark, [(text,)], "t string").select(f.relative_age(F.col("t")), f.value_before_points(F.col("t"), "Stock")).first()
        assert tuple(row) == (age, points), text


def test_fetch_hook_maps_failures():
    from sextant.sources import fetch

    def failing(address, timeout):
        raise OSError("refused")

    assert fetch.fetch_object(lambda a, t: b'{"x": 1}', "a", required="x") == {"x": 1}
    for get, said in ((failing, "refused"), (lambda a, t: b"{", "JSON"), (lambda a, t: b"[1]", "object"), (lambda a, t: b"{}", "lacks x")):
        with pytest.raises(RuntimeError, match=said):
            fetch.fetch_object(get, "a", required="x")
    for bad in (lambda: fetch.fetch_object(failing, "a", 0), lambda: fetch.check_symbol(" "), lambda: fetch.check_alert(50, 50), lambda: fetch.check_window(369, 1), lambda: fetch.check_window(370, -1)):
        with pytest.raises(ValueError):
            bad()


def test_fetched_tables_land_and_histories_flatten(spark, tmp_path):
    from sextant.sources import fetch

    assert fetch.fetch_table(spark, None, "", str(tmp_path)) is None
    path = fetch.fetch_table(spark, lambda a, t: b"Date\tValue\n7/29/2026\t32\n", "somewhere", str(tmp_path))
    assert [r.value for r in delimited.load_intraday(spark, path).collect()] == [32.0] and delimited.load_intraday(spark, str(tmp_path / "no")).count() == 0
    raw = frame(spark, [(dt.datetime(2024, 1, 5), (1.0, 2.0)), (dt.datetime(2024, 1, 8), (None, None))], "ts timestamp, Close struct<A:double,B:double>")
    flat = delimited.flat_columns(raw)
    assert flat.columns == ["ts", "Close_A", "Close_B"] and delimited.flat_columns(raw, joined=False).columns == ["ts", "Close"]
    assert [tuple(r) for r in delimited.parse_download(flat).collect()] == [(D(2024, 1, 5), 1.0, 1.0, 1.0, 1.0)]
    with pytest.raises(RuntimeError, match="no rows"):
        fetch.fetch_history(lambda s, a, b: flat.limit(0), "X", D(2024, 1, 1), D(2024, 1, 2))


def test_options_reach_every_step(spark, tmp_path):
    """Names of option files, and that the decision follows the options it is given."""
    path = tmp_path / "s.json"
    path.write_text('{"cooldown_calendar_days": 0, "minimum_regime_sample": 1, "minimum_regime_baseline_sample": 100000, "bootstrap_iterations": 7, "analog_level_band": 60, "maximum_analogs": 3}')
    options = feeds.Settings.load(str(path))
    assert options.analogs() == sel.AnalogSettings(level=60, most=3, cooldown=0, least=1) and options.rules() == decisions.Rules(sample=1, baseline=100000)
    assert feeds.Settings().analogs() == sel.AnalogSettings() and feeds.Settings().rules() == decisions.Rules()
    assert [x[1] for x in feeds.Settings(levels=(10,), drops=()).specs()] == ["score <= 10"]
    found = event_queries.verdict(spark, SF, options).first()
    assert found.sample <= 3 and found.action == "INSUFFICIENT EVIDENCE"


def test_buckets_carry_the_last_value_over(spark):
    """Series of one hot key and gaps of days give what one window over the key gives."""
    from sextant.streaming.changes import changes

    rows = [("a", dt.datetime(2024, 1, 1 + (i * 7) % 20, i % 24), i, [None, 1.0, 2.0][i * i % 3]) for i in range(60)] + [("b", dt.datetime(2024, 1, 3), 99, None), (None, dt.datetime(2024, 1, 3), 98, 1.0)]
    df = frame(spark, rows, "k string, ts timestamp, id long, v double")
    plain, bucketed = (sorted(map(tuple, changes(df, ["k"], ["ts", "id"], unit=unit).collect()), key=repr) for unit in (None, "day"))
    assert plain == bucketed and plain
    left = df.select("k", "ts", "id").where("id % 3 = 0")
    right = df.where("id % 3 = 1").groupBy("k", F.col("ts").alias("seen")).agg(F.max("id").alias("last"))
    days, hours = (sorted(map(tuple, asof_times(left, right, "ts", "seen", ["k"], unit).collect()), key=repr) for unit in ("day", "hour"))
    want = []
    for k, ts, i in sorted(map(tuple, left.collect()), key=repr):
        seen = max(((r.seen, r.last) for r in right.collect() if r.k == k and r.seen <= ts), default=(None, None))
        want.append((k, ts, i, *seen))
    assert days == hours == sorted(want, key=repr)


def test_dataset_of_420_sessions(spark):
    """Three scores give three rows of 53 columns; without a session on or before a score it fails."""
    from sextant.operators.dataset import combined_dataset

    days, day = [], D(2024, 1, 2)
    while len(days) < 420:
        if day.weekday() < 5:
            days.append(day)
        day += dt.timedelta(1)
    prices = frame(spark, [(x, "X", 4500.0 + i, 4512.0 + i, 4492.0 + i, 4505.0 + i, 4505.0 + i, 0.0, "t") for i, x in enumerate(days)], "date date, symbol string, open double, high double, low double, close double, adj_close double, volume double, data_source string")
    scores = frame(spark, [(D(2025, 7, x), D(2025, 7, x), dt.datetime(2025, 7, x, 20), v, "fear") for x, v in ((1, 24.0), (2, 29.0), (3, 35.0))], "day date, market_day date, source_time timestamp, value double, rating string")
    got = combined_dataset(scores, prices).orderBy("score_market_date").collect()
    assert len(got) == 3 and len(got[0]) == 53 and got[1].score_change_1d == 5.0 and got[0].price_same_trading_day
    assert combined_dataset(scores, prices, "s", "p").columns[:2] == ["s_date_utc", "s_market_date"]
    with pytest.raises(DataValidationError, match="2025-07-01"):
        combined_dataset(scores, prices.where("date > '2025-07-01'"))
    with pytest.raises(DataValidationError, match="no prices"):
        combined_dataset(scores, prices.limit(0))


def test_results_are_exported(spark, tmp_path):
    events, now = event_queries.daily(spark, SF)
    analogs, _ = sel.find_analogs(events, now)
    sinks.export_results(str(tmp_path), stats.event_study(events), analogs, events)
    rows = {x: spark.read.option("header", True).csv(str(tmp_path / x)) for x in ("event_study", "analogs", "full_analysis")}
    assert rows["event_study"].count() == 19 and rows["full_analysis"].count() == events.count() and "analog_distance" in rows["analogs"].columns
    days = [r.day for r in rows["analogs"].collect()]
    assert days == sorted(days)
    assert sinks.with_header(frame(spark, [("a", "b", 1, "c")], "w string, x string, y int, z string")).columns == sinks.SHEET_HEADER
