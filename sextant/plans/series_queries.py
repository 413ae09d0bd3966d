"""Queries over ordered series: windows, as-of joins, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import asof_days, asof_times, with_lag
from ..operators.windows import Series, price_features, sentiment_features
from . import standins as s
from .registry import query, table

ROUND = 6


def rounded(df: DataFrame, *names: str, digits: int = ROUND) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if df.schema[c].dataType.typeName() == "double" else F.col(c) for c in names or df.columns))


def _r(*names: str, digits: int = ROUND) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


SENTIMENT_FEATURES = ("change_1", "change_5", "sma_5", "sma_20", "z_20")


@query(
    f"""WITH {s.SENTIMENT}, f AS (
  SELECT day, v, v - lag(v, 1) OVER (ORDER BY day) AS change_1, v - lag(v, 5) OVER (ORDER BY day) AS change_5,
         {s.guarded("avg", "v", 5, order="day")} AS sma_5, {s.guarded("avg", "v", 20, order="day")} AS sma_20,
         (v - ({s.guarded("avg", "v", 20, order="day")})) / nullif({s.guarded("stddev_samp", "v", 20, order="day")}, 0) AS z_20
  FROM sentiment)
SELECT day, v, {_r(*SENTIMENT_FEATURES)} FROM f"""
)
def win02_sentiment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02, WIN-03, WIN-07, WIN-10: changes, full averages, z-score."""
    return rounded(sentiment_features(s.sentiment(spark, sf_dir), Series(("day",))), "day", "v", *SENTIMENT_FEATURES)


PAST, FORWARD, PATH, AVERAGES = (1, 5, 10, 20, 60, 252), (1, 5, 10, 20, 60), (5, 20, 60), (20, 50, 200)
PRICE_FEATURES = (
    "previous_close", "gap_pct", "intraday_pct", "range_pct", *(f"return_{n}" for n in PAST), *(f"{k}_{n}" for n in AVERAGES for k in ("sma", "vs_sma")), "high_252", "drawdown_252",
    *(f"forward_{n}" for n in FORWARD), *(f"{k}_next_{n}" for n in PATH for k in ("drawdown", "gain")), "volatility_20",
)


#: Averages of six-digit prices are exact at nine digits; at six they would tie.
DIGITS = {c: 9 if c.startswith("sma_") else ROUND for c in PRICE_FEATURES}
PRICE_SQL = ", ".join(f"round({c}, {n}) AS {c}" for c, n in DIGITS.items())


def _price_sql(source: str, over: str) -> str:
    w = f"OVER ({over} ROWS BETWEEN"
    back = lambda agg, x, n: f"CASE WHEN count({x}) {w} {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN {agg}({x}) {w} {n - 1} PRECEDING AND CURRENT ROW) END"
    ahead = lambda agg, x, n: f"CASE WHEN count({x}) {w} 1 FOLLOWING AND {n} FOLLOWING) = {n} THEN {agg}({x}) {w} 1 FOLLOWING AND {n} FOLLOWING) END"
    lag = lambda n: f"lag(close, {n}) OVER ({over})"
    parts = [
        f"{lag(1)} AS previous_close", f"(open / {lag(1)} - 1) * 100 AS gap_pct", "(close / open - 1) * 100 AS intraday_pct", f"(high - low) / {lag(1)} * 100 AS range_pct",
        *(f"(close / {lag(n)} - 1) * 100 AS return_{n}" for n in PAST),
        *(f"{back('avg', 'close', n)} AS sma_{n}, (close / ({back('avg', 'close', n)}) - 1) * 100 AS vs_sma_{n}" for n in AVERAGES),
        f"{back('max', 'close', 252)} AS high_252", f"(close / ({back('max', 'close', 252)}) - 1) * 100 AS drawdown_252",
        *(f"(lead(close, {n}) OVER ({over}) / close - 1) * 100 AS forward_{n}" for n in FORWARD),
        *(f"(({ahead('min', 'low', n)}) / close - 1) * 100 AS drawdown_next_{n}, (({ahead('max', 'high', n)}) / close - 1) * 100 AS gain_next_{n}" for n in PATH),
    ]
    return f"f AS (SELECT *, {', '.join(parts)} FROM {source}), g AS (SELECT *, ({back('stddev_samp', 'return_1', 20)}) * sqrt(252) AS volatility_20 FROM f)"


@query(f"WITH {s.WALK}, {_price_sql('walk', 'ORDER BY d')} SELECT d, open, high, low, close, {PRICE_SQL} FROM g")
def win05_price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01, WIN-05 to WIN-07, WIN-09, WIN-11 to WIN-13, WIN-15 to WIN-17: full windows, percent."""
    return _digits(price_features(s.walk(spark, sf_dir), s.DAY))


def _digits(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c not in PRICE_FEATURES]
    return df.select(*keep, *(F.round(c, DIGITS[c]).alias(c) for c in PRICE_FEATURES))


SYMBOLS = s.SESSIONS.replace("SELECT", "SELECT o_orderpriority,").replace("GROUP BY 1", "GROUP BY 1, 2")


@query(f"WITH {SYMBOLS}, {_price_sql('sessions', 'PARTITION BY o_orderpriority ORDER BY d')} SELECT o_orderpriority, d, open, high, low, close, {PRICE_SQL} FROM g")
def win05_price_features_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for several series at once, partitioned by their key."""
    return _digits(price_features(s.sessions(spark, sf_dir, "o_orderpriority"), Series(("d",), ("o_orderpriority",))))


CONTEXT = ("ret_1", "ret_5", "ret_20", "off_high_20", "off_high_252", "off_record", "vs_sma_50", "vs_sma_200", "vol_20")


@query(f"WITH {s.CONTEXT} SELECT d, {_r(*CONTEXT)}, regime FROM context")
def win08_market_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04, WIN-08, WIN-11 to WIN-14, SCA-05: partial windows, fractions, regime."""
    return rounded(s.market(spark, sf_dir), "d", *CONTEXT, "regime")


OUTCOMES = ("fwd_1", "fwd_5", "fwd_10", "fwd_20", "fwd_60", "max_drawdown_20")


@query(f"WITH {s.MARKET} SELECT d, entry_date, {_r('entry_price', *OUTCOMES)} FROM market")
def win18_next_session_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-18, WIN-19, JON-05: entry at the next open, outcomes relative to it."""
    return rounded(s.market(spark, sf_dir), "d", "entry_date", "entry_price", *OUTCOMES)


@query(
    f"""WITH {s.SENTIMENT} SELECT day, row_number() OVER (ORDER BY day) AS position, date_diff('day', lag(day) OVER (ORDER BY day), day)::INT AS gap,
       v IS DISTINCT FROM lag(v) OVER (ORDER BY day) AS changed FROM sentiment"""
)
def win20_position_gap_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-20, WIN-21, WIN-22."""
    w = Series(("day",))
    return s.sentiment(spark, sf_dir).select("day", w.position().alias("position"), F.datediff("day", w.lag(F.col("day"))).alias("gap"), w.changed(F.col("v")).alias("changed"))


@query(
    f"""WITH {s.SESSIONS}, {s.SENTIMENT} SELECT day, v, d, open, high, low, close, date_diff('day', d, day)::INT AS lag_days, d = day AS same_day
FROM sentiment ASOF LEFT JOIN sessions ON sentiment.day >= sessions.d"""
)
def jon01_asof_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-01, JON-03: latest session on or before each day."""
    return with_lag(asof_days(s.sentiment(spark, sf_dir), s.sessions(spark, sf_dir)), "day", "d")


@query(
    """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT a.event_id, a.user_id, a.ts, b.ts AS seen, b.v FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts"""
)
def jon01_asof_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-01 at timestamp grain, by key."""
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("seen")).agg(F.max("value").alias("v"))
    return asof_times(left, right, "ts", "seen", ["user_id"])


@query(f"WITH {s.SESSIONS}, {s.SENTIMENT} SELECT count(*) AS unmatched FROM sentiment WHERE day < (SELECT min(d) FROM sessions)")
def jon02_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-02: days before the first session."""
    return asof_days(s.sentiment(spark, sf_dir), s.sessions(spark, sf_dir)).where("d IS NULL").agg(F.count("*").alias("unmatched"))


SIGNAL_COLUMNS = ("v", "chg_1", "chg_3", "chg_5", "chg_10", "entry_price", *CONTEXT, *OUTCOMES)


@query(f"WITH {s.SIGNALS} SELECT day, d, entry_date, regime, {_r(*SIGNAL_COLUMNS)} FROM signals")
def jon04_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-04: scores matched to sessions, entry at the next one, all features and outcomes."""
    return rounded(s.signals(spark, sf_dir), "day", "d", "entry_date", "regime", *SIGNAL_COLUMNS)


@query(f"WITH {s.CURRENT} SELECT day, d, regime, {_r('v', 'chg_5', *CONTEXT)} FROM now")
def jon06_current_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-06, JON-08, LIM-02: the latest score with its session."""
    return rounded(s.current(spark, sf_dir), "day", "d", "regime", "v", "chg_5", *CONTEXT)


@query(
    f"""WITH {s.SIGNALS} SELECT d, count(*) AS n, {_r('m')} FROM (SELECT d, avg(v) OVER (PARTITION BY d) AS m FROM signals WHERE v <= 25) GROUP BY d, m"""
)
def jon04_low_scores_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low scores gathered by matched session."""
    return rounded(s.signals(spark, sf_dir).where("v <= 25").groupBy("d").agg(F.count("*").alias("n"), F.avg("v").alias("m")))
