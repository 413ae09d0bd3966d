"""Queries over long series: every reading is a row, nothing is cut to days first.

The series is all of ``events`` in order of time, in blocks with halos; prices
around each value stand in for the parts of a bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import large_stats, ranges, spacing
from ..operators.windows import Series, market_context, next_session_outcomes, price_features, sentiment_features
from . import standins as s
from .registry import query, table
from .series_queries import CONTEXT, DIGITS, OUTCOMES, PRICE_SQL, ROUND, SENTIMENT_FEATURES, _price_sql, _r

TIME = Series(("ts", "event_id"))
BY_TYPE = Series(("ts", "event_id"), ("event_type",))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    close, opened = F.col("value") + 100, F.col("value") + 97 + F.col("event_id") % 7
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", close.alias("close"), opened.alias("open"))
    return rows.withColumns({"high": F.greatest("open", "close") + 1, "low": F.least("open", "close") - 1})


TICKS = """ticks AS (SELECT *, greatest(open, close) + 1 AS high, least(open, close) - 1 AS low
  FROM (SELECT event_id, ts, event_type, value + 100 AS close, value + 97 + event_id % 7 AS open FROM events))"""
ORDER = "ts, event_id"


def _rounded(df: DataFrame, keep: list[str], digits: dict[str, int]) -> DataFrame:
    return df.select(*keep, *(F.round(c, n).alias(c) for c, n in digits.items()))


@query(f"WITH {TICKS}, {_price_sql('ticks', f'ORDER BY {ORDER}')} SELECT event_id, {PRICE_SQL} FROM g")
def win05_price_features_long(spark: SparkSession, sf_dir: str, rows: int = ranges.BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """WIN-01, WIN-05 to WIN-07, WIN-09, WIN-11 to WIN-13, WIN-15 to WIN-17 over one series of any length."""
    found = ranges.over_blocks(ticks(spark, sf_dir), TIME, price_features, back=252, ahead=60, rows=rows, parts=parts)
    return _rounded(found, ["event_id"], DIGITS)


@query(f"WITH {TICKS}, {_price_sql('ticks', f'PARTITION BY event_type ORDER BY {ORDER}')} SELECT event_type, event_id, {PRICE_SQL} FROM g")
def win05_price_features_long_by_type(spark: SparkSession, sf_dir: str, rows: int = ranges.BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """The same for a few long series at once: more tasks than series."""
    found = ranges.over_blocks(ticks(spark, sf_dir), BY_TYPE, price_features, back=252, ahead=60, rows=rows, parts=parts)
    return _rounded(found, ["event_type", "event_id"], DIGITS)


def _guarded(aggregate: str, x: str, rows: int, least: int | None = None) -> str:
    return s.guarded(aggregate, x, rows, least, ORDER)


LONG_FEATURES = f"""f AS (SELECT event_id, close - lag(close, 1) OVER (ORDER BY {ORDER}) AS change_1, close - lag(close, 5) OVER (ORDER BY {ORDER}) AS change_5,
  {_guarded("avg", "close", 5)} AS sma_5, {_guarded("avg", "close", 20)} AS sma_20,
  (close - ({_guarded("avg", "close", 20)})) / nullif({_guarded("stddev_samp", "close", 20)}, 0) AS z_20 FROM ticks)"""
NINE = dict.fromkeys(SENTIMENT_FEATURES, 9)


@query(f"WITH {TICKS}, {LONG_FEATURES} SELECT event_id, {_r(*SENTIMENT_FEATURES, digits=9)} FROM f")
def win02_sentiment_features_long(spark: SparkSession, sf_dir: str, rows: int = ranges.BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """WIN-02, WIN-03, WIN-07, WIN-10 over one series of any length."""
    found = ranges.over_blocks(ticks(spark, sf_dir), TIME, lambda df, series: sentiment_features(df, series, "close"), back=19, rows=rows, parts=parts)
    return _rounded(found, ["event_id"], NINE)


LONG_MARKET = f"""context_a AS (
  SELECT *, {", ".join(f"close / lag(close, {n}) OVER (ORDER BY {ORDER}) - 1 AS ret_{n}" for n in (1, 5, 20))},
         close / ({_guarded("max", "close", 20, 5)}) - 1 AS off_high_20, close / ({_guarded("max", "close", 252, 60)}) - 1 AS off_high_252,
         close / (max(close) OVER (ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS off_record,
         close / ({_guarded("avg", "close", 50, 20)}) - 1 AS vs_sma_50, close / ({_guarded("avg", "close", 200, 60)}) - 1 AS vs_sma_200,
         lead(ts) OVER (ORDER BY {ORDER}) AS entry_date, lead(open) OVER (ORDER BY {ORDER}) AS entry_price
  FROM ticks),
market AS (
  SELECT *, ({_guarded("stddev_samp", "ret_1", 20, 10)}) * sqrt(252) AS vol_20,
         CASE WHEN off_high_252 IS NULL OR vs_sma_200 IS NULL THEN NULL WHEN vs_sma_200 < 0 THEN 'downtrend' WHEN off_high_252 <= -0.10 THEN 'correction'
              WHEN off_high_252 >= -0.02 THEN 'near_high_uptrend' ELSE 'uptrend_off_high' END AS regime,
         {", ".join(f"lead(close, {h}) OVER (ORDER BY {ORDER}) / entry_price - 1 AS fwd_{h}" for h in (1, 5, 10, 20, 60))},
         min(low) OVER (ORDER BY {ORDER} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / entry_price - 1 AS max_drawdown_20
  FROM context_a)"""


@query(f"WITH {TICKS}, {LONG_MARKET} SELECT event_id, regime, entry_date, {_r(*CONTEXT, 'entry_price', *OUTCOMES)} FROM market")
def win08_market_context_long(spark: SparkSession, sf_dir: str, rows: int = ranges.BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """WIN-04, WIN-08, WIN-11 to WIN-14, WIN-18, WIN-19: partial windows, the running record, outcomes ahead."""
    both = lambda df, series: next_session_outcomes(market_context(df, series), series)
    found = ranges.over_blocks(ticks(spark, sf_dir), TIME, both, back=252, ahead=60, records=["close"], rows=rows, parts=parts)
    return _rounded(found, ["event_id", "regime", "entry_date"], dict.fromkeys((*CONTEXT, "entry_price", *OUTCOMES), ROUND))


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def _steps(df: DataFrame, series: Series) -> DataFrame:
    kind = F.col("event_type")
    return df.withColumns({"position": series.position(), "gap_us": _micros("ts") - series.lag(_micros("ts")), "changed": series.changed(kind)})


@query(
    f"""SELECT event_id, row_number() OVER (ORDER BY {ORDER})::INT AS position, date_diff('microsecond', lag(ts) OVER (ORDER BY {ORDER}), ts) AS gap_us,
       event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY {ORDER}) AS changed FROM events"""
)
def win20_position_gap_change_long(spark: SparkSession, sf_dir: str, rows: int = ranges.BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """WIN-20 to WIN-22: place, gap and change in one series of any length, by a scan of two levels."""
    found = ranges.over_blocks(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), TIME, _steps, back=1, rows=rows, parts=parts)
    return found.select("event_id", "position", "gap_us", "changed")


@query(
    f"""WITH g AS (SELECT event_type, date_diff('microsecond', lag(ts) OVER (PARTITION BY event_type ORDER BY {ORDER}), ts) AS gap FROM events)
SELECT event_type, count_if(gap > 3600000000) AS gaps, max(gap) AS longest FROM g GROUP BY event_type"""
)
def agg13_gaps_long(spark: SparkSession, sf_dir: str, rows: int = ranges.BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """AGG-13: gaps of more than an hour between a type's readings, and the longest, in microseconds."""
    gap = lambda df, series: df.withColumn("gap", _micros("ts") - series.lag(_micros("ts")))
    found = ranges.over_blocks(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), BY_TYPE, gap, back=1, rows=rows, parts=parts)
    return found.groupBy("event_type").agg(F.count_if(F.col("gap") > 3_600_000_000).alias("gaps"), F.max("gap").alias("longest"))




HOUR = 3_600_000_000


def _kept(source: str, name: str, step: str, key: str | None = None) -> str:
    """SQL of the greedy cooldown: from a kept time to the first at least ``step`` later."""
    k, on, group, from_key = (f"{key}, ", f"x.{key} = h.{key} AND ", f" GROUP BY {key}", f"h.{key}, ") if key else ("", "", "", "")
    return f"""{name} AS (
  SELECT {k}min(ts) AS ts FROM {source}{group}
  UNION ALL
  SELECT {from_key}(SELECT min(x.ts) FROM {source} x WHERE {on}x.ts >= h.ts + INTERVAL {step}) FROM {name} h WHERE h.ts IS NOT NULL)"""


@query(f"WITH RECURSIVE {_kept('events', 'kept', '2 hours', 'event_type')} SELECT event_id, event_type, ts FROM events WHERE (event_type, ts) IN (SELECT (event_type, ts) FROM kept WHERE ts IS NOT NULL)")
def sel01_cooldown_times(spark: SparkSession, sf_dir: str, rows: int = ranges.BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """SEL-01 at timestamp grain: each type's readings at least two hours apart, by pointer doubling."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return spacing.cooldown_times(events, 2 * HOUR, "ts", ["event_type"], rows, parts)


@query(f"WITH RECURSIVE {_kept('events', 'kept', '90 minutes')} SELECT event_id, ts FROM events WHERE ts IN (SELECT ts FROM kept WHERE ts IS NOT NULL)")
def sel01_cooldown_times_one_series(spark: SparkSession, sf_dir: str, rows: int = ranges.BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """SEL-01 over all readings as one series, an hour and a half apart."""
    return spacing.cooldown_times(table(spark, sf_dir, "events").select("event_id", "ts"), 3 * HOUR // 2, "ts", (), rows, parts)


@query(
    """WITH c AS (SELECT epoch_us(ts) AS t, min(abs(value - 60)) AS dist FROM events GROUP BY ts),
chosen AS (
  SELECT unnest(list_reduce(list_prepend([]::BIGINT[], list_transform(list(t ORDER BY dist, t), lambda t: [t])),
    lambda k, x: CASE WHEN len(k) < 50 AND len(list_filter(k, lambda y: abs(y - x[1]) < 21600000000)) = 0 THEN k || x ELSE k END)) AS t FROM c)
SELECT event_id, ts, round(abs(value - 60), 6) AS distance FROM events WHERE epoch_us(ts) IN (SELECT t FROM chosen)"""
)
def sel02_nearest_times(spark: SparkSession, sf_dir: str, span: int | None = None) -> DataFrame:
    """SEL-02 at timestamp grain: values nearest to 60, six hours apart, at most fifty, in parallel rounds."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.abs(F.col("value") - 60).alias("distance"))
    found = spacing.nearest_apart_times(rows, 6 * HOUR, 50, span=span)
    return found.select("event_id", "ts", F.round("distance", ROUND).alias("distance"))


@query(
    """SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(quantile_cont(l_extendedprice, 0.975), 6) AS high
FROM lineitem GROUP BY ALL"""
)
def agg05_median_large(spark: SparkSession, sf_dir: str, bits: int = large_stats.BITS) -> DataFrame:
    """AGG-05, quantiles of AGG-09: exact, for groups of any size, by histograms of ordered bits."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    found = large_stats.quantiles(items, "l_extendedprice", (0.5, 0.025, 0.975), ["l_returnflag", "l_linestatus"], bits)
    return found.select("l_returnflag", "l_linestatus", *(F.round(q, ROUND).alias(c) for q, c in (("q0", "median"), ("q1", "low"), ("q2", "high"))))


RESAMPLES = 400


@query(
    f"""SELECT count(l_extendedprice) AS n, {RESAMPLES}::BIGINT AS resamples, count(l_extendedprice) AS least, count(l_extendedprice) AS most, round(avg(l_extendedprice), 2) AS mean,
       true AS centred, true AS spread FROM lineitem"""
)
def agg09_bootstrap_large(spark: SparkSession, sf_dir: str, part: int = large_stats.PART) -> DataFrame:
    """AGG-09 over a sample of any size: every resample as large as the sample, its means
    centred within five standard errors of theirs, and spread as the standard error says, within a fifth."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"))
    means = large_stats.resampled_means(items, RESAMPLES, 42, part=part).agg(
        F.count("*").alias("resamples"), F.min("size").alias("least"), F.max("size").alias("most"), F.avg("mean").alias("m"), F.stddev_samp("mean").alias("s")
    )
    facts = items.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    error = F.col("sd") / F.sqrt("n")
    return facts.join(F.broadcast(means)).select(
        "n", "resamples", "least", "most", F.round("mean", 2).alias("mean"), (F.abs(F.col("m") - F.col("mean")) < 5 * error / F.sqrt("resamples")).alias("centred"), F.col("s").between(0.8 * error, 1.2 * error).alias("spread")
    )
