"""Daily series drawn from the test tables, in Spark and in SQL.

The tables hold no prices or scores: ``sessions`` are weekday orders rolled
up to prices, ``sentiment`` picks one line item a day, ``walk`` is a smoother
price path made from the sessions. All are cut to daily grain by a grouped
aggregation before any window runs over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import asof_days
from ..operators.windows import Series, market_context, next_session_outcomes
from .registry import table

DAY = Series(("d",))


def sessions(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), "o_totalprice", "o_orderkey", *keys)
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return (
        orders.where(F.weekday("d") < 5)
        .groupBy(*keys, "d")
        .agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"))
    )


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.max_by(2 * F.col("l_quantity"), order).alias("v"))


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = sessions(spark, sf_dir)
    facts = base.agg(F.avg("close").alias("m"), F.stddev_samp("close").alias("s"))
    z = base.join(F.broadcast(facts)).withColumn("z", (F.col("close") - F.col("m")) / F.col("s"))
    total = F.sum("z").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    close = z.select("d", "z", F.round(100 * F.exp(0.01 * total), 6).alias("close")).withColumn("s", 0.004 * F.abs("z") + 0.001)
    opened = close.withColumn("open", F.coalesce(DAY.lag(F.col("close")), F.lit(100.0)))
    return opened.select(
        "d", "open", F.round(F.greatest("open", "close") * (1 + F.col("s")), 6).alias("high"), F.round(F.least("open", "close") * (1 - F.col("s")), 6).alias("low"), "close"
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("v"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``walk`` with context and outcomes."""
    return next_session_outcomes(market_context(walk(spark, sf_dir), DAY), DAY)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sentiment`` with changes over 1, 3, 5 and 10 observations."""
    series = Series(("day",))
    return sentiment(spark, sf_dir).withColumns({f"chg_{n}": series.diff(F.col("v"), n) for n in (1, 3, 5, 10)})


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores matched to the latest session, with a next session to enter in."""
    return asof_days(scores(spark, sf_dir), market(spark, sf_dir), how="inner").where("entry_date IS NOT NULL")


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest score with the latest session on or before it; one row."""
    latest = scores(spark, sf_dir).orderBy(F.desc("day")).limit(1)
    return asof_days(latest, market_context(walk(spark, sf_dir), DAY), how="inner")


def over(rows: int, order: str = "d") -> str:
    return f"OVER (ORDER BY {order} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def guarded(aggregate: str, x: str, rows: int, least: int | None = None, order: str = "d") -> str:
    return f"CASE WHEN count({x}) {over(rows, order)} >= {least or rows} THEN {aggregate}({x}) {over(rows, order)} END"


SESSIONS = """sessions AS (
  SELECT CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close
  FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1)"""
SENTIMENT = """sentiment AS (
  SELECT CAST(l_shipdate AS DATE) AS day, arg_max(2 * l_quantity, (l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS v
  FROM lineitem GROUP BY 1)"""
WALK = f"""{SESSIONS},
walk_z AS (SELECT d, (close - avg(close) OVER ()) / stddev_samp(close) OVER () AS z FROM sessions),
walk_c AS (SELECT d, 0.004 * abs(z) + 0.001 AS s,
                  round(100 * exp(0.01 * sum(z) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS close FROM walk_z),
walk_o AS (SELECT *, coalesce(lag(close) OVER (ORDER BY d), 100) AS open FROM walk_c),
walk AS (SELECT d, open, round(greatest(open, close) * (1 + s), 6) AS high, round(least(open, close) * (1 - s), 6) AS low, close FROM walk_o)"""
CONTEXT = f"""{WALK},
context_a AS (
  SELECT *, close / lag(close, 1) OVER (ORDER BY d) - 1 AS ret_1, close / lag(close, 5) OVER (ORDER BY d) - 1 AS ret_5,
         close / lag(close, 20) OVER (ORDER BY d) - 1 AS ret_20,
         close / ({guarded("max", "close", 20, 5)}) - 1 AS off_high_20, close / ({guarded("max", "close", 252, 60)}) - 1 AS off_high_252,
         close / (max(close) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS off_record,
         close / ({guarded("avg", "close", 50, 20)}) - 1 AS vs_sma_50, close / ({guarded("avg", "close", 200, 60)}) - 1 AS vs_sma_200
  FROM walk),
context AS (
  SELECT *, ({guarded("stddev_samp", "ret_1", 20, 10)}) * sqrt(252) AS vol_20,
         CASE WHEN off_high_252 IS NULL OR vs_sma_200 IS NULL THEN NULL WHEN vs_sma_200 < 0 THEN 'downtrend' WHEN off_high_252 <= -0.10 THEN 'correction'
              WHEN off_high_252 >= -0.02 THEN 'near_high_uptrend' ELSE 'uptrend_off_high' END AS regime
  FROM context_a)"""
MARKET = f"""{CONTEXT},
market_a AS (SELECT *, lead(d) OVER (ORDER BY d) AS entry_date, coalesce(lead(open) OVER (ORDER BY d), lead(close) OVER (ORDER BY d)) AS entry_price FROM context),
market AS (
  SELECT *, {", ".join(f"lead(close, {h}) OVER (ORDER BY d) / entry_price - 1 AS fwd_{h}" for h in (1, 5, 10, 20, 60))},
         min(low) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / entry_price - 1 AS max_drawdown_20
  FROM market_a)"""
SCORES = f"""{SENTIMENT},
scores AS (SELECT day, v, {", ".join(f"v - lag(v, {n}) OVER (ORDER BY day) AS chg_{n}" for n in (1, 3, 5, 10))} FROM sentiment)"""
SIGNALS = f"""{MARKET}, {SCORES},
signals AS (SELECT * FROM scores ASOF JOIN market ON scores.day >= market.d WHERE entry_date IS NOT NULL)"""
CURRENT = f"""{SIGNALS},
now AS (SELECT * FROM (SELECT * FROM scores ORDER BY day DESC LIMIT 1) s ASOF JOIN context ON s.day >= context.d)"""
