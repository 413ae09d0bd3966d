"""Queries over sources, merging and streams."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators import dataset
from ..operators.refresh import refresh
from ..operators.upsert import merge, newest
from ..schema import DAILY_HEADER
from ..session import shared_root, written
from ..sources import chain, delimited, feeds
from ..sources.formats import infer_formats
from ..sources.snapshots import read_snapshot
from ..streaming import alerts as al
from ..streaming import changes as ch
from . import standins as s
from .registry import query, table
from .series_queries import DIGITS, _price_sql


def _events_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(*(F.col(c).cast("string").alias(c) for c in ("event_id", "ts", "value")))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed payload for each event type and hour, as JSON text: the hours of a hot day are rows of their own."""
    e = table(spark, sf_dir, "events")
    item = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("x"), F.col("value").alias("y"), F.lit("Extreme_Fear").alias("rating"))
    hours = e.groupBy("event_type", F.date_trunc("hour", "ts")).agg(F.collect_list(item).alias("data"))
    current = F.struct(F.lit("abc").alias("score"), F.lit("").alias("rating"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"))
    return hours.select("event_type", F.to_json(F.struct(current.alias("current"), F.struct("data").alias("history"))).alias("payload"))


@query(
    """SELECT event_type, ts::DATE AS day, arg_max(value, (date_trunc('second', ts), value)) AS value, 'extreme fear' AS rating, max(date_trunc('second', ts)) AS source_time
FROM events WHERE value BETWEEN 0 AND 100 AND ts::DATE >= DATE '2024-01-05' GROUP BY 1, 2"""
)
def src03_parse_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03, FLT-05, FLT-10, AGG-01: nested JSON to the newest reading of each day."""
    return feeds.parse_feed(_payloads(spark, sf_dir), "current", "history", date(2024, 1, 5), ["event_type"])


@query(
    """SELECT ts::DATE AS day, arg_max(value, (date_trunc('second', ts), value)) AS value, arg_max(CASE WHEN value <= 24 THEN 'extreme fear' WHEN value <= 44 THEN 'fear' WHEN value <= 55 THEN 'neutral' WHEN value <= 75 THEN 'greed' ELSE 'extreme greed' END, (date_trunc('second', ts), value)) AS rating,
 max(date_trunc('second', ts)) AS source_time FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1"""
)
def src05_strict_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04, SRC-05, FLT-02, FLT-03, AGG-02: strict text rows, blanks skipped."""
    e = table(spark, sf_dir, "events")
    ok = F.col("value").between(0, 100)
    raw = e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(ok, F.col("value").cast("string")).otherwise(" ").alias("value"), F.lit(" ").alias("rating"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("source_time"),
    )
    return delimited.strict_daily(raw)


@query("SELECT ts::DATE AS day, arg_max(value, (ts::VARCHAR, value)) AS value FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def src12_inferred_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12, PRJ-08, PRJ-09: roles inferred from the values."""
    return delimited.parse_daily(_events_text(spark, sf_dir).select("event_id", "ts", "value"), order="ts")


@query(f"WITH {s.SESSIONS} SELECT d AS date, CASE WHEN day(d) % 2 = 0 THEN open END AS open, close AS high, close AS low, close FROM sessions WHERE day(d) <> 13")
def src13_inferred_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: missing high and low columns are the close; a blank open stays blank, a blank close drops the row."""
    given = lambda c, test: F.when(test, F.col(c).cast("string")).otherwise(F.lit(" ")).alias(c)
    base = s.sessions(spark, sf_dir).select(F.col("d").cast("string").alias("date"), given("open", F.day("d") % 2 == 0), given("close", F.day("d") != 13))
    return delimited.parse_prices(base)


@query(f"WITH {s.SESSIONS}, {s.SENTIMENT} SELECT 'score' AS kind, day, v AS value, NULL::DOUBLE AS open FROM sentiment UNION ALL SELECT 'price', d, close, CASE WHEN day(d) % 2 = 0 THEN open END FROM sessions")
def src14_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: one wide table of text split into both series."""
    text = lambda df, **names: df.select(*(F.col(c).cast("string").alias(n) for n, c in names.items()))
    scores = text(s.sentiment(spark, sf_dir), score_date_utc="day", score_value="v")
    sessions = s.sessions(spark, sf_dir).withColumn("open", F.when(F.day("d") % 2 == 0, F.col("open")))
    prices = text(sessions, price_date="d", price_open="open", price_high="high", price_low="low", price_close="close")
    daily, market = delimited.parse_combined(scores.unionByName(prices, allowMissingColumns=True))
    return daily.select(F.lit("score").alias("kind"), "day", "value", F.lit(None).cast("double").alias("open")).union(market.select(F.lit("price"), "date", "close", "open"))


@query(
    """WITH h AS (SELECT CAST(timezone('America/New_York', timezone('UTC', o_orderdate + to_hours((o_orderkey % 24)::INT))) AS DATE) AS date, o_totalprice AS p, (o_orderdate + to_hours((o_orderkey % 24)::INT)) AS ts FROM orders)
SELECT date, 'X' AS symbol, arg_max(p, (ts, p)) + 2 AS open, arg_max(p, (ts, p)) + 4 AS high, arg_max(p, (ts, p)) - 8 AS low, arg_max(p, (ts, p)) AS close, arg_max(p, (ts, p)) AS adj_close, NULL::DOUBLE AS volume, 'test' AS data_source FROM h GROUP BY 1"""
)
def src08_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08, PRJ-04: defaults for missing columns, market-zone dates, last for each date."""
    ts = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 24 * 3600)
    raw = table(spark, sf_dir, "orders").select(ts.alias("ts"), *((F.col("o_totalprice") + more).alias(c) for c, more in (("Open", 2), ("High", 4), ("Low", -8), ("Close", 0))))
    return delimited.normalise_history(raw, "X", "test")


@query(f"WITH {s.SESSIONS} SELECT d AS date, 'X' AS symbol, open, high, NULL::DOUBLE AS low, close, NULL::DOUBLE AS adj_close, 7.0::DOUBLE AS volume, 'test' AS data_source FROM sessions")
def src06_price_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06, AGG-02: a cache file read back; unreadable numbers are null, the last row of a date counts."""
    text = s.sessions(spark, sf_dir).select(
        F.col("d").cast("string").alias("date"), F.lit("X").alias("symbol"), *(F.col(c).cast("string").alias(c) for c in ("open", "high")), F.lit("none").alias("low"),
        F.col("close").cast("string").alias("close"), F.lit("").alias("adj_close"), F.lit("7").alias("volume"), F.lit("test").alias("data_source"),
    )
    stale = text.withColumns({"close": F.lit("999999"), "open": F.lit("1")})
    path = f"{shared_root(spark)}/cache-{uuid.uuid4().hex}"
    stale.withColumn("late", F.lit(0)).unionByName(text.withColumn("late", F.lit(1))).orderBy("late", "date").coalesce(1).drop("late").write.option("header", True).csv(path)
    return delimited.load_prices(spark, path)


@query("SELECT floor(arg_max(value, (ts, event_id)) + 0.5)::INT AS latest FROM events WHERE value IS NOT NULL")
def src19_latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19, SCA-08: the newest value, rounded half up."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return e.agg(F.floor(F.max_by("value", F.struct("ts", "event_id")) + 0.5).cast("int").alias("latest"))


@query("SELECT event_type, ts::DATE AS day, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2")
def agg01_newest_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-02."""
    r = s.readings(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return newest(r, ["event_type", "day"], ["ts", "event_id"]).select("event_type", "day", "event_id", "v")


@query("SELECT DISTINCT date_trunc('hour', ts) AS ts, floor(value) AS value FROM events WHERE value BETWEEN 0 AND 100")
def agg03_merge_intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03, SET-01, SRC-11: two tables united, repeated rows once."""
    r = s.readings(spark, sf_dir).where("v BETWEEN 0 AND 100").select(F.date_trunc("hour", "ts").alias("ts"), F.floor("v").cast("double").alias("value"), "event_id")
    return delimited.merge_intraday(r.where("event_id % 2 = 0").drop("event_id"), r.where("event_id % 3 <> 0 OR event_id % 2 = 1").drop("event_id")).select("ts", "value")


@query(
    """WITH o AS (SELECT user_id, ts, value, 0 AS prio FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT user_id, date_trunc('day', ts), value + 1, 1 FROM events WHERE event_id % 3 = 0)
SELECT user_id, arg_max(value, (ts, prio, value)) AS v, max(ts) AS ts FROM o GROUP BY 1"""
)
def jon07_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-07, SET-02: newest source time wins, new rows win ties. Both sides together are all events."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    old = e.where("event_id % 3 <> 0").select("user_id", "ts", F.col("value").alias("v"))
    new = e.where("event_id % 3 = 0").select("user_id", F.date_trunc("day", "ts").alias("ts"), (F.col("value") + 1).alias("v"))
    last = lambda df: newest(df, ["user_id"], ["ts", "v"])
    return merge(last(old), last(new), ["user_id"], ["ts"]).select("user_id", "v", "ts")


CHANGES = """SELECT event_type, ts AS ts, event_id, v FROM (
  SELECT event_type, ts, event_id, floor(value / 50) AS v, lag(floor(value / 50)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events) WHERE v IS DISTINCT FROM before"""


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.readings(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 50).cast("double"))


@query(CHANGES)
def str02_changes_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02, SNK-10, WIN-22 by series."""
    return ch.changes(_coarse(spark, sf_dir), ["event_type"], ["ts", "event_id"], unit="day").select("event_type", "ts", "event_id", "v")


def _run(spark: SparkSession, sf_dir: str, sink, columns: str, build=lambda x: x, read=None) -> DataFrame:
    """Run a stream over the events file to its end; checkpoint and results lie in the shared folder."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("v"))
    path = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    running = build(stream).writeStream.foreachBatch(sink(path)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return (read or (lambda spark, at: spark.read.parquet(at)))(spark, f"{path}/rows").select(*columns.split())


@query(CHANGES)
def str02_changes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, STR-02 as a stream with state."""
    return _run(spark, sf_dir, ch.changes_sink, "event_type ts event_id v", lambda x: x.withColumn("v", F.floor(F.col("v") / 50).cast("double")))


@query("SELECT event_type, ts::DATE AS day, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2")
def str03_newest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03: newest for each key and day, merged into a table of versions; rows may be late by any time."""
    return _run(spark, sf_dir, ch.newest_sink, "event_type day ts event_id v", read=read_snapshot)


#: One row of a series after another, with the state of both alerts before and after it.
ALERTS = """WITH RECURSIVE e AS (
  SELECT event_type, ts, event_id, value AS v, CASE WHEN value <= 25 THEN 'low' WHEN value >= 75 THEN 'high' ELSE 'normal' END AS kind,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events WHERE value IS NOT NULL AND isfinite(value)),
w AS (
  SELECT event_type, 0::BIGINT AS rn, NULL::TIMESTAMP AS ts, NULL::BIGINT AS event_id, NULL::DOUBLE AS v, NULL::VARCHAR AS kind, false AS was_low, false AS was_high, false AS notify,
         false AS low_open, NULL::DATE AS low_day, NULL::DOUBLE AS low_value, false AS high_open, NULL::DATE AS high_day, NULL::DOUBLE AS high_value FROM e WHERE rn = 1
  UNION ALL
  SELECT event_type, rn, ts, event_id, v, kind, low_open, high_open, notify,
         CASE kind WHEN 'low' THEN true WHEN 'normal' THEN false ELSE low_open END, CASE WHEN kind = 'low' AND notify THEN ts::DATE ELSE low_day END, CASE WHEN kind = 'low' AND notify THEN v ELSE low_value END,
         CASE kind WHEN 'high' THEN true WHEN 'normal' THEN false ELSE high_open END, CASE WHEN kind = 'high' AND notify THEN ts::DATE ELSE high_day END, CASE WHEN kind = 'high' AND notify THEN v ELSE high_value END
  FROM (SELECT e.*, w.low_open, w.low_day, w.low_value, w.high_open, w.high_day, w.high_value,
               CASE e.kind WHEN 'low' THEN w.low_day IS NULL OR w.low_day <> e.ts::DATE OR abs(e.v - w.low_value) >= 5
                           WHEN 'high' THEN w.high_day IS NULL OR w.high_day <> e.ts::DATE OR abs(e.v - w.high_value) >= 5 ELSE false END AS notify
        FROM w JOIN e ON e.event_type = w.event_type AND e.rn = w.rn + 1) x)
SELECT event_type, ts, event_id, v, kind, CASE WHEN CASE kind WHEN 'low' THEN was_low ELSE was_high END THEN 'update' ELSE 'open' END AS action, notify FROM w
WHERE kind IN ('low', 'high') AND (notify OR NOT CASE kind WHEN 'low' THEN was_low ELSE was_high END)
UNION ALL SELECT event_type, ts, event_id, v, 'low', 'close', false FROM w WHERE kind = 'normal' AND was_low
UNION ALL SELECT event_type, ts, event_id, v, 'high', 'close', false FROM w WHERE kind = 'normal' AND was_high"""


@query(ALERTS)
def str07_alerts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07: alerts opened, told again and closed, as a stream with state."""
    return _run(spark, sf_dir, al.alerts_sink, "event_type ts event_id v kind action notify")


@query(ALERTS)
def str07_alerts_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07 over all readings at once: each day of a series is a task's work."""
    e = table(spark, sf_dir, "events")
    return al.alerts(e.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("v")))[0]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return s.sentiment(spark, sf_dir).select("day", F.col("day").alias("market_day"), F.col("day").cast("timestamp").alias("source_time"), v.alias("value"), f.rating(v).alias("rating"))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = (F.lit("X").alias("symbol"), "open", "high", "low", "close", F.col("close").alias("adj_close"), F.lit(None).cast("double").alias("volume"), F.lit("made").alias("data_source"))
    return s.walk(spark, sf_dir).select(F.col("d").alias("date"), *named)


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from the first session on: earlier ones have none to meet."""
    prices = written(_prices(spark, sf_dir), "prices")
    first = prices.agg(F.min("date").alias("first"))
    scores = _scores(spark, sf_dir).join(F.broadcast(first)).where("day >= first").drop("first")
    return dataset.combined_dataset(scores, prices)


_R = dataset.PRICE_FEATURES | dataset.OUTCOMES
_DIGITS = {k: DIGITS.get(k, 6) for k in _R}
_NAMED = ", ".join(
    [f"{x} AS {n}" for x, n in (("date", "score_date_utc"), ("date", "score_market_date"), ("stamp", "score_source_timestamp_utc"), ("v", "score_value"), ("rating", "score_rating"))]
    + [f"round({k}, 6) AS score_{n}" for k, n in dataset.SCORE_FEATURES.items()]
    + ["dayname(date) AS score_day_of_week", "d AS price_date", "date_diff('day', d, date)::INT AS price_match_lag_calendar_days", "d = date AS price_same_trading_day", "dayname(d) AS price_day_of_week", "'X' AS price_symbol"]
    + [f"{c} AS price_{c}" for c in ("open", "high", "low", "close")]
    + ["close AS price_adj_close", "NULL::DOUBLE AS price_volume", "'made' AS price_data_source"]
    + [f"round({k.replace('past_', 'return_')}, {_DIGITS[k]}) AS price_{n}" for k, n in dataset.PRICE_FEATURES.items() if k != "data_source"]
    + [f"round({k}, 6) AS {n}" for k, n in dataset.OUTCOMES.items()]
)
_RATED = "CASE WHEN v <= 24 THEN 'extreme fear' WHEN v <= 44 THEN 'fear' WHEN v <= 55 THEN 'neutral' WHEN v <= 75 THEN 'greed' ELSE 'extreme greed' END AS rating"
DATASET = f"""{s.WALK}, {_price_sql('walk', 'ORDER BY d')}, {s.SENTIMENT},
kept AS (SELECT day AS date, v FROM sentiment WHERE day >= (SELECT min(d) FROM walk)),
scored AS (
  SELECT date, date::TIMESTAMP AS stamp, v, {_RATED}, v - lag(v, 1) OVER (ORDER BY date) AS change_1, v - lag(v, 5) OVER (ORDER BY date) AS change_5,
         {s.guarded("avg", "v", 5, order="date")} AS sma_5, {s.guarded("avg", "v", 20, order="date")} AS sma_20x,
         (v - ({s.guarded("avg", "v", 20, order="date")})) / nullif({s.guarded("stddev_samp", "v", 20, order="date")}, 0) AS z_20 FROM kept)"""
# sma_20 of the scores and of the prices meet in one row
DATASET_SQL = f"WITH {DATASET} SELECT {_NAMED.replace('round(sma_20, 6) AS score_sma_20d', 'round(sma_20x, 6) AS score_sma_20d')} FROM scored ASOF JOIN g ON scored.date >= g.d"


def _shown(df: DataFrame) -> DataFrame:
    held = {n: k for k, n in dataset.OUTCOMES.items()} | {f"price_{n}": k for k, n in dataset.PRICE_FEATURES.items()} | {f"score_{n}": k for k, n in dataset.SCORE_FEATURES.items()}
    prices = {f"price_{n}" for n in dataset.PRICE_FEATURES.values()}
    return df.select(*(F.round(c, DIGITS.get(held[c], 6) if c in prices else 6).alias(c) if c in held and kind == "double" else F.col(c) for c, kind in df.dtypes))


@query(DATASET_SQL)
def prj02_combined_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02, PRJ-03, JON-01, JON-03, SCA-23: all 53 columns of the combined dataset."""
    return _shown(_dataset(spark, sf_dir))


_TEXT = {"score_date_utc": "strftime({}, '%Y-%m-%d')", "score_market_date": "strftime({}, '%Y-%m-%d')", "price_date": "strftime({}, '%Y-%m-%d')", "score_source_timestamp_utc": "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"} | dict.fromkeys(
    ("score_rating", "score_day_of_week", "price_day_of_week", "price_symbol", "price_data_source", "price_match_lag_calendar_days", "price_same_trading_day"), "{}::VARCHAR"
)
_NAMES = [
    *(f"score_{n}" for n in ("date_utc", "market_date", "source_timestamp_utc", "value", "rating", *dataset.SCORE_FEATURES.values(), "day_of_week")),
    *(f"price_{n}" for n in ("date", "match_lag_calendar_days", "same_trading_day", "day_of_week", "symbol", "open", "high", "low", "close", "adj_close", "volume", "data_source")),
    *(f"price_{n}" for k, n in dataset.PRICE_FEATURES.items() if k != "data_source"),
    *dataset.OUTCOMES.values(),
]
# averages have up to nine digits: less than their last digit is added, so that no half is left to rounding
_TIED = tuple(f"price_{n}" for k, n in dataset.PRICE_FEATURES.items() if k.startswith("sma_"))
_AS_TEXT = ", ".join(f"coalesce({_TEXT.get(n, 'printf(' + chr(39) + '%.6f' + chr(39) + ', {})').format(f'({n} + 2e-10)' if n in _TIED else n)}, '') AS {n}" for n in _NAMES)


@query(f"SELECT {_AS_TEXT} FROM ({DATASET_SQL})")
def snk02_dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02, SRT-02: the dataset as text, all 53 columns: dates, six-digit numbers, empty for null."""
    from ..sources.sinks import text_rows

    shown = _shown(_dataset(spark, sf_dir))
    return text_rows(shown.withColumns({c: F.col(c) + 2e-10 for c in _TIED}))


SERIES = f"""{s.SESSIONS}, {s.SENTIMENT}, facts AS (SELECT (SELECT count(*) FROM sentiment) AS days, (SELECT min(day) FROM sentiment) AS first_day, (SELECT arg_max(v, day) FROM sentiment) AS last_value)"""


@query(
    f"""WITH {SERIES}
SELECT 'separate' AS case_, 'scores.csv + prices.csv' AS source, facts.*, (SELECT count(*) FROM sessions) AS sessions, (SELECT arg_max(close, d) FROM sessions) AS last_close FROM facts
UNION ALL SELECT 'combined', 'combined.csv', facts.*, (SELECT count(*) FROM sessions), (SELECT arg_max(close, d) FROM sessions) FROM facts
UNION ALL SELECT 'download', 'scores.csv + download', facts.*, (SELECT count(*) FROM sessions WHERE d >= first_day - 450 AND d <= DATE '1995-06-30'), (SELECT arg_max(close, d) FROM sessions WHERE d <= DATE '1995-06-30') FROM facts"""
)
def src15_source_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15, SRC-09: both series from separate files, from a combined one where prices cannot be read, from a download where there are none."""
    days, sessions = written(s.sentiment(spark, sf_dir), "days"), written(s.sessions(spark, sf_dir), "sessions")
    root = f"{shared_root(spark)}/chain-{uuid.uuid4().hex}"
    put = lambda df, path: df.write.option("header", True).csv(f"{root}/{path}")
    wide = days.select(F.col("day").alias("score_date_utc"), F.col("v").alias("score_value")).unionByName(sessions.select(F.col("d").alias("price_date"), *(F.col(c).alias(f"price_{c}") for c in ("open", "high", "low", "close"))), allowMissingColumns=True)
    for case in ("separate", "combined", "download"):
        put(days.select("day", F.col("v").alias("value")), f"{case}/scores.csv")
    put(sessions.withColumnRenamed("d", "date"), "separate/prices.csv")
    put(sessions.select("d", F.lit("n/a").alias("close")), "combined/prices.csv")
    put(wide, "combined/combined.csv")
    history = lambda start, end: sessions.where((F.col("d") >= F.lit(start)) & (F.col("d") < F.lit(end))).select(F.col("d").cast("timestamp").alias("ts"), *(F.col(c).alias(f"{c}_X") for c in ("open", "high", "low", "close")))
    found = []
    for case in ("separate", "combined", "download"):
        daily, market, label = chain.load_series(spark, f"{root}/{case}", date(1995, 6, 30), download=history)
        one = daily.agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max_by("value", "day").alias("last_value"))
        two = market.agg(F.count("*").alias("sessions"), F.max_by("close", "date").alias("last_close"))
        found.append(one.join(F.broadcast(two)).select(F.lit(case).alias("case_"), F.lit(label).alias("source"), "*"))
    return found[0].union(found[1]).union(found[2])


#: The first score is one whose context of 450 days begins at a session; the cache reaches from there to the last score's session.
REFRESH = f"""{s.WALK}, {s.SENTIMENT},
kept AS (SELECT day FROM sentiment WHERE day BETWEEN (SELECT min(day) FROM sentiment JOIN walk ON day - 450 = d) AND (SELECT max(d) FROM walk)),
ends AS (SELECT min(day) - 450 AS first, max(day) AS last, max(day) - greatest(0, isodow(max(day)) - 5)::INT AS needed FROM kept),
cached AS (SELECT walk.* FROM walk, ends WHERE d >= first AND d < needed + 2),
revised AS (SELECT d, open, high, low, CASE WHEN d = (SELECT max(d) FROM cached) THEN close + 1 ELSE close END AS close FROM cached),
news AS (SELECT d FROM (SELECT * FROM revised EXCEPT SELECT * FROM cached)),
told AS (SELECT (SELECT count(*) FROM cached) AS cached, (SELECT count(*) FROM kept) AS rows, (SELECT count(DISTINCT year(d)) FROM cached) AS years, (SELECT count(DISTINCT year(d)) FROM news) AS new_years,
                (SELECT max(d) FROM cached) < (SELECT needed FROM ends) AS behind, EXISTS (SELECT * FROM kept WHERE day >= (SELECT min(d) FROM news)) AS met)"""


@query(
    f"""WITH {REFRESH}
SELECT 0 AS step, 'no_scores' AS status, false AS fetched, false AS cache_written, false AS output_written, 0::BIGINT AS cache_years, cached, rows FROM told
UNION ALL SELECT 1, 'ok', rows > 0, cached > 0, rows > 0, years, cached, rows FROM told
UNION ALL SELECT 2, 'ok', behind, false, false, 0, cached, rows FROM told
UNION ALL SELECT 3, 'ok', true, false, false, 0, cached, rows FROM told
UNION ALL SELECT 4, 'ok', true, new_years > 0, met, new_years, cached, rows FROM told"""
)
def str05_cache_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04 to STR-06, STR-09, SNK-01, SET-05: no scores, a first fetch, a current cache, a forced one without news, a revised row that costs one year."""
    prices = written(_prices(spark, sf_dir), "prices")
    days = _scores(spark, sf_dir)
    start = days.join(prices, F.date_sub("day", 450) == F.col("date")).agg(F.min("day").alias("start"))
    end = feeds.bounds(prices, "date")[1]
    scores = written(days.join(F.broadcast(start)).where((F.col("day") >= F.col("start")) & (F.col("day") <= F.lit(end))).drop("start"), "scores")
    last = prices.where(F.col("date") <= F.lit(feeds.bounds(scores, "day")[1])).agg(F.max("date")).first()[0]
    root = f"{shared_root(spark)}/refresh-{uuid.uuid4().hex}"

    def fetch(start: date, end: date, change: float = 0.0) -> DataFrame:
        close = F.when(F.col("date") == F.lit(last), F.col("close") + change).otherwise(F.col("close"))
        return prices.withColumn("close", close).where((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))

    revised = lambda start, end: fetch(start, end, 1.0)
    steps = [(scores.limit(0), fetch, False), (scores, fetch, False), (scores, fetch, False), (scores, fetch, True), (scores, revised, True)]
    done = []
    for i, (rows, load, force) in enumerate(steps):
        got = refresh(spark, rows, f"{root}/cache", f"{root}/output", load, min(last, date(1990, 1, 1)), force=force)  # the last score is the day to be current at
        done.append((i, got["status"], got["fetched"] is not None, got["cache_written"], got["output_written"], len(got["cache_years"])))
    counts = [read_snapshot(spark, f"{root}/{x}").count() for x in ("cache", "output")]
    told = spark.createDataFrame(done, "step int, status string, fetched boolean, cache_written boolean, output_written boolean, cache_years long")
    return told.withColumns({"cached": F.lit(counts[0]).cast("long"), "rows": F.lit(counts[1]).cast("long")})


_DATE_COLUMNS = {
    "iso": "yyyy-MM-dd", "slashed": "yyyy/M/d", "packed": "yyyyMMdd", "month_first": "M/d/yyyy", "day_first": "d/M/yyyy", "dotted": "d.M.yyyy", "named": "d MMM yyyy", "dashed": "dd-MM-yyyy",
}
_FOUND = {"iso": "yyyy-M-d", "dashed": "d-M-yyyy"}
_FORMATS = "\nUNION ALL ".join(
    [f"SELECT '{c}' AS name, 'date' AS kind, '{_FOUND.get(c, p)}' AS format, count(*) AS parsed, 0::BIGINT AS conflicts, true AS decided FROM events" for c, p in _DATE_COLUMNS.items()]
    + [
        "SELECT 'mixed', 'date', 'M/d/yyyy', count_if(event_id % 4 <> 0 OR day(ts) <= 12), count_if(event_id % 4 = 0 AND day(ts) > 12), count_if(event_id % 4 <> 0 AND day(ts) > 12) <> count_if(event_id % 4 = 0 AND day(ts) > 12) FROM events",
        "SELECT 'early', 'date', 'M/d/yyyy', count_if(day(ts) <= 12), 0, false FROM events",
        "SELECT 'plain', 'number', '1234.5', count(value), 0, true FROM events",
        "SELECT 'comma', 'number', '1.234,5', count(value), 0, true FROM events",
        "SELECT 'type', 'text', NULL, 0, 0, true FROM events LIMIT 1",
    ]
).replace("UNION ALL SELECT 'type', 'text', NULL, 0, 0, true FROM events LIMIT 1", "UNION ALL (SELECT 'type', 'text', NULL, 0, 0, true FROM events LIMIT 1)")


@query(_FORMATS)
def prj09_inferred_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-09, SRC-10, SCA-26: formats of dates and numbers found from all values, conflicts counted, day or month first by evidence."""
    e = table(spark, sf_dir, "events")
    shown = lambda pattern: F.date_format("ts", pattern)
    texts = {c: shown(p) for c, p in _DATE_COLUMNS.items()} | {
        "mixed": F.when(F.col("event_id") % 4 == 0, shown("d/M/yyyy")).otherwise(shown("M/d/yyyy")),
        "early": F.when(F.day("ts") <= 12, shown("M/d/yyyy")),
        "plain": F.format_string("%.2f", "value"),
        "comma": F.translate(F.format_number(F.col("value") + 1000, 2), ",.", ".,"),
        "type": F.col("event_type"),
    }
    found = infer_formats(e.select(*(x.alias(c) for c, x in texts.items())))
    rows = [(c, x.kind, x.format, x.parsed, x.conflicts, x.decided) for c, x in found.items()]
    return spark.createDataFrame(rows, "name string, kind string, format string, parsed long, conflicts long, decided boolean")


@query(
    """SELECT ts::DATE AS day, arg_max(value, (date_trunc('second', ts), value)) AS value, max(date_trunc('second', ts)) AS source_time FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1"""
)
def src04_daily_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04: the strict daily file, written and read back."""
    e = table(spark, sf_dir, "events").where("value BETWEEN 0 AND 100")
    rows = e.select(F.date_format("ts", "yyyy-MM-dd"), F.col("value").cast("string"), F.lit(""), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).toDF(*DAILY_HEADER)
    path = f"{shared_root(spark)}/daily-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(path)
    return delimited.load_daily(spark, path).select("day", "value", "source_time")


@query("\nUNION ALL ".join(f"SELECT '{name}' AS name, '{name}' AS sep, count(*) AS rows, max(value) AS most, 0::BIGINT AS absent FROM events WHERE value BETWEEN 0 AND 100" for name in ("comma", "tab", "semicolon")))
def src10_sniffed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, SRC-11, SRC-22, PRJ-07: tables under other headers and separators, sniffed; an absent file is an empty table."""
    from ..session import new_folder

    names, found = {",": "comma", "\t": "tab", ";": "semicolon"}, []
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("Day"), F.date_format("ts", "HH:mm:ss").alias("Hour"), F.col("value").alias("Score"))
    for sep, name in names.items():
        path = new_folder(spark, f"sniffed-{name}")
        absent = delimited.load_intraday(spark, path).count()
        e.write.option("header", True).option("sep", sep).csv(path)
        facts = delimited.load_intraday(spark, path).agg(F.count("*").alias("rows"), F.max("value").alias("most"))
        found.append(facts.select(F.lit(name).alias("name"), F.lit(names[delimited.sniff(spark, path)]).alias("sep"), "rows", "most", F.lit(absent).cast("long").alias("absent")))
    return found[0].union(found[1]).union(found[2])


@query(
    """WITH a AS (SELECT value, ts, ts + to_seconds(event_id * 977 % 400000) AS checked, greatest(0, event_id * 977 % 400000)::BIGINT // 60 AS m FROM events)
SELECT strftime(checked, '%m/%d/%Y') AS "Date", strftime(checked, '%H:%M:%S') AS "Time", floor(value + 0.5)::INT AS "Value",
 CASE WHEN m < 1 THEN 'a minute ago' WHEN m = 1 THEN '1 minute ago' WHEN m < 60 THEN m || ' minutes ago' WHEN m // 60 = 1 THEN '1 hour ago' WHEN m // 60 < 24 THEN (m // 60) || ' hours ago'
 WHEN m // 1440 = 1 THEN '1 day ago' ELSE (m // 1440) || ' days ago' END AS "Site Updated" FROM a"""
)
def src20_sheet_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20: the sheet's rows under the expected header."""
    from ..sources.sinks import sheet_rows, with_header

    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(ts.alias("ts"), F.col("value").alias("v"), F.timestamp_seconds(F.unix_seconds(ts) + F.col("event_id") * 977 % 400000).alias("checked"))
    return with_header(sheet_rows(rows))
