"""Queries over column functions and formatted projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as f
from . import standins as s
from .registry import query, table

RATING = "CASE WHEN {x} <= 24 THEN 'extreme fear' WHEN {x} <= 44 THEN 'fear' WHEN {x} <= 55 THEN 'neutral' WHEN {x} <= 75 THEN 'greed' WHEN {x} IS NOT NULL THEN 'extreme greed' END"


@query(
    f"""SELECT event_id, CASE WHEN value <= 25 THEN 'low' WHEN value >= 75 THEN 'high' WHEN value IS NOT NULL THEN 'normal' END AS alert, {RATING.format(x='value')} AS rating,
 CASE WHEN value < 25 THEN 0 WHEN value < 45 THEN 1 WHEN value < 55 THEN 2 WHEN value < 75 THEN 3 WHEN value IS NOT NULL THEN 4 END AS band FROM events"""
)
def sca02_alerts_and_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA-02, SCA-03, SCA-36."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", f.alert_type(v).alias("alert"), f.rating(v).alias("rating"), f.colour_band(v).alias("band"))


@query(
    f"""SELECT o_orderkey, coalesce(nullif(trim(replace(lower(trim(CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE replace(o_orderpriority, '-', '_') END)), '_', ' ')), ''), {RATING.format(x='(o_orderkey % 101)')}) AS rating,
 coalesce(nullif(array_to_string(list_transform(string_split(lower(trim(replace(o_orderpriority, '-', '_'))), ' '), lambda w: w), ' '), ''), '') AS plain FROM orders"""
)
def sca04_clean_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA-04, SCA-31."""
    raw = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.replace("o_orderpriority", F.lit("-"), F.lit("_")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", f.clean_rating(raw, F.col("o_orderkey") % 101).alias("rating"), F.lower(F.trim(F.replace("o_orderpriority", F.lit("-"), F.lit("_")))).alias("plain")
    )


@query(
    f"""WITH {s.MARKET}, p AS (SELECT d, regime, coalesce(off_high_252 >= -0.01, false)::INT + coalesce(ret_20 >= 0.05, false)::INT + coalesce(vs_sma_50 >= 0.03, false)::INT + coalesce(vs_sma_200 >= 0.12, false)::INT AS points FROM market)
SELECT d, points, CASE WHEN points >= 2 THEN 'High' WHEN points = 1 THEN 'Moderate' ELSE 'Normal' END AS extension,
 CASE regime WHEN 'near_high_uptrend' THEN 'Near-high uptrend' WHEN 'uptrend_off_high' THEN 'Uptrend, off high' WHEN 'correction' THEN 'Correction' WHEN 'downtrend' THEN 'Downtrend' ELSE 'Unknown' END AS regime_label FROM p"""
)
def sca06_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA-05, SCA-06, SCA-28."""
    points = f.extension_points(F.col("off_high_252"), F.col("vs_sma_50"), F.col("ret_20"), F.col("vs_sma_200"))
    return s.market(spark, sf_dir).select("d", points.alias("points"), f.extension(points).alias("extension"), f.regime_label(F.col("regime")).alias("regime_label"))


@query(
    """WITH a AS (SELECT event_id, greatest(0, epoch(ts + to_seconds(event_id * 977 % 400000)) - epoch(ts))::BIGINT // 60 AS m FROM events)
SELECT event_id, CASE WHEN m < 1 THEN 'a minute ago' WHEN m = 1 THEN '1 minute ago' WHEN m < 60 THEN m || ' minutes ago' WHEN m // 60 = 1 THEN '1 hour ago' WHEN m // 60 < 24 THEN (m // 60) || ' hours ago'
 WHEN m // 1440 = 1 THEN '1 day ago' ELSE (m // 1440) || ' days ago' END AS age FROM a"""
)
def sca07_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA-07."""
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    later = F.timestamp_seconds(F.unix_seconds(ts) + F.col("event_id") * 977 % 400000)
    return table(spark, sf_dir, "events").select("event_id", f.age_text(ts, later).alias("age"))


@query(
    r"""SELECT event_id, floor(value + 0.5)::INT AS shown, regexp_replace(printf('%.6f', value), '\.?0+$', '') AS text, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS zulu,
 date_trunc('second', ts) AS second, date_trunc('millisecond', ts) AS back, (CASE WHEN value BETWEEN 0 AND 100 THEN value END) AS valid, coalesce(printf('%.2f%%', value / 100 * 100), 'N/A') AS percent FROM events"""
)
def sca08_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA-08 to SCA-10, SCA-13, SCA-15, SCA-16, SCA-26, SCA-27."""
    v, ts = F.col("value"), F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", f.half_up(v).alias("shown"), f.score_text(v).alias("text"), f.zulu(ts).alias("zulu"), f.to_second(ts).alias("second"), f.from_millis(F.unix_millis(ts)).alias("back"),
        f.valid_score(v.cast("string")).alias("valid"), f.percent_text(v / 100, 2).alias("percent"),
    )


@query(
    """SELECT o_orderkey, CAST(timezone('America/New_York', timezone('UTC', o_orderdate + to_hours((o_orderkey % 24)::INT))) AS DATE) AS market_day,
 (o_orderdate::DATE - greatest(isodow(o_orderdate) - 5, 0)::INT) AS previous_weekday, month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) AS us,
 strftime(o_orderdate, '%m/%d/%Y') AS padded, dayname(o_orderdate) AS day_name, (o_orderdate::DATE + 450) AS ahead, date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::INT AS days FROM orders"""
)
def sca17_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA-17 to SCA-21, SCA-23 to SCA-25."""
    day = F.to_date("o_orderdate")
    ts = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 24 * 3600)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", f.market_date(ts).alias("market_day"), f.previous_weekday(day).alias("previous_weekday"), f.us_date(day).alias("us"), F.date_format(day, "MM/dd/yyyy").alias("padded"),
        f.day_name(day).alias("day_name"), F.date_add(day, 450).alias("ahead"), F.datediff(F.lit("2000-01-01").cast("date"), day).alias("days"),
    )


@query("SELECT event_id, date_trunc('second', ts) AS parsed, (ts + INTERVAL 5 HOUR)::DATE AS own_day, date_trunc('second', ts) AS joined FROM events")
def sca14_parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA-01, SCA-14, SCA-19, SCA-22: ISO text, the date in its own offset, date and time text."""
    ts = F.col("ts").cast("timestamp")
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    shifted = F.concat(F.date_format(F.timestamp_seconds(F.unix_seconds(ts) + 5 * 3600), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00"))
    return table(spark, sf_dir, "events").select(
        "event_id", f.from_iso(iso).alias("parsed"), f.own_date(shifted).alias("own_day"), f.date_and_time(F.date_format(ts, "M/d/yyyy"), F.date_format(ts, "H:mm:ss")).alias("joined")
    )


@query(
    r"""WITH t AS (
  SELECT page_id, html, regexp_extract_all(html, '[A-Za-z0-9]+|[^\sA-Za-z0-9]') AS w, list_filter(list_transform(string_split(html, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM pages),
p AS (
  SELECT *, list_filter(range(2, len(w) + 1), lambda i: lower(w[i]) = 'ago' AND lower(w[i - 1]) IN ('minute', 'minutes', 'hour', 'hours', 'day', 'days'))[1] AS e,
         list_filter(range(2, len(l) + 1), lambda i: regexp_matches(lower(l[i]), '^[+-]?[0-9]+ *points') AND regexp_matches(concat_ws(' ', CASE WHEN i > 2 THEN l[i - 2] END, l[i - 1]), '(?i)Stock *([0-9]{1,3})$'))[1] AS n FROM t)
SELECT page_id, md5(regexp_replace(html, '<[^>]+>', chr(10), 'g')) AS text_md5,
 CASE WHEN e IS NULL THEN '' ELSE concat_ws(' ', CASE WHEN e > 2 AND (regexp_matches(w[e - 2], '^[0-9]+$') OR (lower(w[e - 2]) = 'a' AND lower(w[e - 1]) = 'minute')) THEN w[e - 2] END, w[e - 1], w[e]) END AS age,
 CASE WHEN n IS NULL THEN '' ELSE regexp_extract(concat_ws(' ', CASE WHEN n > 2 THEN l[n - 2] END, l[n - 1]), '(?i)Stock *([0-9]{1,3})$', 1) END AS points,
 regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM p"""
)
def src18_html_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18, SCA-32, SCA-33."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(f.strip_tags(html)).alias("text_md5"), f.relative_age(html).alias("age"), f.value_before_points(html, "Stock").alias("points"), F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1).alias("title")
    )


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS doc FROM events")
def sca34_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA-34: decode and encode."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc")
    )


@query(
    r"""SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') AS slug, replace(replace(replace(lower(trim(p_name)), '&', 'and'), ' ', '_'), '-', '_') AS plain FROM part"""
)
def prj05_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05, PRJ-06 applied to values."""
    return table(spark, sf_dir, "part").select("p_partkey", schema.slug_column(F.col("p_name")).alias("slug"), schema.plain_column(F.col("p_name")).alias("plain"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(*(F.col(c).cast("string").alias(c) for c in ("event_id", "ts", "event_type", "value", "user_id")))


def _picked(shares: str, least: float) -> str:
    return f"""SELECT name, round(share, 6) AS share, share >= {least} AND row_number() OVER (ORDER BY share DESC, place) = 1 AS picked FROM (
  SELECT unnest(['event_id', 'ts', 'event_type', 'value', 'user_id']) AS name, unnest([1, 2, 3, 4, 5]) AS place, unnest({shares}) AS share FROM events)"""


def _told(spark: SparkSession, found: dict[str, float], picked: str | None) -> DataFrame:
    """One row for each column of a table."""
    return spark.createDataFrame([(c, round(x, 6), c == picked) for c, x in found.items()], "name string, share double, picked boolean")


@query(_picked("[avg((event_id BETWEEN 0 AND 100)::INT), 0, 0, avg(coalesce((value BETWEEN 0 AND 100)::INT, 0)), avg((user_id BETWEEN 0 AND 100)::INT)]", 0.75))
def prj08_numeric_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-08, AGG-12: the share of values in 0 to 100 by column, one pass, and the column picked by it."""
    df = _texts(spark, sf_dir)
    return _told(spark, schema.shares(df, lambda c: schema.number(c).between(0, 100)), schema.pick_numeric(df, []))


@query(_picked("[0, avg((ts IS NOT NULL)::INT), 0, 0, 0]", 0.6))
def prj09_date_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-09: the share of values that parse as dates by column, and the column picked by it."""
    df = _texts(spark, sf_dir)
    return _told(spark, schema.shares(df, lambda c: schema.parse_date(c).isNotNull()), schema.pick_date(df))


@query("SELECT event_id, value FROM events WHERE value BETWEEN 0 AND 100 AND event_type IS NOT NULL AND trim(event_type) <> '' AND ts::DATE >= (SELECT min(ts::DATE) + 7 FROM events)")
def flt01_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, FLT-03 to FLT-05, PRJ-01: range, blank, null and start-date filters."""
    e = table(spark, sf_dir, "events")
    start = e.agg(F.date_add(F.to_date(F.min("ts")), 7).alias("start"))
    return e.where("value BETWEEN 0 AND 100 AND trim(event_type) <> ''").na.drop(subset=["event_type"]).join(F.broadcast(start)).where("to_date(ts) >= start").select("event_id", "value")


@query(f"WITH {s.WALK}, {s.SENTIMENT} SELECT d, close, min(low) OVER () AS least, max(high) OVER () AS most FROM walk WHERE d >= (SELECT min(day) FROM sentiment)")
def flt11_visible_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11, AGG-16: sessions from the first score on, and their price range."""
    first = s.sentiment(spark, sf_dir).agg(F.min("day").alias("first"))
    seen = s.walk(spark, sf_dir).join(F.broadcast(first)).where("d >= first")
    ends = seen.agg(F.min("low").alias("least"), F.max("high").alias("most"))
    return seen.select("d", "close").join(F.broadcast(ends))


@query(f"WITH {s.SENTIMENT} SELECT strftime(day, '%Y-%m-%d') AS date, regexp_replace(printf('%.6f', v), '\\.?0+$', '') AS value, {RATING.format(x='v')} AS rating, strftime(day, '%Y-%m-%dT00:00:00Z') AS stamp FROM sentiment")
def snk01_daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01: the daily file's rows as text."""
    from ..sources.sinks import daily_rows

    return daily_rows(s.sentiment(spark, sf_dir).select("day", F.col("v").alias("value"), f.rating(F.col("v")).alias("rating"), F.col("day").cast("timestamp").alias("source_time")))


@query(
    """SELECT month(ts) || '/' || day(ts) || '/' || year(ts) AS date, strftime(ts, '%H:%M:%S') AS time, floor(value + 0.5)::INT AS value, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place
FROM events WHERE value BETWEEN 0 AND 100"""
)
def snk03_intraday_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: newest first, with the place that the file gives a row."""
    from ..sources.sinks import intraday_rows

    return intraday_rows(s.readings(spark, sf_dir).where("v BETWEEN 0 AND 100"))


@query(
    f"""WITH {s.SIGNALS} SELECT (SELECT count(*) FROM sentiment) AS scores, (SELECT count(*) FROM walk) AS sessions, count(*) AS signals, count(fwd_5) AS completed,
 strftime(min(day), '%Y-%m-%d') AS first, strftime(max(day), '%Y-%m-%d') AS last FROM signals"""
)
def snk05_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05, AGG-07: the report's coverage."""
    one = s.signals(spark, sf_dir).agg(
        F.count("*").alias("signals"), F.count("fwd_5").alias("completed"), F.date_format(F.min("day"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last")
    )
    counts = s.sentiment(spark, sf_dir).agg(F.count("*").alias("scores")).join(F.broadcast(s.walk(spark, sf_dir).agg(F.count("*").alias("sessions"))))
    return one.join(F.broadcast(counts)).select("scores", "sessions", "signals", "completed", "first", "last")


@query(
    f"""WITH {s.SENTIMENT}, a AS (SELECT day, v, CASE WHEN v <= 25 THEN 'low' WHEN v >= 75 THEN 'high' ELSE 'normal' END AS kind, {RATING.format(x='v')} AS rating FROM sentiment),
b AS (SELECT *, array_to_string(list_transform(string_split(rating, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label, regexp_replace(printf('%.4f', v), '\\.?0+$', '') AS shown FROM a)
SELECT day, CASE kind WHEN 'low' THEN 'Low score alert' WHEN 'high' THEN 'High score alert' ELSE 'Score update' END || ': ' || shown || ' (' || label || ')' AS title,
 'Score: ' || shown || chr(10) || 'Rating: ' || label || chr(10) || 'Date: ' || strftime(day, '%m/%d/%Y') || chr(10) || 'Thresholds: 25 and 75' AS body FROM b"""
)
def snk08_alert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-08, SCA-11, SCA-12, SCA-35."""
    v = F.col("v")
    return s.sentiment(spark, sf_dir).select("day", f.alert_title(v, f.rating(v), f.alert_type(v)).alias("title"), f.alert_body(v, f.rating(v), F.col("day"), 25, 75).alias("body"))


@query(
    """WITH a AS (SELECT event_id, value, ts, ts + to_seconds(event_id * 977 % 400000) AS checked, greatest(0, event_id * 977 % 400000)::BIGINT // 60 AS m FROM events)
SELECT event_id, strftime(checked, '%m/%d/%Y') AS date, strftime(checked, '%H:%M:%S') AS time, floor(value + 0.5)::INT AS value, CASE WHEN m < 1 THEN 'a minute ago' WHEN m = 1 THEN '1 minute ago' WHEN m < 60 THEN m || ' minutes ago' WHEN m // 60 = 1 THEN '1 hour ago' WHEN m // 60 < 24 THEN (m // 60) || ' hours ago'
 WHEN m // 1440 = 1 THEN '1 day ago' ELSE (m // 1440) || ' days ago' END AS updated FROM a"""
)
def snk07_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07, SNK-10, SRC-20: a sheet's rows under its header."""
    from ..sources.sinks import sheet_rows

    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", ts.alias("ts"), F.col("value").alias("v"), F.timestamp_seconds(F.unix_seconds(ts) + F.col("event_id") * 977 % 400000).alias("checked"))
    return sheet_rows(rows, "event_id")


@query(
    f"""WITH {s.SENTIMENT}, a AS (SELECT day, v, CASE WHEN v <= 25 THEN 'low' WHEN v >= 75 THEN 'high' ELSE 'normal' END AS kind, {RATING.format(x='v')} AS rating FROM sentiment),
b AS (SELECT *, array_to_string(list_transform(string_split(rating, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label, regexp_replace(printf('%.4f', v), '\\.?0+$', '') AS shown FROM a)
SELECT day, shown || ' (' || label || ', ' || strftime(day, '%Y-%m-%d') || ')' AS line, 'alert_type=' || kind || chr(10) || 'alert_title=t' || chr(10) || 'alert_body<<END' || chr(10) || 'b' || chr(10) || 'END' AS outputs FROM b"""
)
def snk09_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-08, SNK-09: the result as a line of text, and as lines of outputs."""
    from ..sources.sinks import output_lines

    v = F.col("v")
    return s.sentiment(spark, sf_dir).select("day", f.result_text(v, f.rating(v), F.col("day")).alias("line"), output_lines(F.lit("t"), F.lit("b"), f.alert_type(v)).alias("outputs"))
