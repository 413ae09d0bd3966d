"""Delimited files: strict, coercing, and with inferred separators and roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators.upsert import newest
from ..schema import DAILY_HEADER, PRICES, DataValidationError, number, parse_date, pick_date, pick_numeric, plain_name, require, resolve, slug

SEPARATORS = (",", "\t", ";")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def sniff(spark: SparkSession, path: str, separators: Sequence[str] = SEPARATORS) -> str:
    """The separator that gives the header most columns; the first of ties."""
    head = spark.read.text(path).first()
    line = (head[0] if head else "").lstrip("﻿")
    return max(separators, key=line.count)


def read_text(spark: SparkSession, path: str, sep: str | None = None, names=slug, place: str | None = None) -> DataFrame:
    """All columns as strings, names made plain. Bad bytes are replaced.

    ``place`` adds a column of this name that orders rows as they stand in the
    files: give it as ``order`` to the parsers, so that the last row counts."""
    df = spark.read.options(header=True, sep=sep or sniff(spark, path), inferSchema=False, encoding="UTF-8", mode="PERMISSIVE").csv(path)
    plain = [F.col(f"`{c}`").alias(names(c.lstrip("﻿"))) for c in df.columns]
    if place is not None:
        plain.append(F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias(place))
    return df.select(*plain)


def load_daily(spark: SparkSession, path: str) -> DataFrame:
    """The strict daily file: exact header, any bad row fails, newest by source
    time for each day. An absent file is an empty table."""
    columns = ["day", "value", "rating", "source_time"]
    if not exists(spark, path):
        return spark.createDataFrame([], "day date, value double, rating string, source_time timestamp")
    head = spark.read.text(path).first()
    if head is None or head[0].lstrip("﻿").strip().split(",") != DAILY_HEADER:
        raise DataValidationError(f"unexpected header: {head[0] if head else ''}")
    raw = spark.read.options(header=True, mode="FAILFAST").schema("a string, b string, c string, d string").csv(path).toDF(*columns)
    return strict_daily(raw)


def strict_daily(raw: DataFrame) -> DataFrame:
    """Text rows ``day, value, rating, source_time``: blank values are skipped,
    anything else malformed or outside 0..100 raises; newest for each day."""
    rows = raw.where(F.trim("value") != "")
    score, day, ts = F.col("value").try_cast("double"), F.try_to_timestamp(F.trim("day"), F.lit("yyyy-MM-dd")).cast("date"), f.from_iso(F.col("source_time"))
    bad = ~F.coalesce(score.between(0, 100) & day.isNotNull() & ts.isNotNull(), F.lit(False))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad row: "), F.concat_ws(",", "day", "value", "source_time")))).otherwise(score)
    typed = rows.select(day.alias("day"), checked.cast("double").alias("value"), f.clean_rating(F.col("rating"), score).alias("rating"), ts.alias("source_time"))
    return newest(typed, ["day"], ["source_time", "value"])


#: Header names that parsers look for before they look at values, in order. Give others that your files have.
SCORE_NAMES = ("value", "score", "index", "index_value", "rating_value")
CLOSE_NAMES = ("close", "adj_close", "adjusted_close", "market_close", "price")


def _last(rows: DataFrame, key: str, order: str | None, rest: Sequence[str]) -> DataFrame:
    """Of each key the last row by ``order``; without one, by the values in ``rest``."""
    return newest(rows, [key], [*(["_order"] if order else []), *rest]).drop("_order")


def _places(df: DataFrame, order: str | None) -> list[str]:
    """The order column if it is a place in files: it plays no other role."""
    return [order] if order and df.schema[order].dataType.typeName() == "struct" else []


def parse_daily(df: DataFrame, order: str | None = None, date: str | None = None, value: str | None = None, names: Sequence[str] = SCORE_NAMES) -> DataFrame:
    """``day, value`` from any table of text: roles inferred unless named, bad or
    out-of-range rows dropped, the last by ``order`` for each day. A table
    without ``order`` has no last row: then the largest value stays."""
    skip = _places(df, order)
    date = date or pick_date(df.drop(*skip))
    if date is None:
        raise DataValidationError("no date column")
    value = value or pick_numeric(df, names, ["value", "score"], skip=[date, *skip])
    if value is None:
        raise DataValidationError("no value column")
    rows = df.select(parse_date(F.col(date)).alias("day"), number(F.col(value)).alias("value"), (F.col(order) if order else F.lit(0)).alias("_order"))
    return _last(rows.where("day IS NOT NULL AND value BETWEEN 0 AND 100"), "day", order, ["value"])


def parse_prices(df: DataFrame, order: str | None = None, names: Sequence[str] = CLOSE_NAMES) -> DataFrame:
    """``date, open, high, low, close`` from a table of text; absent open, high
    and low columns are the close; rows without date or close are dropped, other
    blanks stay null; the last for each date counts, as in ``parse_daily``."""
    skip = _places(df, order)
    date = pick_date(df.drop(*skip), ("date", "d"))
    close = pick_numeric(df, names, ["close"], 0, 1e12, skip=[*skip, *([date] if date else [])])
    if date is None or close is None:
        raise DataValidationError("no date or close column")
    price = {c: number(F.col(c if c in df.columns else close)) for c in ("open", "high", "low")} | {"close": number(F.col(close))}
    rows = df.select(parse_date(F.col(date)).alias("date"), *(x.alias(c) for c, x in price.items()), (F.col(order) if order else F.lit(0)).alias("_order"))
    return _last(rows.na.drop(subset=["date", "close"]), "date", order, ["close", "open", "high", "low"])


def parse_combined(df: DataFrame, score: str = "score", price: str = "price", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A wide table with ``{score}_date_utc, {score}_value`` and ``{price}_date, {price}_open..close``,
    split into both series. Name the prefixes that the file has."""
    prices = [f"{price}_{c}" for c in ("open", "high", "low", "close")]
    require(df, [f"{score}_date_utc", f"{score}_value", f"{price}_date", *prices])
    daily = parse_daily(df, order, date=f"{score}_date_utc", value=f"{score}_value")
    place = (F.col(order) if order else F.lit(0)).alias("_order")
    market = df.select(parse_date(F.col(f"{price}_date")).alias("date"), *(number(F.col(c)).alias(c.removeprefix(f"{price}_")) for c in prices), place)
    return daily, _last(market.na.drop(subset=["date", "close"]), "date", order, ["close", "open", "high", "low"])


def located(columns: Sequence[str], prefix: str) -> str | None:
    """The first column whose plain name is ``prefix`` or begins with it and an underscore."""
    return next((c for c in columns if slug(c) == prefix or slug(c).startswith(f"{prefix}_")), None)


def parse_download(raw: DataFrame) -> DataFrame:
    """``date, open, high, low, close`` of a downloaded history ``ts, ...`` whose columns
    begin with these names; missing ones are the close, rows without close are dropped."""
    close = located(raw.columns, "close")
    if close is None:
        raise DataValidationError("no close column")
    price = (number(F.col(f"`{located(raw.columns, c) or close}`")).alias(c) for c in ("open", "high", "low", "close"))
    rows = raw.select(F.to_date("ts").alias("date"), *price, F.col("ts").alias("_order"))
    return _last(rows.na.drop(subset=["close"]), "date", "ts", ["close", "open"])


def flat_columns(df: DataFrame, joined: bool = True) -> DataFrame:
    """Fields of struct columns as columns: ``outer_inner``, or ``outer`` alone for
    the first field of each if not ``joined``. Others stay."""
    found = []
    for field in df.schema:
        if field.dataType.typeName() != "struct":
            found.append(F.col(f"`{field.name}`"))
            continue
        inner = field.dataType.names if joined else field.dataType.names[:1]
        found += [F.col(f"`{field.name}`.`{x}`").alias(f"{field.name}_{x}" if joined else field.name) for x in inner]
    return df.select(*found)


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """The price cache; an absent file is an empty table, numbers are coerced."""
    if not exists(spark, path):
        return spark.createDataFrame([], PRICES)
    raw = require(read_text(spark, path, place="_order"), PRICES.names)
    rows = raw.select(F.to_date("date").alias("date"), "symbol", *(number(F.col(c)).alias(c) for c in PRICES.names[2:-1]), "data_source", "_order")
    return _last(rows.na.drop(subset=["date", "close"]), "date", "_order", ["close", "open", "high", "low"])


def normalise_history(raw: DataFrame, symbol: str, source: str, zone: str = f.MARKET_ZONE) -> DataFrame:
    """``ts`` and ``Open, High, Low, Close`` (with ``Adj Close``, ``Volume`` if there)
    as price rows: market-zone dates, coerced numbers, the last for each date."""
    require(raw, ["ts", "Open", "High", "Low", "Close"])
    adjusted = "Adj Close" if "Adj Close" in raw.columns else "Close"
    volume = number(F.col("Volume")) if "Volume" in raw.columns else F.lit(None).cast("double")
    rows = raw.select(
        f.market_date(F.col("ts"), zone).alias("date"), F.lit(symbol).alias("symbol"), *(number(F.col(c)).alias(c.lower()) for c in ("Open", "High", "Low", "Close")),
        number(F.col(f"`{adjusted}`")).alias("adj_close"), volume.alias("volume"), F.lit(source).alias("data_source"), F.col("ts").alias("_ts"),
    )
    return newest(rows.na.drop(subset=["date", "close"]), ["date"], ["_ts", "close", "open"]).drop("_ts")


#: Header names accepted for each role of an intraday table.
ALIASES = {"date": ("date", "day"), "time": ("time", "hour"), "value": ("value", "score", "index")}
CLOSING_TIME = "16:00:00"


def standard_intraday(raw: DataFrame, aliases: dict[str, Sequence[str]] = ALIASES) -> DataFrame:
    """``ts, value`` from a table of text by header aliases; a missing time
    column is the closing time, bad and out-of-range rows are dropped."""
    raw = raw.toDF(*(plain_name(c) for c in raw.columns))
    found = resolve(raw.columns, aliases)
    if not {"date", "value"} <= found.keys():
        raise DataValidationError("date and value columns are needed")
    time = F.col(found["time"]) if "time" in found else F.lit(CLOSING_TIME)
    day = f.us_date(parse_date(F.col(found["date"])))
    rows = raw.select(f.date_and_time(day, F.trim(time)).alias("ts"), number(F.col(found["value"])).alias("value"))
    return rows.where("ts IS NOT NULL AND value BETWEEN 0 AND 100")


def load_intraday(spark: SparkSession, path: str, aliases: dict[str, Sequence[str]] = ALIASES) -> DataFrame:
    """``standard_intraday`` of a file; an absent one is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], "ts timestamp, value double")
    return standard_intraday(read_text(spark, path, names=plain_name), aliases)


def merge_intraday(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows ``ts, value``, each once."""
    return old.unionByName(new).dropDuplicates(["ts", "value"])
