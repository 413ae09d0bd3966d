"""Text projections and sinks that write only what has changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as f


def daily_rows(readings: DataFrame) -> DataFrame:
    """``day, value, rating, source_time`` as the daily file's text."""
    return readings.select(
        F.date_format("day", "yyyy-MM-dd").alias("date"), f.score_text(F.col("value")).alias("value"), F.col("rating"), f.zulu(F.col("source_time")).alias("stamp")
    )


def text_rows(df: DataFrame) -> DataFrame:
    """Dates, timestamps and six-digit numbers as text, empty for null."""

    def shown(field) -> F.Column:
        col, kind = F.col(field.name), field.dataType.typeName()
        text = {"date": lambda: F.date_format(col, "yyyy-MM-dd"), "timestamp": lambda: f.zulu(col), "double": lambda: f.fixed("%.6f", f.finite(col))}.get(kind, lambda: col.cast("string"))()
        return F.coalesce(F.when(col.isNotNull(), text), F.lit("")).alias(field.name)

    return df.select(*(shown(x) for x in df.schema))


def intraday_rows(readings: DataFrame) -> DataFrame:
    """``ts, event_id, v`` as date, time, rounded value and place, newest first.

    A place counts the rows of later days, from a table of one row a day, and
    those before it on its own day: no task orders more than a day."""
    rows = readings.withColumn("_day", F.to_date("ts"))
    later = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("_day").agg(F.count("*").alias("_n")).select(F.col("_day").alias("_d"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    within = Window.partitionBy("_day").orderBy(F.desc("ts"), F.desc("event_id"))
    placed = rows.withColumn("_rank", F.row_number().over(within)).join(F.broadcast(days), F.col("_day").eqNullSafe(F.col("_d")))
    place = (F.col("_later") + F.col("_rank")).cast("int")
    return placed.select(f.us_date(F.col("ts")).alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"), f.half_up(F.col("v")).alias("value"), place.alias("place"))


def sheet_rows(readings: DataFrame, *keep: str) -> DataFrame:
    """``ts, v, checked`` as a sheet's row: padded date and clock of the check, rounded value, age."""
    c = F.col("checked")
    return readings.select(*keep, F.date_format(c, "MM/dd/yyyy").alias("date"), F.date_format(c, "HH:mm:ss").alias("time"), f.half_up(F.col("v")).alias("value"), f.age_text(F.col("ts"), c).alias("updated"))


#: Fixed value: the header of the sheet and of the intraday file.
SHEET_HEADER = ["Date", "Time", "Value", "Site Updated"]


def with_header(rows: DataFrame, header: Sequence[str] = SHEET_HEADER) -> DataFrame:
    """``rows`` under the expected header, whatever their columns were called."""
    return rows if rows.columns == list(header) else rows.toDF(*header)


def output_lines(title: Column, body: Column, kind: Column) -> Column:
    """Lines ``name=value``; a text of several lines stands between two marks."""
    return F.concat_ws("\n", F.concat(F.lit("alert_type="), kind), F.concat(F.lit("alert_title="), title), F.lit("alert_body<<END"), body, F.lit("END"))


def content_digest(df: DataFrame) -> str:
    """A digest of all rows, whatever their order."""
    row = df.select(F.xxhash64(*df.columns).alias("h"), F.xxhash64(F.lit(7), *df.columns).alias("g")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.sum(F.col("g").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()


def write_text(df: DataFrame, path: str, sep: str = ",", order: Sequence[str] = ()) -> None:
    """One delimited file with a header, for tables of daily size, in order."""
    rows = df.orderBy(*order) if order else df
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).option("lineSep", "\n").csv(path)


#: Fixed value: what the export of comparable events holds, if there.
ANALOG_COLUMNS = (
    "day", "v", "chg_1", "chg_3", "chg_5", "regime", "off_high_252", "ret_20", "vs_sma_200", "vol_20", "d", "entry_date", "entry_price",
    "fwd_1", "fwd_5", "fwd_10", "fwd_20", "fwd_60", "max_drawdown_20", "analog_distance",
)


def export_results(folder: str, study: DataFrame, analogs: DataFrame, events: DataFrame) -> None:
    """``event_study``, ``analogs`` and ``full_analysis`` as delimited files with headers."""
    write_text(study, f"{folder}/event_study", order=["ord"])
    write_text(analogs.select(*(c for c in ANALOG_COLUMNS if c in analogs.columns)), f"{folder}/analogs", order=["day"])
    write_text(events, f"{folder}/full_analysis", order=["day"])


def report_json(coverage: DataFrame, latest: DataFrame, decided: DataFrame, warnings: DataFrame, **facts: str) -> DataFrame:
    """One nested JSON document: ``facts`` such as the time of the run, then
    coverage, the latest reading, verdict and warnings. Unknown numbers, NaN and
    infinities too, are null."""
    said = warnings.agg(F.array_sort(F.collect_list("warning")).alias("warnings"))
    clean = lambda df: df.select(*((f.finite(F.col(c)).alias(c) if kind == "double" else F.col(c)) for c, kind in df.dtypes))
    one = said
    for name, df in (("coverage", coverage), ("latest", latest), ("verdict", decided)):
        one = one.join(F.broadcast(clean(df).select(F.struct("*").alias(name))))
    parts = [*(F.lit(v).alias(k) for k, v in facts.items()), "coverage", "latest", "verdict", "warnings"]
    return one.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))


def version_json(generated: str, build: str) -> str:
    """The small document by which readers see that there is a new report."""
    return json.dumps({"generated_at": generated, "build_id": build}, indent=2)
