"""Alerts of a series: opened, told again on movement, closed; days are folded apart.

The first alert of a day always notifies, so what is told within a day depends on
that day alone. Whether an alert is open when a day begins follows from the last
reading before it that opens or closes it: a table of one row for each day and kind
carries it over. A series uses as many tasks as it has days.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators.ranges import same
from ..session import small_or_shuffled, temporary, unstage, written
from ..sources.fetch import check_alert

KINDS = ("low", "high")


def told_in_day(rows: list[tuple], held: dict[str, float | None], move: float) -> tuple[list[tuple], dict[str, bool | None]]:
    """One day of a series, ``(value, kind)`` in order: ``(place, kind, alert, open before, notify)``.

    ``held`` has the value last told of each kind on that day, if any, and is brought up to
    date. Open is None where it depends on the days before; also returned for the end."""
    open_now: dict[str, bool | None] = dict.fromkeys(KINDS)
    found = []
    for place, (value, kind) in enumerate(rows):
        if kind not in KINDS:
            found += [(place, k, False, open_now[k], False) for k in KINDS if open_now[k] is not False]
            open_now = dict.fromkeys(KINDS, False)
            continue
        notify = held[kind] is None or abs(value - held[kind]) >= move
        if notify:
            held[kind] = value
        if notify or open_now[kind] is not True:
            found.append((place, kind, True, open_now[kind], notify))
        open_now[kind] = True
    return found, open_now


def alerts(
    readings: DataFrame, state: DataFrame | None = None, key: str = "event_type", time: str = "ts", tie: str = "event_id", value: str = "v", low: float = 25, high: float = 75, move: float = 5
) -> tuple[DataFrame, DataFrame]:
    """What becomes of each series' alerts: rows ``key, time, tie, value, kind, action, notify``, and the state after them.

    A reading in an alert range opens that alert (``open``); readings while it is
    open give a row (``update``) only if they notify; a normal reading closes both
    (``close``). It notifies on the first alert of a day, else once the value has
    moved by ``move`` or more since that alert's last notification. Readings that are
    null or not finite are passed over. ``state``, one row for each key and kind
    (``key, kind, open, day, told``), is what came before."""
    check_alert(low, high)
    fields = [key, time, tie, value]
    rated = readings.select(*fields, f.alert_type(f.finite(F.col(value)), low, high).alias("kind"), F.to_date(time).alias("day")).where(f.finite(F.col(value)).isNotNull())
    types = dict(rated.dtypes)
    if state is None:
        state = readings.sparkSession.createDataFrame([], f"`{key}` {types[key]}, kind string, open boolean, day date, told double")
    match = lambda other: F.col(key).eqNullSafe(F.col(other))
    # a value told before counts on the first day of new alerts only, if that is its day
    first = rated.where(F.col("kind").isin(*KINDS)).groupBy(key, "kind").agg(F.min("day").alias("first"))
    going = first.join(state.select(F.col(key).alias("_k"), F.col("kind").alias("_kind"), F.col("day").alias("_day"), "told"), match("_k") & (F.col("kind") == F.col("_kind")) & (F.col("first") == F.col("_day")))
    pivoted = going.groupBy(key, F.col("first").alias("_first")).agg(*(F.max(F.when(F.col("kind") == k, F.col("told"))).alias(f"held_{k}") for k in KINDS))
    held = written(pivoted.withColumnRenamed(key, "_k"), "alerts-held")
    rows = rated.join(small_or_shuffled(held), match("_k") & (F.col("day") == F.col("_first")), "left").drop("_k", "_first")

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by([(time, "ascending"), (tie, "ascending")])
        told = {k: group[f"held_{k}"][0].as_py() for k in KINDS}
        found, ends = told_in_day(list(zip(group[value].to_pylist(), group["kind"].to_pylist(), strict=True)), told, move)
        seen = set(group["kind"].to_pylist())
        found += [(0, k, None, ends[k], False) for k in KINDS]  # the day's end
        places, kinds, alert, opened, notify = zip(*found, strict=True)
        marks = [None if a is not None else told[k] if k in seen else None for a, k in zip(alert, kinds, strict=True)]
        rest = {"kind": (kinds, pa.string()), "alert": (alert, pa.bool_()), "open": (opened, pa.bool_()), "notify": (notify, pa.bool_()), "told": (marks, pa.float64())}
        return pa.table({**{c: group[c].take(pa.array(places)) for c in (*fields, "day")}, **{c: pa.array(x, t) for c, (x, t) in rest.items()}})

    schema = ", ".join(f"`{c}` {types[c]}" for c in (*fields, "day")) + ", kind string, alert boolean, open boolean, notify boolean, told double"
    folded = written(rows.groupBy(key, "day").applyInArrow(fold, schema), "alerts-folded")
    ends = folded.where("alert IS NULL").select(key, "kind", "day", "open", "told")
    both = ends.withColumn("_new", F.lit(1)).unionByName(state.select(key, "kind", "day", "open", "told").withColumn("_new", F.lit(0)))
    before = Window.partitionBy(key, "kind").orderBy("_new", "day").rowsBetween(Window.unboundedPreceding, -1)
    days = both.withColumn("_open", F.last("open", ignorenulls=True).over(before)).where("_new = 1").select(F.col(key).alias("_k"), F.col("kind").alias("_kind"), F.col("day").alias("_day"), "_open")
    days = written(days, "alerts-days")
    on = same([F.col(key), F.col("kind"), F.col("day")], [F.col("_k"), F.col("_kind"), F.col("_day")])
    known = folded.where("alert IS NOT NULL").join(small_or_shuffled(days), on)
    opened = F.coalesce("open", "_open", F.lit(False))
    action = F.when(F.col("alert"), F.when(opened, "update").otherwise("open")).otherwise("close")
    said = known.where(F.when(F.col("alert"), F.col("notify") | ~opened).otherwise(opened)).select(*fields, "kind", action.alias("action"), "notify")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_new", "day")))
    told = F.when(F.col("told").isNotNull(), F.struct("day", "told"))
    after = both.withColumn("_told", told).groupBy(key, "kind").agg(latest("open").alias("open"), latest("_told").alias("_t"))
    return said, after.select(key, "kind", "open", F.col("_t.day").alias("day"), F.col("_t.told").alias("told"))


def alerts_sink(
    path: str, key: str = "event_type", time: str = "ts", tie: str = "event_id", value: str = "v", low: float = 25, high: float = 75, move: float = 5
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: ``alerts`` of a batch into ``path/rows/batch=N``, after the state
    of the batch before, ``path/state/N``; a repeated batch writes the same. States of
    batches before the last one are deleted."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kinds = dict(batch.dtypes)
        schema = f"`{key}` {kinds[key]}, kind string, open boolean, day date, told double"
        with temporary(spark):
            state = spark.read.schema(schema).parquet(f"{path}/state/{number - 1}") if number else None
            said, after = alerts(batch, state, key, time, tie, value, low, high, move)
            said.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            after.write.mode("overwrite").parquet(f"{path}/state/{number}")
        if number > 1:
            unstage(spark, f"{path}/state/{number - 2}")

    return write
