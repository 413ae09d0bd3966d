"""Streams of readings: append on change, newest for each day, merge on arrival."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import Series
from ..session import unstage
from ..sources.snapshots import upsert_snapshot


def changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "v", unit: str | None = None, before: DataFrame | None = None) -> DataFrame:
    """Rows whose value differs from the row before in its series.

    With ``unit``, ``order`` begins with a time, and a window holds one unit of a
    key, however hot the key; the last value before it comes from a table of
    one row for each key and unit. ``before``, one row of ``keys`` and ``value`` for each
    key, comes before all of ``df`` (with ``unit`` only)."""
    if unit is None:
        return df.withColumn("_c", Series(tuple(order), tuple(keys)).changed(F.col(value))).where("_c").drop("_c")
    rows = df.withColumn("_unit", F.date_trunc(unit, order[0]))
    units = rows.groupBy(*keys, "_unit").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    units = units.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_unit").alias("_u"), Series(("_unit",), tuple(keys)).lag(F.col("_last")).alias("_before"))
    if before is not None:
        old = before.select(*(F.col(k).alias(f"_o_{k}") for k in keys), F.struct(value).alias("_old"))
        match = F.lit(True)
        for k in keys:
            match = match & F.col(f"_k_{k}").eqNullSafe(F.col(f"_o_{k}"))
        units = units.join(old, match, "left").withColumn("_before", F.coalesce("_before", "_old")).drop("_old", *(f"_o_{k}" for k in keys))
    inside = Series(tuple(order), (*keys, "_unit"))
    rows = rows.withColumns({"_first": inside.position() == 1, "_lag": inside.lag(F.col(value))})
    same = F.col("_unit").eqNullSafe(F.col("_u"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    earlier = F.when(F.col("_first"), F.col("_before")[value]).otherwise(F.col("_lag"))
    return rows.join(units, same).where(~F.col(value).eqNullSafe(earlier)).select(*df.columns)


def changes_sink(path: str, key: str = "event_type", time: str = "ts", tie: str = "event_id", value: str = "v", unit: str = "day") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows that differ from the one before, into ``path/rows/batch=N``.

    Rows of a batch are compared in time order, a ``unit`` of a key in one window; the
    first of a key with its last row of the batches before (``path/state/N``, of which
    the last two stay). A repeated batch writes the same."""
    fields = [key, time, tie, value]

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(*fields)
        before = batch.sparkSession.read.schema(rows.schema).parquet(f"{path}/state/{number - 1}") if number else None
        changes(rows, [key], (time, tie), value, unit, before).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        both = rows.withColumn("_place", F.lit(1))
        both = both if before is None else both.unionByName(before.withColumn("_place", F.lit(0)))
        last = both.groupBy(key).agg(F.max_by(F.struct(time, tie, value), F.struct("_place", time, tie)).alias("_r")).select(key, "_r.*")
        last.write.mode("overwrite").parquet(f"{path}/state/{number}")
        if number > 1:
            unstage(batch.sparkSession, f"{path}/state/{number - 2}")

    return write


def newest_sink(path: str, key: str = "event_type", time: str = "ts", tie: str = "event_id", value: str = "v") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream of readings: the newest of each key and day in the
    table of versions ``path/rows``. A batch is merged into the days that it has rows of, and no
    others are read or written; the table is all the state there is, so a row may be late by any time."""

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.select(key, F.to_date(time).alias("day"), time, tie, value)
        upsert_snapshot(rows, f"{path}/rows", [key, "day"], [time, tie], F.col("day"))

    return write


#: Parts of a table that is merged into, unless a column tells them apart.
BUCKETS = 64


def upsert_sink(path: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS, part: Column | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merge a batch into the table of versions at ``path``.

    Its parts are ``part``, which must follow from the keys, such as a day; else a hash
    of the keys. Only parts with keys of the batch are read, only those whose
    rows change are written, and readers see all of a batch or nothing. Late rows
    count; a repeated batch, or one that ended halfway, gives the same table."""

    def write(batch: DataFrame, _: int) -> None:
        upsert_snapshot(batch, path, keys, order, F.pmod(F.xxhash64(*keys), F.lit(buckets)) if part is None else part)

    return write
