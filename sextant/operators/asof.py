"""As-of joins as equi-joins or window functions; never a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DataValidationError
from .windows import Series


def asof_days(left: DataFrame, right: DataFrame, left_day: str = "day", right_day: str = "d", keys: Sequence[str] = (), how: str = "left") -> DataFrame:
    """Each left row with the latest right row on or before its day.

    The right side's rows are valid from their day to the day before the next;
    each is spread over these days, up to the last left day, and the join is an
    equality on the day. Right days must be unique within the keys; columns of
    both sides must differ but for the keys. No tolerance: any age matches.
    """
    end = left.agg(F.max(left_day).alias("_end"))
    series = Series((right_day,), tuple(keys))
    spread = (
        right.withColumn("_next", series.lead(F.col(right_day)))
        .join(F.broadcast(end))
        .withColumn("_until", F.coalesce(F.date_sub("_next", 1), F.greatest(F.col(right_day), F.col("_end"))))
        .withColumn("_day", F.explode(F.sequence(F.col(right_day), F.col("_until"))))
        .drop("_next", "_end", "_until")
    )
    on = F.col(left_day) == F.col("_day")
    for k in keys:
        spread = spread.withColumnRenamed(k, f"_{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(spread, on, how).drop("_day", *(f"_{k}" for k in keys))


def asof_times(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: Sequence[str] = (), unit: str = "day") -> DataFrame:
    """As ``asof_days`` for timestamps: both sides in one window, right rows first at equal times.

    A window holds one ``unit`` of a key, however hot the key; what was last
    before it comes from a table of one row for each key and unit. Columns that
    are no times have no units: there a window holds a key.
    """
    payload = [c for c in right.columns if c not in keys]
    kind = right.select(F.struct(*payload)).schema[0].dataType
    both = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_r")).unionByName(
        right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*payload).alias("_r")), allowMissingColumns=True
    )
    timed = left.schema[left_time].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    both = both.withColumn("_unit", F.date_trunc(unit, "_t") if timed else F.lit(0))
    units = both.groupBy(*keys, "_unit").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    units = units.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_unit").alias("_u"), F.last("_last", ignorenulls=True).over(before).alias("_before"))
    within = Window.partitionBy(*keys, "_unit").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_r", F.last("_r", ignorenulls=True).over(within)).where("_side = 1")
    same = F.col("_unit").eqNullSafe(F.col("_u"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    found = seen.join(units, same, "left").withColumn("_r", F.coalesce("_r", "_before"))
    return found.select(*left.columns, *(F.col("_r")[c].alias(c) for c in payload))


def assert_matched(joined: DataFrame, right_column: str, left_day: str) -> DataFrame:
    """Raise with the first unmatched days, if any."""
    missing = [str(r[0]) for r in joined.where(F.col(right_column).isNull()).select(left_day).orderBy(left_day).take(5)]
    if missing:
        raise DataValidationError(f"no session on or before: {', '.join(missing)}")
    return joined


def with_lag(joined: DataFrame, left_day: str, right_day: str) -> DataFrame:
    lag = F.datediff(F.col(left_day), F.col(right_day))
    return joined.withColumns({"lag_days": lag, "same_day": lag == 0})
