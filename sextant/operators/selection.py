"""Independent events, banded and nearest analogs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AnalogSettings:
    """Bands, scales and limits; the defaults are fixed values that results depend on."""

    level: float = 7.0
    change: float = 5.0
    high: float = 0.03
    ret_20: float = 0.05
    sma_200: float = 0.08
    vol: float = 0.08
    cap: float = 4.5
    most: int = 50
    cooldown: int = 10
    least: int = 20
    widen: float = 1.5
    missing: float = 1.5

    def strict(self) -> dict[str, float]:
        return {"v": self.level, "chg_5": self.change, "off_high_252": self.high, "ret_20": self.ret_20, "vs_sma_200": self.sma_200}

    def relaxed(self) -> dict[str, float]:
        return {"v": self.level, "chg_5": self.change, "off_high_252": self.high * self.widen, "ret_20": self.ret_20 * self.widen}

    def scales(self) -> dict[str, tuple[float, float]]:
        """Scale and weight of each part of the distance."""
        return {
            "v": (self.level, 1.0), "chg_5": (self.change, 1.0), "off_high_252": (self.high, 0.8), "ret_20": (self.ret_20, 0.7), "vs_sma_200": (self.sma_200, 0.6), "vol_20": (self.vol, 0.4)
        }


def cooldown_days(dates: Column, days: int) -> Column:
    """Greedy: of an array of dates, in order, each at least ``days`` after the last kept one."""
    if days <= 0:
        return F.array_sort(dates)
    start = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<date>").alias("kept"))
    take = lambda s, d: F.coalesce(F.datediff(d, s["last"]) >= days, F.lit(True))
    step = lambda s, d: F.when(take(s, d), F.struct(d.alias("last"), F.concat(s["kept"], F.array(d)).alias("kept"))).otherwise(s)
    return F.aggregate(F.array_sort(dates), start, step, lambda s: s["kept"])


def apply_cooldown(events: DataFrame, days: int, date: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """The rows that the greedy rule keeps, for each key.

    A key's candidate dates meet in one row, distinct days only (some tens of
    thousands in a century), then a semi-join finds their rows.
    """
    dates = events.groupBy(*keys).agg(F.collect_set(date).alias("_all"))
    kept = dates.select(*keys, F.explode(cooldown_days(F.col("_all"), days)).alias(date))
    return events.join(kept, [*keys, date], "left_semi")


def in_bands(events: DataFrame, current: DataFrame, bands: dict[str, float]) -> DataFrame:
    """Rows whose values lie within the bands around the one row of ``current``;
    an unknown current value leaves its band open."""
    named = current.select(*(F.col(c).alias(f"_c_{c}") for c in bands))
    joined = events.join(F.broadcast(named))
    test = F.lit(True)
    for c, band in bands.items():
        now = F.col(f"_c_{c}")
        test = test & (now.isNull() | F.coalesce(F.col(c).between(now - band, now + band), F.lit(False)))
    return joined.where(test).select(*events.columns)


def distance(events: DataFrame, current: DataFrame, settings: AnalogSettings) -> DataFrame:
    """Weighted distance to the current row: an unknown row value costs a fixed
    number of scales, an unknown current value leaves its part out."""
    scales = settings.scales()
    named = current.select(*(F.col(c).alias(f"_c_{c}") for c in scales))
    total = F.lit(0.0)
    for c, (scale, weight) in scales.items():
        now = F.col(f"_c_{c}")
        part = F.coalesce(F.abs(F.col(c) - now) / scale, F.lit(settings.missing)) * weight
        total = total + F.when(now.isNull(), 0.0).otherwise(part)
    return events.join(F.broadcast(named)).withColumn("analog_distance", total).select(*events.columns, "analog_distance")


def nearest_apart(ranked: DataFrame, settings: AnalogSettings, date: str = "day", by: str = "analog_distance") -> DataFrame:
    """Greedy: nearest first, each at least ``cooldown`` days from all taken, at most ``most``.

    A taken date rules out itself and ``cooldown`` - 1 dates on either side, so only
    so many of the nearest dates can matter for ``most``: these, a bounded number,
    meet in one row. ``spacing.nearest_apart_times`` is for times without that bound."""
    near = ranked.where(F.col(by) <= settings.cap)
    if settings.cooldown > 0:
        near = near.groupBy(date).agg(F.min(by).alias(by)).orderBy(by, date).limit(settings.most * (2 * settings.cooldown - 1))
    pairs = near.agg(F.array_sort(F.collect_list(F.struct(by, date))).alias("_all"))
    apart = lambda kept, d: F.forall(kept, lambda y: F.abs(F.datediff(d, y)) >= settings.cooldown)
    step = lambda kept, x: F.when((F.size(kept) < settings.most) & apart(kept, x[date]), F.concat(kept, F.array(x[date]))).otherwise(kept)
    kept = pairs.select(F.explode(F.aggregate("_all", F.array().cast("array<date>"), step)).alias(date))
    return ranked.join(kept, date, "left_semi")


def same_regime(events: DataFrame, current: DataFrame) -> DataFrame:
    """Completed events of the current regime."""
    now = current.select(F.col("regime").alias("_c_regime"))
    return events.where("fwd_5 IS NOT NULL AND regime IS NOT NULL").join(F.broadcast(now)).where("regime = _c_regime").select(*events.columns)


def strict_analogs(events: DataFrame, current: DataFrame, settings: AnalogSettings) -> DataFrame:
    found = apply_cooldown(in_bands(same_regime(events, current), current, settings.strict()), settings.cooldown)
    return found.orderBy("day").limit(settings.most)


def relaxed_analogs(events: DataFrame, current: DataFrame, settings: AnalogSettings) -> DataFrame:
    found = apply_cooldown(in_bands(same_regime(events, current), current, settings.relaxed()), settings.cooldown)
    return found.orderBy("day").limit(settings.most)


def nearest_analogs(events: DataFrame, current: DataFrame, settings: AnalogSettings) -> DataFrame:
    return nearest_apart(distance(same_regime(events, current), current, settings), settings)


def find_analogs(events: DataFrame, current: DataFrame, settings: AnalogSettings = AnalogSettings()) -> tuple[DataFrame, str]:
    """Strict bands if enough independent events, else relaxed ones, else the nearest.

    Two counts choose the branch. ``analog_distance`` is null but for the nearest.
    """
    blank = lambda df: df.withColumn("analog_distance", F.lit(None).cast("double"))
    strict = strict_analogs(events, current, settings)
    if strict.count() >= settings.least:
        return blank(strict), "strict"
    relaxed = relaxed_analogs(events, current, settings)
    if relaxed.count() >= settings.least:
        return blank(relaxed), "relaxed"
    return nearest_analogs(events, current, settings), "nearest"


def regime_baseline(events: DataFrame, current: DataFrame, settings: AnalogSettings = AnalogSettings()) -> DataFrame:
    return apply_cooldown(same_regime(events, current), settings.cooldown)
