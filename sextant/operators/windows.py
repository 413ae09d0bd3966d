"""Features over ordered series.

Every function takes the columns that tell series apart and those that order
one series; frames count rows, not days. A window over no key puts all rows
in one task: that is for series cut to daily grain. ``ranges.over_blocks`` runs
the same functions over series of any length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = math.sqrt(252)


@dataclass(frozen=True)
class Series:
    """How rows form series."""

    order: tuple[str, ...] = ("d",)
    keys: tuple[str, ...] = ()

    @property
    def base(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.base)

    def lead(self, x: Column, n: int = 1) -> Column:
        return F.lead(x, n).over(self.base)

    def diff(self, x: Column, n: int) -> Column:
        return x - self.lag(x, n)

    def change(self, x: Column, n: int) -> Column:
        """Fraction against n rows before; null over a zero or null."""
        return F.try_divide(x, self.lag(x, n)) - 1

    def rolling(self, aggregate, x: Column, rows: int, least: int | None = None) -> Column:
        """``aggregate`` over the last ``rows`` rows if ``least`` (default all) of them are known."""
        frame = self.base.rowsBetween(1 - rows, 0)
        return F.when(F.count(x).over(frame) >= (rows if least is None else least), aggregate(x).over(frame))

    def ahead(self, aggregate, x: Column, rows: int, whole: bool = True) -> Column:
        """``aggregate`` over the next ``rows`` rows, this one excluded; ``whole``: only if all are known."""
        frame = self.base.rowsBetween(1, rows)
        value = aggregate(x).over(frame)
        return F.when(F.count(x).over(frame) == rows, value) if whole else value

    def record(self, name: str) -> Column:
        """The largest value of a column so far."""
        return F.max(name).over(self.base.rowsBetween(Window.unboundedPreceding, 0))

    def position(self) -> Column:
        return F.row_number().over(self.base)

    def changed(self, x: Column) -> Column:
        """Whether the value differs from the row before; true on the first row unless null."""
        return ~x.eqNullSafe(self.lag(x))


def future_stat(series: Series, x: Column, horizon: int, op: str) -> Column:
    if op not in ("min", "max"):
        raise ValueError("op must be min or max")
    return series.ahead(F.min if op == "min" else F.max, x, horizon)


def sentiment_features(df: DataFrame, series: Series, value: str = "v") -> DataFrame:
    """Changes over 1 and 5 observations, averages and z-score over 5 and 20."""
    v = F.col(value)
    mean, std = series.rolling(F.avg, v, 20), series.rolling(F.stddev_samp, v, 20)
    return df.withColumns(
        {"change_1": series.diff(v, 1), "change_5": series.diff(v, 5), "sma_5": series.rolling(F.avg, v, 5), "sma_20": mean, "z_20": F.try_divide(v - mean, std)}
    )


def price_features(
    df: DataFrame, series: Series, past: Sequence[int] = (1, 5, 10, 20, 60, 252), averages: Sequence[int] = (20, 50, 200),
    forward: Sequence[int] = (1, 5, 10, 20, 60), path: Sequence[int] = (5, 20, 60),
) -> DataFrame:
    """Past and forward features in percent, full windows only, close to close."""
    close, previous = F.col("close"), series.lag(F.col("close"))
    percent = lambda a, b: (F.try_divide(a, b) - 1) * 100
    found: dict[str, Column] = {
        "previous_close": previous,
        "gap_pct": percent(F.col("open"), previous),
        "intraday_pct": percent(close, F.col("open")),
        "range_pct": F.try_divide(F.col("high") - F.col("low"), previous) * 100,
    }
    found |= {f"return_{n}": series.change(close, n) * 100 for n in past}
    for n in averages:
        found[f"sma_{n}"] = series.rolling(F.avg, close, n)
        found[f"vs_sma_{n}"] = percent(close, series.rolling(F.avg, close, n))
    found["high_252"] = series.rolling(F.max, close, 252)
    found["drawdown_252"] = percent(close, series.rolling(F.max, close, 252))
    found |= {f"forward_{n}": (F.try_divide(series.lead(close, n), close) - 1) * 100 for n in forward}
    for n in path:
        found[f"drawdown_next_{n}"] = percent(future_stat(series, F.col("low"), n, "min"), close)
        found[f"gain_next_{n}"] = percent(future_stat(series, F.col("high"), n, "max"), close)
    df = df.withColumns(found)
    return df.withColumn("volatility_20", series.rolling(F.stddev_samp, F.col("return_1"), 20) * YEAR)


def market_context(df: DataFrame, series: Series) -> DataFrame:
    """Backward features in fractions, partial windows allowed, and the regime."""
    from ..functions.scalars import regime

    close = F.col("close")
    off = lambda top: F.try_divide(close, top) - 1
    df = df.withColumns(
        {
            "ret_1": series.change(close, 1),
            "ret_5": series.change(close, 5),
            "ret_20": series.change(close, 20),
            "off_high_20": off(series.rolling(F.max, close, 20, 5)),
            "off_high_252": off(series.rolling(F.max, close, 252, 60)),
            "off_record": off(series.record("close")),
            "vs_sma_50": off(series.rolling(F.avg, close, 50, 20)),
            "vs_sma_200": off(series.rolling(F.avg, close, 200, 60)),
        }
    )
    return df.withColumn("vol_20", series.rolling(F.stddev_samp, F.col("ret_1"), 20, 10) * YEAR).withColumn("regime", regime(F.col("off_high_252"), F.col("vs_sma_200")))


def next_session_outcomes(df: DataFrame, series: Series, horizons: Sequence[int] = (1, 5, 10, 20, 60), path: int = 20) -> DataFrame:
    """Entry at the next session's open (close if there is none), outcomes as fractions of it."""
    entry = F.coalesce(series.lead(F.col("open")), series.lead(F.col("close")))
    found = {"entry_date": series.lead(F.col(series.order[0])), "entry_price": entry}
    found |= {f"fwd_{h}": F.try_divide(series.lead(F.col("close"), h), entry) - 1 for h in horizons}
    found[f"max_drawdown_{path}"] = F.try_divide(series.ahead(F.min, F.col("low"), path, whole=False), entry) - 1
    return df.withColumns(found)
