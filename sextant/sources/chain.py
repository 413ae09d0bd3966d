"""From files to both series: separate files, else a combined one, else a download."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..schema import DataValidationError
from .delimited import exists, parse_combined, parse_daily, parse_download, parse_prices, read_text
from .feeds import bounds
from .fetch import check_window

#: ``download(start, end)``: a history ``ts, open, high, low, close``, as ``parse_download`` takes it, of ``[start, end)``.
Download = Callable[[date, date], DataFrame]


def load_series(
    spark: SparkSession, root: str, today: date, scores: str | None = "scores.csv", prices: str | None = "prices.csv", combined: str | None = "combined.csv", download: Download | None = None, context: int = 450
) -> tuple[DataFrame, DataFrame, str]:
    """``day, value`` and ``date, open, high, low, close``, and which source they came from.

    A tier whose files are absent, cannot be read or have no rows leads to the next;
    if none is left, ``DataValidationError`` tells why each failed. A download
    begins ``context`` days before the first score and ends after ``today``."""
    check_window(context, 0)
    at = {name: f"{root.rstrip('/')}/{name}" for name in (scores, prices, combined) if name}
    there = {name: exists(spark, path) for name, path in at.items()}
    text = lambda name: read_text(spark, at[name], place="place")
    said: list[str] = []

    def read(name: str, parse: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        found = parse(text(name), "place")
        if found.isEmpty():
            raise DataValidationError(f"{name}: no rows")
        return found

    def tier(label: str, load: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, str] | None:
        try:
            return *load(), label
        except Exception as e:  # whatever is wrong with a tier, the next one is tried
            said.append(f"{label}: {str(e).splitlines()[0]}")
            return None

    def both() -> tuple[DataFrame, DataFrame]:
        daily, market = parse_combined(text(combined), order="place")
        if daily.isEmpty() or market.isEmpty():
            raise DataValidationError("no rows")
        return daily, market

    def fetched() -> tuple[DataFrame, DataFrame]:
        daily = read(scores, parse_daily)
        market = parse_download(download(bounds(daily, "day")[0] - timedelta(days=context), today + timedelta(days=1)))
        if market.isEmpty():
            raise DataValidationError("the download has no rows")
        return daily, market

    tiers = [
        (there.get(scores) and there.get(prices), f"{scores} + {prices}", lambda: (read(scores, parse_daily), read(prices, parse_prices))),
        (there.get(combined), f"{combined}", both),
        (there.get(scores) and download is not None, f"{scores} + download", fetched),
    ]
    for usable, label, load in tiers:
        if not usable:
            said.append(f"{label}: not there")
        elif found := tier(label, load):
            return found
    raise DataValidationError("no source has data; " + "; ".join(said))
