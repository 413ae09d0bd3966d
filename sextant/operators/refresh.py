"""Incremental refresh of a price cache and of the dataset built on it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PRICES
from ..sources.feeds import bounds, fetch_window
from ..sources.fetch import check_window
from ..sources.snapshots import manifest, read_snapshot, write_snapshot
from .dataset import combined_dataset
from .upsert import merge


def refresh(
    spark: SparkSession, scores: DataFrame, cache: str, output: str, fetch: Callable[[date, date], DataFrame], today: date, context: int = 450, overlap: int = 10, force: bool = False
) -> dict[str, object]:
    """Bring the cache at ``cache`` (rows as ``PRICES``) and the dataset at ``output`` up to date.

    Without scores nothing is fetched or written. Else ``fetch(start, end)`` is
    called for what the planner finds missing, half-open; fetched rows replace
    cached ones of the same date. Both are tables of versions kept by year: only
    years whose rows change are written. Returns what was done.
    """
    check_window(context, overlap)
    wanted = bounds(scores, "market_day")
    if wanted is None:
        return {"status": "no_scores", "fetched": None, "cache_written": False, "output_written": False, "cache_years": set(), "output_years": set()}
    old = read_snapshot(spark, cache) if manifest(spark, cache) else spark.createDataFrame([], PRICES)
    window = fetch_window(wanted, bounds(old, "date"), today, context, overlap, force)
    cached = set() if window is None else write_snapshot(merge(old, fetch(*window).select(*PRICES.names), ["date"]), cache, F.year("date"))
    prices = read_snapshot(spark, cache)
    output_years = write_snapshot(combined_dataset(scores, prices), output, F.year("score_date_utc"))
    return {"status": "ok", "fetched": window, "cache_written": bool(cached), "output_written": bool(output_years), "cache_years": cached, "output_years": output_years}
