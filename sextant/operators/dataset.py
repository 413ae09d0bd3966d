"""The combined dataset: scores with features, joined to sessions with features and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..schema import DataValidationError
from .asof import asof_days, assert_matched, with_lag
from .windows import Series, price_features, sentiment_features

PAST, AVERAGES, FORWARD, PATH = (1, 5, 10, 20, 60, 252), (20, 50, 200), (1, 5, 10, 20, 60), (5, 20, 60)

#: Names of features under the two prefixes, and of outcomes, by the column that holds them.
SCORE_FEATURES = {"change_1": "change_1d", "change_5": "change_5d", "sma_5": "sma_5d", "sma_20": "sma_20d", "z_20": "zscore_20d"}
PRICE_FEATURES = {
    "previous_close": "previous_close",
    "return_1": "daily_return_pct",
    "gap_pct": "gap_pct",
    "intraday_pct": "intraday_return_pct",
    "range_pct": "range_pct",
    **{f"past_{n}": f"return_{n}d_pct" for n in PAST},
    **{k: v for n in AVERAGES for k, v in ((f"sma_{n}", f"sma_{n}d"), (f"vs_sma_{n}", f"close_vs_sma_{n}d_pct"))},
    "volatility_20": "volatility_20d_annualized_pct",
    "drawdown_252": "drawdown_from_252d_high_pct",
    "data_source": "data_source",
}
OUTCOMES = {
    **{f"forward_{n}": f"outcome_forward_return_{n}d_pct" for n in FORWARD},
    **{k: v for n in PATH for k, v in ((f"drawdown_next_{n}", f"outcome_forward_max_drawdown_{n}d_pct"), (f"gain_next_{n}", f"outcome_forward_max_gain_{n}d_pct"))},
}


def combined_dataset(scores: DataFrame, prices: DataFrame, score: str = "score", price: str = "price") -> DataFrame:
    """One row for each score, in 53 columns named under the prefixes ``score`` and ``price``.

    ``scores(day, market_day, source_time, value, rating)`` and ``prices`` as
    ``schema.PRICES``. Each score meets the latest session on or before its
    market day; without one ``DataValidationError`` names the first such days,
    also if there are no prices. Series are at daily grain: see ``windows``.
    """
    if prices.isEmpty():
        raise DataValidationError("there are no prices")
    featured = sentiment_features(scores, Series(("market_day", "source_time")), "value").withColumnsRenamed({k: f"score {k}" for k in SCORE_FEATURES})
    market = price_features(prices, Series(("date",)), PAST, AVERAGES, FORWARD, PATH)
    joined = with_lag(assert_matched(asof_days(featured, market, "market_day", "date"), "date", "market_day"), "market_day", "date")
    joined = joined.withColumns({f"past_{n}": F.col(f"return_{n}") for n in PAST})
    named = {
        f"{score}_date_utc": F.col("day"), f"{score}_market_date": F.col("market_day"), f"{score}_source_timestamp_utc": F.col("source_time"), f"{score}_value": F.col("value"), f"{score}_rating": F.col("rating"),
        **{f"{score}_{v}": F.col(f"`score {k}`") for k, v in SCORE_FEATURES.items()},
        f"{score}_day_of_week": f.day_name(F.col("market_day")),
        f"{price}_date": F.col("date"), f"{price}_match_lag_calendar_days": F.col("lag_days"), f"{price}_same_trading_day": F.col("same_day"), f"{price}_day_of_week": f.day_name(F.col("date")),
        **{f"{price}_{c}": F.col(c) for c in ("symbol", "open", "high", "low", "close", "adj_close", "volume")},
        **{f"{price}_{v}": F.col(k) for k, v in PRICE_FEATURES.items()},
        **{v: F.col(k) for k, v in OUTCOMES.items()},
    }
    return joined.select(*(x.alias(c) for c, x in named.items()))
