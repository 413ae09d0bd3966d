"""JSON feeds, the fallback chain of sources, and the fetch planner."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..functions.decisions import Rules
from ..operators.selection import AnalogSettings
from ..operators.stats import DROPS, LEVELS, WINDOWS, study_specs
from ..operators.upsert import newest
from ..schema import DataValidationError


def record(text: Column, section: str) -> Column:
    """``day, score, rating, source_time`` of the object under ``section`` in a
    JSON text; the day is that of the text's own offset. Null if malformed."""
    got = F.from_json(text, f"`{section}` struct<score:string,rating:string,timestamp:string>")[section]
    score = f.valid_score(got["score"])
    fields_ = (f.own_date(got["timestamp"]).alias("day"), score.alias("value"), f.clean_rating(got["rating"], score).alias("rating"), f.from_iso(got["timestamp"]).alias("source_time"))
    return F.when(score.isNotNull() & fields_[0].isNotNull(), F.struct(*fields_))


def parse_record(payload: str) -> dict:
    """The current reading of one payload on the driver, as the feed's first object."""
    from datetime import datetime, timezone

    try:
        inner = next(iter(json.loads(payload).values()))
        when = datetime.fromisoformat(inner["timestamp"].replace("Z", "+00:00"))
        when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
        return {"day": when.date(), "value": float(inner["score"]), "rating": str(inner["rating"]), "source_time": when}
    except (StopIteration, KeyError, TypeError, ValueError, AttributeError) as e:
        raise ValueError("unexpected data format") from e


def parse_feed(payloads: DataFrame, section: str, history: str, start: date, keys: Sequence[str] = (), column: str = "payload") -> DataFrame:
    """The readings of JSON payloads, history and current one, newest for each day.

    ``history`` holds ``data``, a list of ``x`` (epoch milliseconds), ``y`` and
    ``rating``; items that are no objects or lack a valid score are skipped;
    days before ``start`` are dropped. ``keys`` are columns kept apart.
    """
    items = F.from_json(F.get_json_object(column, f"$.{history}.data"), "array<string>")
    item = F.from_json("item", "x double, y double, rating string")
    ts, score = f.to_second(f.from_millis(F.col("i.x"))), f.valid_score(F.col("i.y"))
    past = payloads.select(*keys, F.explode(items).alias("item")).select(*keys, item.alias("i")).select(
        *keys, F.to_date(ts).alias("day"), score.alias("value"), f.clean_rating(F.col("i.rating"), score).alias("rating"), ts.alias("source_time")
    )
    now = payloads.select(*keys, record(F.col(column), section).alias("r")).select(*keys, "r.*")
    rows = past.unionByName(now).where(F.col("value").isNotNull() & (F.col("day") >= F.lit(start)))
    return newest(rows, [*keys, "day"], ["source_time", "value"])


def first_source(loaders: Sequence[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame, str]:
    """The first loader that gives rows, and its label; all failures are told at the end."""
    said = []
    for label, load in loaders:
        try:
            df = load()
            if not df.isEmpty():
                return df, label
            said.append(f"{label}: no rows")
        except Exception as e:  # a source that cannot be read leads to the next
            said.append(f"{label}: {e}")
    raise DataValidationError("no source has data; " + "; ".join(said))


def fetch_window(
    wanted: tuple[date, date] | None, cached: tuple[date, date] | None, today: date, context: int = 450, overlap: int = 10, force: bool = False
) -> tuple[date, date] | None:
    """What to fetch, half-open, given the score days wanted and the session days cached.

    Nothing without scores, or if the cache reaches from ``context`` days before
    the first score to the last weekday that today or the last score needs. All
    of it if the cache is empty or starts later; else, also if forced, from
    ``overlap`` days before the cache's end, so that revised rows are read again.
    """
    if wanted is None:
        return None
    weekday = lambda day: day - timedelta(days=max(0, day.weekday() - 4))
    first, needed = wanted[0] - timedelta(days=context), max(weekday(today), weekday(wanted[1]))
    end = max(today, needed) + timedelta(days=2)
    if cached is None or cached[0] > first:
        return first, end
    if force or cached[1] < needed:
        return max(first, cached[1] - timedelta(days=overlap)), end
    return None


def bounds(df: DataFrame, column: str) -> tuple[date, date] | None:
    row = df.agg(F.min(column), F.max(column)).first()
    return None if row[0] is None else (row[0], row[1])


#: Names that option files use for some of the options below.
OPTION_NAMES = {
    "cooldown_calendar_days": "cooldown", "minimum_regime_sample": "least", "minimum_regime_baseline_sample": "baseline", "bootstrap_iterations": "iterations", "bootstrap_seed": "seed",
    "level_thresholds": "levels", "drop_thresholds": "drops", "analog_level_band": "level_band", "analog_change_band": "change_band", "analog_high_distance_band": "high_band",
    "analog_return_20d_band": "return_band", "analog_sma_200_band": "average_band", "analog_volatility_band": "volatility_band", "max_analog_distance": "farthest", "maximum_analogs": "most",
    "normal_minimum_excess_5d": "excess", "moderate_extension_minimum_excess_5d": "excess_moderate", "high_extension_minimum_excess_5d": "excess_high", "negative_excess_5d": "excess_negative",
    "normal_maximum_average_drawdown_20d": "drawdown", "high_extension_maximum_average_drawdown_20d": "drawdown_high",
}


@dataclass(frozen=True)
class Settings:
    """Options of the research run, the only place of their defaults, which are
    fixed values that results depend on; unknown keys of a file are ignored."""

    cooldown: int = 10
    least: int = 20
    baseline: int = 30
    iterations: int = 5000
    seed: int = 42
    horizons: tuple[int, ...] = (1, 5, 10, 20, 60)
    levels: tuple[float, ...] = LEVELS
    drop_windows: tuple[int, ...] = WINDOWS
    drops: tuple[float, ...] = DROPS
    level_band: float = AnalogSettings.level
    change_band: float = AnalogSettings.change
    high_band: float = AnalogSettings.high
    return_band: float = AnalogSettings.ret_20
    average_band: float = AnalogSettings.sma_200
    volatility_band: float = AnalogSettings.vol
    farthest: float = AnalogSettings.cap
    most: int = AnalogSettings.most
    excess: float = Rules.excess
    excess_moderate: float = Rules.excess_moderate
    excess_high: float = Rules.excess_high
    excess_negative: float = Rules.excess_negative
    drawdown: float = Rules.drawdown
    drawdown_high: float = Rules.drawdown_high

    def __post_init__(self) -> None:
        if not {5, 20} <= set(self.horizons):
            raise ValueError("horizons must include 5 and 20")
        if self.cooldown < 0 or self.iterations < 0:
            raise ValueError("cooldown and iterations must not be negative")

    @classmethod
    def load(cls, path: str) -> Settings:
        file = Path(path)
        if not file.exists():
            return cls()
        known = {x.name for x in fields(cls)}
        given = {OPTION_NAMES.get(k, k): v for k, v in json.loads(file.read_text()).items()}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})

    def analogs(self) -> AnalogSettings:
        return AnalogSettings(
            self.level_band, self.change_band, self.high_band, self.return_band, self.average_band, self.volatility_band, self.farthest, self.most, self.cooldown, self.least
        )

    def rules(self) -> Rules:
        return Rules(
            sample=self.least, baseline=self.baseline, excess=self.excess, excess_moderate=self.excess_moderate, excess_high=self.excess_high,
            excess_negative=self.excess_negative, drawdown=self.drawdown, drawdown_high=self.drawdown_high,
        )

    def specs(self) -> list[tuple[int, str, str, float]]:
        return study_specs(self.levels, self.drop_windows, self.drops)
