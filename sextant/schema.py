"""Schemas of the daily tables, and inference of column roles from names and values."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DataValidationError(RuntimeError):
    """Input that breaks its contract."""


PRICES = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close", "volume")]
    + [T.StructField("data_source", T.StringType())]
)
# Fixed value: the header of the daily sentiment file.
DAILY_HEADER = ["Date", "Value", "Rating", "Source Timestamp UTC"]

#: Shares of parsed values that a column needs to pass for its role.
NUMERIC_SHARE, DATE_SHARE = 0.75, 0.6
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "yyyy/M/d")


def slug(name: str) -> str:
    """Lower case, runs of other characters to one underscore, none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def plain_name(name: str) -> str:
    """Trimmed and lower-cased, ``&`` as ``and``, blanks and hyphens as underscores."""
    return name.strip().lower().replace("&", "and").replace(" ", "_").replace("-", "_")


def slug_column(col: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(col)), "[^a-z0-9]+", "_"), F.lit("_"))


def plain_column(col: Column) -> Column:
    text = F.lower(F.trim(col))
    for old, new in (("&", "and"), (" ", "_"), ("-", "_")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def require(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise DataValidationError(f"missing columns: {', '.join(missing)}")
    return df


def resolve(columns: Sequence[str], aliases: dict[str, Sequence[str]]) -> dict[str, str]:
    """For each role the first alias that is a column; roles without one are left out."""
    return {role: hit for role, names in aliases.items() if (hit := next((n for n in names if n in columns), None))}


def parse_date(col: Column) -> Column:
    """A date in any of DATE_FORMATS, a time part ignored; else null."""
    text = F.trim(col.cast("string"))
    head = F.regexp_extract(text, r"^([^T\s]*)", 1)
    return F.coalesce(*(F.try_to_timestamp(head, F.lit(f)).cast("date") for f in DATE_FORMATS))


def number(col: Column) -> Column:
    """A finite number or null."""
    x = F.trim(col.cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def shares(df: DataFrame, test: Callable[[Column], Column]) -> dict[str, float]:
    """The share of rows that pass, for every column, in one pass."""
    row = df.agg(*(F.avg(F.coalesce(test(F.col(f"`{c}`")), F.lit(False)).cast("double")).alias(c) for c in df.columns)).first()
    return {c: row[c] or 0.0 for c in df.columns}


def pick_numeric(df: DataFrame, exact: Sequence[str], contains: Sequence[str] = (), low: float = 0, high: float = 100, skip: Sequence[str] = ()) -> str | None:
    """Exact name, then part of a name, then the best share of values in the
    range (the first of ties), at least NUMERIC_SHARE."""
    columns = [c for c in df.columns if c not in skip]
    for name in exact:
        if name in columns:
            return name
    for part in contains:
        for c in columns:
            if part in c:
                return c
    if not columns:
        return None
    hit = shares(df.select(*columns), lambda c: number(c).between(low, high))
    best = max(columns, key=lambda c: hit[c])
    return best if hit[best] >= NUMERIC_SHARE else None


def pick_date(df: DataFrame, exact: Sequence[str] = ("date",)) -> str | None:
    """A column named in ``exact`` or with ``date`` in its name whose values
    parse at DATE_SHARE or more, else the best of all at that share."""
    hit = shares(df, lambda c: parse_date(c).isNotNull())
    named = [c for c in df.columns if c in exact] + [c for c in df.columns if "date" in c and c not in exact]
    for c in named:
        if hit[c] >= DATE_SHARE:
            return c
    best = max(df.columns, key=lambda c: hit[c])
    return best if hit[best] >= DATE_SHARE else None
