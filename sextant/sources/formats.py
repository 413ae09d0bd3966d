"""Formats of text columns, found from their values: how dates and numbers are written.

All candidates of all columns are tried in one aggregate. Which reading of
``3/4/2024`` holds is decided by the values that only one reading allows; what the
chosen format cannot read but another could is reported, as is a column that
nothing decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DATE_SHARE, NUMERIC_SHARE

#: Patterns of dates, the first of equals wins: without evidence the month comes first.
DATES = ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "MMM d, yyyy")
#: Ways to write numbers: what groups digits, and the decimal sign.
NUMBERS = {"1234.5": ("", "."), "1,234.5": (",", "."), "1.234,5": (".", ","), "1 234,5": (" ", ","), "1'234.5": ("'", ".")}
#: Readings of one text that differ only in which part is the month.
SWAPPED = {"M/d/yyyy": "d/M/yyyy", "d/M/yyyy": "M/d/yyyy", "M-d-yyyy": "d-M-yyyy", "d-M-yyyy": "M-d-yyyy"}


@dataclass(frozen=True)
class ColumnFormat:
    """``kind`` is date, number or text. Of ``known`` values that are not blank, ``parsed`` have
    the format; ``conflicts`` have another of its kind only. ``decided`` is false
    if as many values have the swapped reading."""

    kind: str
    format: str | None
    known: int
    parsed: int
    conflicts: int
    decided: bool


_PARTS = {"yyyy": r"\d{4}", "MMM": "[A-Z][a-z]{2}", "MM": r"(0[1-9]|1[0-2])", "dd": r"(0[1-9]|[12]\d|3[01])", "M": r"(0?[1-9]|1[0-2])", "d": r"(0?[1-9]|[12]\d|3[01])"}


def shape(pattern: str) -> str:
    """A regular expression of the texts of a pattern: what is plainly none need not be parsed."""
    return "^" + re.sub("yyyy|MMM|MM|dd|M|d|[.]", lambda m: _PARTS.get(m[0], r"\."), pattern) + "$"


def date_as(text: Column, pattern: str) -> Column:
    """The date in a text of one pattern, a time after it ignored; else null."""
    trimmed = F.trim(text.cast("string"))
    head = trimmed if " " in pattern else F.regexp_extract(trimmed, r"^([^T\s]*)", 1)
    return F.when(head.rlike(shape(pattern)), F.try_to_timestamp(head, F.lit(pattern)).cast("date"))


def number_as(text: Column, way: str) -> Column:
    """The number in a text of one way: a sign or brackets, a currency sign and a percent sign may
    stand around it, of which only the sign and the brackets count; else null."""
    group, point = NUMBERS[way]
    bare = F.regexp_replace(F.trim(text.cast("string")), r"^([+-]?)[$€£]\s?|\s?%$", "$1")
    negative = bare.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(bare, r"^\(|\)$", "")
    g, p = (f"\\{x}" if x in ".'" else x for x in (group, point))
    whole = rf"\d{{1,3}}({g}\d{{3}})+" if group else r"\d+"
    fits = bare.rlike(rf"^[+-]?({whole}|\d+)({p}\d*)?([eE][+-]?\d+)?$")
    plain = F.replace(F.replace(bare, F.lit(group)) if group else bare, F.lit(point), F.lit("."))
    found = plain.try_cast("double")
    return F.when(fits, F.when(negative, -found).otherwise(found))


def infer_formats(df: DataFrame) -> dict[str, ColumnFormat]:
    """The format of each column, in one pass over all. A column is a date if enough values
    have a date's format, else a number if enough have a number's; blanks do not count."""
    if not df.columns:
        return {}
    # a row for each column and value, so that each test is in the plan once, however many columns
    texts = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("x")) for i, c in enumerate(df.columns)))))
    text = F.col("x")
    tests = {f"d{j}": date_as(text, p).isNotNull() for j, p in enumerate(DATES)} | {f"n{j}": number_as(text, w).isNotNull() for j, w in enumerate(NUMBERS)}
    tried = texts.where(F.trim(text) != "").select("i", *(F.coalesce(t, F.lit(False)).alias(name) for name, t in tests.items()))
    some = {letter: F.greatest(*(F.col(f"{letter}{j}") for j in range(len(names)))) for letter, names in (("d", DATES), ("n", NUMBERS))}
    counts = tried.groupBy("i").agg(F.count("*").alias("k"), *(F.count_if(name).alias(name) for name in tests), *(F.count_if(x).alias(f"{letter}a") for letter, x in some.items()))
    rows = {r["i"]: r.asDict() for r in counts.collect()}  # a row a column
    found = {}
    for i, c in enumerate(df.columns):
        row = rows.get(i, {})
        known = row.get("k", 0)
        found[c] = ColumnFormat("text", None, known, 0, 0, True)
        for kind, letter, names, share in (("date", "d", DATES, DATE_SHARE), ("number", "n", list(NUMBERS), NUMERIC_SHARE)):
            hits = {name: row.get(f"{letter}{j}", 0) for j, name in enumerate(names)}
            best = max(hits, key=hits.get)
            if known and row[f"{letter}a"] >= share * known:
                decided = best not in SWAPPED or hits[best] != hits[SWAPPED[best]]
                found[c] = ColumnFormat(kind, best, known, hits[best], row[f"{letter}a"] - hits[best], decided)
                break
    return found


def parsed(text: Column, fmt: ColumnFormat) -> Column:
    if fmt.kind == "text":
        return text
    return date_as(text, fmt.format) if fmt.kind == "date" else number_as(text, fmt.format)


def normalised(df: DataFrame, formats: dict[str, ColumnFormat] | None = None, decided: bool = False) -> DataFrame:
    """All columns as plain text: dates as yyyy-MM-dd, numbers with a point; what has not the
    column's format is null. So tables of any format can go to the parsers of
    ``delimited``. With ``decided``, a column that nothing decides raises."""
    formats = formats or infer_formats(df)
    unclear = [c for c, x in formats.items() if not x.decided]
    if decided and unclear:
        raise ValueError(f"day or month first is not decided: {', '.join(unclear)}")
    return df.select(*(parsed(F.col(f"`{c}`"), formats[c]).cast("string").alias(c) for c in df.columns))
