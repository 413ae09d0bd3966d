"""Newest and last row for each key, and merging new rows into old."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row with the largest ``order`` columns.

    One aggregation with partial results before the shuffle. Give enough
    columns to break ties: else which of equal rows stays is not defined.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union in which, of a key's rows, the largest ``order`` wins and new rows win ties."""
    both = old.withColumn("_prio", F.lit(0)).unionByName(new.withColumn("_prio", F.lit(1)), allowMissingColumns=True)
    return newest(both, keys, [*order, "_prio"]).drop("_prio")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows, repeats included, in any order."""
    columns = a.columns
    if set(columns) != set(b.columns):
        return False
    b = b.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
