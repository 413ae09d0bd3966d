"""Long ordered series: global positions, blocks with halos, two-level scans.

A series, keyed or not, is sorted over all partitions and numbered from counts
of one row a partition. Blocks of so many rows, each with copies of the rows
that its frames reach into, are then windows of their own: one series uses as
many tasks as it has blocks, and no task holds more than a block and its halo.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_or_shuffled, written
from .windows import Series

#: Rows of a block.
BLOCK_ROWS = 1 << 18
_HELD = ("_at", "_pos", "_size", "_block", "_home")


def same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Equal keys, null with null; true without keys."""
    test = F.lit(True)
    for x, y in zip(a, b, strict=True):
        test = test & x.eqNullSafe(y)
    return test


def in_order(df: DataFrame, by: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """``df`` sorted over all its partitions by ``by``, and written so: ``_at`` grows with the order.

    Rows equal in ``by`` lie in one partition: give enough columns to tell rows apart."""
    columns = [F.col(c) if isinstance(c, str) else c for c in by]
    dealt = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    return written(dealt.sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id()), "ordered")


def carried(rows: DataFrame, keys: Sequence[str], part: str, totals: dict[str, Column], carry: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Of each part of a series what the parts before it come to.

    ``totals`` are aggregates over the rows of a part, ``carry`` adds them up.
    Written: ``keys`` as ``_k_...``, ``_part``, the totals, and each as ``_before_...`` too.
    Only this table, of one row a part, is in a window of the series."""
    each = rows.groupBy(*keys, F.col(part).alias("_part")).agg(*(x.alias(name) for name, x in totals.items()))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.withColumns({f"_before_{name}": carry(F.col(name)).over(before) for name in totals})
    return written(sums.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in sums.columns if c not in keys)), "carried")


def joined(rows: DataFrame, table: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """``rows`` with what ``carried`` found for their part."""
    on = same([F.col(k) for k in keys], [F.col(f"_k_{k}") for k in keys]) & (F.col(part) == F.col("_part"))
    return rows.join(small_or_shuffled(table), on).drop("_part", *(f"_k_{k}" for k in keys))


def positioned(ordered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The result of ``in_order`` with ``_pos``, the place of a row in its series from 0, and ``_size``, the series' rows."""
    rows = ordered.withColumn("_p", F.shiftright("_at", 33))
    table = carried(rows, keys, "_p", {"_n": F.count("*"), "_first": F.min("_at")})
    sizes = written(table.groupBy(*(f"_k_{k}" for k in keys)).agg(F.sum("_n").alias("_size")), "sizes") if keys else table.agg(F.sum("_n").alias("_size"))
    placed = joined(rows, table.drop("_before__first"), keys, "_p")
    on = same([F.col(k) for k in keys], [F.col(f"_k_{k}") for k in keys])
    placed = placed.join(small_or_shuffled(sizes) if keys else F.broadcast(sizes), on)  # without keys: one row
    place = F.coalesce("_before__n", F.lit(0)) + F.col("_at") - F.col("_first")
    return placed.withColumn("_pos", place).drop("_p", "_n", "_first", "_before__n", *(f"_k_{k}" for k in keys))


@dataclass(frozen=True)
class BlockSeries(Series):
    """Columns over a block; what reaches beyond its halo comes from the blocks before."""

    def record(self, name: str) -> Column:
        return F.greatest(super().record(name), F.col(f"_before_{name}"))

    def position(self) -> Column:
        return (F.col("_pos") + 1).cast("int")


def over_blocks(
    df: DataFrame, series: Series, features: Callable[[DataFrame, Series], DataFrame], back: int = 0, ahead: int = 0, records: Sequence[str] = (),
    rows: int = BLOCK_ROWS, parts: int | None = None,
) -> DataFrame:
    """``features(df, series)``, computed in blocks of ``rows`` rows.

    ``back`` and ``ahead`` are the rows that the features reach to, features of
    features together; a halo may span several blocks. ``records`` names the
    columns of which running maxima are asked. The order must tell rows apart.
    Rows, and the values of frames, are those of the plain call."""
    keys = series.keys
    placed = positioned(in_order(df, [*keys, *series.order], parts), keys)
    block = lambda pos: F.floor(pos / rows).cast("long")
    first, last = block(F.greatest(F.col("_pos") - ahead, F.lit(0))), block(F.least(F.col("_pos") + back, F.col("_size") - 1))
    dealt = placed.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_home", F.col("_block") == block(F.col("_pos")))
    added: list[str] = []
    if records:
        table = carried(placed.withColumn("_b", block(F.col("_pos"))), keys, "_b", {c: F.max(c) for c in records}, F.max)
        dealt = joined(dealt, table.drop(*records), keys, "_block")
        added = [f"_before_{c}" for c in records]
    return features(dealt, BlockSeries(series.order, (*keys, "_block"))).where("_home").drop(*_HELD, *added)
