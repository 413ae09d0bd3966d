"""Events kept apart in time, for any number of events at timestamp grain.

The daily forms in ``selection`` fold the days of a calendar in one row. Here
no task holds more than a block of times: the greedy chain is followed by
successor pointers and pointer doubling, and the greedy choice of the nearest
goes on in all buckets of time at once, in rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_folder, small_or_shuffled, temporary, written
from .ranges import BLOCK_ROWS, carried, in_order, joined, positioned, same

#: Gaps of time that a bucket of the greedy choice spans at most.
SPAN = 4096


def micros(time: str | Column) -> Column:
    """Microseconds of a date or timestamp; a whole number stays as it is."""
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def _successors(times: DataFrame, keys: Sequence[str], gap: int, parts: int | None) -> DataFrame:
    """``keys, _pos, _t, _next``: of each distinct time of a series, the place of the first that is ``gap`` or more after it.

    Times and times to reach are sorted together, those to reach first; how many
    times lie before one is its place."""
    placed = written(positioned(in_order(times, [*keys, "_t"], parts), keys).select(*keys, "_t", "_pos", "_size"), "times")
    reach = placed.select(*keys, (F.col("_t") + gap).alias("_x"), F.lit(0).alias("_here"), "_pos", "_t", "_size")
    both = placed.select(*keys, F.col("_t").alias("_x"), F.lit(1).alias("_here"), F.lit(None).cast("long").alias("_pos"), F.lit(None).cast("long").alias("_t"), "_size").unionByName(reach)
    rows = in_order(both, [*keys, "_x", "_here"], parts).withColumn("_p", F.shiftright("_at", 33))
    before = joined(rows, carried(rows, keys, "_p", {"_n": F.sum("_here")}).drop("_n"), keys, "_p")
    inside = Window.partitionBy(*keys, "_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    found = before.withColumn("_next", F.coalesce("_before__n", F.lit(0)) + F.sum("_here").over(inside)).where("_here = 0")
    return found.select(*keys, "_t", "_pos", F.when(F.col("_next") < F.col("_size"), F.col("_next")).alias("_next"))


def cooldown_times(events: DataFrame, gap: int, time: str = "ts", keys: Sequence[str] = (), rows: int = BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """The events that the greedy rule keeps: the first, then each at least ``gap``
    microseconds after the last kept time. All events of a kept time stay.

    Events without time are dropped; without a gap all others stay. Within a
    block of ``rows`` times, a pass from the end tells where a chain that comes by
    leaves the block. These exits, few as chains run together, are doubled until
    the chain from the first time is known: log2 of the number of blocks rounds.
    """
    known = events.where(F.col(time).isNotNull())
    if gap <= 0:
        return known
    spark = events.sparkSession
    held = new_folder(spark, "kept-times")
    with temporary(spark):
        times = known.select(*keys, micros(time).alias("_t")).distinct()
        nexts = _successors(times, keys, gap, parts).withColumn("_block", F.floor(F.col("_pos") / rows).cast("long"))
        nexts = written(nexts, "successors")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nexts.select(*keys).schema)
        lead = f"{kinds}, " if keys else ""

        def exits(group: pa.Table) -> pa.Table:
            group = group.sort_by("_pos")
            first, following = group["_pos"][0].as_py(), group["_next"].to_pylist()
            leave: list[int | None] = [None] * len(following)
            for i in range(len(following) - 1, -1, -1):
                j = following[i]
                leave[i] = j if j is None or j - first >= len(following) else leave[j - first]
            return group.select([*keys, "_pos"]).append_column("_exit", pa.array(leave, pa.int64()))

        def walk(group: pa.Table, entry: pa.Table) -> pa.Table:
            group = group.sort_by("_pos")
            if not len(entry) or not len(group):
                return group.slice(0, 0).select([*keys, "_t"])
            first, following, kept = group["_pos"][0].as_py(), group["_next"].to_pylist(), []
            at = entry["_pos"][0].as_py() - first
            while at is not None and at < len(following):
                kept.append(at)
                at = None if following[at] is None else following[at] - first
            return group.select([*keys, "_t"]).take(pa.array(kept, pa.int64()))

        out = written(nexts.groupBy(*keys, "_block").applyInArrow(exits, f"{lead}_pos long, _exit long"), "exits")
        ends = out.where("_exit IS NOT NULL")
        named = lambda df, *names: df.select(*(F.col(k).alias(f"_j_{k}") for k in keys), *names)
        on = lambda a, b: same([F.col(k) for k in keys], [F.col(f"_j_{k}") for k in keys]) & (F.col(a) == F.col(b))
        entries = named(ends.select(*keys, "_exit").distinct().union(out.where("_pos = 0").select(*keys, "_pos")).distinct(), F.col("_exit").alias("_e"))
        jumps = written(ends.join(small_or_shuffled(written(entries, "entries")), on("_pos", "_e"), "left_semi"), "jumps")
        reached = written(out.where("_pos = 0").select(*keys, "_pos"), "reached")
        while True:
            far = named(jumps, F.col("_pos").alias("_from"), F.col("_exit").alias("_to"))
            ahead = written(reached.join(small_or_shuffled(far), on("_pos", "_from")).select(*keys, F.col("_to").alias("_pos")), "ahead")
            if ahead.isEmpty():
                break
            reached = written(reached.union(ahead), "reached")
            jumps = written(jumps.join(small_or_shuffled(far), on("_exit", "_from")).select(*keys, "_pos", F.col("_to").alias("_exit")), "jumps")
        reached = reached.withColumn("_block", F.floor(F.col("_pos") / rows).cast("long"))
        kept = nexts.groupBy(*keys, "_block").cogroup(reached.groupBy(*keys, "_block")).applyInArrow(walk, f"{lead}_t long")
        named(kept, "_t").write.parquet(held)
    kept = spark.read.schema(named(kept, "_t").schema).parquet(held)
    return known.join(small_or_shuffled(kept), same([F.col(k) for k in keys], [F.col(f"_j_{k}") for k in keys]) & (micros(time) == F.col("_t")), "left_semi")


def _thinned(times: DataFrame, kept: DataFrame, gap: int, most: int | None) -> tuple[DataFrame, DataFrame]:
    """One step of the greedy choice that holds no rows: the times left open, and those kept.

    Time is cut into cells of one gap, of which each keeps one time at most. A kept
    time reaches three cells: the nearest ``3 * most`` of the cells' nearest hold
    ``most`` kept ones, where those already kept count whole, and what is farther goes.
    A cell's nearest is kept if those of the cells beside it are farther; what lies
    within a gap of it goes.
    """
    t, low = F.col("_t"), F.col("_low")
    cell = t - F.pmod(t, F.lit(gap))
    beside = lambda c: F.explode(F.array(*(F.col(c) + i * gap for i in (-1, 0, 1)))).alias("_near")
    cells = written(times.groupBy(cell.alias("_cell")).agg(F.min(F.struct("_by", "_t")).alias("_low")), "cells")
    if most:
        counted = cells.select("_low", F.lit(1).alias("_n")).unionByName(kept.select(F.struct("_by", "_t").alias("_low"), F.lit(3).alias("_n")))
        before = Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, 0)  # over 3 * most rows
        last = counted.orderBy("_low").limit(3 * most).withColumn("_sum", F.sum("_n").over(before)).where(F.col("_sum") >= 3 * most).agg(F.min("_low")).first()[0]
        if last is not None:
            upto = lambda by, at: (F.col(by) < last["_by"]) | ((F.col(by) == last["_by"]) & (F.col(at) <= last["_t"]))
            times, kept, cells = times.where(upto("_by", "_t")), kept.where(upto("_by", "_t")), cells.where(upto("_low._by", "_low._t"))
    around = cells.select(beside("_cell"), "_cell", "_low").groupBy("_near").agg(F.min("_low").alias("_least"), F.min(F.when(F.col("_near") == F.col("_cell"), low)).alias("_low"))
    sure = around.where(low == F.col("_least")).select(F.col("_near").alias("_cell"), "_low._by", "_low._t").select(beside("_cell"), "_cell", "_by", "_t")
    side = lambda i, c: F.max(F.when(F.col("_cell") == F.col("_near") + i * gap, F.col(c)))
    reach = written(sure.groupBy("_near").agg(side(-1, "_t").alias("_left"), side(1, "_t").alias("_right"), side(0, "_t").alias("_own"), side(0, "_by").alias("_own_by")), "reach")
    clear = lambda c: F.col(c).isNull() | (F.abs(t - F.col(c)) >= gap)
    rest = times.join(small_or_shuffled(reach), cell == F.col("_near"), "left").where(F.col("_own").isNull() & clear("_left") & clear("_right"))
    return written(rest.select("_t", "_by"), "open"), kept.unionByName(reach.where("_own IS NOT NULL").select(F.col("_own").alias("_t"), F.col("_own_by").alias("_by")))


def nearest_apart_times(ranked: DataFrame, gap: int, most: int | None, time: str = "ts", by: str = "distance", span: int | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """Greedy: nearest first, each at least ``gap`` microseconds from all taken, at most ``most``.

    Equal distances go by time; rows of one time stand or fall together. Rows
    without time or distance take no part. More than ``rows`` candidates are first
    thinned, as long as that takes half of them. In a round every bucket of time, with
    a margin of one gap around it, takes its candidates by distance: one is kept
    if no nearer one within the gap is open, and goes if one is kept there. What
    hangs on a candidate beyond the margin stays open for the next round; each
    settles at least the nearest open one. Rounds end when none is open, or
    ``most`` kept ones are nearer than all that are. A bucket spans ``span`` gaps;
    unless given, so many that it holds about ``rows`` candidates, but one gap at least.
    """
    known = ranked.where(F.col(time).isNotNull() & F.col(by).isNotNull() & ~F.isnan(F.col(by).cast("double")))
    if gap <= 0:
        return known if most is None else known.orderBy(by, time).limit(most)
    spark = ranked.sparkSession
    held = new_folder(spark, "kept-nearest")

    def settle(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_by", "ascending"), ("_t", "ascending")])
        kept: dict[int, tuple[int, int]] = {}  # first and last time by cell of one gap
        opened: dict[int, tuple[int, int]] = {}

        def clear(cells: dict[int, tuple[int, int]], t: int) -> bool:
            at = t // gap
            return at not in cells and (at - 1 not in cells or cells[at - 1][1] <= t - gap) and (at + 1 not in cells or cells[at + 1][0] >= t + gap)

        def add(cells: dict[int, tuple[int, int]], t: int) -> None:
            first, last = cells.get(t // gap, (t, t))
            cells[t // gap] = min(first, t), max(last, t)

        states = []
        for t, home, was_kept in zip(*(group[c].to_pylist() for c in ("_t", "_home", "_kept")), strict=True):
            if was_kept:
                add(kept, t)
            elif not clear(kept, t):
                states.append("gone")
                continue
            elif home and clear(opened, t):
                add(kept, t)
                was_kept = True
            else:
                add(opened, t)
            states.append("kept" if was_kept else "open")
        stay = np.array([s != "gone" for s in states]) & group["_home"].to_numpy(zero_copy_only=False).astype(bool)
        found = group.select(["_t", "_by"]).append_column("_kept", pa.array([s == "kept" for s in states]))
        return found.filter(pa.array(stay))

    with temporary(spark):
        times = written(known.select(micros(time).alias("_t"), F.col(by).cast("double").alias("_by")), "times")
        sure, n = times.limit(0), times.count()
        while n > rows:
            times, sure = _thinned(times, sure, gap, most)
            before, n = n, times.count()
            if n > before // 2:
                break
        each = times.groupBy("_t").agg(F.min("_by").alias("_by")).withColumn("_kept", F.lit(False))
        found = written(each.unionByName(sure.withColumn("_kept", F.lit(True))), "nearest")
        if span is None:
            n, first, last = found.agg(F.count("*"), F.min("_t"), F.max("_t")).first()
            span = max(1, min(SPAN, (last - first) * rows // (gap * n))) if n else 1
        width = span * gap
        bucket = lambda t: F.floor(t / width).cast("long")
        while True:
            facts = found.agg(F.min(F.when(~F.col("_kept"), F.struct("_by", "_t"))).alias("nearest")).first()
            if facts["nearest"] is None:
                break
            near, at = facts["nearest"]
            ahead = found.where(F.col("_kept") & ((F.col("_by") < near) | ((F.col("_by") == near) & (F.col("_t") < at))))
            if most is not None and ahead.count() >= most:
                break
            t = F.col("_t")
            dealt = found.withColumn("_bucket", F.explode(F.sequence(bucket(t - gap + 1), bucket(t + gap - 1)))).withColumn("_home", F.col("_bucket") == bucket(t))
            found = written(dealt.groupBy("_bucket").applyInArrow(settle, "_t long, _by double, _kept boolean"), "nearest")
        kept = found.where("_kept").select("_t", "_by")
        (kept if most is None else kept.orderBy("_by", "_t").limit(most)).select(F.col("_t").alias("_k")).write.parquet(held)
    kept = spark.read.schema("_k long").parquet(held)
    return known.join(small_or_shuffled(kept), micros(time) == F.col("_k"), "left_semi")
