"""Exact order statistics and the bootstrap for groups of any size.

``percentile`` keeps every distinct value of a group in one buffer, and a
resample of a large sample would gather it in one row. Here ranks are found by
histograms over the ordered bits of a double, finer in every pass, and resamples
are dealt to parts of the sample by binomial splits that every task draws alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_folder, small_or_shuffled, temporary, written
from .ranges import in_order, positioned, same

#: Bits of a double that a pass looks at: a histogram has at most 2 ** BITS bins for each rank.
BITS = 12
#: Values of a part of a sample, and resamples that a task draws.
PART, DRAWS = 1 << 16, 500


def ordered_bits(x: Column) -> Column:
    """A whole number for each double, in the same order; NaN last, -0.0 as 0.0."""
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x.cast("double") + 0.0).cast("long")
    return F.when(x.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits))


def quantiles(df: DataFrame, value: str, at: Sequence[float] = (0.5,), keys: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """One row for each group: ``keys``, and ``q0, q1, ...``, the exact quantiles at ``at``.

    Values between two ranks are interpolated, as ``percentile`` does. Nulls do not
    count; NaN is the largest value; a group without values has null quantiles;
    without keys there is one row, also for an empty table. A pass counts, in each
    bin of the next ``bits`` bits of a wanted rank, the values there, before any
    shuffle; a hot group is no more than its bins. Passes end once a bin holds
    one value, after 64 bits at the latest; each reads only what is left.
    """
    spark = df.sparkSession
    held = new_folder(spark, "quantiles")
    numbers = [f"q{i}" for i in range(len(at))]
    named = lambda rows, *columns: rows.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *columns)
    match = same([F.col(k) for k in keys], [F.col(f"_k_{k}") for k in keys])
    with temporary(spark):
        rows = written(df.select(*keys, F.col(value).cast("double").alias("_x"), ordered_bits(F.col(value)).alias("_b")), "bits")
        sizes = written(rows.groupBy(*keys).agg(F.count("_x").alias("_n")), "sizes")
        wanted = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("at")) for i, q in enumerate(at)))
        sides = F.array(*(F.struct(F.lit(i).alias("side"), f("at").cast("long").alias("_rank")) for i, f in enumerate((F.floor, F.ceil))))
        ranks = written(sizes.where("_n > 0").select(*keys, F.inline(wanted)).select(*keys, "i", "at", F.inline(sides)), "ranks")
        going = written(ranks.select(*keys, "_rank").distinct().withColumns({"_left": F.col("_rank"), "_prefix": F.lit(0).cast("long")}), "going")
        found = [ranks.limit(0).select(*keys, "_rank", F.lit(None).cast("double").alias("_value"))]
        left, prefix, shift = rows.where("_b IS NOT NULL"), F.lit(0).cast("long"), 64
        while not going.isEmpty():
            shift = max(0, shift - bits)
            digit = F.shiftright("_b", shift)
            bins = left.groupBy(*keys, prefix.alias("_p"), digit.alias("_digit")).agg(F.count("*").alias("_count"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
            below = Window.partitionBy(*keys, "_p").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
            bins = bins.withColumn("_before", F.coalesce(F.sum("_count").over(below), F.lit(0)))
            asked = named(going, "_rank", "_left", "_prefix")
            here = match & (F.col("_p") == F.col("_prefix")) & (F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_count"))
            chosen = written(bins.join(small_or_shuffled(asked), here).select(*keys, "_rank", "_left", "_digit", "_before", "_low", "_high"), "chosen")
            one = F.col("_low").eqNullSafe(F.col("_high"))
            found.append(chosen.where(one).select(*keys, "_rank", F.col("_low").alias("_value")))
            going = written(chosen.where(~one).select(*keys, "_rank", (F.col("_left") - F.col("_before")).alias("_left"), F.col("_digit").alias("_prefix")), "going")
            there = written(named(going, "_prefix").distinct(), "there")
            left, prefix = written(left.join(small_or_shuffled(there), match & (digit == F.col("_prefix")), "left_semi"), "left"), digit
        values = written(named(reduce(DataFrame.union, found), F.col("_rank").alias("_r"), "_value"), "values")
        placed = ranks.join(small_or_shuffled(values), match & (F.col("_rank") == F.col("_r")))
        low, high = (F.max(F.when(F.col("side") == i, F.col("_value"))) for i in (0, 1))
        part = F.max(F.col("at") - F.floor("at"))
        each = placed.groupBy(*keys, "i").agg(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias("_q"))
        wide = each.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, F.col("_q"))).alias(name) for i, name in enumerate(numbers)))
        if keys:
            wide = sizes.join(small_or_shuffled(written(named(wide, *numbers), "wide")), match, "left").select(*keys, *numbers)
        wide.write.parquet(held)
    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema), *(f"{name} double" for name in numbers)]
    return spark.read.schema(", ".join(kinds)).parquet(held)


def _share(seed: Sequence[int], size: int, part: int, wanted: int) -> int:
    """How many of the ``size`` draws of a resample fall on part ``wanted`` of the sample.

    The sample's parts are halved until one is left. How the draws of a node divide is
    a binomial draw seeded by the node, so all tasks divide them alike, and
    the shares of all parts add up to ``size``."""
    first, last, draws = 0, -(-size // part), size
    while last - first > 1:
        middle = (first + last) // 2
        rows, under = min(size, last * part) - first * part, (middle - first) * part
        left = int(np.random.default_rng([*seed, first, last]).binomial(draws, under / rows))
        first, last, draws = (first, middle, left) if wanted < middle else (middle, last, draws - left)
    return draws


def resampled_means(values: DataFrame, iterations: int, seed: int, side: int = 0, value: str = "x", part: int = PART, draws: int = DRAWS) -> DataFrame:
    """``iter, size, mean`` of resamples with replacement of all known values.

    The sorted sample is cut into parts of ``part`` values. A task has one part and
    ``draws`` resamples: of each it draws its share. Nothing else of the
    sample is in one place; a resample has exactly as many draws as the sample has
    values, and reruns agree. No values, no rows.
    """
    known = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), F.monotonically_increasing_id().alias("u"))
    placed = positioned(in_order(known, ["x", "u"])).select("x", "_size", F.floor(F.col("_pos") / part).cast("long").alias("part"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // draws))).alias("chunk")

    def draw(group: pa.Table) -> pa.Table:
        xs, size, here, chunk = np.sort(group["x"].to_numpy()), *(group[c][0].as_py() for c in ("_size", "part", "chunk"))
        numbers = range(chunk * draws, min(iterations, (chunk + 1) * draws))
        shares = [_share((seed, side, i), size, part, here) for i in numbers]
        sums = [float(xs[np.random.default_rng([seed, side, i, here]).integers(0, len(xs), n)].sum()) for i, n in zip(numbers, shares, strict=True)]
        return pa.table({"iter": pa.array(numbers, pa.int64()), "part": pa.array([here] * len(shares), pa.int64()), "n": pa.array(shares, pa.int64()), "total": pa.array(sums, pa.float64())})

    sums = placed.select("*", chunks).groupBy("part", "chunk").applyInArrow(draw, "iter long, part long, n long, total double")
    # totals are added in the order of the parts, so that reruns agree to the last bit
    each = sums.groupBy("iter").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("part", "total"))).alias("totals"))
    return each.select("iter", "size", (F.aggregate("totals", F.lit(0.0), lambda a, x: a + x["total"]) / F.col("size")).alias("mean"))


def resampled_excess(a: DataFrame, b: DataFrame, iterations: int = 5000, seed: int = 42, confidence: float = 0.95, value: str = "x", part: int = PART) -> DataFrame:
    """One row ``ci_low, ci_high`` of the difference of resampled means; null unless both have two values."""
    means = [resampled_means(df, iterations, seed, i, value, part).select("iter", F.col("mean").alias(f"mean_{i}"), F.col("size").alias(f"size_{i}")) for i, df in enumerate((a, b))]
    both = means[0].join(means[1], "iter").where((F.col("size_0") >= 2) & (F.col("size_1") >= 2))
    edge = (1 - confidence) / 2
    excess = F.col("mean_0") - F.col("mean_1")
    return both.agg(*(F.percentile(excess, F.lit(q)).alias(name) for q, name in ((edge, "ci_low"), (1 - edge, "ci_high"))))
