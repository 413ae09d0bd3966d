"""Summaries of outcomes: event study, Wilson floor, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import apply_cooldown


def win_rate(x: Column) -> Column:
    return F.avg(F.when(x.isNotNull(), (x > 0).cast("double")))


def wilson_floor(successes: Column, total: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson score interval, at least 0; null without trials."""
    n, p = total.cast("double"), F.try_divide(successes.cast("double"), total.cast("double"))
    centre = p + z * z / (2 * n)
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(total > 0, F.greatest(F.lit(0.0), (centre - margin) / (1 + z * z / n)))


def outcome_measures(five: str = "fwd_5", twenty: str = "fwd_20", drawdown: str = "max_drawdown_20") -> list[Column]:
    return [
        F.count(five).alias("n"), win_rate(F.col(five)).alias("win5"), F.avg(five).alias("mean5"), F.median(five).alias("median5"),
        F.avg(twenty).alias("mean20"), F.min(five).alias("worst5"), F.avg(drawdown).alias("drawdown"),
    ]


#: The study's score levels, the windows of its drops and their sizes.
LEVELS, WINDOWS, DROPS = (15, 20, 25, 30, 35, 40, 50), (1, 3, 5), (5, 10, 15, 20)


def study_specs(levels: Sequence[float] = LEVELS, windows: Sequence[int] = WINDOWS, drops: Sequence[float] = DROPS) -> list[tuple[int, str, str, float]]:
    """Order, label, column and upper bound of each group."""
    rows = [(f"score <= {x:g}", "v", float(x)) for x in levels]
    rows += [(f"{w}-obs drop >= {x:g}", f"chg_{w}", -float(x)) for w in windows for x in drops]
    return [(i, *r) for i, r in enumerate(rows)]


def event_study(events: DataFrame, specs: Sequence[tuple[int, str, str, float]] | None = None, cooldown: int = 10) -> DataFrame:
    """Outcomes of events in overlapping groups, each thinned by its own cooldown.

    One scan: every event is tested against the few specs, which are an array
    in the plan; groups without events keep a row with count 0. The cooldown
    may keep events without outcome; they are not counted.
    """
    specs = list(specs or study_specs())
    spark = events.sparkSession
    table = spark.createDataFrame([(i, label) for i, label, _, _ in specs], "ord int, label string")
    tests = F.array_compact(F.array(*(F.when(F.col(c) <= bound, F.lit(i)) for i, _, c, bound in specs)))
    hits = events.select("day", "fwd_5", "fwd_20", "max_drawdown_20", F.explode(tests).alias("ord"))
    measured = apply_cooldown(hits, cooldown, "day", ["ord"]).groupBy("ord").agg(*outcome_measures())
    mean = events.agg(F.avg("fwd_5").alias("_mean"))
    return (
        table.join(measured, "ord", "left")
        .join(F.broadcast(mean))
        .select("ord", "label", F.coalesce("n", F.lit(0)).alias("n"), "win5", "mean5", "median5", "mean20", "worst5", "drawdown", (F.col("mean5") - F.col("_mean")).alias("excess5"))
    )


def bootstrap_means(values: DataFrame, side: str, iterations: int, seed: int) -> DataFrame:
    """Means of resamples: ``iter, mean``. Draws come from md5 of seed, side,
    iteration and position, so every engine and rerun draws the same.

    ``values(x)`` is one small sample (a few dozen events). An iteration is a row
    that draws and averages within itself: nothing is exploded or shuffled.
    """
    known = values.where("x IS NOT NULL").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    rows = values.sparkSession.range(iterations).withColumnRenamed("id", "iter").join(F.broadcast(known)).where(F.size("xs") > 0)

    def drawn(position: Column) -> Column:
        code = F.md5(F.concat_ws(":", F.lit(seed), F.lit(side), F.col("iter"), position))
        return F.get("xs", (F.conv(F.substring(code, 1, 8), 16, 10).cast("long") % F.size("xs")).cast("int"))

    draws = F.transform(F.sequence(F.lit(0), F.size("xs") - 1), drawn)
    return rows.select("iter", (F.aggregate(draws, F.lit(0.0), lambda total, x: total + x) / F.size("xs")).alias("mean"))


def bootstrap_excess(a: DataFrame, b: DataFrame, iterations: int = 5000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """One row ``ci_low, ci_high`` of the difference of resampled means; null unless both have two values."""
    both = bootstrap_means(a, "a", iterations, seed).alias("p").join(bootstrap_means(b, "b", iterations, seed).alias("q"), "iter")
    edge = (1 - confidence) / 2
    ci = both.select((F.col("p.mean") - F.col("q.mean")).alias("x")).agg(F.percentile("x", F.lit(edge)).alias("lo"), F.percentile("x", F.lit(1 - edge)).alias("hi"))
    sizes = a.agg(F.count("x").alias("na")).join(F.broadcast(b.agg(F.count("x").alias("nb"))))
    enough = (F.col("na") >= 2) & (F.col("nb") >= 2)
    return sizes.join(F.broadcast(ci)).select(F.when(enough, F.col("lo")).alias("ci_low"), F.when(enough, F.col("hi")).alias("ci_high"))


def gap_count(df: DataFrame, date: str = "day", days: int = 7) -> DataFrame:
    from .windows import Series

    series = Series((date,))
    gap = F.datediff(F.col(date), series.lag(F.col(date)))
    return df.select(gap.alias("gap")).agg(F.count_if(F.col("gap") > days).alias("gaps"), F.max("gap").alias("longest"))


def verdict_summary(analogs: DataFrame, baseline: DataFrame, current: DataFrame, interval: DataFrame) -> DataFrame:
    """One row for ``decisions.decide``: measures of analogs, their excess, the interval, the market's extension."""
    from ..functions.scalars import extension, extension_points

    found = analogs.agg(*outcome_measures(), F.count_if(F.col("fwd_5") > 0).alias("wins"))
    base = baseline.agg(F.count("fwd_5").alias("baseline"), F.avg("fwd_5").alias("base5"))
    points = extension_points(F.col("off_high_252"), F.col("vs_sma_50"), F.col("ret_20"), F.col("vs_sma_200"))
    market = current.select(points.alias("points"), extension(points).alias("extension"))
    one = found.join(F.broadcast(base)).join(F.broadcast(market)).join(F.broadcast(interval))
    return one.withColumn("excess", F.col("mean5") - F.col("base5")).withColumn("wilson", wilson_floor(F.col("wins"), F.col("n"))).withColumnRenamed("n", "sample")
