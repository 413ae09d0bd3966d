"""Decision rules over one-row summaries: gates, supports, action, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Thresholds; the defaults are fixed values that results depend on."""

    sample: int = 20
    high_sample: int = 25
    baseline: int = 30
    excess: float = 0.0025
    excess_moderate: float = 0.0030
    excess_high: float = 0.0040
    excess_negative: float = -0.0025
    drawdown: float = -0.04
    drawdown_high: float = -0.03
    win: float = 0.60
    win_low: float = 0.45
    supports: int = 3
    confident: int = 30


def _holds(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _count(*tests: Column) -> Column:
    total = F.lit(0)
    for t in tests:
        total = total + _holds(t).cast("int")
    return total


def decide(summary: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Add requirements, gates, supports, action, tone and confidence.

    ``summary`` has ``sample, baseline, win5, mean5, median5, mean20, drawdown,
    excess, ci_low, ci_high, extension``. Unknown values fail their test.
    """
    high, moderate = F.col("extension") == "High", F.col("extension") == "Moderate"
    tier = lambda a, b, c: F.when(high, a).when(moderate, b).otherwise(c)
    need = summary.withColumns(
        {
            "need_sample": F.when(high, max(rules.sample, rules.high_sample)).otherwise(rules.sample),
            "need_excess": tier(rules.excess_high, rules.excess_moderate, rules.excess),
            "need_drawdown": F.when(high, rules.drawdown_high).otherwise(rules.drawdown),
        }
    )
    gates = need.withColumns(
        {
            "ok_sample": _holds(F.col("sample") >= F.col("need_sample")),
            "ok_baseline": _holds(F.col("baseline") >= rules.baseline),
            "ok_excess": _holds(F.col("excess") >= F.col("need_excess")),
            "ok_ci": _holds(F.col("ci_low") > 0),
            "supports": _count(F.col("win5") >= rules.win, F.col("median5") > 0, F.col("mean20") > 0, F.col("drawdown") >= F.col("need_drawdown")),
            "against": _count(F.col("win5") <= rules.win_low, F.col("mean5") < 0, F.col("median5") < 0, F.col("mean20") < 0),
        }
    )
    enough = F.col("ok_sample") & F.col("ok_baseline")
    buy = F.col("ok_excess") & F.col("ok_ci") & (F.col("supports") >= rules.supports)
    wait = _holds(F.col("excess") <= rules.excess_negative) & _holds(F.col("ci_high") < 0) & (F.col("against") >= rules.supports)
    # fixed values: the action strings
    action = F.when(~enough, "INSUFFICIENT EVIDENCE").when(buy, "BUY GRADUALLY").when(wait, "WAIT ON BUYING").otherwise("HOLD / NO EXTRA BUYING")
    tone = F.when(~enough, "neutral").when(buy, "positive").when(wait, "negative").otherwise("neutral")
    confidence = F.when(~enough, "Very low").when(F.col("sample") >= rules.confident, "Moderate").otherwise("Low")
    return gates.withColumns({"action": action, "tone": tone, "confidence": confidence})


def checks(decided: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row for each of eight checks: ``position, label, value, requirement, passed``."""
    rows = [
        ("Comparable events", "sample", F.col("need_sample").cast("double"), F.col("ok_sample")),
        ("Baseline events", "baseline", F.lit(float(rules.baseline)), F.col("ok_baseline")),
        ("Excess over baseline", "excess", F.col("need_excess"), F.col("ok_excess")),
        ("Lower confidence bound", "ci_low", F.lit(0.0), F.col("ok_ci")),
        ("Win rate", "win5", F.lit(rules.win), F.col("win5") >= rules.win),
        ("Median 5 sessions", "median5", F.lit(0.0), F.col("median5") > 0),
        ("Mean 20 sessions", "mean20", F.lit(0.0), F.col("mean20") > 0),
        ("Average drawdown", "drawdown", F.col("need_drawdown"), F.col("drawdown") >= F.col("need_drawdown")),
    ]
    table = F.array(
        *(
            F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), F.col(c).cast("double").alias("value"), need.alias("requirement"), _holds(ok).alias("passed"))
            for i, (label, c, need, ok) in enumerate(rows, 1)
        )
    )
    return decided.select(F.inline(table))


def warnings(facts: DataFrame) -> DataFrame:
    """``facts(gaps, completed, sample, need_sample, extension)`` -> a row for each warning that applies."""
    said = F.array(
        F.when(F.col("gaps") > 0, F.concat(F.lit("Score series has "), F.col("gaps").cast("string"), F.lit(" gaps of more than 7 days"))),
        F.when(F.col("completed") < 100, F.concat(F.lit("Only "), F.col("completed").cast("string"), F.lit(" completed signals"))),
        F.when(F.col("sample") < F.col("need_sample"), F.lit("Fewer comparable events than required")),
        F.when(F.col("extension") == "High", F.lit("Market is extended")),
    )
    return facts.select(F.explode(F.array_compact(said)).alias("warning"))
