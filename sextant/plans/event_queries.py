"""Queries over selected events: cooldown, event study, analogs, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions
from ..operators import large_stats, stats
from ..operators import selection as sel
from ..session import written
from ..sources.feeds import Settings
from . import standins as s
from .registry import query
from .series_queries import rounded

#: Wide bands, for which the strict and the relaxed branch have events.
WIDE = sel.AnalogSettings(level=60.0, change=90.0, high=0.5, ret_20=0.5, sma_200=0.5)
NARROW = sel.AnalogSettings()  # the defaults
OPTIONS = Settings()


def daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Signals and the current row: daily tables of a few thousand rows, written
    once for a query, as many branches of its plan read them."""
    return written(s.signals(spark, sf_dir), "signals"), written(s.current(spark, sf_dir), "current")


def _hops(source: str, name: str, days: int = 10, key: str | None = None) -> str:
    """SQL of the greedy cooldown: from a kept day to the first at least ``days`` later."""
    k, on = (f"{key}, ", f"x.{key} = h.{key} AND ") if key else ("", "")
    group = f" GROUP BY {key}" if key else ""
    from_key = f"h.{key}, " if key else ""
    return f"""{name} AS (
  SELECT {k}min(day) AS day FROM {source}{group}
  UNION ALL
  SELECT {from_key}(SELECT min(x.day) FROM {source} x WHERE {on}x.day >= h.day + {days}) FROM {name} h WHERE h.day IS NOT NULL)"""


MEASURES = """count(fwd_5) AS n, avg(CASE WHEN fwd_5 IS NULL THEN NULL WHEN fwd_5 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS win5, avg(fwd_5) AS mean5, median(fwd_5) AS median5,
         avg(fwd_20) AS mean20, min(fwd_5) AS worst5, avg(max_drawdown_20) AS drawdown"""
R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(f"WITH RECURSIVE {s.SIGNALS}, low AS (SELECT * FROM signals WHERE v <= 30), {_hops('low', 'kept')} SELECT day, v FROM low WHERE day IN (SELECT day FROM kept)")
def sel01_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-01, JON-09: low scores at least ten days apart."""
    return sel.apply_cooldown(s.signals(spark, sf_dir).where("v <= 30"), 10).select("day", "v")


_SPECS = ", ".join(f"({i}, '{label}', '{c}', {bound})" for i, label, c, bound in stats.study_specs())


@query(
    f"""WITH RECURSIVE {s.SIGNALS}, specs(ord, label, c, bound) AS (VALUES {_SPECS}),
hits AS (SELECT ord, s.* FROM specs JOIN signals s ON CASE c WHEN 'v' THEN v WHEN 'chg_1' THEN chg_1 WHEN 'chg_3' THEN chg_3 ELSE chg_5 END <= bound),
{_hops('hits', 'kept', key='ord')},
m AS (SELECT hits.ord, {MEASURES} FROM hits JOIN kept ON hits.ord = kept.ord AND hits.day = kept.day GROUP BY hits.ord)
SELECT ord, label, coalesce(n, 0) AS n, {R('win5', 'mean5', 'median5', 'mean20', 'worst5', 'drawdown')}, round(mean5 - (SELECT avg(fwd_5) FROM signals), 6) AS excess5
FROM specs LEFT JOIN m USING (ord)"""
)
def agg10_event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04 to AGG-07, AGG-10, AGG-11: nineteen overlapping groups, each with its own cooldown."""
    return rounded(stats.event_study(daily(spark, sf_dir)[0], OPTIONS.specs(), OPTIONS.cooldown))


@query(
    f"""WITH {s.SIGNALS}, m AS (SELECT regime, {MEASURES} FROM signals GROUP BY regime)
SELECT regime, n, {R('win5', 'mean5', 'median5', 'mean20', 'worst5', 'drawdown')} FROM m"""
)
def agg04_outcomes_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04 to AGG-07 by regime."""
    return rounded(s.signals(spark, sf_dir).groupBy("regime").agg(*stats.outcome_measures()))


def _distance(settings: sel.AnalogSettings) -> str:
    return " + ".join(
        f"CASE WHEN now.{c} IS NULL THEN 0.0::DOUBLE ELSE coalesce(abs(e.{c} - now.{c}) / {scale}::DOUBLE, 1.5) * {weight}::DOUBLE END" for c, (scale, weight) in settings.scales().items()
    )


_DISTANCE = _distance(NARROW)
_SAME = "same AS (SELECT signals.* FROM signals, now WHERE fwd_5 IS NOT NULL AND signals.regime = now.regime)"


@query(f"WITH {s.CURRENT}, {_SAME} SELECT e.day, round({_DISTANCE}, 6) AS analog_distance FROM same e, now")
def sel03_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-03, FLT-07: weighted distance to the current row within its regime."""
    now = s.current(spark, sf_dir)
    return rounded(sel.distance(sel.same_regime(s.signals(spark, sf_dir), now), now, NARROW), "day", "analog_distance")


def _banded(bands: dict[str, float]) -> str:
    return " AND ".join(f"(now.{c} IS NULL OR coalesce(e.{c} BETWEEN now.{c} - {b}::DOUBLE AND now.{c} + {b}::DOUBLE, false))" for c, b in bands.items())


@query(f"WITH RECURSIVE {s.CURRENT}, {_SAME}, banded AS MATERIALIZED (SELECT e.* FROM same e, now WHERE {_banded(WIDE.strict())}), {_hops('banded', 'kept')} SELECT day, {R('v', 'fwd_5')} FROM banded WHERE day IN (SELECT day FROM kept) ORDER BY day LIMIT 50")
def sel04_strict_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-04, FLT-06, LIM-01: the strict branch, with wide bands."""
    return rounded(sel.strict_analogs(s.signals(spark, sf_dir), s.current(spark, sf_dir), WIDE), "day", "v", "fwd_5")


@query(f"WITH RECURSIVE {s.CURRENT}, {_SAME}, banded AS MATERIALIZED (SELECT e.* FROM same e, now WHERE {_banded(WIDE.relaxed())}), {_hops('banded', 'kept')} SELECT day, {R('v', 'fwd_5')} FROM banded WHERE day IN (SELECT day FROM kept) ORDER BY day LIMIT 50")
def sel04_relaxed_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-04: the relaxed branch, with wide bands."""
    return rounded(sel.relaxed_analogs(s.signals(spark, sf_dir), s.current(spark, sf_dir), WIDE), "day", "v", "fwd_5")


NEAREST = f"""{s.CURRENT}, {_SAME}, ranked AS (SELECT e.day, e.fwd_5, e.fwd_20, e.max_drawdown_20, {_DISTANCE} AS dist FROM same e, now),
chosen AS (
  SELECT unnest(list_reduce(list_prepend([]::DATE[], list_transform(list(day ORDER BY dist, day), lambda d: [d])),
    lambda k, x: CASE WHEN len(k) < 50 AND len(list_filter(k, lambda y: abs(date_diff('day', y, x[1])) < 10)) = 0 THEN k || x ELSE k END)) AS day
  FROM ranked WHERE dist <= 4.5),
analogs AS (SELECT ranked.* FROM ranked JOIN chosen USING (day))"""


@query(f"WITH {NEAREST} SELECT day, round(dist, 6) AS analog_distance, round(fwd_5, 6) AS fwd_5 FROM analogs")
def sel02_nearest_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-02, SEL-04, FLT-09, SRT-01: nearest first, ten days apart, at most fifty."""
    return rounded(sel.nearest_analogs(s.signals(spark, sf_dir), s.current(spark, sf_dir), NARROW), "day", "analog_distance", "fwd_5")


def _analogs(settings: sel.AnalogSettings) -> str:
    """The strict events if there are enough, else the relaxed ones, else the nearest."""
    banded = lambda name, bands: f"""{name}_in AS MATERIALIZED (SELECT e.day FROM same e, now WHERE {_banded(bands)}), {_hops(f"{name}_in", f"{name}_days")},
{name} AS (SELECT day FROM {name}_in WHERE day IN (SELECT day FROM {name}_days) ORDER BY day LIMIT {settings.most})"""  # noqa: E731
    return f"""{s.CURRENT}, {_SAME}, {banded("strict", settings.strict())}, {banded("relaxed", settings.relaxed())},
ranked AS (SELECT e.day, e.fwd_5, e.fwd_20, e.max_drawdown_20, {_distance(settings)} AS dist FROM same e, now),
nearest AS (
  SELECT unnest(list_reduce(list_prepend([]::DATE[], list_transform(list(day ORDER BY dist, day), lambda d: [d])),
    lambda k, x: CASE WHEN len(k) < {settings.most} AND len(list_filter(k, lambda y: abs(date_diff('day', y, x[1])) < {settings.cooldown})) = 0 THEN k || x ELSE k END)) AS day
  FROM ranked WHERE dist <= {settings.cap}),
method AS (SELECT CASE WHEN (SELECT count(*) FROM strict) >= {settings.least} THEN 'strict' WHEN (SELECT count(*) FROM relaxed) >= {settings.least} THEN 'relaxed' ELSE 'nearest' END AS method),
analogs AS (SELECT ranked.*, method FROM ranked, method WHERE CASE method WHEN 'strict' THEN day IN (SELECT day FROM strict) WHEN 'relaxed' THEN day IN (SELECT day FROM relaxed) ELSE day IN (SELECT day FROM nearest) END)"""


def _found(spark: SparkSession, sf_dir: str, settings: sel.AnalogSettings) -> DataFrame:
    analogs, method = sel.find_analogs(*daily(spark, sf_dir), settings)
    return rounded(analogs.withColumn("method", F.lit(method)), "day", "method", "analog_distance", "fwd_5")


CHOSEN = "SELECT day, method, CASE WHEN method = 'nearest' THEN round(dist, 6) END AS analog_distance, round(fwd_5, 6) AS fwd_5 FROM analogs"


@query(f"WITH RECURSIVE {_analogs(NARROW)} {CHOSEN}")
def sel04_find_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-04, PRJ-12: strict, relaxed or nearest events, whichever are enough; the distance of the nearest only."""
    return _found(spark, sf_dir, OPTIONS.analogs())


@query(f"WITH RECURSIVE {_analogs(WIDE)} {CHOSEN}")
def sel04_find_analogs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with bands so wide that the strict events are enough."""
    return _found(spark, sf_dir, WIDE)


BASELINE = f"{_hops('same', 'base_days')}, baseline AS (SELECT * FROM same WHERE day IN (SELECT day FROM base_days))"


@query(f"WITH RECURSIVE {s.CURRENT}, {_SAME}, {BASELINE} SELECT day, regime, round(fwd_5, 6) AS fwd_5 FROM baseline")
def sel05_regime_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL-05: completed events of the current regime, ten days apart."""
    return rounded(sel.regime_baseline(s.signals(spark, sf_dir), s.current(spark, sf_dir)), "day", "regime", "fwd_5")


@query(
    f"""WITH {s.SIGNALS}, g AS (SELECT regime, count_if(fwd_5 > 0) AS wins, count(fwd_5) AS n FROM signals GROUP BY regime)
SELECT regime, wins, n, round(CASE WHEN n > 0 THEN greatest(0.0::DOUBLE, (wins / n + 1.96::DOUBLE ** 2 / (2 * n) - 1.96::DOUBLE * sqrt((wins / n * (1 - wins / n) + 1.96::DOUBLE ** 2 / (4 * n)) / n)) / (1 + 1.96::DOUBLE ** 2 / n)) END, 6) AS floor
FROM g"""
)
def agg08_wilson_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08: Wilson floor of the share of gains by regime."""
    g = s.signals(spark, sf_dir).groupBy("regime").agg(F.count_if(F.col("fwd_5") > 0).alias("wins"), F.count("fwd_5").alias("n"))
    return rounded(g.withColumn("floor", stats.wilson_floor(F.col("wins"), F.col("n"))))


def _means(source: str, side: str, name: str) -> str:
    return f"""{name}_x AS (SELECT list(fwd_5 ORDER BY fwd_5) AS xs FROM {source} WHERE fwd_5 IS NOT NULL),
{name} AS (SELECT i AS iter, avg(xs[(('0x' || substr(md5('42:{side}:' || i || ':' || p), 1, 8))::BIGINT % len(xs))::INT + 1]) AS m
  FROM {name}_x, range({OPTIONS.iterations}) t(i), unnest(range(len(xs))) u(p) GROUP BY i)"""


BOOTSTRAP = f"""{_means('analogs', 'a', 'boot_a')}, {_means('baseline', 'b', 'boot_b')},
ci AS (SELECT CASE WHEN (SELECT count(fwd_5) FROM analogs) >= 2 AND (SELECT count(fwd_5) FROM baseline) >= 2 THEN quantile_cont(a.m - b.m, 0.025) END AS ci_low,
              CASE WHEN (SELECT count(fwd_5) FROM analogs) >= 2 AND (SELECT count(fwd_5) FROM baseline) >= 2 THEN quantile_cont(a.m - b.m, 0.975) END AS ci_high
       FROM boot_a a JOIN boot_b b USING (iter))"""


def _interval(analogs: DataFrame, baseline: DataFrame, settings: Settings = OPTIONS) -> DataFrame:
    x = F.col("fwd_5").alias("x")
    return stats.bootstrap_excess(analogs.select(x), baseline.select(x), settings.iterations, settings.seed)


@query(f"WITH RECURSIVE {_analogs(NARROW)}, {BASELINE}, {BOOTSTRAP} SELECT round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ci")
def agg09_bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09: interval of the difference of resampled means, draws from md5."""
    events, now = daily(spark, sf_dir)
    analogs = written(sel.find_analogs(events, now, OPTIONS.analogs())[0], "analogs")
    return rounded(_interval(analogs, written(sel.regime_baseline(events, now), "baseline")))


@query()
def agg09_bootstrap_numpy(spark: SparkSession, sf_dir: str, part: int = large_stats.PART) -> DataFrame:
    """AGG-09 with numpy's draws, a resample dealt to the parts of its sample; other draws than SQL has."""
    events, now = daily(spark, sf_dir)
    x = F.col("fwd_5").alias("x")
    analogs = written(sel.find_analogs(events, now, OPTIONS.analogs())[0].select(x), "analogs")
    return large_stats.resampled_excess(analogs, written(sel.regime_baseline(events, now).select(x), "baseline"), OPTIONS.iterations, OPTIONS.seed, part=part)


def decided(events: DataFrame, now: DataFrame, settings: Settings = OPTIONS) -> DataFrame:
    """The whole decision over signals and the current row, under one set of options."""
    chosen = settings.analogs()
    analogs = written(sel.find_analogs(events, now, chosen)[0], "analogs")
    baseline = written(sel.regime_baseline(events, now, chosen), "baseline")
    return written(decisions.decide(stats.verdict_summary(analogs, baseline, now, _interval(analogs, baseline, settings)), settings.rules()), "decided")


def verdict(spark: SparkSession, sf_dir: str, settings: Settings = OPTIONS) -> DataFrame:
    return decided(*daily(spark, sf_dir), settings)


VERDICT = f"""{_analogs(NARROW)}, {BASELINE}, {BOOTSTRAP},
facts AS (
  SELECT a.*, b.baseline, a.mean5 - b.base5 AS excess, ci_low, ci_high,
         (coalesce(off_high_252 >= -0.01, false)::INT + coalesce(ret_20 >= 0.05, false)::INT + coalesce(vs_sma_50 >= 0.03, false)::INT + coalesce(vs_sma_200 >= 0.12, false)::INT) AS points
  FROM (SELECT {MEASURES}, count_if(fwd_5 > 0) AS wins FROM analogs) a, (SELECT count(fwd_5) AS baseline, avg(fwd_5) AS base5 FROM baseline) b, ci, now),
tiers AS (SELECT *, n AS sample, CASE WHEN points >= 2 THEN 'High' WHEN points = 1 THEN 'Moderate' ELSE 'Normal' END AS extension,
                 CASE WHEN points >= 2 THEN 25 ELSE 20 END AS need_sample, CASE WHEN points >= 2 THEN 0.004 WHEN points = 1 THEN 0.003 ELSE 0.0025 END::DOUBLE AS need_excess,
                 CASE WHEN points >= 2 THEN -0.03 ELSE -0.04 END::DOUBLE AS need_drawdown FROM facts),
gates AS (SELECT *, n >= need_sample AS ok_sample, baseline >= 30 AS ok_baseline, coalesce(excess >= need_excess, false) AS ok_excess, coalesce(ci_low > 0, false) AS ok_ci,
                 coalesce(win5 >= 0.6, false)::INT + coalesce(median5 > 0, false)::INT + coalesce(mean20 > 0, false)::INT + coalesce(drawdown >= need_drawdown, false)::INT AS supports,
                 coalesce(win5 <= 0.45, false)::INT + coalesce(mean5 < 0, false)::INT + coalesce(median5 < 0, false)::INT + coalesce(mean20 < 0, false)::INT AS against FROM tiers),
verdict AS (SELECT *, CASE WHEN NOT (ok_sample AND ok_baseline) THEN 'INSUFFICIENT EVIDENCE' WHEN ok_excess AND ok_ci AND supports >= 3 THEN 'BUY GRADUALLY'
                           WHEN coalesce(excess <= -0.0025, false) AND coalesce(ci_high < 0, false) AND against >= 3 THEN 'WAIT ON BUYING' ELSE 'HOLD / NO EXTRA BUYING' END AS action,
                   CASE WHEN NOT (ok_sample AND ok_baseline) THEN 'Very low' WHEN n >= 30 THEN 'Moderate' ELSE 'Low' END AS confidence FROM gates)"""
VERDICT_COLUMNS = ("sample", "baseline", "extension", "points", "need_sample", "ok_sample", "ok_baseline", "ok_excess", "ok_ci", "supports", "against", "action", "confidence")
VERDICT_VALUES = ("win5", "mean5", "median5", "mean20", "drawdown", "excess", "ci_low", "ci_high", "need_excess", "need_drawdown")


@query(f"WITH RECURSIVE {VERDICT} SELECT {', '.join(VERDICT_COLUMNS)}, {R(*VERDICT_VALUES)} FROM verdict")
def agg15_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15, DEC-01 to DEC-06, SCA-06: the whole decision, one row."""
    return rounded(verdict(spark, sf_dir), *VERDICT_COLUMNS, *VERDICT_VALUES)


@query(
    f"""WITH RECURSIVE {VERDICT}
SELECT position, label, round(value, 6) AS value, requirement, coalesce(passed, false) AS passed FROM (
  SELECT unnest([
    {{'position': 1, 'label': 'Comparable events', 'value': sample::DOUBLE, 'requirement': need_sample::DOUBLE, 'passed': ok_sample}},
    {{'position': 2, 'label': 'Baseline events', 'value': baseline::DOUBLE, 'requirement': 30.0::DOUBLE, 'passed': ok_baseline}},
    {{'position': 3, 'label': 'Excess over baseline', 'value': excess, 'requirement': need_excess, 'passed': ok_excess}},
    {{'position': 4, 'label': 'Lower confidence bound', 'value': ci_low, 'requirement': 0.0::DOUBLE, 'passed': ok_ci}},
    {{'position': 5, 'label': 'Win rate', 'value': win5, 'requirement': 0.6::DOUBLE, 'passed': win5 >= 0.6}},
    {{'position': 6, 'label': 'Median 5 sessions', 'value': median5, 'requirement': 0.0::DOUBLE, 'passed': median5 > 0}},
    {{'position': 7, 'label': 'Mean 20 sessions', 'value': mean20, 'requirement': 0.0::DOUBLE, 'passed': mean20 > 0}},
    {{'position': 8, 'label': 'Average drawdown', 'value': drawdown, 'requirement': need_drawdown, 'passed': drawdown >= need_drawdown}}], recursive := true) FROM verdict)"""
)
def dec07_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-07, AGG-14: the eight checks as rows."""
    return rounded(decisions.checks(verdict(spark, sf_dir), OPTIONS.rules()))


def tiles(events: DataFrame, now: DataFrame, found: DataFrame) -> DataFrame:
    """DEC-09: figures with a label and a note, as rows of text."""
    from ..functions.scalars import number_text, percent_text, regime_label

    one = found.join(F.broadcast(now.drop("points", "extension"))).join(F.broadcast(events.agg(F.count("fwd_5").alias("completed"))))
    cells = [
        ("Score", number_text(F.col("v")), "latest"), ("Change 5 observations", number_text(F.col("chg_5")), "score points"), ("Regime", regime_label(F.col("regime")), "of the market"),
        ("From yearly high", percent_text(F.col("off_high_252")), "close"), ("Against 200-day average", percent_text(F.col("vs_sma_200")), "close"), ("Return 20 sessions", percent_text(F.col("ret_20")), "past"),
        ("Comparable events", F.col("sample").cast("string"), "independent"), ("Baseline events", F.col("baseline").cast("string"), "same regime"), ("Win rate", percent_text(F.col("win5")), "5 sessions"),
        ("Mean 5 sessions", percent_text(F.col("mean5"), 2), "from entry"), ("Mean 20 sessions", percent_text(F.col("mean20"), 2), "from entry"), ("Average drawdown", percent_text(F.col("drawdown"), 2), "20 sessions"),
        ("Extension", F.col("extension"), "of the market"), ("Completed signals", F.col("completed").cast("string"), "all regimes"),
    ]
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("label"), b.alias("value"), F.lit(c).alias("note")) for a, b, c in cells))))


@query(
    f"""WITH RECURSIVE {VERDICT}, one AS (SELECT verdict.*, now.v, now.chg_5, now.regime, now.off_high_252, now.vs_sma_200, now.ret_20, (SELECT count(fwd_5) FROM signals) AS completed FROM verdict, now)
SELECT u.label, u.value, u.note FROM (SELECT unnest([
 {{'label': 'Score', 'value': coalesce(printf('%.1f', v), 'N/A'), 'note': 'latest'}}, {{'label': 'Change 5 observations', 'value': coalesce(printf('%.1f', chg_5), 'N/A'), 'note': 'score points'}},
 {{'label': 'Regime', 'value': CASE regime WHEN 'near_high_uptrend' THEN 'Near-high uptrend' WHEN 'uptrend_off_high' THEN 'Uptrend, off high' WHEN 'correction' THEN 'Correction' WHEN 'downtrend' THEN 'Downtrend' ELSE 'Unknown' END, 'note': 'of the market'}},
 {{'label': 'From yearly high', 'value': coalesce(printf('%.1f%%', off_high_252 * 100), 'N/A'), 'note': 'close'}}, {{'label': 'Against 200-day average', 'value': coalesce(printf('%.1f%%', vs_sma_200 * 100), 'N/A'), 'note': 'close'}},
 {{'label': 'Return 20 sessions', 'value': coalesce(printf('%.1f%%', ret_20 * 100), 'N/A'), 'note': 'past'}}, {{'label': 'Comparable events', 'value': sample::VARCHAR, 'note': 'independent'}},
 {{'label': 'Baseline events', 'value': baseline::VARCHAR, 'note': 'same regime'}}, {{'label': 'Win rate', 'value': coalesce(printf('%.1f%%', win5 * 100), 'N/A'), 'note': '5 sessions'}},
 {{'label': 'Mean 5 sessions', 'value': coalesce(printf('%.2f%%', mean5 * 100), 'N/A'), 'note': 'from entry'}}, {{'label': 'Mean 20 sessions', 'value': coalesce(printf('%.2f%%', mean20 * 100), 'N/A'), 'note': 'from entry'}},
 {{'label': 'Average drawdown', 'value': coalesce(printf('%.2f%%', drawdown * 100), 'N/A'), 'note': '20 sessions'}}, {{'label': 'Extension', 'value': extension, 'note': 'of the market'}},
 {{'label': 'Completed signals', 'value': completed::VARCHAR, 'note': 'all regimes'}}]) AS u FROM one)"""
)
def dec09_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, now = daily(spark, sf_dir)
    return tiles(events, now, decided(events, now))


@query(
    f"""WITH {s.SENTIMENT}, g AS (SELECT date_diff('day', lag(day) OVER (ORDER BY day), day)::INT AS gap FROM sentiment)
SELECT count_if(gap > 7)::BIGINT AS gaps, max(gap) AS longest FROM g"""
)
def agg13_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13: gaps of more than seven days."""
    return stats.gap_count(s.sentiment(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {VERDICT}, f AS (SELECT (SELECT count_if(gap > 7) FROM (SELECT date_diff('day', lag(day) OVER (ORDER BY day), day) AS gap FROM sentiment)) AS gaps,
  (SELECT count(fwd_5) FROM signals) AS completed, sample, need_sample, extension FROM verdict)
SELECT warning FROM (SELECT unnest([CASE WHEN gaps > 0 THEN 'Score series has ' || gaps || ' gaps of more than 7 days' END, CASE WHEN completed < 100 THEN 'Only ' || completed || ' completed signals' END,
  CASE WHEN sample < need_sample THEN 'Fewer comparable events than required' END, CASE WHEN extension = 'High' THEN 'Market is extended' END]) AS warning FROM f) WHERE warning IS NOT NULL"""
)
def dec08_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC-08."""
    events, now = daily(spark, sf_dir)
    return warnings(spark, sf_dir, events, decided(events, now))


def warnings(spark: SparkSession, sf_dir: str, events: DataFrame, found: DataFrame) -> DataFrame:
    gaps = stats.gap_count(s.sentiment(spark, sf_dir)).select("gaps")
    done = events.agg(F.count("fwd_5").alias("completed"))
    return decisions.warnings(found.join(F.broadcast(gaps)).join(F.broadcast(done)))


def report(spark: SparkSession, sf_dir: str, build: str = "local") -> DataFrame:
    """The nested report as one JSON text."""
    from ..sources.sinks import report_json

    events, now = daily(spark, sf_dir)
    found = decided(events, now)
    days = s.sentiment(spark, sf_dir)
    coverage = days.agg(F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.count("*").alias("daily_observations"))
    coverage = coverage.join(F.broadcast(events.agg(F.count("fwd_5").alias("completed_5d_outcomes")))).join(F.broadcast(stats.gap_count(days).select(F.col("gaps").alias("gaps_over_7_days"))))
    latest = now.select("day", "d", "v", "chg_5", "regime", "off_high_252", "ret_20", "vs_sma_200", "vol_20").join(F.broadcast(found.select("extension")))
    return report_json(coverage, latest, found, warnings(spark, sf_dir, events, found), data_source="tables", build_id=build)


@query(
    f"""WITH RECURSIVE {VERDICT}, g AS (SELECT date_diff('day', lag(day) OVER (ORDER BY day), day) AS gap FROM sentiment)
SELECT (SELECT min(day)::VARCHAR FROM sentiment) AS first_date, (SELECT count(*) FROM sentiment) AS observations, (SELECT count(fwd_5) FROM signals) AS completed, (SELECT count_if(gap > 7) FROM g)::BIGINT AS gaps,
 (SELECT day::VARCHAR FROM now) AS latest, (SELECT v FROM now) AS v, (SELECT regime FROM now) AS regime, action, sample, round(ci_low, 6) AS ci_low, round(mean5, 6) AS mean5, extension, 'local' AS build, '{chr(123)}"generated_at":"now","build_id":"local"{chr(125)}' AS version,
 ((SELECT count_if(gap > 7) FROM g) > 0)::INT + ((SELECT count(fwd_5) FROM signals) < 100)::INT + (sample < need_sample)::INT + (extension = 'High')::INT AS warnings FROM verdict"""
)
def snk05_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: the nested report, read back from its JSON, and the version document."""
    from ..sources.sinks import version_json

    at = lambda path, kind="string": F.get_json_object("json", f"$.{path}").cast(kind)
    return report(spark, sf_dir).select(
        at("coverage.first_date").alias("first_date"), at("coverage.daily_observations", "long").alias("observations"), at("coverage.completed_5d_outcomes", "long").alias("completed"),
        at("coverage.gaps_over_7_days", "long").alias("gaps"), at("latest.day").alias("latest"), at("latest.v", "double").alias("v"), at("latest.regime").alias("regime"), at("verdict.action").alias("action"),
        at("verdict.sample", "long").alias("sample"), F.round(at("verdict.ci_low", "double"), 6).alias("ci_low"), F.round(at("verdict.mean5", "double"), 6).alias("mean5"),
        F.size(F.from_json(at("warnings"), "array<string>")).alias("warnings"), at("latest.extension").alias("extension"), at("build_id").alias("build"),
        F.regexp_replace(F.lit(version_json("now", "local")), r"\s", "").alias("version"),
    )


@query(
    f"""WITH RECURSIVE {_analogs(NARROW)}
SELECT 'event_study' AS file, {len(stats.study_specs())}::BIGINT AS rows, 10 AS columns UNION ALL SELECT 'analogs', (SELECT count(*) FROM analogs), 20 UNION ALL SELECT 'full_analysis', (SELECT count(*) FROM signals), 29"""
)
def snk04_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04, PRJ-12: the three result files, written and read back."""
    from ..session import new_folder
    from ..sources.sinks import export_results

    events, now = daily(spark, sf_dir)
    folder = new_folder(spark, "exports")
    export_results(folder, stats.event_study(events, OPTIONS.specs(), OPTIONS.cooldown), sel.find_analogs(events, now, OPTIONS.analogs())[0], events)
    read = [(name, spark.read.option("header", True).csv(f"{folder}/{name}")) for name in ("event_study", "analogs", "full_analysis")]
    return spark.createDataFrame([(name, df.count(), len(df.columns)) for name, df in read], "file string, rows long, columns int")
