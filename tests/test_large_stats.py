"""Quantiles by histograms and the split bootstrap, against Spark's percentile and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import large_stats
from sextant.operators.stats import bootstrap_excess
from sextant.plans import long_queries

SF = "/root/testdata/sf0.001"
AT = (0.5, 0.025, 0.975, 0.0, 1.0, 1 / 3)


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    n = F.col("id")
    wide = F.exp(F.pmod(F.xxhash64(n), F.lit(1400)) - 700)
    x = F.when(n % 11 == 0, None).when(n % 7 == 0, -3.5).when(n % 13 == 0, float("nan")).when(n % 17 == 0, -0.0).when(n % 19 == 0, float("-inf")).when(n % 3 == 0, -wide).otherwise(wide)
    key = F.when(n % 50 == 0, None).when(n < 3000, 1).when(n == 3999, 9).otherwise(2)
    rows = spark.range(4000).select(n, key.alias("k"), x.alias("x")).union(spark.createDataFrame([(1, 5, None), (2, 6, 1.0), (3, 7, -1.0), (4, 7, 2.0)], "id long, k int, x double"))
    path = f"{tmp_path_factory.mktemp('stats')}/rows"
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("keys", "bits"), [([], 5), (["k"], 12), ([], 64)])
def test_quantiles_equal_percentile(skewed, keys, bits):
    want = (skewed.groupBy(*keys) if keys else skewed).agg(*(F.percentile("x", F.lit(q)).alias(f"q{i}") for i, q in enumerate(AT))).collect()
    assert sorted(map(repr, large_stats.quantiles(skewed, "x", AT, keys, bits).collect())) == sorted(map(repr, want))


def test_quantiles_of_nothing(skewed):
    assert [tuple(r) for r in large_stats.quantiles(skewed.limit(0), "x").collect()] == [(None,)]
    assert large_stats.quantiles(skewed.limit(0), "x", keys=["k"]).count() == 0


def test_ordered_bits_keep_the_order(spark):
    xs = [float("-inf"), -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.0, 1e300, float("inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(large_stats.ordered_bits(F.col("x"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(xs)


@pytest.mark.parametrize(("size", "part"), [(1, 4), (4, 4), (9, 4), (1000, 7)])
def test_shares_add_up(size, part):
    parts = -(-size // part)
    shares = np.array([[large_stats._share((1, 0, i), size, part, p) for p in range(parts)] for i in range(40)])
    assert (shares.sum(axis=1) == size).all()
    if parts > 2:
        assert abs(shares[:, 0].mean() - part) < 5 * (part / 40) ** 0.5


def test_resamples_are_whole_centred_and_repeat(spark):
    xs = np.random.default_rng(5).gamma(2, 3, 3000)
    values = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
    one, two = (large_stats.resampled_means(values.repartition(n), 300, 42, part=128, draws=70).orderBy("iter").collect() for n in (3, 5))
    assert one == two and len(one) == 300 and {r.size for r in one} == {3000}
    means = np.array([r.mean for r in one])
    error = xs.std(ddof=1) / 3000**0.5
    assert abs(means.mean() - xs.mean()) < 4 * error / 300**0.5 and 0.85 < means.std(ddof=1) / error < 1.15
    assert large_stats.resampled_means(values.limit(0), 300, 42).count() == 0


def test_interval_is_near_the_other_one(spark):
    draw = np.random.default_rng(6)
    a, b = (spark.createDataFrame([(float(x),) for x in draw.normal(m, 1, 60)], "x double") for m in (0.6, 0))
    want, got = bootstrap_excess(a, b, 2000).first(), large_stats.resampled_excess(a, b, 2000, part=8).first()
    assert abs(got.ci_low - want.ci_low) < 0.06 and abs(got.ci_high - want.ci_high) < 0.06


def test_queries_do_not_depend_on_sizes(spark):
    assert sorted(long_queries.agg05_median_large(spark, SF, 5).collect()) == sorted(long_queries.agg05_median_large(spark, SF).collect())
    assert long_queries.agg09_bootstrap_large(spark, SF, 500).first() == long_queries.agg09_bootstrap_large(spark, SF).first()
