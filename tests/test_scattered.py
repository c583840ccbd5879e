"""Resampling for groups of any size: the draws, the sums and what they give."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadlens.operators import stats


def test_draws_depend_on_item_and_seed_alone():
    items = np.array([5, -7, 5, 2**62], np.int64)
    a = stats.scattered(items, 300, 3)
    assert (a[0] == a[2]).all() and (a[0] != a[1]).mean() > 0.99 and (a != stats.scattered(items, 300, 4)).mean() > 0.99
    assert (stats.scattered(items[1:2], 300, 3)[0] == a[1]).all()
    many = np.arange(2_000)
    w = stats.poisson_weights(many, 500, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    s = stats.flip_signs(many, 500, 1)
    assert set(np.unique(s)) == {-1.0, 1.0} and abs(s.mean()) < 0.01 and abs(np.corrcoef(s[:, 0], s[:, 64])[0, 1]) < 0.1


def test_sign_flips_come_near_all_flips(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(0.3, 1, (10, 2)).round(3)
    df = spark.createDataFrame([("A", f"i{i}", float(a), float(b)) for i, (a, b) in enumerate(v)] + [("A", "x", None, 1.0), (None, "y", 1.0, 1.0)], "g string, item string, diff_p double, diff_q double")
    got = {r.g: r for r in stats.sign_flip_test(df, ["p", "q"], ["g"], "item", resamples=20_000, seed=2).collect()}
    seen = (v.mean(0) ** 2).sum()
    exact = np.mean([((np.array(s) @ v / 10) ** 2).sum() >= seen - 1e-15 for s in itertools.product((-1, 1), repeat=10)])
    assert got["A"].n == 10 and got["A"].statistic == pytest.approx(seen) and got["A"].p == pytest.approx(exact, abs=0.015)
    again = stats.sign_flip_test(df.repartition(7), ["p", "q"], ["g"], "item", resamples=20_000, seed=2).where("g = 'A'").first()
    assert again.p == got["A"].p
    assert stats.sign_flip_test(df.limit(0), ["p", "q"], ["g"], "item", resamples=100).count() == 0


def test_poisson_interval_comes_near_the_bootstrap(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(g, i, float(x)) for g in "ab" for i, x in enumerate(rng.normal(3, 2, 400))], "g string, item int, v double")
    a = {r.g: r for r in stats.poisson_ci(df, "v", ["g"], "item", resamples=4000).collect()}
    b = {r.g: r for r in stats.bootstrap_ci(df, "v", ["g"], "item", resamples=4000).collect()}
    for g in "ab":
        assert a[g].ci_lo == pytest.approx(b[g].ci_lo, abs=0.05) and a[g].ci_hi == pytest.approx(b[g].ci_hi, abs=0.05)


def test_seeds_by_group_are_numpys(spark):
    df = spark.createDataFrame([(g, i, float(i * i % 7)) for g in "ab" for i in range(30)], "g string, item int, v double")
    got = {r.g: (r.ci_lo, r.ci_hi) for r in stats.bootstrap_ci(df, "v", ["g"], "item", resamples=500, seed=1, seeds={("b",): 9}).collect()}
    v = np.array([i * i % 7 for i in range(30)], float)
    for g, seed in (("a", 1), ("b", 9)):
        means = v[np.random.default_rng(seed).integers(0, 30, size=(500, 30))].mean(axis=1)
        assert got[g] == pytest.approx((np.percentile(means, 2.5), np.percentile(means, 97.5)), abs=1e-12)


def test_more_groups_than_the_bound_are_an_error_or_shuffled(spark):
    df = spark.range(60).select((F.col("id") % 20).alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    with pytest.raises(Exception, match="more than 5 rows"):
        stats.counted_before(df, ["g"], "v", ["n"], most_groups=5).collect()
    got = {(r.g, r.v): (r.n_before, r.n_all) for r in stats.counted_before(df, ["g"], "v", ["n"], most_groups=None).collect()}
    assert got == {(i % 20, float(i)): (i // 20, 3.0) for i in range(60)}
