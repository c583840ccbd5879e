import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadlens.operators import stats


def values(spark, xs, slot="A"):
    return spark.createDataFrame([(slot, i, float(x) if x is not None else None) for i, x in enumerate(xs)], "slot string, item int, v double")


def brute_w(xs):
    d = [x for x in xs if x]
    ranks = {a: np.mean([i + 1 for i, b in enumerate(sorted(map(abs, d))) if b == a]) for a in set(map(abs, d))}
    plus = sum(ranks[abs(x)] for x in d if x > 0)
    return min(plus, sum(ranks[abs(x)] for x in d if x < 0))


def test_signed_rank_matches_brute_force(spark):
    rng = random.Random(1)
    xs = [rng.randint(-9, 9) for _ in range(400)] + [None, None]
    r = stats.signed_rank(values(spark, xs), "v", ["slot"]).first()
    assert r.w == brute_w([x for x in xs if x is not None]) and r.n == 400 and r.n_nonzero == sum(1 for x in xs if x)


@pytest.mark.parametrize(("xs", "p"), [([], None), ([1.0], None), ([0.0, 0.0, 0.0], 1.0)])
def test_signed_rank_degenerate(spark, xs, p):
    got = stats.signed_rank_test(values(spark, xs), "v", ["slot"]).collect()
    assert (got[0].p if got else None) == p


def test_wilcoxon_golden():
    z = lambda w, n: (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    p = lambda w, n: stats.wilcoxon_p(120, n, w, 1.0, z(w, n))
    assert p(761, 94) < 0.001 and p(693.5, 100) < 0.001 and abs(p(1780, 88) - 0.458) < 0.002 and abs(p(1823.5, 99) - 0.023) < 0.001
    assert stats.wilcoxon_p(5, 5, 0.0, 0.0, None) == 2 / 32


def test_cliffs_delta(spark):
    df = spark.createDataFrame([("A", 1.0, 4.0), ("A", 2.0, 2.0), ("A", 3.0, None)], "slot string, a double, b double")
    r = stats.cliffs_delta(df, "a", "b", ["slot"]).first()
    want = sum((x > y) - (x < y) for x in (1, 2, 3) for y in (4, 2)) / 6
    assert abs(r.delta - want) < 1e-9 and (r.n_a, r.n_b) == (3, 2)


def test_holm(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.02), ("f", 3, 0.04), ("f", 4, None)], "f string, t int, p double")
    got = {r.t: (r.p_holm, r.reject) for r in stats.holm(df, "p", ["f"], "t").collect()}
    assert got[1] == (0.03, True) and got[2] == (0.04, True) and got[3] == (0.04, True) and got[4] == (None, False)


def test_chi_square(spark):
    rows = [("x", "a")] * 10 + [("x", "b")] * 20 + [("y", "a")] * 25 + [("y", "b")] * 15
    df = spark.createDataFrame(rows, "r string, c string")
    n, e = np.array([[10, 20], [25, 15]]), np.outer([30, 40], [35, 35]) / 70
    want = ((np.abs(n - e) - 0.5) ** 2 / e).sum()
    got = stats.chi_square_test(df, "r", "c", []).first()
    assert abs(got.chi2 - want) < 1e-6 and got.dof == 1 and abs(got.p - math.erfc(math.sqrt(want / 2))) < 1e-6
    assert stats.chi_square(df.where("r = 'x'"), "r", "c", []).first().chi2 is None


@pytest.mark.parametrize(("x", "dof", "p"), [(7.222, 3, 0.065), (6.772, 4, 0.148), (3.581, 2, 0.167)])
def test_chi_square_p(x, dof, p):
    assert abs(stats.chi_square_p(x, dof) - p) < 0.001


def test_signs(spark):
    r = stats.sign_statistic(values(spark, [1, 2, -1, 0, 0]), "v", ["slot"]).first()
    assert (r.n_positive, r.n_negative, r.n_tied, r.statistic) == (2, 1, 2, 0.333333333)


def test_kappa_and_confusion(spark):
    rows = [("x", "x")] * 3 + [("x", "y")] * 2 + [("y", "y")] * 4 + [("q", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    r = stats.kappa(df, "a", "b", ["x", "y", "z"]).first()
    po, pe = 7 / 9, (5 * 3 + 4 * 6) / 81
    assert r.n == 9 and r.exact == 7 and abs(r.kappa - (po - pe) / (1 - pe)) < 1e-9
    assert {t.row: (t.x, t.y, t.z) for t in stats.confusion(df, "a", "b", ["x", "y", "z"]).collect()} == {"x": (3, 2, 0), "y": (0, 4, 0), "z": (0, 0, 0)}


def test_bootstrap_is_numpys_and_blocks_do_not_matter(spark):
    v = np.arange(30) / 7
    idx = np.random.default_rng(3).integers(0, 30, size=(500, 30))
    assert np.array_equal(stats.bootstrap_means(v, 500, 3, budget=100), v[idx].mean(axis=1))
    r = stats.bootstrap_ci(values(spark, v), "v", ["slot"], "item", 500, seed=3).first()
    lo, hi = np.percentile(v[idx].mean(axis=1), [2.5, 97.5])
    assert abs(r.ci_lo - lo) < 1e-12 and abs(r.ci_hi - hi) < 1e-12
    q = stats.poisson_ci(values(spark, v), "v", ["slot"], "item", 500).first()
    assert q.ci_lo < v.mean() < q.ci_hi and abs(q.ci_lo - lo) < 0.3
    assert stats.bootstrap_ci(values(spark, [1.0]), "v", ["slot"], "item", 100).first().ci_lo is None


def test_permutation(spark):
    df = spark.createDataFrame([("A", i, 0.3, 0.0) for i in range(40)], "slot string, item int, diff_a double, diff_b double")
    r = stats.permutation_test(df, ["a", "b"], ["slot"], "item", 500).first()
    assert abs(r.statistic - 0.09) < 1e-9 and r.p < 0.01 and r.n == 40
    none = stats.permutation_test(df.withColumn("diff_a", F.lit(None).cast("double")), ["a", "b"], ["slot"], "item", 50).first()
    assert none.n == 0 and none.p is None


def test_histogram_counts_all(spark):
    got = stats.histogram(values(spark, [-2, 2, 0, 0.5]), "v", ["slot"]).collect()
    assert sum(r.n for r in got) == 4 and max(r.bin for r in got) == 23
