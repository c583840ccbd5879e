"""Non-parametric statistics as DataFrame operators.

Values are grouped by `by` (a slot, a family). Nulls are left out everywhere; "cannot be tested" is null, "tested, no
difference" is p = 1. Ranks never sort a whole group in one task: values are first reduced to distinct ones with their
counts, then cut into value ranges at approximate quantiles, so a group of any size is ranked in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The largest sample without ties and zeros whose signed-rank p is exact.
EXACT_UP_TO = 50


# ---- ranks -----------------------------------------------------------------------------------------------------------
def _few(df: DataFrame, by: list[str], column: str, most_rows: int) -> DataFrame:
    """df, one row or a few a group, to be sent to every task; more than `most_rows` rows are an error when it is read.

    Nothing is collected for the check: the rows are counted beside themselves.
    """
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    checked = F.when(n <= most_rows, F.col(column)).otherwise(F.raise_error(F.lit(f"more than {most_rows} rows by {by}; pass most_groups=None")))
    return F.broadcast(df.withColumn(column, checked))


def counted_before(df: DataFrame, by: list[str], value: str, counts: Sequence[str], ranges: int = 64, most_groups: int | None = 10_000) -> DataFrame:
    """df, one row per distinct value in a group, with how many units of each count lie below the value in the group
    (`<count>_before`) and how many the group has (`<count>_all`).

    Groups are factors with few levels: their cuts (`ranges` numbers each) and sums are broadcast under a checked bound.
    With most_groups=None they are joined by shuffles, whatever their number.
    """
    small = lambda d, c, rows: d if most_groups is None else _few(d, by, c, rows * most_groups)
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000).alias("_cuts"))
    j = df.join(small(cuts, "_cuts", 1), by).withColumn("_range", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    # at most `ranges` rows a group
    sums = j.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_{c}") for c in counts))
    whole = Window.partitionBy(*by)
    below = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_range", F.struct(*(F.coalesce(F.sum(f"_{c}").over(below), F.lit(0)).alias(f"{c}_off") for c in counts), *(F.sum(f"_{c}").over(whole).alias(f"{c}_all") for c in counts)).alias("_sums"))
    j = j.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{c}_in") for c in counts)).join(small(sums, "_sums", ranges), [*by, "_range"])
    both = [F.col(f"_{c}_in") + F.col(f"_sums.{c}_off") for c in counts]
    return j.select(*df.columns, *(x.cast("double").alias(f"{c}_before") for x, c in zip(both, counts)), *(F.col(f"_sums.{c}_all").cast("double").alias(f"{c}_all") for c in counts))


def medians(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, median), exact: the middle values by counts of distinct ones, so that no task holds a group."""
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value))).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    at = lambda rank: F.max(F.when(F.col("_n_before") < rank, F.col("_v")))
    n = F.col("_n_all")
    middle = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    return counted_before(counts, by, "_v", ["_n"]).groupBy(*by).agg(F.max(n).cast("long").alias("n"), middle.alias("median"))


def signed_rank(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """T-W without p: (by, n, n_nonzero, w, w_plus, ties, z, mean, median).

    Zeros are dropped, ties share their average rank, w is the smaller rank sum. z has the tie correction and no
    continuity correction; it is null where nothing can be tested. Everything comes from one count of the sizes by sign:
    in the order of the values the negative ones stand from the greatest size down, then the zeros, then the positive ones.
    """
    v = F.col(value)
    n_of = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    sizes = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, F.abs(v).alias("_a")).agg(n_of(v > 0).alias("_p"), n_of(v < 0).alias("_m"), n_of(v == 0).alias("_z"))
    ranked = counted_before(sizes, by, "_a", ["_p", "_m", "_z"])
    p, m, a = F.col("_p"), F.col("_m"), F.col("_a")
    t = (p + m).cast("double")
    rank = F.col("_p_before") + F.col("_m_before") + (t + 1) / 2
    minus, zeros = F.col("_m_all"), F.col("_z_all")
    n = F.col("_p_all") + minus + zeros

    def at(place: Column) -> Column:
        """The value at a place, 1 and up, of the order."""
        negative = F.max(F.when((m > 0) & (F.col("_m_before") < minus - place + 1), a))
        positive = F.max(F.when((p > 0) & (F.col("_p_before") < place - minus - zeros), a))
        sign = F.max(F.when(place <= minus, -1).when(place <= minus + zeros, 0).otherwise(1))
        return F.when(sign < 0, -negative).when(sign == 0, F.lit(0.0)).otherwise(positive)

    sums = ranked.groupBy(*by).agg(
        F.max(n).cast("long").alias("n"), F.max(n - zeros).cast("long").alias("n_nonzero"), F.sum(p * rank).alias("w_plus"), F.sum(m * rank).alias("_wm"), F.sum(t * t * t - t).alias("ties"),
        F.round(F.sum(a * (p - m)) / F.max(n), 9).alias("mean"), F.round((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2, 9).alias("median"),
    )
    k = F.col("n_nonzero").cast("double")
    w = F.least("w_plus", "_wm")
    var = k * (k + 1) * (2 * k + 1) / 24 - F.col("ties") / 48
    testable = (F.col("n") >= 2) & (k > 0)
    return sums.select(
        *by, "n", "n_nonzero", F.when(testable, w).alias("w"), F.when(testable, F.col("w_plus")).alias("w_plus"), "ties",
        F.when(testable & (var > 0), F.round((w - k * (k + 1) / 4) / F.sqrt(var), 9)).alias("z"), "mean", "median",
    )


def wilcoxon_p(n: int, nonzero: int, w: float | None, ties: float, z: float | None) -> float | None:
    """Two-sided p: null below two values, 1 if all are zero, exact for small samples without ties and zeros."""
    if n < 2:
        return None
    if nonzero == 0 or w is None:
        return 1.0
    if ties == 0 and nonzero == n and n <= EXACT_UP_TO:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    return 1.0 if z is None else math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(DoubleType())
def _wilcoxon_p(n: pd.Series, nonzero: pd.Series, w: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    clean = lambda v: None if pd.isna(v) else float(v)
    return pd.Series([wilcoxon_p(int(a), int(b), clean(c), float(d), clean(e)) for a, b, c, d, e in zip(n, nonzero, w, ties, z)], dtype=float)


def signed_rank_test(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """T-W with p; one row per group reaches Python."""
    return signed_rank(df, value, by).withColumn("p", F.nanvl(_wilcoxon_p("n", "n_nonzero", "w", "ties", "z"), F.lit(None).cast("double")))


def cliffs_delta(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """T-C: (by, n_a, n_b, delta) of two columns taken as unpaired samples; null if either is empty."""
    both = df.select(*by, F.explode(F.array(F.struct(F.col(a).alias("v"), F.lit(1).alias("s")), F.struct(F.col(b).alias("v"), F.lit(0).alias("s")))).alias("x")).select(*by, "x.*")
    counts = both.where("v is not null and not isnan(v)").groupBy(*by, "v").agg(F.sum("s").alias("_na"), F.sum(1 - F.col("s")).alias("_nb"))
    ranked = counted_before(counts, by, "v", ["_nb"])
    sums = ranked.groupBy(*by).agg(F.sum("_na").alias("n_a"), F.sum("_nb").alias("n_b"), F.sum(F.col("_na") * (F.col("_nb_before") + F.col("_nb") / 2)).alias("_u"))
    return sums.select(*by, "n_a", "n_b", F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.round(2 * F.col("_u") / (F.col("n_a") * F.col("n_b")) - 1, 9)).alias("delta"))


def stacked(df: DataFrame, tests: dict[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """(keep, hypothesis, value, a, b): each test's column and its two sides below one another, so that one pass serves all."""
    rows = [F.struct(F.lit(h).alias("hypothesis"), F.col(v).alias("value"), F.col(a).alias("a"), F.col(b).alias("b")) for h, (v, a, b) in tests.items()]
    return df.select(*keep, F.explode(F.array(*rows)).alias("_x")).select(*keep, "_x.*")


# ---- signs, families, tables -----------------------------------------------------------------------------------------
def sign_statistic(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """T-S and A12: counts of signs and (plus - minus) / (plus + minus), null without a sign."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    plus, minus = n(F.col(value) > 0), n(F.col(value) < 0)
    return kept.groupBy(*by).agg(
        plus.alias("n_positive"), minus.alias("n_negative"), n(F.col(value) == 0).alias("n_tied"), F.count("*").alias("n_total"), (plus + minus).alias("n_nontied"),
        F.round(F.try_divide((plus - minus).cast("double"), (plus + minus).cast("double")), 9).alias("statistic"),
    )


def holm(df: DataFrame, p: str, family: list[str], order: str, alpha: float = 0.05) -> DataFrame:
    """T-H: df with `p_holm` and `reject`; null p's take no part and stay null, not rejected. Ties go by `order`.

    A family's tests share one window: families are sets of tests, a few rows each.
    """
    ok = F.col(p).isNotNull() & ~F.isnan(F.col(p))
    by = Window.partitionBy(*family, F.when(ok, 1).otherwise(0))
    ranked = by.orderBy(p, order)
    step = F.least(F.lit(1.0), (F.count("*").over(by) - F.row_number().over(ranked) + 1) * F.col(p))
    out = df.withColumn("_step", F.when(ok, step))
    out = out.withColumn("p_holm", F.when(ok, F.max("_step").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")
    return out.withColumn("reject", F.coalesce(F.col("p_holm") < alpha, F.lit(False)))


def contingency(df: DataFrame, row: str, column: str, by: list[str]) -> DataFrame:
    """A5 in long form: (by, row, column, n) for every pair of observed levels, zeros included; nulls dropped."""
    kept = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    counts = kept.groupBy(*by, row, column).agg(F.count("*").alias("n"))
    # levels of two factors: a few rows each
    grid = counts.select(*by, row).distinct().join(counts.select(*by, column).distinct(), by) if by else counts.select(row).distinct().crossJoin(counts.select(column).distinct())
    return grid.join(counts, [*by, row, column], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def chi_square(df: DataFrame, row: str, column: str, by: list[str]) -> DataFrame:
    """T-X without p: (by, chi2, dof, n, small_cells); Yates' correction at one degree of freedom; null below 2 x 2."""
    t = contingency(df, row, column, by)
    w = lambda *c: F.sum("n").over(Window.partitionBy(*by, *c)).cast("double")
    t = t.withColumn("_r", w(row)).withColumn("_c", w(column)).withColumn("_n", w())
    levels = t.groupBy(*by).agg(F.count_distinct(row).alias("_rows"), F.count_distinct(column).alias("_cols")) if by else t.agg(F.count_distinct(row).alias("_rows"), F.count_distinct(column).alias("_cols"))
    t = t.join(levels, by) if by else t.crossJoin(F.broadcast(levels))
    dof = (F.col("_rows") - 1) * (F.col("_cols") - 1)
    e = F.col("_r") * F.col("_c") / F.col("_n")
    gap = F.abs(F.col("n") - e)
    gap = F.when(dof == 1, F.greatest(gap - F.lit(0.5), F.lit(0.0))).otherwise(gap)
    t = t.withColumn("_dof", dof).withColumn("_x", gap * gap / e).withColumn("_small", (e < 5).cast("long"))
    return t.groupBy(*by).agg(
        F.when(F.max("_dof") >= 1, F.round(F.sum("_x"), 6)).alias("chi2"), F.max("_dof").cast("long").alias("dof"), F.sum("n").alias("n"), F.sum("_small").alias("small_cells")
    )


def chi_square_p(x: float | None, dof: int) -> float | None:
    """The upper tail of the chi-square distribution: the regularised incomplete gamma function."""
    if x is None or dof < 1:
        return None
    a, h = dof / 2, x / 2
    if h <= 0:
        return 1.0
    scale = math.exp(a * math.log(h) - h - math.lgamma(a))
    if h < a + 1:  # series of the lower tail
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * total:
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1 - scale * total)
    b, c, d = h + 1 - a, 1e300, 1 / (h + 1 - a)  # continued fraction of the upper tail
    f = d
    for i in range(1, 500):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b)
        c = b + n / c
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, scale * f)


@F.pandas_udf(DoubleType())
def _chi_square_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi_square_p(None if pd.isna(a) else float(a), 0 if pd.isna(b) else int(b)) for a, b in zip(x, dof)], dtype=float)


def chi_square_test(df: DataFrame, row: str, column: str, by: list[str]) -> DataFrame:
    """T-X with p; one row per group reaches Python."""
    return chi_square(df, row, column, by).withColumn("p", F.nanvl(_chi_square_p("chi2", "dof"), F.lit(None).cast("double")))


def confusion(df: DataFrame, a: str, b: str, domain: Sequence[str]) -> DataFrame:
    """(row, one column per label) over a fixed domain, empty rows and columns kept."""
    inside = df.where(F.col(a).isin(*domain) & F.col(b).isin(*domain))
    counted = inside.groupBy(F.col(a).alias("row")).agg(*[F.sum((F.col(b) == c).cast("long")).alias(c) for c in domain])
    rows = df.sparkSession.createDataFrame([(c,) for c in domain], "row string")
    return rows.join(counted, "row", "left").na.fill(0, list(domain))


def kappa(df: DataFrame, a: str, b: str, domain: Sequence[str]) -> DataFrame:
    """T-K: (n, exact, kappa) over a fixed domain; 1 where chance agreement is complete, null without rows."""
    inside = df.where(F.col(a).isin(*domain) & F.col(b).isin(*domain))
    sums = [F.sum((F.col(x) == c).cast("double")).alias(f"_{k}{i}") for i, c in enumerate(domain) for k, x in (("a", a), ("b", b))]
    one = inside.agg(F.count("*").alias("n"), F.sum((F.col(a) == F.col(b)).cast("long")).alias("exact"), *sums)
    n = F.col("n")
    pe = sum((F.col(f"_a{i}") * F.col(f"_b{i}") for i in range(len(domain))), F.lit(0.0)) / (n * n)
    po = F.col("exact") / n
    return one.select("n", F.coalesce("exact", F.lit(0)).cast("long").alias("exact"), F.when(n > 0, F.when(pe >= 1, 1.0).otherwise(F.round((po - pe) / (1 - pe), 9))).alias("kappa"))


def omnibus(diffs: DataFrame, categories: Sequence[str], by: list[str]) -> DataFrame:
    """T-O: the sum over categories of the squared mean difference; items lacking a category are left out."""
    names = [f"diff_{c}" for c in categories]
    total: Column = F.lit(0.0)
    for c in names:
        total = total + F.avg(c) * F.avg(c)
    return diffs.dropna("any", subset=names).groupBy(*by).agg(F.count("*").alias("n"), F.round(total, 9).alias("statistic"))


def histogram(df: DataFrame, value: str, by: list[str], bins: int = 24, most_groups: int = 10_000) -> DataFrame:
    """(by, bin, lo, hi, n) over equal bins from -s to s, s = max(1, largest absolute value); the last bin is closed."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    span = kept.groupBy(*by).agg(F.greatest(F.lit(1.0), F.max(F.abs(value))).alias("_s"))
    width = 2 * F.col("_s") / bins
    at = F.least(F.floor((F.col(value) + F.col("_s")) / width), F.lit(bins - 1)).cast("int")
    got = kept.join(_few(span, by, "_s", most_groups), by).withColumn("bin", at)  # one row a group
    out = got.groupBy(*by, "bin", "_s").agg(F.count("*").alias("n"))
    return out.select(*by, "bin", F.round(F.col("bin") * width - F.col("_s"), 6).alias("lo"), F.round((F.col("bin") + 1) * width - F.col("_s"), 6).alias("hi"), "n")


# ---- resampling ------------------------------------------------------------------------------------------------------
def bootstrap_means(values: np.ndarray, resamples: int, seed: int, budget: int = 4_000_000) -> np.ndarray:
    """Means of resamples drawn from one generator, in blocks that hold `budget` indices; the draws don't depend on it."""
    rng = np.random.default_rng(seed)
    n = len(values)
    step = max(1, budget // n)
    return np.concatenate([values[rng.integers(0, n, size=(min(step, resamples - k), n))].mean(axis=1) for k in range(0, resamples, step)])


def bootstrap_ci(
    df: DataFrame, value: str, by: list[str], order: str, resamples: int = 10_000, level: float = 0.95, seed: int = 0, seeds: dict[tuple, int] | None = None, most_items: int = 100_000
) -> DataFrame:
    """T-B: (by, n, mean, ci_lo, ci_hi), the percentile interval of the mean, drawn exactly as by NumPy's generator.

    seeds: a group's own seed, by the values of `by`. A group's values, ordered by `order`, are drawn in one task, which
    is why a group beyond `most_items` is refused; poisson_ci has no such bound. Below two values the interval is null.
    """
    group = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in by)
    own = seeds or {}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].to_numpy(float)
        v = v[~np.isnan(v)]
        if len(v) > most_items:
            raise ValueError(f"{len(v)} items; use poisson_ci")
        lo = hi = None
        if len(v) >= 2:
            means = bootstrap_means(v, resamples, own.get(tuple(key), seed))
            tail = (1 - level) / 2 * 100
            lo, hi = np.percentile(means, tail), np.percentile(means, 100 - tail)
        return pd.DataFrame([(*key, len(v), v.mean() if len(v) else None, lo, hi)], columns=[*by, "n", "mean", "ci_lo", "ci_hi"])

    return df.select(*by, order, value).groupBy(*by).applyInPandas(run, f"{group}, n long, mean double, ci_lo double, ci_hi double")


def scattered(items: np.ndarray, columns: int, seed: int) -> np.ndarray:
    """items x columns of random 64-bit numbers that depend on item, column and seed alone (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        base = items.astype(np.int64).view(np.uint64) ^ (np.uint64(seed & (2**64 - 1)) * np.uint64(0xD6E8FEB86659FD93))
        z = base[:, None] + np.arange(1, columns + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def poisson_sums() -> list[float]:
    """The chances of at most 0, 1, 2 ... of the Poisson distribution with mean 1."""
    return np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)]).tolist()


def poisson_weights(items: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """items x resamples of Poisson(1) counts: uniform numbers looked up among the distribution's sums."""
    return np.searchsorted(poisson_sums(), (scattered(items, resamples, seed) >> np.uint64(11)) * 2.0**-53).astype(float)


def flip_signs(items: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """items x resamples of -1 and 1, a bit of a random number each."""
    bits = np.unpackbits(scattered(items, -(-resamples // 64), seed).view(np.uint8), axis=1)[:, :resamples]
    return bits.astype(float) * 2 - 1


def _partial_sums(df: DataFrame, by: list[str], item: str, values: list[str], resamples: int, draw, seed: int, block: int = 2_000_000) -> DataFrame:  # noqa: ANN001
    """(by, r, w, x_<value>...): per resample the sums of the weights and of weight times value.

    Each row's weights depend on its item and the seed alone, so partitions sum on their own, in any order and again
    after a loss; `resamples` rows a group and partition are all that is shuffled.
    """
    kinds = dict(df.dtypes)
    group = ", ".join(f"{c} {kinds[c]}" for c in by)
    step = max(1, block // resamples)

    def run(batches):  # noqa: ANN001, ANN202
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, rows in pdf.groupby(by, dropna=False, sort=False):
                key = key if isinstance(key, tuple) else (key,)
                at = tuple(None if pd.isna(k) else k for k in key)
                s = held.setdefault(at, np.zeros((1 + len(values), resamples)))
                h, v = rows["_h"].to_numpy(), rows[values].to_numpy(float)
                for i in range(0, len(h), step):
                    w = draw(h[i : i + step], resamples, seed)
                    s[0] += w.sum(axis=0)
                    s[1:] += v[i : i + step].T @ w
        for at, s in held.items():
            yield pd.DataFrame({**{c: [k] * resamples for c, k in zip(by, at)}, "r": range(resamples), "w": s[0], **{f"x_{c}": s[1 + i] for i, c in enumerate(values)}})

    number = F.conv(F.substring(F.sha2(F.col(item).cast("string"), 256), 1, 15), 16, 10).cast("long")  # a digest that any engine has
    whole = df.dropna("any", subset=values).select(*by, F.coalesce(number, F.lit(0)).alias("_h"), *values)
    sums = ", ".join(f"x_{c} double" for c in values)
    drawn = whole.mapInPandas(run, f"{group}, r int, w double, {sums}")
    return drawn.groupBy(*by, "r").agg(F.sum("w").alias("w"), *(F.sum(f"x_{c}").alias(f"x_{c}") for c in values))


def poisson_ci(df: DataFrame, value: str, by: list[str], item: str, resamples: int = 10_000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """T-B for groups of any size: the percentile interval by Poisson resampling; not the same draws as bootstrap_ci."""
    kept = df.where(~F.isnan(F.col(value)))
    draws = _partial_sums(kept, by, item, [value], resamples, poisson_weights, seed).select(*by, F.try_divide(f"x_{value}", "w").alias("m"))
    tail = (1 - level) / 2
    return draws.groupBy(*by).agg(F.percentile("m", tail).alias("ci_lo"), F.percentile("m", 1 - tail).alias("ci_hi"))


def sign_flip_test(diffs: DataFrame, categories: Sequence[str], by: list[str], item: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """T-P for groups of any size: the test of permutation_test, (by, n, statistic, p), with other draws of the signs."""
    names = [f"diff_{c}" for c in categories]
    seen = omnibus_exact(diffs, names, by)
    flipped = _partial_sums(diffs, by, item, names, resamples, flip_signs, seed)
    stat = sum((F.col(f"x_{c}") / F.col("n") * F.col(f"x_{c}") / F.col("n") for c in names), F.lit(0.0))
    hits = flipped.join(seen, by).groupBy(*by).agg(F.max("n").alias("n"), F.max("statistic").alias("statistic"), F.sum((stat >= F.col("statistic") - 1e-15).cast("long")).alias("_hits"))
    return hits.select(*by, "n", "statistic", ((1 + F.col("_hits")) / F.lit(1.0 + resamples)).alias("p"))


def omnibus_exact(diffs: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """(by, n, statistic) without rounding."""
    total = sum((F.avg(c) * F.avg(c) for c in names), F.lit(0.0))
    return diffs.dropna("any", subset=names).groupBy(*by).agg(F.count("*").alias("n"), total.alias("statistic"))


def permutation_test(diffs: DataFrame, categories: Sequence[str], by: list[str], item: str, resamples: int = 10_000, seed: int = 0, seeds: dict[tuple, int] | None = None, most_items: int = 100_000) -> DataFrame:
    """T-P: (by, n, statistic, p): an item's whole vector changes its sign at once; p = (1 + hits) / (1 + resamples).

    Observed and permuted statistics use the same complete items; without any, all is null. The product of signs and
    values replaces the cube of all flips. A group beyond `most_items` is refused, since it is drawn in one task by one
    generator (`seeds`: its own seed); sign_flip_test has no such bound.
    """
    names = [f"diff_{c}" for c in categories]
    group = ", ".join(f"{c} {dict(diffs.dtypes)[c]}" for c in by)
    own = seeds or {}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(item)[names].to_numpy(float)
        v = v[~np.isnan(v).any(axis=1)]
        n = len(v)
        if n > most_items:
            raise ValueError(f"more than {most_items} items; use sign_flip_test")
        stat = p = None
        if n:
            stat = float((v.mean(axis=0) ** 2).sum())
            rng = np.random.default_rng(own.get(tuple(key), seed))
            hits = 0
            step = max(1, 4_000_000 // n)
            for k in range(0, resamples, step):
                signs = rng.choice(np.array([-1.0, 1.0]), size=(min(step, resamples - k), n))
                hits += int(((((signs @ v) / n) ** 2).sum(axis=1) >= stat - 1e-15).sum())
            p = (1 + hits) / (1 + resamples)
        return pd.DataFrame([(*key, n, stat, p)], columns=[*by, "n", "statistic", "p"])

    return diffs.select(*by, item, *names).groupBy(*by).applyInPandas(run, f"{group}, n long, statistic double, p double")
