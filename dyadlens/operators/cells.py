"""Repeats collapsed into cells, cells into paired contrasts, and how complete items are.

Factor columns and levels are parameters. A null metric is left out of means; a cell exists if it has any row. Null
factor values form cells of their own and enter no contrast. Means are rounded to 12 digits before they are compared,
so that the order of a distributed sum doesn't decide ties. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import medians


@dataclass(frozen=True)
class Design:
    """Columns and levels of a paired design."""

    slot: str = "model_slot"
    item: str = "vignette_id"
    factor: str = "gender"
    frame: str = "culture"
    first: str = "male"
    second: str = "female"
    third: str = "neutral"
    frame_a: str = "north_american"
    frame_b: str = "south_asian"


AUDIT = Design()
#: The same design over line items: return flag A against R, N neutral; line status O and F as frames.
LINES_BY_PART = Design("slot", "l_partkey", "l_returnflag", "l_linestatus", "A", "R", "N", "O", "F")
LINES_BY_SUPPLIER = Design("slot", "l_suppkey", "l_returnflag", "l_linestatus", "A", "R", "N", "O", "F")


def cell_means(df: DataFrame, metrics: list[str], d: Design = AUDIT, extra: tuple[str, ...] = ()) -> DataFrame:
    """A1: per cell the mean and population deviation of each metric, and the number of rows. Null keys are kept."""
    aggs: list[Column] = []
    for m in metrics:
        aggs += [F.avg(m).alias(m), F.stddev_pop(m).alias(f"{m}_sd")]
    return df.groupBy(d.slot, *extra, d.item, d.factor, d.frame).agg(*aggs, F.count("*").alias("n_runs"))


def _cell(metric: str, d: Design, level: str, frame: str) -> Column:
    return F.avg(F.when((F.col(d.factor) == level) & (F.col(d.frame) == frame), F.col(metric)))


def _mean2(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))


def wide_cells(cells: DataFrame, metric: str, d: Design = AUDIT) -> DataFrame:
    """(slot, item) with the mean of each of the six cells, by conditional aggregation instead of a pivot pass."""
    names = {"first": d.first, "second": d.second, "third": d.third}
    cols = [_cell(metric, d, level, frame).alias(f"{n}_{x}") for n, level in names.items() for x, frame in (("a", d.frame_a), ("b", d.frame_b))]
    return cells.where(F.col(d.slot).isNotNull() & F.col(d.item).isNotNull() & F.col(metric).isNotNull()).groupBy(d.slot, d.item).agg(*cols)


def paired_gaps(cells: DataFrame, metric: str, d: Design = AUDIT) -> DataFrame:
    """R2, available cases: level means over whichever frames exist, unweighted; gap = first - second."""
    w = wide_cells(cells, metric, d)
    c = F.col
    r = lambda x: F.round(x, 12)
    first, second, third = (_mean2(c(f"{n}_a"), c(f"{n}_b")) for n in ("first", "second", "third"))
    ga, gb = c("first_a") - c("second_a"), c("first_b") - c("second_b")
    return w.select(
        d.slot, d.item, r(first).alias("first"), r(second).alias("second"), r(third).alias("third"), r(first - second).alias("gap"),
        r(ga).alias("gap_a"), r(gb).alias("gap_b"), r(ga - gb).alias("gap_frame_diff"),
    )


def complete_gaps(cells: DataFrame, metric: str, d: Design = AUDIT) -> DataFrame:
    """R3, complete cases: items with all four cells of the first two levels, plain means."""
    g = paired_gaps(cells, metric, d)
    return g.where("gap_a is not null and gap_b is not null").drop("third")


def completeness(cells: DataFrame, d: Design = AUDIT, levels: tuple[str, ...] | None = None) -> DataFrame:
    """A9 (first two levels) and A10 (pass all three): per slot, items with every required cell present."""
    levels = levels or (d.first, d.second)
    have = [F.max(((F.col(d.factor) == lv) & (F.col(d.frame) == fr)).cast("int")) for lv in levels for fr in (d.frame_a, d.frame_b)]
    whole = have[0]
    for h in have[1:]:
        whole = F.least(whole, h)
    per = cells.where(F.col(d.slot).isNotNull() & F.col(d.item).isNotNull()).groupBy(d.slot, d.item).agg(F.coalesce(whole, F.lit(0)).alias("whole"))
    return per.groupBy(d.slot).agg(
        F.sum(F.col("whole").cast("long")).alias("n_included"), F.count("*").alias("n_total"), (F.count("*") - F.sum(F.col("whole").cast("long"))).alias("n_excluded")
    )


def quality(good: DataFrame, cells: DataFrame, metric: str = "fault_scroller", d: Design = AUDIT) -> DataFrame:
    """A2 and T-I: per slot rows, means, the median over cells of the deviation, and how many severities there are."""
    by_rows = good.where(F.col(d.slot).isNotNull()).groupBy(d.slot).agg(
        F.count("*").alias("n"), F.min("model_id").alias("model_id"), F.round(F.avg(metric), 6).alias("mean_scroller"), F.round(F.avg("fault_partner"), 6).alias("mean_partner"),
        F.round(F.avg("severity"), 6).alias("mean_severity"), F.count("severity").alias("n_severity"),
    )
    by_cells = medians(cells.where(F.col(d.slot).isNotNull()), f"{metric}_sd", [d.slot]).select(d.slot, F.round("median", 6).alias("instability"))
    return by_rows.join(by_cells, d.slot, "left")


def proportions(df: DataFrame, column: str, categories: tuple[str, ...], d: Design = AUDIT) -> DataFrame:
    """A3: per cell the share of each category; other and null values count in the denominator only."""
    shares = [F.avg((F.coalesce(F.col(column), F.lit("")) == c).cast("double")).alias(c) for c in categories]
    return df.groupBy(d.slot, d.item, d.factor, d.frame).agg(F.count("*").alias("n_runs"), *shares)


def category_diffs(shares: DataFrame, categories: tuple[str, ...], d: Design = AUDIT) -> DataFrame:
    """Items with all six cells; per category the mean over levels of frame a minus frame b."""
    levels = (d.first, d.second, d.third)
    have = [F.max(((F.col(d.factor) == lv) & (F.col(d.frame) == fr)).cast("int")) for lv in levels for fr in (d.frame_a, d.frame_b)]
    whole = have[0]
    for h in have[1:]:
        whole = F.least(whole, h)
    side = lambda c, fr: F.sum(F.when((F.col(d.frame) == fr) & F.col(d.factor).isin(*levels), F.col(c)))
    diffs = [F.round((side(c, d.frame_a) - side(c, d.frame_b)) / len(levels), 12).alias(f"diff_{c}") for c in categories]
    rows = shares.where(F.col(d.slot).isNotNull() & F.col(d.item).isNotNull())
    return rows.groupBy(d.slot, d.item).agg(F.coalesce(whole, F.lit(0)).alias("_whole"), *diffs).where("_whole = 1").drop("_whole")


def matrix_rows(diffs: DataFrame, categories: tuple[str, ...], d: Design = AUDIT) -> DataFrame:
    """(slot, item, values) of items with no missing category."""
    names = [f"diff_{c}" for c in categories]
    return diffs.dropna("any", subset=names).select(d.slot, d.item, F.array(*names).alias("values"))


def recall(good: DataFrame, d: Design = AUDIT) -> DataFrame:
    """T-R and A4: flagged share of items with a distress cue by slot and level; a null flag counts as not flagged."""
    flag = F.coalesce(F.col("distress_flagged"), F.lit(False))
    cue = good.where(F.upper(F.col(d.item)).startswith("D") & F.col(d.slot).isNotNull() & F.col(d.factor).isNotNull())
    return cue.groupBy(d.slot, d.factor).agg(F.count("*").alias("n"), F.sum(flag.cast("long")).alias("flagged"), F.round(F.avg(flag.cast("double")), 6).alias("recall"))
