"""The composed analysis: primary family, sensitivity, secondary family, as frames of a few rows each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import cells as C
from .operators import scoring, stats
from .schemas import CATEGORIES


#: The two hypotheses: the contrast, and the two sides whose effect size goes with it.
HYPOTHESES = {"H1": ("gap", "first", "second"), "H2": ("gap_frame_diff", "gap_a", "gap_b")}


class Analysis:
    """All frames of one scored table. What several tests share (cells, contrasts) is kept until `close`; with `with` until its end.

    Seeds are those of the protocol's order: every test of every slot draws its own numbers, as NumPy's generator gives
    them. Where a slot has more than `most_items` items, which one task should not hold, all draws are scattered ones
    (stats.poisson_ci, stats.sign_flip_test) instead. Slots are few; more than `most_slots` are refused.
    """

    def __init__(
        self, scored: DataFrame, design: C.Design = C.AUDIT, metric: str = "fault_scroller", seed: int = 20260914, resamples: int = 10_000, most_slots: int = 1_000, most_items: int = 100_000
    ) -> None:
        self.scored, self.design, self.metric, self.seed, self.resamples = scored, design, metric, seed, resamples
        self.good = scoring.analysable(scored)
        self.cells = C.cell_means(self.good, [metric, "fault_partner", "severity"], design, ("model_id",)).persist()
        self.gaps = C.paired_gaps(self.cells, metric, design).persist()
        self.complete = C.complete_gaps(self.cells, metric, design).persist()
        shares = C.proportions(self.good, "action_category", CATEGORIES, design)
        self.diffs = C.category_diffs(shares, CATEGORIES, design).persist()
        items = self.cells.where(F.col(design.slot).isNotNull()).groupBy(design.slot).agg(F.approx_count_distinct(design.item).alias("n"))
        found = items.limit(most_slots + 1).collect()
        if len(found) > most_slots:
            raise ValueError(f"more than {most_slots} slots")
        self.slots = sorted(r[0] for r in found)
        # the count is within a few per cent, hence the margin
        self.scattered = max((r["n"] for r in found), default=0) > 0.8 * most_items

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Let go of what is kept."""
        for df in (self.cells, self.gaps, self.complete, self.diffs):
            df.unpersist()

    def _seeds(self, of) -> dict[tuple, int]:  # noqa: ANN001
        """(slot, hypothesis) -> seed."""
        return {(s, h): self.seed + of(i, k) for i, s in enumerate(self.slots) for k, h in enumerate(HYPOTHESES)}

    def _intervals(self, long: DataFrame, by: list[str], seeds: dict[tuple, int] | None = None) -> DataFrame:
        """(by, n, mean, ci_lo, ci_hi) of the column `value`."""
        if not self.scattered:
            return stats.bootstrap_ci(long, "value", by, self.design.item, self.resamples, seed=self.seed, seeds=seeds)
        basic = long.where("value is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
        return basic.join(stats.poisson_ci(long, "value", by, self.design.item, self.resamples, seed=self.seed), by, "left")

    def _tests(self, gaps: DataFrame, seeds: dict[tuple, int]) -> DataFrame:
        by = [self.design.slot, "hypothesis"]
        long = stats.stacked(gaps, HYPOTHESES, (self.design.slot, self.design.item))
        t = stats.signed_rank_test(long, "value", by).join(stats.cliffs_delta(long, "a", "b", by).select(*by, "delta"), by, "left")
        ci = self._intervals(long, by, seeds)
        return t.join(ci.select(*by, "ci_lo", "ci_hi"), by, "left")

    def primary(self) -> DataFrame:
        """H1 and H2 of every slot, corrected as one family; a test's seed grows by its place among them."""
        tests = self._tests(self.gaps, self._seeds(lambda i, k: len(HYPOTHESES) * i + k))
        return stats.holm(tests.withColumn("_f", F.lit(1)).withColumn("_t", F.concat(self.design.slot, "hypothesis")), "p", ["_f"], "_t").drop("_f", "_t")

    def sensitivity(self) -> DataFrame:
        """The same over complete items, uncorrected, with the matched-pair signs."""
        by = [self.design.slot, "hypothesis"]
        signs = stats.sign_statistic(stats.stacked(self.complete, HYPOTHESES, (self.design.slot,)), "value", by)
        return self._tests(self.complete, self._seeds(lambda i, k: 5000 * (i + 1) + k + 1)).join(signs, by, "left")

    def per_frame(self) -> DataFrame:
        """T-E: the gap within each frame, uncorrected, all with one seed, and the third level's mean."""
        by = [self.design.slot, "frame"]
        sides = {self.design.frame_a: ("gap_a", "gap_a", "gap_a"), self.design.frame_b: ("gap_b", "gap_b", "gap_b")}
        long = stats.stacked(self.gaps, sides, (self.design.slot, self.design.item)).withColumnRenamed("hypothesis", "frame")
        ci = self._intervals(long, by).select(*by, "ci_lo", "ci_hi")
        third = self.gaps.groupBy(self.design.slot).agg(F.round(F.avg("third"), 9).alias("third_mean"))
        return stats.signed_rank_test(long, "value", by).join(ci, by).join(third, self.design.slot)

    def categories(self) -> DataFrame:
        """H3: chi-square of categories against frames."""
        return stats.chi_square_test(self.good.where(F.col("action_category").isin(*CATEGORIES)), "action_category", self.design.frame, [self.design.slot])

    def _slot_seed(self, slot: str) -> int:
        return self.seed + 1000 * (self.slots.index(slot) + 1)

    def category_permutation(self) -> DataFrame:
        """H3 sensitivity: the omnibus sign-flip test."""
        if self.scattered:
            return stats.sign_flip_test(self.category_diffs(), CATEGORIES, [self.design.slot], self.design.item, self.resamples, self.seed)
        seeds = {(s,): self._slot_seed(s) + 500 for s in self.slots}
        return stats.permutation_test(self.category_diffs(), CATEGORIES, [self.design.slot], self.design.item, self.resamples, self.seed, seeds)

    def category_diffs(self) -> DataFrame:
        """Category contrasts of complete items."""
        return self.diffs

    def category_intervals(self) -> DataFrame:
        """The bootstrap interval of each category's mean contrast; each category has a seed of its own."""
        slot = self.design.slot
        long = stats.stacked(self.category_diffs(), {c: (f"diff_{c}",) * 3 for c in CATEGORIES}, (slot, self.design.item)).withColumnRenamed("hypothesis", "action_category")
        seeds = {(s, c): self._slot_seed(s) + i for s in self.slots for i, c in enumerate(CATEGORIES)}
        return self._intervals(long, [slot, "action_category"], seeds)

    def flags(self) -> DataFrame:
        """H4: chi-square of the distress flag against the first factor, over items with a cue."""
        cue = self.good.where(F.upper(self.design.item).startswith("D")).withColumn("flagged", F.coalesce("distress_flagged", F.lit(False)))
        return stats.chi_square_test(cue, "flagged", self.design.factor, [self.design.slot])

    def secondary(self) -> DataFrame:
        """H3 and H4 corrected as one family."""
        both = self.categories().withColumn("hypothesis", F.lit("H3")).unionByName(self.flags().withColumn("hypothesis", F.lit("H4")))
        return stats.holm(both.withColumn("_f", F.lit(1)).withColumn("_t", F.concat("hypothesis", self.design.slot)), "p", ["_f"], "_t").drop("_f", "_t")

    def sections(self) -> list[tuple[str, Callable[[], DataFrame], list[str]]]:
        """The report's sections: title, what makes the frame, and its order."""
        s, d = self.design.slot, self.design
        return [
            ("Quality", lambda: C.quality(self.good, self.cells, self.metric, d), [s]),
            ("Quotes not found in the story", lambda: scoring.hallucination_report(self.scored), [s]),
            ("Refusals", lambda: scoring.refusal_rate(self.scored), [s]),
            ("Primary tests", self.primary, ["hypothesis", s]),
            ("Complete items", lambda: C.completeness(self.cells, d), [s]),
            ("Complete-case sensitivity", self.sensitivity, ["hypothesis", s]),
            ("Within frames", self.per_frame, ["frame", s]),
            ("Secondary tests", self.secondary, ["hypothesis", s]),
            ("Category contrasts", self.category_intervals, ["action_category", s]),
            ("Category permutation test", self.category_permutation, [s]),
            ("Distress recall", lambda: C.recall(self.good, d), [s, d.factor]),
        ]
