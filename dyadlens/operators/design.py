"""The crossed design: planned tasks, their content-addressed keys, and what is still to be collected.

A missing rendering of an item is an error, as are items without id or renderings. An empty item table gives an empty
plan. Keys of cached rows that repeat count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import cache_key
from ..schemas import CULTURES, GENDERS


def grid(items: DataFrame, slots: Sequence[tuple[str, str]], runs: int, genders: Sequence[str] = GENDERS, cultures: Sequence[str] = CULTURES) -> DataFrame:
    """One row per slot, item, gender, culture and run, run innermost, with the item's rendering.

    slots: (slot, model id). The design's factors are short lists, exploded from literals, so no join is needed.
    """
    array = lambda xs: F.array(*(F.lit(x) for x in xs))
    df = items.select(F.col("id").alias("vignette_id"), "distress", "variants")
    pairs = F.array(*(F.struct(F.lit(i).alias("slot_no"), F.lit(s).alias("model_slot"), F.lit(m).alias("model_id")) for i, (s, m) in enumerate(slots)))
    df = df.select("*", F.explode(pairs).alias("_s")).select("*", "_s.*").drop("_s")
    df = df.select("*", F.posexplode(array(genders)).alias("gender_no", "gender"))
    df = df.select("*", F.posexplode(array(cultures)).alias("culture_no", "culture"))
    df = df.withColumn("variant", F.concat_ws("_", "gender", "culture"))
    text = F.element_at("variants", F.col("variant"))
    df = df.withColumn("vignette_text", F.when(text.isNull(), F.raise_error(F.concat(F.lit("no rendering "), "variant", F.lit(" of "), "vignette_id"))).otherwise(text))
    return df.drop("variants").select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run_index"))


def with_keys(plan: DataFrame, template: str, system: str, effort: Column | None = None, form: Column | None = None) -> DataFrame:
    """The prompt from its template (`{vignette}` stands for the story) and the task's key."""
    null = F.lit(None).cast("string")
    df = plan.withColumn("system_prompt", F.lit(system)).withColumn("user_prompt", F.replace(F.lit(template), F.lit("{vignette}"), F.col("vignette_text")))
    key = cache_key(F.col("model_id"), null if effort is None else effort, null if form is None else form, F.col("run_index"), F.col("system_prompt"), F.col("user_prompt"))
    return df.withColumn("cache_key", key)


def of_slot(options: dict[str, str | None]) -> Column:
    """A slot's own option; null where it has none."""
    out = F.lit(None).cast("string")
    for slot, value in options.items():
        out = F.when(F.col("model_slot") == slot, F.lit(value).cast("string")).otherwise(out)
    return out


def pending(plan: DataFrame, cached: DataFrame, key: str | Sequence[str] = "cache_key") -> DataFrame:
    """Planned rows without a cached one; an anti join whose strategy is left to the optimiser."""
    keys = [key] if isinstance(key, str) else list(key)
    return plan.join(cached.select(*keys).distinct(), keys, "left_anti")


def first_pending(plan: DataFrame, n: int) -> DataFrame:
    """O3: the first n rows in the plan's order."""
    return plan.orderBy("slot_no", "vignette_id", "gender_no", "culture_no", "run_index").limit(n)


def of_slots(df: DataFrame, slots: Sequence[str]) -> DataFrame:
    """rows of the named slots, whatever the case."""
    return df.where(F.upper("model_slot").isin(*(s.upper() for s in slots)))
