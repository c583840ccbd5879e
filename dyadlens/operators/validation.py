"""Control checks, worksheets, samples, manifests and the checks before a release.

Nulls in labels and ratings are missing, not wrong: a control without both ratings has no verdict. Worksheets with
repeated sample ids, labels outside the domain or blanks are reported as problems. Empty tables give empty reports.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CATEGORIES
from ..session import shared_dir

_BLANKS = r"(?U)^\s+|\s+$"

#: The one criterion a control may have, its threshold, and size and seed of the validation sample.
CRITERION = "fault_scroller > fault_partner, and fault_scroller >= 7"
THRESHOLD = 7
SAMPLE, SEED = 50, 20260914


def control_checks(scored: DataFrame, key: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scored rows of control items with `pass`; null if a rating is missing.

    key: (id) and, if it has one, pass_criterion, of which only CRITERION is known: any other is an error. The key's
    size is left to the optimiser's own broadcast threshold.
    """
    item = F.col("id")
    if "pass_criterion" in key.columns:
        item = F.when(F.col("pass_criterion") == CRITERION, item).otherwise(F.raise_error(F.concat(F.lit("unknown criterion of "), item)))
    k = key.select(item.alias("vignette_id")).distinct()
    verdict = F.when(F.col("fault_scroller").isNull() | F.col("fault_partner").isNull(), None).otherwise((F.col("fault_scroller") > F.col("fault_partner")) & (F.col("fault_scroller") >= threshold))
    return scored.join(k, "vignette_id").select("vignette_id", "model_slot", "gender", "culture", "run_index", "fault_scroller", "fault_partner", verdict.alias("pass"))


def control_summary(checks: DataFrame) -> DataFrame:
    """(model_slot, n, pass_rate) by slot and, with null as slot, overall; rows without a verdict don't count."""
    judged = checks.where("pass is not null and model_slot is not null")
    return judged.rollup("model_slot").agg(F.count("*").alias("n"), F.round(F.avg(F.col("pass").cast("double")), 6).alias("pass_rate")).where("n > 0")


def _stripped(column: str) -> Column:
    return F.regexp_replace(F.coalesce(column, F.lit("")), _BLANKS, "")


def worksheet_problems(sheet: DataFrame, domain: Sequence[str] = CATEGORIES, rows: int | None = None) -> DataFrame:
    """(problem, sample_id, n): repeated ids, blank labels, labels outside the domain; with `rows` another number of them."""
    label = _stripped("action_category")
    repeats = sheet.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("problem"), "sample_id", "n")
    blank = sheet.where(label == "").groupBy("sample_id").agg(F.count("*").alias("n")).select(F.lit("blank").alias("problem"), "sample_id", "n")
    odd = sheet.where((label != "") & ~label.isin(*domain)).groupBy("sample_id").agg(F.count("*").alias("n")).select(F.lit("unknown").alias("problem"), "sample_id", "n")
    out = repeats.unionByName(blank).unionByName(odd)
    if rows is None:
        return out
    counted = sheet.agg(F.count("*").alias("n")).where(F.col("n") != rows)
    return out.unionByName(counted.select(F.lit("rows").alias("problem"), F.lit(None).cast("string").alias("sample_id"), "n"))


def sheet_labels(sheet: DataFrame, column: str, name: str) -> DataFrame:
    """(sample_id, name) with the stripped label, one row a sample: of repeated rows the last, in the order of the scan."""
    at = sheet.where("sample_id is not null").select("sample_id", _stripped(column).alias("_label"), F.monotonically_increasing_id().alias("_at"))
    return at.groupBy("sample_id").agg(F.max_by("_label", "_at").alias(name))


def matched_labels(a: DataFrame, b: DataFrame, key: DataFrame, expected: int | None = None) -> DataFrame:
    """(sample_id, coder_a, coder_b, automated) of samples in all three tables; another number than `expected` is an error."""
    parts = [sheet_labels(a, "action_category", "coder_a"), sheet_labels(b, "action_category", "coder_b"), sheet_labels(key, "automated_action_category", "automated")]
    matched = parts[0].join(parts[1], "sample_id").join(parts[2], "sample_id")
    if expected is not None and (n := matched.count()) != expected:
        raise ValueError(f"{n} samples stand in all three tables, not {expected}")
    return matched


def filled(sheet: DataFrame) -> bool:
    """Q2: a label has been written into the worksheet, so it must not be written over."""
    return not sheet.where(_stripped("action_category") != "").isEmpty()


def quotas(slots: Sequence[str], total: int) -> dict[str, int]:
    """Equal shares, the rest to the first slots."""
    base, rest = divmod(total, max(1, len(slots)))
    return {s: base + (i < rest) for i, s in enumerate(sorted(slots))}


def hashed_sample(scored: DataFrame, total: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Q1 for any size: per slot exactly its quota of distinct rows with the smallest seeded hash, numbered by slot and key.

    Slots are few; each task keeps at most the quota of a slot, since the rank limit is pushed below the shuffle.
    """
    slots = [r[0] for r in scored.where("model_slot is not null").select("model_slot").distinct().collect()]
    q = quotas(slots, total)
    keys = scored.where("model_slot is not null").select("model_slot", "cache_key").distinct()
    h = F.sha2(F.concat(F.lit(str(seed)), F.col("cache_key")), 256)
    ranked = keys.withColumn("_r", F.row_number().over(Window.partitionBy("model_slot").orderBy(h, "cache_key"))).where(F.col("_r") <= max(q.values(), default=0))
    quota = F.coalesce(F.element_at(F.create_map(*(x for s, n in q.items() for x in (F.lit(s), F.lit(n)))), F.col("model_slot")), F.lit(0)) if q else F.lit(0)
    kept = ranked.where(F.col("_r") <= quota).drop("_r")
    number = F.row_number().over(Window.orderBy("model_slot", "cache_key"))  # at most `total` rows
    kept = F.broadcast(kept.withColumn("sample_id", F.format_string("MV%03d", number)))
    # of copies of a row the first by its columns, so that the sample is the same in every run
    whole = F.struct(*(c for c, kind in scored.dtypes if not kind.startswith("map") and c not in ("model_slot", "cache_key")))
    rows = scored.join(kept, (scored["model_slot"] == kept["model_slot"]) & scored["cache_key"].eqNullSafe(kept["cache_key"])).select(scored["*"], kept["sample_id"], whole.alias("_w"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id").orderBy("_w"))).where("_n = 1").drop("_n", "_w")


def seeded_sample(scored: DataFrame, total: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Q1 as the reference draws it, at any size: one sequential generator over the slots, each with its keys sorted.

    The generator only needs to know how many keys a slot has; it draws places in their order. The keys are written
    sorted by ranges below the shared folder, the driver sees how many of a slot each file holds, and the keys at the
    places drawn are read from the files that hold them.
    """
    spark = scored.sparkSession
    pairs = scored.where("model_slot is not null and cache_key is not null").select("model_slot", "cache_key")
    into = shared_dir(spark, "sorted")
    pairs.repartitionByRange("model_slot", "cache_key").write.parquet(into)
    rows = spark.read.schema("model_slot string, cache_key string").parquet(into).select("model_slot", "cache_key", F.col("_metadata.file_name").alias("file"))
    # a few rows a file: ranges don't overlap, so files follow one another by their first key
    held = rows.groupBy("model_slot", "file").agg(F.count("*").alias("n"), F.min("cache_key").alias("first")).collect()
    by: dict[str, list[tuple[str, str, int]]] = {}
    for r in held:
        by.setdefault(r["model_slot"], []).append((r["first"], r["file"], r["n"]))
    rng, q, places = random.Random(seed), quotas(list(by), total), []
    for slot in sorted(by):
        files = sorted(by[slot])
        size = sum(n for *_, n in files)
        for place in rng.sample(range(size), min(q[slot], size)):
            for _, file, n in files:
                if place < n:
                    places.append((slot, file, place + 1))
                    break
                place -= n
    drawn = F.broadcast(spark.createDataFrame(places, "s string, f string, p int"))  # at most `total` rows
    ranked = rows.where(F.col("file").isin(sorted({f for _, f, _ in places}))).withColumn("p", F.row_number().over(Window.partitionBy("model_slot", "file").orderBy("cache_key")))
    kept = ranked.join(drawn, (F.col("model_slot") == F.col("s")) & (F.col("file") == F.col("f")) & (ranked["p"] == drawn["p"])).select("model_slot", "cache_key")
    return kept.select(F.format_string("MV%03d", F.row_number().over(Window.orderBy("model_slot", "cache_key"))).alias("sample_id"), "model_slot", "cache_key")


def worksheets(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K4: (worksheet, key) of a sample: the blinded sheet with empty label columns, and what it hides."""
    sheet = sample.select(
        "sample_id", "model_slot", "vignette_id", "gender", "culture", "run_index", "recommended_action", F.lit("").alias("action_category"), F.lit("").alias("coder_notes")
    )
    return sheet, sample.select("sample_id", "cache_key", F.col("action_category").alias("automated_action_category"))


def manifest(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, sha256) of file contents. Null contents have no digest."""
    return files.select(F.col(path).alias("path"), F.sha2(F.col(content), 256).alias("sha256"))


def release_gate(n: int, target: int, locked: bool) -> str:
    """'ready', 'waiting' below the target; too many rows or an unlocked protocol is an error."""
    if n < target:
        return "waiting"
    if n > target or not locked:
        raise ValueError(f"{n} of {target} rows, locked: {locked}")
    return "ready"
