"""The subpackage's queries: (spark, sf_dir) -> DataFrame, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import consensus, cutoff, leakage, look, mapping, packing, pairs, sentences

SHEETS = {"coder_a": ("manual_validation_50_coder_a", "action_category"), "coder_b": ("manual_validation_50_coder_b", "action_category"), "automated": ("manual_validation_50_key", "automated_action_category")}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs with their kind."""
    return pairs.broken_pairs(table(spark, d, "raw")).select("cache_key", F.col("first").alias("defect"))


def p1_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every rule that triggers, by how many pairs."""
    found = pairs.broken_pairs(table(spark, d, "raw")).select(F.explode("defects").alias("defect"))
    return found.groupBy("defect").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Responses that break off."""
    return cutoff.cut_responses(table(spark, d, "raw"))


def p3_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of broken-off responses by slot."""
    return cutoff.cut_share(table(spark, d, "raw"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that look like their story but are made of other characters."""
    v = table(spark, d, "vignettes", "id", "variants")
    raw = look.same_look(table(spark, d, "raw"), "vignette_text", "cache_key", v, passage=False)
    scored = look.same_look(table(spark, d, "scored"), "evidence_quote", "cache_key", v, passage=True)
    return raw.select(F.lit("vignette_text").alias("field"), "cache_key").unionByName(scored.select(F.lit("evidence_quote").alias("field"), "cache_key"))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one consistent form of every quote and story."""
    a = look.forms_of(table(spark, d, "raw", "cache_key", "vignette_text"), "vignette_text")
    b = look.forms_of(table(spark, d, "scored", "cache_key", "evidence_quote"), "evidence_quote")
    a = a.select(F.lit("vignette_text").alias("field"), "cache_key", F.col("vignette_text_form").alias("form"))
    return a.unionByName(b.select(F.lit("evidence_quote").alias("field"), "cache_key", F.col("evidence_quote_form").alias("form")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Freely worded values with the entry meant, or none."""
    got = mapping.mapped_values(table(spark, d, "scored"), table(spark, d, "canonical_values"))
    return got.where("not exact").select("field", "cache_key", "code").distinct()


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The report of values without an entry."""
    return mapping.unmatched(table(spark, d, "scored"), table(spark, d, "canonical_values"))


def p5_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All entries within the allowed distance of each value."""
    return mapping.candidates(table(spark, d, "scored"), table(spark, d, "canonical_values"))


def _consensus(spark: SparkSession, d: str) -> consensus.Consensus:
    labels = consensus.given_labels({who: (table(spark, d, t), c) for who, (t, c) in SHEETS.items()})
    return consensus.Consensus(labels, list(SHEETS))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Samples whose labels differ, with the category most annotators name."""
    return _consensus(spark, d).pluralities().where("not unanimous").select("sample_id", F.col("plurality").alias("label"))


def p6_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The consensus label of every sample."""
    return _consensus(spark, d).items().select("sample_id", "label", "confidence", "n_labels")


def p6_reliability(spark: SparkSession, d: str) -> DataFrame:
    """The reliability of every annotator."""
    return _consensus(spark, d).annotators()


def p6_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far annotators agree."""
    return _consensus(spark, d).agreement()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container."""
    return packing.containers(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(packing.containers(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that repeat a passage of an evaluation item."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked."""
    return leakage.leaked_items(leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The ends of all sentences."""
    return sentences.sentence_units(table(spark, d, "documents")).select("doc_id", "end_char")


def p9_units(spark: SparkSession, d: str) -> DataFrame:
    """All sentences with their places."""
    return sentences.sentence_units(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All of them by name."""
    return {f.__name__: f for f in (p1_found, p1_defects, p3_found, p3_share, p4_found, p4_forms, p5_found, p5_unmatched, p5_candidates, p6_found, p6_consensus, p6_reliability, p6_agreement, p7_containers, p7_fill, p8_found, p8_items, p9_found, p9_units)}
