"""The operators over DataFrames: nulls, blanks, repeats, empty tables and clashing extra columns."""

import json

import pytest
from pyspark.sql import functions as F

from dyadlens.llm import consensus, cutoff, leakage, look, mapping, packing, pairs, queries, sentences
from dyadlens.schemas import RAW

STORY = "Dana tuned the cello. Noël kept reading. A banner said 1,002 people were viewing the same page."


def raw(spark, rows):
    base = {"model_slot": "A", "vignette_id": "V1", "variant": "male_x", "vignette_text": STORY, "user_prompt": STORY, "usage": {"completion_tokens": 90}}
    lines = [json.dumps(base | r) for r in rows] or ["{}"]
    df = spark.read.schema(RAW).json(spark.sparkContext.parallelize(lines))
    return (df if rows else df.limit(0)).withColumn("k", F.lit("clash")).withColumn("t", F.lit(1)).withColumn("doc", F.lit(1))


def whole(quote="Dana tuned the cello."):
    return json.dumps({"fault_scroller": 7, "fault_partner": 2, "severity": 5, "recommended_action": "Talk about it.", "evidence_quote": quote, "distress_flagged": False})


def test_pairs_and_cuts(spark):
    rows = [{"cache_key": "a", "response_text": whole()}, {"cache_key": "b", "response_text": whole()[:50]}, {"cache_key": "b", "response_text": whole()[:50], "usage": None}, {"cache_key": "c", "response_text": None}, {"cache_key": None, "response_text": ""}, {"cache_key": "d", "response_text": whole("A banner said 1,002 peo"), "finish_reason": "length"}]
    # intact ones to learn from
    quotes = ("Dana tuned the cello.", "Noël kept reading.", "A banner said 1,002 people were viewing the same page.")
    rows += [{"cache_key": f"w{i}", "response_text": whole(quotes[i % 3]) + ("\n\nThat is all." if i % 5 == 0 else ""), "finish_reason": (None, "stop", "length")[i % 2 + (i % 4 == 3)]} for i in range(24)]
    df = raw(spark, rows * 3)
    assert {tuple(r)[:2] for r in pairs.broken_pairs(df).collect()} == {("b", "truncated"), ("c", "empty"), ("d", "truncated")}
    assert {r.cache_key for r in cutoff.cut_responses(df).collect()} == {"b", "d"}
    share = cutoff.cut_share(df).first()
    assert (share.n, share.n_cut, share.share) == (28, 2, round(2 / 28, 6))
    assert pairs.broken_pairs(raw(spark, [])).count() == 0 == cutoff.cut_responses(raw(spark, [])).count()


def test_same_look(spark):
    v = spark.createDataFrame([("V1", {"male_x": STORY}), ("V2", None), (None, {"male_x": STORY})], "id string, variants map<string,string>").withColumn("k", F.lit(1))
    rows = [{"cache_key": "a", "vignette_text": STORY}, {"cache_key": "b", "vignette_text": STORY.replace("a", "а")}, {"cache_key": "b", "vignette_text": STORY.replace("a", "а")}, {"cache_key": "c", "vignette_text": STORY.replace("lunch", "dinner")}, {"cache_key": "d", "vignette_text": None}, {"cache_key": "e", "vignette_text": "Noël kept"}, {"cache_key": "f", "vignette_text": "Noël kept"}, {"cache_key": "g", "vignette_text": "noël kept"}]
    df = raw(spark, rows)
    assert {r[0] for r in look.same_look(df, "vignette_text", "cache_key", v, passage=False).collect()} == {"b"}
    assert {r[0] for r in look.same_look(df, "vignette_text", "cache_key", v, passage=True).collect()} == {"b", "f"}
    assert look.same_look(raw(spark, []), "vignette_text", "cache_key", v, passage=True).count() == 0
    assert look.forms_of(df, "vignette_text").where("vignette_text is null and vignette_text_form is not null").count() == 0


def test_mapping_frame(spark):
    c = spark.createDataFrame([("recommended_action", "A1", "Read the articles together"), ("action_category", "boundary", "boundary"), (None, "x", "y")], "field string, code string, label string").withColumn("cache_key", F.lit(1))
    s = spark.createDataFrame([("1", "read the artcles together", "boundary"), ("2", "Read the articles together", None), ("3", " ", "lunch"), (None, "x", "y"), ("1", "read the artcles together", "boundary")], "cache_key string, recommended_action string, action_category string").withColumn("code", F.lit(1))
    got = mapping.mapped_values(s, c).where("not exact").select("field", "cache_key", "code").distinct()
    assert {tuple(r) for r in got.collect()} == {("recommended_action", "1", "A1"), ("action_category", "3", "none")}
    assert mapping.mapped_values(s, c.limit(0)).count() == 0 and mapping.mapped_values(s.limit(0), c).count() == 0
    assert {(r.value, r.n) for r in mapping.unmatched(s, c).collect()} == {("lunch", 1)}
    with pytest.raises(ValueError):
        mapping.reference_list(c, most=1)


def test_consensus_frames(spark):
    cols = "sample_id string, action_category string"
    a = spark.createDataFrame([("1", "boundary"), ("1", "Boundary "), ("2", "negotiate"), ("3", None), (None, "boundary"), ("4", "boundary")], cols).withColumn("label", F.lit(1))
    b = spark.createDataFrame([("1", "boundary"), ("2", "seek help"), ("3", "lunch"), ("4", "negotiate")], cols)
    k = spark.createDataFrame([("1", "bound-ary"), ("2", "negotiation"), ("3", "accommodate"), ("4", "")], cols)
    x = consensus.Consensus(consensus.given_labels({"a": (a, "action_category"), "b": (b, "action_category"), "k": (k, "action_category")}), ["a", "b", "k"])
    got = {r.sample_id: (r.plurality, r.unanimous, r.n_labels) for r in x.items().collect()}
    assert got == {"1": ("boundary", True, 3), "2": ("negotiate", False, 3), "3": ("accommodate", True, 1), "4": ("none", False, 2)}
    assert x.annotators().count() == 3 and x.agreement().count() == 4
    none = consensus.Consensus(consensus.given_labels({"a": (a.limit(0), "action_category"), "b": (b.limit(0), "action_category")}), ["a", "b"])
    assert none.items().count() == 0 and none.annotators().count() == 2 and none.agreement().where("value is not null").count() == 0


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(9)).withColumn("container", F.lit("x"))


def test_packing_frame(spark):
    rows = [(i, "word " * (i % 40)) for i in range(300)] + [(1000, "long text of words " * 400), (1001, None), (1002, "")]
    placed = packing.containers(docs(spark, rows), capacity=64, shard_docs=100)
    per = placed.groupBy("container").agg(F.sum("n_tokens").alias("n")).collect()
    assert max(r.n for r in per) <= 64 and placed.select("doc_id").distinct().count() == 303
    n = {r.doc_id: r.n_tokens for r in packing.lengths(docs(spark, rows)).collect()}
    back = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces")).collect()
    assert all(r.n == n[r.doc_id] and (r.pieces == 1 or n[r.doc_id] > 64) for r in back)
    assert packing.containers(docs(spark, rows[:0])).count() == 0
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, packing.containers(docs(spark, rows).repartition(7), capacity=64, shard_docs=100).collect()))


def test_leaks_and_sentences_frames(spark):
    item = "While the beacon changed colour, the elderly harbour clerk balanced a gilded weathervane on one knee."
    d = docs(spark, [(1, item), (1, item), (2, None), (3, ""), (4, "A. B said no. " * 3)])
    items = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = leakage.leaks(d, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 7)} and leakage.leaked_items(found).first().n_docs == 1
    assert leakage.leaks(d, items.limit(0)).count() == 0 and leakage.leaks(d.limit(0), items).count() == 0
    units = sentences.sentence_units(d)
    assert units.where("doc_id in (2, 3)").count() == 0 and units.where("doc_id = 1").count() == 2
    assert sentences.sentence_units(d.limit(0)).count() == 0


def test_queries_are_whole():
    names = queries.queries()
    assert {f"p{n}_found" for n in (1, 3, 4, 5, 6, 8, 9)} <= set(names) and "p7_containers" in names
