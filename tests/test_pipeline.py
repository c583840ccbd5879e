import json
import random

import pytest
from pyspark.sql import functions as F

from dyadlens import report
from dyadlens.analysis import Analysis
from dyadlens.operators import compaction, design, runlog, scoring, validation
from dyadlens.schemas import RAW, RESPONSE_KEYS, SCORED
from dyadlens.sources import files
from dyadlens.streaming import pipeline

STORY = "He kept reading. She left the room."
WHOLE = json.dumps(dict(zip(RESPONSE_KEYS, (7, "2/10", None, "Talk it over", "She left the room.", "yes"))))


def raw(spark, texts):
    rows = [{"cache_key": f"k{i}", "model_slot": "A", "vignette_id": "D1", "vignette_text": STORY, "response_text": t, "attempts": 1, "run_index": 1} for i, t in enumerate(texts)]
    return spark.read.schema(RAW).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows])).withColumn("collected_at", F.expr("timestamp'2026-01-02 03:00:00'"))


def test_score(spark):
    df = scoring.score(raw(spark, [WHOLE, None, "", '{"fault_scroller": 3}', "{" * 500]))
    assert df.schema.simpleString() == spark.createDataFrame([], SCORED).schema.simpleString()
    r = {x.cache_key: x for x in df.collect()}
    a = r["k0"]
    assert (a.fault_scroller, a.fault_partner, a.fault_total, a.severity, a.missing_keys, a.quote_match_mode, a.distress_flagged, a.action_category) == (7.0, 2.0, 9.0, None, "", "exact", True, "negotiate")
    assert r["k1"].missing_keys == "|".join(RESPONSE_KEYS) and not r["k1"].parse_ok and r["k1"].quote_verbatim is None and r["k1"].response_chars == 0
    assert r["k3"].missing_keys == "|".join(RESPONSE_KEYS[1:]) and r["k3"].quote_match_mode == "empty"


def test_grid_and_resume(spark):
    items = spark.createDataFrame([("V1", False, {f"{g}_{c}": "t" for g in ("male", "female", "neutral") for c in ("north_american", "south_asian")})], "id string, distress boolean, variants map<string,string>")
    g = design.grid(items, [("A", "m"), ("B", "n")], 2)
    assert g.count() == 24
    k = design.with_keys(g, "Judge: {vignette}", "sys")
    assert k.select("cache_key").distinct().count() == 4  # slot and run differ, texts don't
    assert design.pending(k, k.where("model_slot = 'A'")).count() == 12
    assert [r.run_index for r in design.first_pending(k, 3).collect()] == [1, 2, 1]
    with pytest.raises(Exception, match="no rendering"):
        design.grid(items.withColumn("variants", F.map_from_entries(F.array(F.struct(F.lit("x"), F.lit("y"))))), [("A", "m")], 1).collect()


def file_row(i, body, when="2026-01-01 00:00:00"):
    return (i, f"f{i}.json", len(body or ""), when, body)


def test_compaction(spark, tmp_path):
    rec = lambda k, n: json.dumps({"cache_key": k, "attempts": n})
    rows = [file_row(1, rec("a", 1)), file_row(2, "﻿" + rec("a", 2) + "\n", "2026-02-01 00:00:00"), file_row(3, rec("b", 1)), file_row(4, rec("c", 1)[:-3]), file_row(5, ""), file_row(6, None), file_row(7, json.dumps({"cache_key": "b"}, indent=2))]
    df = spark.createDataFrame(rows, "file_id long, file_path string, size_bytes long, modified_at string, body string").withColumn("modified_at", F.to_timestamp("modified_at"))
    assert {tuple(r) for r in compaction.same_record_pairs(df).collect()} == {(1, 2), (3, 7)}
    into = f"file://{tmp_path}/out"
    done = compaction.compact(df, into, target_bytes=20)
    assert done.agg(F.sum("n_records")).first()[0] == 2
    assert {(r.cache_key, r.attempts) for r in spark.read.parquet(into).collect()} == {("a", 2), ("b", None)}
    compaction.compact(df, into)  # over an existing folder
    assert spark.read.parquet(into).count() == 2
    assert compaction.compact(df.where("file_id = 5"), f"file://{tmp_path}/none").count() == 0


def test_validation(spark):
    s = spark.createDataFrame([("C1", "A", 8.0, 2.0), ("C1", "B", 5.0, 2.0), ("C1", "B", None, 2.0), ("V1", "A", 8.0, 2.0)], "vignette_id string, model_slot string, fault_scroller double, fault_partner double").selectExpr("*", "'g' gender", "'c' culture", "1 run_index")
    checks = validation.control_checks(s, spark.createDataFrame([("C1",)], "id string"))
    assert {(r.model_slot, r.n, r.pass_rate) for r in validation.control_summary(checks).collect()} == {(None, 2, 0.5), ("A", 1, 1.0), ("B", 1, 0.0)}
    with pytest.raises(Exception, match="unknown criterion"):
        validation.control_checks(s, spark.createDataFrame([("C1", "odd")], "id string, pass_criterion string")).collect()
    sheet = spark.createDataFrame([("1", "boundary"), ("1", "x"), ("2", None)], "sample_id string, action_category string")
    assert {(r.problem, r.sample_id) for r in validation.worksheet_problems(sheet).collect()} == {("repeated", "1"), ("unknown", "1"), ("blank", "2")}
    assert validation.release_gate(3, 5, True) == "waiting" and validation.release_gate(5, 5, True) == "ready"
    with pytest.raises(ValueError):
        validation.release_gate(6, 5, True)


def test_samples(spark):
    df = spark.createDataFrame([(s, f"{s}{i}") for s in "ABC" for i in range(30)], "model_slot string, cache_key string")
    for sample in (validation.hashed_sample(df, 20, 1), validation.seeded_sample(df, 20, 1)):
        counts = {r.model_slot: r["count"] for r in sample.groupBy("model_slot").count().collect()}
        assert counts == {"A": 7, "B": 7, "C": 6} and sample.select("sample_id").distinct().count() == 20
    assert validation.hashed_sample(df.limit(0), 20).count() == 0 and validation.seeded_sample(df.limit(0), 20).count() == 0
    # the draw of one generator over the slots' sorted keys, however the rows are spread
    many = [(s, f"{s}{i * 7919 % 1000:04d}") for s, n in (("B", 400), ("A", 5), ("C", 90)) for i in range(n)]
    rng, want = random.Random(3), []
    for s, quota in (("A", 12), ("B", 11), ("C", 11)):
        keys = sorted(k for t, k in many if t == s)
        want += [(s, k) for k in rng.sample(keys, min(quota, len(keys)))]
    got = validation.seeded_sample(spark.createDataFrame([*many, (None, "x"), ("A", None)], "model_slot string, cache_key string").repartition(5), 34, 3)
    assert [(r.model_slot, r.cache_key) for r in got.orderBy("sample_id").collect()] == sorted(want)


def test_run_status(spark):
    cases = [(0, 0, 0, "SUCCESS"), (0, 0, 2, "CAPPED_CLEAN"), (0, 1, 0, "FAILURE"), (67, 1, 0, "PARTIAL_SUCCESS"), (2, 3, 0, "FAILURE"), (2, 2, 0, "PARTIAL_SUCCESS"), (5, 0, 1, "CAPPED_CLEAN"), (5, 0, 0, "SUCCESS")]
    df = spark.createDataFrame(cases, "w int, f int, c int, want string")
    assert all(r.want == r.got for r in df.withColumn("got", runlog.run_status(F.col("w"), F.col("f"), F.col("c"))).collect())


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.json").write_text(json.dumps({"cache_key": "a", "response_text": WHOLE, "vignette_text": STORY}, indent=2))
    (tmp_path / "raw/b.json").write_text("{broken")
    (tmp_path / "raw/c.json.tmp").write_text("{}")
    rec, bad = files.responses(spark, str(tmp_path / "raw"))
    assert [r.cache_key for r in rec.collect()] == ["a"] and bad.count() == 1
    (tmp_path / "raw/Z.json").write_text('{"cache_key": "z"}')
    assert [r.cache_key for r in files.responses(spark, str(tmp_path / "raw"), ordered=True)[0].collect()] == ["z", "a"]
    (tmp_path / "raw/Z.json").unlink()
    files.write_scored(scoring.score(rec), str(tmp_path / "s.csv"), csv=True)
    assert files.scored_csv(spark, str(tmp_path / "s.csv")).first().fault_scroller == 7.0
    m = validation.manifest(files.binary(spark, str(tmp_path / "raw")))
    assert m.count() == 3
    files.write_manifest(m, str(tmp_path / "m"))
    files.write_json({"a": "ü"}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": "ü"}
    (tmp_path / "i.jsonl").write_text('{"id": "V1", "distress": true, "variants": {"male_x": "t"}}\n{"distress": true}\n')
    with pytest.raises(Exception, match="required key"):
        files.items(spark, str(tmp_path / "i.jsonl")).collect()


def test_streaming(spark, tmp_path):
    raw(spark, [WHOLE, "x"]).write.parquet(str(tmp_path / "in"))
    q = pipeline.score_available(pipeline.raw_stream(spark, str(tmp_path / "in"), "parquet"), str(tmp_path / "out"), str(tmp_path / "c1"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = pipeline.count_available(pipeline.raw_stream(spark, str(tmp_path / "in"), "parquet"), "daily", str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert [(r.model_slot, r.n, r.attempts) for r in spark.table("daily").collect()] == [("A", 2, 2)]
    out = pipeline.once_by_key(pipeline.raw_stream(spark, str(tmp_path / "in"), "parquet")).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert spark.table("once").count() == 2


def test_report(spark):
    assert report.number(None) == "n/a" and report.number(2) == "2" and report.number(0.12345) == "0.123" and report.probability(0.0001) == "<0.001"
    rows = [("A", "m", f"V{i}", g, c, True, "", 5.0 + (g == "male") + i % 3, 2.0, None, "boundary", True, "exact", False) for i in range(6) for g in ("male", "female", "neutral") for c in ("north_american", "south_asian")]
    df = spark.createDataFrame(rows, "model_slot string, model_id string, vignette_id string, gender string, culture string, parse_ok boolean, missing_keys string, fault_scroller double, fault_partner double, severity double, action_category string, quote_verbatim boolean, quote_match_mode string, distress_flagged boolean")
    a = Analysis(df, resamples=200)
    h1 = a.primary().where("hypothesis = 'H1'").first()
    assert (h1.mean, h1.n, h1.ci_lo, h1.ci_hi) == (1.0, 6, 1.0, 1.0) and abs(h1.p_holm - min(1, 2 * h1.p)) < 1e-9
    text = report.results(a.sections())
    assert text.startswith("# Results") and "## Primary tests" in text and "No rows." in text
    a.close()
    with Analysis(df, resamples=400, most_items=2) as large:  # more items than one task should hold: scattered draws
        h1 = large.primary().where("hypothesis = 'H1'").first()
        assert (h1.mean, h1.n, round(h1.ci_lo, 9), round(h1.ci_hi, 9)) == (1.0, 6, 1.0, 1.0)
        assert large.category_permutation().first().p == 1.0 and large.category_intervals().count() == 5
