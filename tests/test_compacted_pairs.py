"""Pairs of files come from the reconciled output of the compaction; what it reads, writes and swaps is checked."""

import json

import pytest
from pyspark.sql import functions as F

from dyadlens.operators import compaction
from dyadlens.session import shared_dir

COLS = "file_id long, file_path string, size_bytes long, modified_at string, body string"


def frame(spark, bodies):
    rows = [(i, f"f{i}.json", 9, "2026-01-01 00:00:00", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, COLS).withColumn("modified_at", F.to_timestamp("modified_at"))


def files(spark, keys):
    return frame(spark, [json.dumps({"cache_key": k, "attempts": i}) if k else k for i, k in enumerate(keys)])


def test_pairs_are_read_from_the_compacted_files(spark, tmp_path):
    keys = ["a", "b", "a", None, "c", "", "b", "a", *[f"k{i}" for i in range(40)], *["hot"] * 30]
    want = [(i, j) for i, a in enumerate(keys) for j in range(i + 1, len(keys)) if a and a == keys[j]]
    for block in (1_000, 4, 1):  # a record's files in one block or in many
        into = f"file://{tmp_path}/out{block}"
        assert sorted(map(tuple, compaction.same_record_pairs(files(spark, keys), into, block).collect())) == want
    assert compaction.compacted(spark, into).count() == len({k for k in keys if k})
    groups = {r.file_id: (r.first_file, r.n_files) for r in compaction.file_groups(spark, into).where("cache_key in ('a', 'c')").collect()}
    assert groups == {0: (0, 3), 2: (0, 3), 7: (0, 3), 4: (4, 1)}
    assert compaction.same_record_pairs(files(spark, [None, ""])).count() == 0


def test_what_counts_as_a_complete_record(spark):
    good = ['{"cache_key": "a"}', ' \n{"cache_key": "b", "x": {"y": [1, {"z": "}{"}]}} \n', '﻿{"cache_key":"c"}', '{"cache_key": "z", "cache_key": "d"}', '{"cache_key": "e", "latency_s": NaN}', '{"cache_key": "f", "response_text": "a \\" b { \\\\"}']
    bad = ['{"cache_key": "x"} trailing', '{"cache_key": "x"}{"cache_key": "y"}', '{"cache_key": "x"}}', '{"cache_key": "x"', '{"cache_key": "x", "response_text": "a}', "[]", '"x"', "7", "", None, '{"a": 1}', '{"cache_key": ""}', '{"cache_key": null}', '{"cache_key": "x"},"end":1}', '{"cache_key": "x"},"y":{"b":2}']
    got = {r.file_id: r.cache_key for r in compaction.complete_records(frame(spark, good + bad)).collect()}
    assert got == dict(enumerate("abcdef"))


def test_unknown_fields_and_nan_are_kept(spark, tmp_path):
    into = f"file://{tmp_path}/out"
    compaction.compact(frame(spark, ['{"cache_key": "a", "attempts": 2}', '{"cache_key": "b", "novel": [1, 2]}', '{"cache_key": "c", "latency_s": NaN}']), into)
    got = {r.cache_key: r for r in compaction.compacted(spark, into).collect()}
    assert got["a"].attempts == 2 and got["a"].other_body is None and "novel" in got["b"].other_body and got["c"].latency_s != got["c"].latency_s


def test_lost_records_and_changed_contents_are_noticed(spark, tmp_path, monkeypatch):
    whole = compaction.distinct_records
    df = files(spark, ["a", "a", "b"])
    for change in (lambda r: r.where("cache_key = 'a'"), lambda r: r.withColumn("body", F.regexp_replace("body", "1", "7")), lambda r: r.unionByName(r)):
        monkeypatch.setattr(compaction, "distinct_records", lambda f, change=change: change(whole(f)))
        with pytest.raises(compaction.Mismatch):
            compaction.compact(df, f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_swap_is_checked(spark, tmp_path):
    into = f"file://{tmp_path}/out"
    for name in ("out", "out.staging"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part").write_text(name)
    compaction.swap(spark, f"{into}.staging", into)
    assert (tmp_path / "out" / "part").read_text() == "out.staging" and not (tmp_path / "out.old").exists()
    with pytest.raises(compaction.Mismatch):  # nothing is staged: the old folder is live again
        compaction.swap(spark, f"{into}.staging", into)
    assert (tmp_path / "out" / "part").read_text() == "out.staging"
    (tmp_path / "out").rename(tmp_path / "out.old")  # broken off between its two steps
    (tmp_path / "out.staging").mkdir()
    compaction.swap(spark, f"{into}.staging", into)
    assert (tmp_path / "out").exists() and not (tmp_path / "out.old").exists()


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        conf = Unset

        def __init__(self, master):
            self.sparkContext = type("C", (), {"master": master, "getConf": lambda _: Unset})()

    for master in ("spark://somewhere:7077", "local-cluster[3,2,3000]", "yarn"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_dir(Session(master), "x")
    assert shared_dir(Session("local[4]"), "x").startswith("file:///")
