"""Endings over all rows: copies of a broken-off response count once, bounds grow with the input."""

import json

from dyadlens.llm import cutoff, pairs
from dyadlens.llm.endings import endings_of
from test_frames import raw

BROKEN = "Read the articles together, even when the eveni"


def response(action, i=0):
    return json.dumps({"fault_scroller": i % 11, "fault_partner": i // 11, "severity": 5, "recommended_action": action, "evidence_quote": "Dana tuned the cello.", "distress_flagged": False})


def test_copies_of_a_broken_response_do_not_make_its_ending_known(spark):
    rows = [{"cache_key": f"w{i}", "response_text": response(("Read the articles together", "Keep the table free, please", "Talk when it is calm.")[i % 3], i)} for i in range(90)]
    rows += [{"cache_key": f"c{i}", "response_text": response(BROKEN)} for i in range(45)]
    rows += [{"cache_key": "other", "response_text": response("Keep the table free, and talk when the eveni", 3)}]
    df = raw(spark, rows)
    want = {f"c{i}" for i in range(45)} | {"other"}
    assert {r.cache_key for r in pairs.broken_pairs(df).where("first = 'truncated'").collect()} == want
    assert {r.cache_key for r in cutoff.cut_responses(df).collect()} == want


def test_bounds_grow_with_the_input(spark):
    texts = [response("Read the articles together", i) for i in range(60)] + [response("Keep it and loo", i) for i in range(10)]
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "t string")
    assert endings_of(df).pairs == {"articles together", "and loo"}
    assert endings_of(df, per=35).pairs == {"articles together"}
    assert endings_of(df.limit(0)).pairs == frozenset()
