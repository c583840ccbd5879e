"""Normalisation and classification over all rows against brute force, beside their SQL."""

import re
import unicodedata
from collections import Counter

from dyadlens.functions import expressions as X
from dyadlens.plans import catalog

TEXTS = ["Plain  TEXT", "a `tick` here", "“Ｆｏｏ”  Straße — x…", "ﬁne print now", "¿Qué  HACER?", "दो लोग  बात करें", "دونوں بات کریں", "二人は　話す", "ทั้งสอง​คน", "", None]
ACTIONS = ["See a therapist", "See a  THERAPIST", "“Set”  a ﬁrm curfew", "No phones at dinner", "Talk — calmly", "phone‑free evenings", "Ｂe　patient", "`talk`", "屋外", "", None]


def brute(text):
    out = unicodedata.normalize("NFKC", text)
    for a, b in X.FOLD.items():
        out = out.replace(a, b)
    return re.sub(r"\s+", " ", out.casefold()).strip()


def category(text):
    return next((c for c, ps in X.ACTION_RULES.items() if any(re.search(p, brute(text)) for p in ps)), "unclassified")


def test_every_document_is_normalised(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.normal for r in catalog.queries()["x1_normalise"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS) if t is not None}


def test_every_action_is_classified(spark, tmp_path):
    spark.createDataFrame([(t,) for t in ACTIONS], "recommended_action string").write.parquet(f"{tmp_path}/scored.parquet")
    got = {r.category: r.n for r in catalog.queries()["x3_classify"](spark, str(tmp_path)).collect()}
    assert got == Counter(category(t) for t in ACTIONS if t is not None) and got["boundary"] == 3
