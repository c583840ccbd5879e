"""Raw responses to scored rows: one Arrow stage extracts and normalises, everything else is built-in expressions.

Nulls: a null response counts as '' and is unparseable. Ill-typed values give null; missing text gives ''. Extra
columns of the input are left out; rows that repeat are scored each, so the result has as many rows as the input.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.jsonx import extract_object
from ..schemas import RESPONSE_KEYS

_FIELDS = ("fault_scroller", "fault_partner", "severity", "distress_flagged")
_NAMES = ["status", "keys", *(f"{f}_{x}" for f in _FIELDS for x in ("kind", "raw")), "action", "quote", "normal_action", "normal_quote", "normal_source"]
_DDL = ", ".join(f"{n} array<string>" if n == "keys" else f"{n} string" for n in _NAMES)


def kind_of(value: object) -> tuple[str, str | None]:
    """(kind, value as text) of a JSON value."""
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    if isinstance(value, (int, float)):
        return "number", repr(value)
    if isinstance(value, str):
        # digits of any script are digits of a number
        return "string", value if value.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in value)
    return ("null", None) if value is None else ("other", json.dumps(value))


#: A story comes with every response to it, so its form is made once and kept; the bound is of a worker's memory.
_story = lru_cache(1 << 13)(X.normalised)


def _extract_one(text: str | None, source: str | None) -> tuple:
    got, status = extract_object(text)
    o = got or {}
    flat = [x for f in _FIELDS for x in kind_of(o.get(f))]
    action, quote = (v.strip() if isinstance(v := o.get(k), str) else "" for k in ("recommended_action", "evidence_quote"))
    return status, list(o) if got is not None else None, *flat, action, quote, X.normalised(action), X.normalised(quote), _story(source) if quote else ""


def extract_udf():  # noqa: ANN201
    """The extraction as one Arrow UDF; nondeterministic by declaration, so that the optimiser runs it once per row."""

    @F.pandas_udf(_DDL)
    def extract(texts: pd.Series, sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_extract_one(t, s) for t, s in zip(texts, sources)], columns=_NAMES)

    return extract.asNondeterministic()


def extraction_status(df: DataFrame, text: str) -> DataFrame:
    """df with `parse_status` of a text column."""
    return df.withColumn("parse_status", extract_udf()(F.col(text), F.lit(""))["status"])


def score(raw: DataFrame) -> DataFrame:
    """The 28 scored columns of each raw row (F1)."""
    keep = ("cache_key", "model_slot", "model_id", "provider", "vignette_id", "gender", "culture", "variant", "run_index", "finish_reason", "attempts", "latency_s", "collected_at")
    df = raw.select(*keep, "response_text", extract_udf()("response_text", "vignette_text").alias("x"))
    x = {n: F.col(f"x.{n}") for n in _NAMES}
    ok = x["status"] != "unparseable"
    fs, fp, sev = (X.score_of(x[f"{f}_kind"], x[f"{f}_raw"]) for f in _FIELDS[:3])
    mode = X.quote_mode(x["quote"], x["normal_quote"], x["normal_source"])
    return df.select(
        *keep[:9],
        X.distress_cue(F.col("vignette_id")).alias("distress_cue"),
        x["status"].alias("parse_status"), ok.alias("parse_ok"),
        X.missing_keys(RESPONSE_KEYS, x["keys"]).alias("missing_keys"),
        fs.alias("fault_scroller"), fp.alias("fault_partner"), (fs + fp).alias("fault_total"), sev.alias("severity"),
        x["action"].alias("recommended_action"), X.classify(x["normal_action"]).alias("action_category"), x["quote"].alias("evidence_quote"),
        F.when(ok, mode.isin("exact", "trimmed")).alias("quote_verbatim"), F.when(ok, mode).alias("quote_match_mode"),
        X.flag_of(x["distress_flagged_kind"], x["distress_flagged_raw"]).alias("distress_flagged"),
        "finish_reason", "attempts", "latency_s", F.char_length(F.coalesce("response_text", F.lit(""))).alias("response_chars"), "collected_at",
    )


def score_summary(scored: DataFrame) -> DataFrame:
    """(parse_status, n): how answers were read."""
    return scored.groupBy("parse_status").agg(F.count("*").alias("n"))


def analysable(scored: DataFrame) -> DataFrame:
    """parsed, no key missing, both fault ratings there; severity is not checked."""
    return scored.where("coalesce(parse_ok, false) and coalesce(missing_keys, '') = '' and fault_scroller is not null and fault_partner is not null")


def scorable(scored: DataFrame) -> DataFrame:
    """parsed and no key missing; ratings are not checked."""
    return scored.where("coalesce(parse_ok, false) and coalesce(missing_keys, '') = ''")


def _rate(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n_quoted"), F.sum(F.coalesce(F.col("quote_verbatim"), F.lit(False)).cast("long")).alias("n_grounded"),
        F.round(1 - F.avg(F.coalesce(F.col("quote_verbatim"), F.lit(False)).cast("double")), 6).alias("hallucination_rate"),
    )


def hallucination_summary(scored: DataFrame) -> DataFrame:
    """T-G, scorer's denominator: complete answers with a quote, all slots."""
    return _rate(scorable(scored).where("quote_match_mode <> 'empty'"))


def hallucination_report(scored: DataFrame, *by: str) -> DataFrame:
    """T-G, report's denominator: analysable answers with a quote, by slot (and by condition, as documented)."""
    return _rate(analysable(scored).where("model_slot is not null and (quote_match_mode is null or quote_match_mode <> 'empty')"), *(by or ("model_slot",)))


def hallucination_dashboard(scored: DataFrame) -> DataFrame:
    """T-G, dashboard's denominator: every row with a mode that isn't blank or 'empty'."""
    return _rate(scored.where("coalesce(quote_match_mode, '') not in ('', 'empty')"))


def refusal_rate(scored: DataFrame, documented: bool = False) -> DataFrame:
    """(model_slot, n, refusal_rate): unparsed answers; with documented, those lacking keys as well."""
    good = F.coalesce(F.col("parse_ok"), F.lit(False))
    if documented:
        good &= F.coalesce(F.col("missing_keys"), F.lit("")) == ""
    return scored.where("model_slot is not null").groupBy("model_slot").agg(F.count("*").alias("n"), F.round(1 - F.avg(good.cast("double")), 6).alias("refusal_rate"))
