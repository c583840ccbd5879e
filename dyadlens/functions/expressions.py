"""Scalar operators as Column expressions; only text normalisation, which needs NFKC and case folding, runs in Python.

Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The fold table that is applied after NFKC.
FOLD = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "ʼ": "'", "´": "'", "`": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"', "«": '"', "»": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-",
    "…": "...", " ": " ", " ": " ", " ": " ", " ": " ", "​": "", "﻿": "", "­": "",
}
#: What is stripped off a quote before the second try.
TRIMMED = " \t\n\r\"'`.,;:!?-—"
#: The rules of the action classifier; the first group that matches wins.
ACTION_RULES: dict[str, list[str]] = {
    "seek_help": [
        r"\btherap(?:y|ist)\b", r"\bcounsel(?:l?or|l?ing)\b", r"\bcounseling\b", r"\bprofessional(?:\s+help|\s+support)?\b", r"\bpsycholog(?:ist|ical)\b", r"\bpsychiatr(?:ist|y)\b",
        r"\bmental[-\s]health\b", r"\bdoctor\b", r"\bsupport\s+group\b", r"\bhelpline\b", r"\bcrisis\b", r"\bseek(?:ing)?\s+(?:outside\s+)?(?:help|support)\b",
    ],
    "boundary": [
        r"\bboundar(?:y|ies)\b", r"\brule\b", r"\brules\b", r"\blimit(?:s|ing)?\b", r"\bphone[-\s]free\b", r"\bscreen[-\s]free\b", r"\bno\s+phones?\b", r"\bout\s+of\s+the\s+bedroom\b",
        r"\boutside\s+the\s+bedroom\b", r"\bcharge\s+(?:the|their|his|her)?\s*phones?\b", r"\bcurfew\b", r"\bdevice[-\s]free\b", r"\bban\b", r"\brestrict\b", r"\bcut\s+back\b",
        r"\bput\s+(?:the|his|her|their)\s+phone\s+(?:away|down)\b", r"\bturn\s+off\b", r"\bdelete\s+(?:the\s+)?apps?\b",
    ],
    "negotiate": [
        r"\bnegotiat(?:e|ing|ion)\b", r"\bcompromis(?:e|ing)\b", r"\bconversation\b", r"\bdiscuss(?:ion)?\b", r"\btalk\b", r"\bsit\s+down\b", r"\bagree\s+(?:on|to)\b", r"\bagreement\b", r"\bopenly\b",
        r"\bcalm(?:ly)?\s+(?:conversation|discussion|talk)\b", r"\bexpress\s+(?:their|his|her)\s+needs\b", r"\bcheck\s+in\b", r"\bmutual(?:ly)?\b", r"\bcommunicat(?:e|ion)\b", r"\blisten\b",
    ],
    "accommodate": [
        r"\baccommodat(?:e|ing)\b", r"\bbe\s+patient\b", r"\bpatience\b", r"\bgive\s+(?:him|her|them)\s+(?:space|time)\b", r"\bempath(?:y|ise|ize)\b", r"\bunderstand(?:ing)?\s+that\b",
        r"\bbe\s+more\s+understanding\b", r"\baccept\b", r"\btolerat(?:e|ing)\b", r"\bstop\s+(?:nagging|pressuring)\b", r"\bback\s+off\b", r"\bnot\s+take\s+it\s+personally\b",
    ],
}
#: Upper bounds of effect magnitudes.
MAGNITUDES = ((0.147, "negligible"), (0.33, "small"), (0.474, "medium"))

_FOLDS = str.maketrans(FOLD)
_BLANK = re.compile(r"\s+")


def normalised(text: str | None) -> str:
    """One text: NFKC, fold table, case folding, single spaces, no blanks around; null and blank give ''."""
    if not text:
        return ""
    if text.isascii():
        folded = text.replace("`", "'").lower()
    else:
        folded = unicodedata.normalize("NFKC", text).translate(_FOLDS).casefold()
    return _BLANK.sub(" ", folded).strip()


@F.pandas_udf(StringType())
def _normalise(texts):  # noqa: ANN001, ANN202
    return texts.map(normalised)


def normalise(c: Column | str) -> Column:
    """X1 as a column; null gives ''."""
    return _normalise(F.col(c) if isinstance(c, str) else c)


def classify(normal: Column) -> Column:
    """X3 over normalised text: the first rule group with a match, else 'unclassified'; null and '' are unclassified."""
    out = None
    for label, patterns in ACTION_RULES.items():
        hit = normal.rlike("(?U)" + "|".join(patterns))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("unclassified")


def quote_mode(quote: Column, normal_quote: Column, normal_source: Column) -> Column:
    """Exact, trimmed, none or empty, over a quote and both normalised texts."""
    bare = F.btrim(normal_quote, F.lit(TRIMMED))
    empty = quote.isNull() | (F.trim(quote) == "") | (normal_quote == "") | (normal_source == "")
    return F.when(empty, "empty").when(normal_source.contains(normal_quote), "exact").when((bare != "") & normal_source.contains(bare), "trimmed").otherwise("none")


def score_of(kind: Column, raw: Column) -> Column:
    """A number within 0 and 10. kind: number, string, boolean, null or other; raw: the value as text."""
    picked = F.when(kind == "number", raw).when(kind == "string", F.nullif(F.regexp_extract(raw, r"-?\d+(?:\.\d+)?", 0), F.lit("")))
    number = picked.try_cast("double")
    return F.when((number >= 0) & (number <= 10) & ~F.isnan(number), number)


def flag_of(kind: Column, raw: Column) -> Column:
    """A truth value from booleans, numbers (any but 0 is true) and words, whatever white space stands around them."""
    word = F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    return (
        F.when(kind == "boolean", word == "true")
        .when(kind == "number", F.coalesce(raw.try_cast("double") != 0, F.lit(True)))
        .when((kind == "string") & word.isin("true", "yes", "y", "1"), F.lit(True))
        .when((kind == "string") & word.isin("false", "no", "n", "0"), F.lit(False))
    )


def number_of(c: Column) -> Column:
    """A number, or null where the text is none."""
    return c.try_cast("double")


def strict_flag(c: Column) -> Column:
    """C4: only the texts True and False map."""
    return F.when(c == "True", True).when(c == "False", False)


def blank_to_empty(c: Column) -> Column:
    """C5."""
    return F.coalesce(c, F.lit(""))


def object_keys(c: Column) -> Column:
    """The keys of a text that is one JSON object and nothing else; null if it isn't.

    Native parsers stop behind an object and take what follows for granted, so a last key is put in before the text's
    last brace: it is read as the object's own only if that brace closes the object. NaN and infinities count as numbers.
    """
    last = "last-of-all"
    closed = F.concat(F.substring(c, F.lit(1), F.length(c) - 1), F.lit(f',"{last}":1}}'))
    plain = F.regexp_replace(closed, r"([:\[,]\s*)-?(?:NaN|Infinity)(?=\s*[,}\]])", "$10")
    keys = F.coalesce(F.json_object_keys(closed), F.json_object_keys(plain))
    # bound to a name by the lambda, so that the text is parsed once
    own = F.get(F.transform(F.array(keys), lambda k: F.when(F.try_element_at(k, F.lit(-1)) == last, F.slice(k, 1, F.size(k) - 1))), F.lit(0))
    return F.when(c.rlike(r"^\{\s*\}$"), F.array().cast("array<string>")).when(c.startswith("{") & c.endswith("}"), own)


def whole_object(c: Column) -> Column:
    """A text is one JSON object and nothing else."""
    return object_keys(c).isNotNull()


def missing_keys(required: Sequence[str], present: Column) -> Column:
    """Required keys that are not there, in order, joined by '|'. present: array of keys, null if unparsed."""
    wanted = F.array(*map(F.lit, required))
    return F.concat_ws("|", F.array_except(wanted, F.coalesce(present, F.array().cast("array<string>"))))


def distress_cue(item: Column) -> Column:
    """F4."""
    return F.upper(item).startswith("D")


def slug(c: Column, width: int = 40) -> Column:
    """Letters, digits, '-' and '_' kept, else '_', cut to a width."""
    return F.substring(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_-]", "_"), 1, width)


def page_id(c: Column) -> Column:
    """The last 32 hexadecimal digits, as a lower-case id with hyphens; null where there are none."""
    low = F.lower(F.try_element_at(F.regexp_extract_all(F.replace(c, F.lit("-"), F.lit("")), F.lit("([0-9a-fA-F]{32})"), F.lit(1)), F.lit(-1)))
    return F.when(low.isNotNull(), F.concat_ws("-", *(F.substring(low, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def note_status(c: Column) -> Column:
    """Failure before running before partial before success."""
    has = lambda *parts: F.greatest(*(c.contains(p) for p in parts)) if len(parts) > 1 else c.contains(parts[0])
    return (
        F.when(has("(failure)", "slotA=FAILURE", "slotB=FAILURE"), "Failed")
        .when(has("(in_progress)"), "Running")
        .when(has("slotA=PARTIAL_SUCCESS", "slotB=PARTIAL_SUCCESS"), "Partial")
        .otherwise("Success")
    )


def endpoint(c: Column, suffix: str = "/chat/completions") -> Column:
    """A base address without closing slashes, with the suffix once."""
    bare = F.regexp_replace(c, "/+$", "")
    return F.when(bare.endswith(suffix), bare).otherwise(F.concat(bare, F.lit(suffix)))


def cache_key(model: Column, effort: Column, form: Column, run: Column, system: Column, user: Column) -> Column:
    """M1: sha256 of six fields with NUL between them; missing options count as ''."""
    none = F.lit("")
    nul = F.expr("chr(0)")
    parts: list[Column] = []
    for c in (model, F.coalesce(effort, none), F.coalesce(form, none), run.cast("string"), system, user):
        parts += [nul, c]
    return F.sha2(F.concat(*parts[1:]), 256)


def backoff(attempt: Column, retry_after: Column, base: float = 2.0, cap: float = 120.0, jitter: Column | None = None) -> Column:
    """M8: seconds to wait after an attempt: what the server asked for, else base ** attempt and a jitter; both up to a cap."""
    own = F.least(F.pow(F.lit(base), attempt.cast("double")), F.lit(cap))
    return F.coalesce(F.least(retry_after, F.lit(cap)), own if jitter is None else own + jitter)


def magnitude(delta: Column) -> Column:
    """M4: the size of an effect; null and NaN give 'n/a'."""
    size = F.abs(delta)
    out = F.when(delta.isNull() | F.isnan(delta), "n/a")
    for bound, name in MAGNITUDES:
        out = out.when(size < bound, name)
    return out.otherwise("large")


def stage_of(cached: Column, target: Column, locked: Column) -> Column:
    """M9: the stage of a collection from its counts."""
    return (
        F.when((cached == 0) & ~locked, "Pre-production readiness").when(cached == 0, "Ready for production")
        .when((target > 0) & (cached < target), "Collecting").otherwise("Collection complete / analysis")
    )


def percent(cached: Column, target: Column) -> Column:
    """M9: percent complete, 0 without a target."""
    return F.when(target > 0, cached / target * 100.0).otherwise(F.lit(0.0))


def register(spark) -> list[str]:  # noqa: ANN001
    """The scalar functions that run in Python, by name, for SQL: normalise_text(text) and extract_json(text)."""
    import pandas as pd

    from .jsonx import extract_object

    @F.pandas_udf("status string, object string")
    def extract_json(texts):  # noqa: ANN001, ANN202
        got = [extract_object(t) for t in texts]
        return pd.DataFrame({"status": [s for _, s in got], "object": [None if o is None else json.dumps(o, ensure_ascii=False) for o, _ in got]})

    spark.udf.register("normalise_text", _normalise)
    spark.udf.register("extract_json", extract_json)
    return ["normalise_text", "extract_json"]
