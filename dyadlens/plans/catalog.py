"""Queries over the driver's tables and the SQL that says the same, by operator."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import cells as C
from ..operators import compaction, design, runlog, scoring, stats, validation
from ..schemas import CATEGORIES, RESPONSE_KEYS, SCORED
from ..session import shared_dir, table
from ..streaming import pipeline

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# ---- shared frames ---------------------------------------------------------------------------------------------------
def _scored(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "scored")


def _good(s: SparkSession, d: str) -> DataFrame:
    return scoring.analysable(_scored(s, d))


def _cells(s: SparkSession, d: str) -> DataFrame:
    return C.cell_means(_good(s, d), ["fault_scroller", "fault_partner", "severity"], extra=("model_id",))


def _gaps(s: SparkSession, d: str) -> DataFrame:
    return C.paired_gaps(_cells(s, d), "fault_scroller")


def _lines(s: SparkSession, d: str, by: C.Design) -> DataFrame:
    df = table(s, d, "lineitem").select(by.item, "l_returnflag", "l_linestatus", "l_quantity", (F.col("l_linenumber") % 2).alias("slot"))
    return C.cell_means(df, ["l_quantity"], by)


def _diffs(s: SparkSession, d: str) -> DataFrame:
    return C.category_diffs(C.proportions(_good(s, d), "action_category", CATEGORIES), CATEGORIES)


GOOD = "good AS (SELECT * FROM scored WHERE coalesce(parse_ok, false) AND coalesce(missing_keys, '') = '' AND fault_scroller IS NOT NULL AND fault_partner IS NOT NULL)"
CELLS = f"{GOOD}, cells AS (SELECT model_slot, model_id, vignette_id, gender, culture, avg(fault_scroller) AS fault_scroller, stddev_pop(fault_scroller) AS fault_scroller_sd, avg(fault_partner) AS fault_partner, stddev_pop(fault_partner) AS fault_partner_sd, avg(severity) AS severity, stddev_pop(severity) AS severity_sd, count(*) AS n_runs FROM good GROUP BY ALL)"


def _wide(cells: str, slot: str, item: str, factor: str, frame: str, metric: str, levels: tuple[str, ...], frames: tuple[str, str]) -> str:
    cols = ", ".join(f"avg({metric}) FILTER (WHERE {factor} = '{lv}' AND {frame} = '{fr}') AS {n}_{x}" for n, lv in zip(("first", "second", "third"), levels) for x, fr in zip("ab", frames))
    return f"wide AS (SELECT {slot}, {item}, {cols} FROM {cells} WHERE {metric} IS NOT NULL GROUP BY ALL)"


_M2 = "CASE WHEN {0}_a IS NOT NULL AND {0}_b IS NOT NULL THEN ({0}_a + {0}_b) / 2 ELSE coalesce({0}_a, {0}_b) END"


def _gaps_sql(slot: str, item: str) -> str:
    f, s, t = (_M2.format(n) for n in ("first", "second", "third"))
    ga, gb = "first_a - second_a", "first_b - second_b"
    return f"gaps AS (SELECT {slot}, {item}, round({f}, 12) AS first, round({s}, 12) AS second, round({t}, 12) AS third, round(({f}) - ({s}), 12) AS gap, round({ga}, 12) AS gap_a, round({gb}, 12) AS gap_b, round(({ga}) - ({gb}), 12) AS gap_frame_diff FROM wide)"


WIDE = CELLS + ", " + _wide("cells", "model_slot", "vignette_id", "gender", "culture", "fault_scroller", ("male", "female", "neutral"), ("north_american", "south_asian"))
GAPS = WIDE + ", " + _gaps_sql("model_slot", "vignette_id")


def _lines_sql(item: str) -> str:
    cells = f"cells AS (SELECT l_linenumber % 2 AS slot, {item}, l_returnflag, l_linestatus, avg(l_quantity) AS l_quantity, stddev_pop(l_quantity) AS l_quantity_sd, count(*) AS n_runs FROM lineitem GROUP BY ALL)"
    return cells + ", " + _wide("cells", "slot", item, "l_returnflag", "l_linestatus", "l_quantity", ("A", "R", "N"), ("O", "F")) + ", " + _gaps_sql("slot", item)


def _signed_rank_sql(ctes: str, frame: str, value: str, by: str) -> str:
    return f"""WITH {ctes}, v AS (SELECT {by}, {value} AS v FROM {frame} WHERE {value} IS NOT NULL), nz AS (SELECT {by}, v, abs(v) AS a FROM v WHERE v <> 0),
    r AS (SELECT {by}, v, rank() OVER (PARTITION BY {by} ORDER BY a) + (count(*) OVER (PARTITION BY {by}, a) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {by}, a) AS t FROM nz),
    s AS (SELECT {by}, count(*) AS n_nonzero, sum(r) FILTER (WHERE v > 0) AS wp, sum(r) FILTER (WHERE v < 0) AS wm, sum(t * t - 1.0) AS ties FROM r GROUP BY ALL),
    b AS (SELECT {by}, count(*) AS n, round(avg(v), 9) AS mean, round(median(v), 9) AS median FROM v GROUP BY ALL)
    SELECT b.{by}, n, coalesce(n_nonzero, 0)::BIGINT AS n_nonzero, least(coalesce(wp, 0), coalesce(wm, 0))::DOUBLE AS w, coalesce(wp, 0)::DOUBLE AS w_plus, coalesce(ties, 0)::DOUBLE AS ties,
      round((least(coalesce(wp, 0), coalesce(wm, 0))::DOUBLE - n_nonzero::DOUBLE * (n_nonzero + 1) / 4) / sqrt(n_nonzero::DOUBLE * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24 - ties::DOUBLE / 48), 9) AS z, mean, median
    FROM b LEFT JOIN s ON b.{by} = s.{by}"""


# ---- problem 2 -------------------------------------------------------------------------------------------------------
_HELD = "held AS (SELECT file_id, body->>'$.cache_key' AS k FROM (SELECT file_id, CASE WHEN json_valid(regexp_replace(body, '^﻿', '')) THEN regexp_replace(body, '^﻿', '') END AS body FROM raw_files) WHERE body IS NOT NULL)"


@query(f"WITH {_HELD} SELECT a.file_id AS file_a, b.file_id AS file_b FROM held a JOIN held b ON a.k = b.k AND a.file_id < b.file_id")
def p2_found(s: SparkSession, d: str) -> DataFrame:
    """Pairs of files that hold the same complete record."""
    return compaction.same_record_pairs(table(s, d, "raw_files"))


_FIELDS = ("cache_key", "model_id", "run_index", "user_prompt", "response_text", "finish_reason", "attempts")
_DIGEST = "sha256(concat_ws('|', " + ", ".join("coalesce(body->>'$." + c + "', '-')" for c in _FIELDS) + "))"
_BOM = "regexp_replace(body, '^﻿', '')"
_LAST = f"last AS (SELECT body->>'$.cache_key' AS k, arg_max(body, (modified_at, file_id)) AS body FROM (SELECT file_id, modified_at, {_BOM} AS body FROM raw_files WHERE json_valid({_BOM})) GROUP BY k)"


@query(f"WITH {_LAST} SELECT k AS cache_key, {_DIGEST} AS content FROM last")
def p2_compact(s: SparkSession, d: str) -> DataFrame:
    """The records of the compacted files, written below the shared folder, with a digest of what they hold."""
    into = shared_dir(s, "compacted")
    compaction.compact(table(s, d, "raw_files"), into)
    fields = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in _FIELDS))
    return compaction.compacted(s, into).select("cache_key", F.sha2(fields, 256).alias("content"))


@query(f"WITH {_HELD} SELECT file_id, k AS cache_key, min(file_id) OVER (PARTITION BY k) AS first_file, count(*) OVER (PARTITION BY k) AS n_files FROM held")
def p2_groups(s: SparkSession, d: str) -> DataFrame:
    """Each file with the first one that holds the same record: the groups that the pairs are made of."""
    into = shared_dir(s, "compacted")
    compaction.compact(table(s, d, "raw_files"), into)
    return compaction.file_groups(s, into)


@query(f"WITH {_HELD} SELECT k AS cache_key, count(*) AS n_files FROM held GROUP BY k")
def p2_copies(s: SparkSession, d: str) -> DataFrame:
    """How many files hold each record."""
    return compaction.complete_records(table(s, d, "raw_files")).groupBy("cache_key").agg(F.count("*").alias("n_files"))


# ---- filters and projections -----------------------------------------------------------------------------------------
@query(f"WITH {GOOD} SELECT cache_key, fault_scroller, fault_partner FROM good")
def f3_analysable(s: SparkSession, d: str) -> DataFrame:
    """Rows that enter the analysis."""
    return _good(s, d).select("cache_key", "fault_scroller", "fault_partner")


@query("SELECT cache_key, model_slot FROM scored WHERE upper(model_slot) IN ('A', 'C')")
def f2_slots(s: SparkSession, d: str) -> DataFrame:
    """Rows of named slots."""
    return design.of_slots(_scored(s, d), ["a", "C"]).select("cache_key", "model_slot")


@query("SELECT cache_key, vignette_id FROM scored WHERE upper(vignette_id) LIKE 'D%'")
def f4_distress(s: SparkSession, d: str) -> DataFrame:
    """Rows of items with a distress cue."""
    return _scored(s, d).where(X.distress_cue(F.col("vignette_id"))).select("cache_key", "vignette_id")


@query("SELECT cache_key, quote_match_mode FROM scored WHERE quote_match_mode <> 'empty'")
def f5_quoted(s: SparkSession, d: str) -> DataFrame:
    """Rows with a quote."""
    return _scored(s, d).where("quote_match_mode <> 'empty'").select("cache_key", "quote_match_mode")


@query("SELECT cache_key FROM scored WHERE coalesce(parse_ok, false) AND coalesce(missing_keys, '') = ''")
def f6_scorable(s: SparkSession, d: str) -> DataFrame:
    """Rows that may be sampled."""
    return scoring.scorable(_scored(s, d)).select("cache_key")


_CONTROL = "k AS (SELECT DISTINCT id AS vignette_id FROM vignettes WHERE id LIKE 'C%'), chk AS (SELECT s.*, CASE WHEN fault_scroller IS NULL OR fault_partner IS NULL THEN NULL ELSE fault_scroller > fault_partner AND fault_scroller >= 7 END AS pass FROM scored s JOIN k USING (vignette_id))"


@query(f"WITH {_CONTROL} SELECT vignette_id, model_slot, gender, culture, run_index, fault_scroller, fault_partner, pass FROM chk")
def n4_control_checks(s: SparkSession, d: str) -> DataFrame:
    """Control items with their verdict."""
    return validation.control_checks(_scored(s, d), table(s, d, "vignettes", "id").where(F.col("id").startswith("C")))


@query(f"WITH {_CONTROL} SELECT model_slot, count(*) AS n, round(avg(pass::INT::DOUBLE), 6) AS pass_rate FROM chk WHERE pass IS NOT NULL AND model_slot IS NOT NULL GROUP BY ROLLUP (model_slot) HAVING count(*) > 0")
def a8_control_summary(s: SparkSession, d: str) -> DataFrame:
    """Pass rates of controls by slot and overall."""
    return validation.control_summary(n4_control_checks(s, d))


# ---- text ------------------------------------------------------------------------------------------------------------
#: How an object (here {}) may come in an answer, and how that is read.
_SHAPES = (
    ("{}", "clean"), ("  {}\n", "clean"), ("```json\n{}\n```", "fenced"), ("```\n{}```", "fenced"), ("Sure: {} as asked.", "embedded"), ("[{}]", "embedded"), ("{} and once more {}", "embedded"),
    ('{"outer": oops, "inner": {}}', "embedded"), ('{"s": "a } brace \\" {", "o": {}}', "clean"), ("<{,}", "repaired"), ('{"a": True, "b": None, "o": {},}', "repaired"), ('So:\n```json\n{"a": False, "o": {}}\n``` Bye.', "repaired"),
    ('{"k": 1, "o": {}', "embedded"), ("[1, 2]", "unparseable"), ('"{"', "unparseable"), ("7", "unparseable"), ("", "unparseable"),
)


@query("SELECT event_id, ['" + "', '".join(status for _, status in _SHAPES) + f"'][(event_id % {len(_SHAPES)})::INT + 1] AS parse_status FROM events WHERE props IS NOT NULL")
def j1_extract(s: SparkSession, d: str) -> DataFrame:
    """Extraction statuses of events' properties, in shapes whose status is known."""
    shape = F.element_at(F.array(*(F.lit(t) for t, _ in _SHAPES)), (F.col("event_id") % len(_SHAPES)).cast("int") + 1)
    inner = F.expr("substring(props, 1, length(props) - 1)")
    text = F.when(shape.startswith("<"), F.concat(inner, F.lit(",}"))).otherwise(F.replace(shape, F.lit("{}"), F.col("props")))
    df = table(s, d, "events", "event_id", "props").where("props is not null").select("event_id", text.alias("t"))
    return scoring.extraction_status(df, "t").select("event_id", "parse_status")


def _values(table: dict[str, str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(c)}, {quoted(m)})" for c, m in table.items())


def _normal_sql(texts: str) -> str:
    """CTEs that end in norm(t, normal): the normalised form of the texts `texts` selects as t.

    Made of the Unicode database: each compatibility character's decomposition, composed again by nfc_normalize; then the
    fold table, case folding and white space by character. DuckDB itself has neither NFKC nor case folding.
    """
    every = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    apart = {c: k for c in every if (k := unicodedata.normalize("NFKD", c)) != unicodedata.normalize("NFD", c)}
    folded = {c: X.FOLD.get(c, c).casefold() for c in (*map(chr, range(0x80)), *every)}
    folded |= {c: " " for c in (*map(chr, range(0x80)), *every) if c.isspace()}
    folded = {c: m for c, m in folded.items() if c != m}
    return (
        f"texts AS (SELECT DISTINCT t FROM ({texts}) WHERE t <> ''), k(c, m) AS (VALUES {_values(apart)}), f(c, m) AS (VALUES {_values(folded)}), "
        "u AS (SELECT t, unnest(string_split(t, '')) AS c, unnest(range(1, length(t) + 1)) AS i FROM texts), "
        "composed AS (SELECT t, nfc_normalize(string_agg(coalesce(m, u.c), '' ORDER BY i)) AS n FROM u LEFT JOIN k ON u.c = k.c GROUP BY t), "
        "w AS (SELECT t, unnest(string_split(n, '')) AS c, unnest(range(1, length(n) + 1)) AS i FROM composed), "
        "norm AS (SELECT t, trim(regexp_replace(string_agg(coalesce(m, w.c), '' ORDER BY i), ' +', ' ', 'g')) AS normal FROM w LEFT JOIN f ON w.c = f.c GROUP BY t)"
    )


@query(f"WITH {_normal_sql('SELECT text AS t FROM documents')} SELECT doc_id, coalesce(normal, '') AS normal FROM documents LEFT JOIN norm ON text = t WHERE text IS NOT NULL")
def x1_normalise(s: SparkSession, d: str) -> DataFrame:
    """Normalised text of all documents."""
    df = table(s, d, "documents", "doc_id", "text").where("text is not null")
    return df.select("doc_id", X.normalise("text").alias("normal"))


_TRIM = "trim({0}, '" + X.TRIMMED.replace("'", "''") + "')"


@query(
    f"WITH src AS (SELECT id, e.key AS variant, e.value AS source FROM (SELECT id, unnest(map_entries(variants)) AS e FROM vignettes)), {_normal_sql('SELECT evidence_quote AS t FROM scored UNION ALL SELECT source FROM src')}, "
    "j AS (SELECT cache_key, evidence_quote AS q, coalesce(a.normal, '') AS nq, coalesce(b.normal, '') AS ns FROM scored s JOIN src ON src.id = s.vignette_id AND src.variant = s.variant LEFT JOIN norm a ON s.evidence_quote = a.t LEFT JOIN norm b ON src.source = b.t) "
    f"SELECT cache_key, CASE WHEN q IS NULL OR trim(q) = '' OR nq = '' OR ns = '' THEN 'empty' WHEN contains(ns, nq) THEN 'exact' WHEN {_TRIM.format('nq')} <> '' AND contains(ns, {_TRIM.format('nq')}) THEN 'trimmed' ELSE 'none' END AS quote_match_mode FROM j"
)
def x2_check_quote(s: SparkSession, d: str) -> DataFrame:
    """How each quote of a scored row stands in its rendering."""
    v = table(s, d, "vignettes", "id", "variants").select(F.col("id").alias("vignette_id"), F.explode("variants").alias("variant", "source"))
    j = _scored(s, d).select("cache_key", "vignette_id", "variant", "evidence_quote").join(v, ["vignette_id", "variant"])
    mode = X.quote_mode(F.col("evidence_quote"), X.normalise("evidence_quote"), X.normalise("source"))
    return j.select("cache_key", mode.alias("quote_match_mode"))


_RULES_SQL = "CASE " + " ".join("WHEN regexp_matches(n, '" + "|".join(ps).replace("'", "''") + f"') THEN '{c}'" for c, ps in X.ACTION_RULES.items()) + " ELSE 'unclassified' END"


@query(f"WITH {_normal_sql('SELECT recommended_action AS t FROM scored')} SELECT {_RULES_SQL} AS category, count(*) AS n FROM (SELECT coalesce(normal, '') AS n FROM scored LEFT JOIN norm ON recommended_action = t WHERE recommended_action IS NOT NULL) GROUP BY ALL")
def x3_classify(s: SparkSession, d: str) -> DataFrame:
    """Categories of all recommended actions."""
    df = _scored(s, d).where("recommended_action is not null")
    return df.groupBy(X.classify(X.normalise("recommended_action")).alias("category")).agg(F.count("*").alias("n"))


_WS = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}]"


def _bare_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _object_sql(x: str) -> str:
    """A whole object; DuckDB's parser lets commas before a closing mark pass, so they are looked for with the strings emptied."""
    skeleton = "regexp_replace(" + x + """, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g')"""
    return f"(json_valid({x}) AND starts_with({x}, '{{') AND NOT regexp_matches({skeleton}, ',\\s*[}}\\]]'))"


_FENCED = _bare_sql("regexp_replace(t, '(?m)^\\s*```[a-zA-Z0-9_-]*\\s*|\\s*```\\s*$', '', 'g')")
_MENDED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(span, ',\\s*([}\\]])', '\\1', 'g'), '\\bTrue\\b', 'true', 'g'), '\\bFalse\\b', 'false', 'g'), '\\bNone\\b', 'null', 'g')"


def _kind_sql(key: str) -> str:
    kind = f"json_type(o, '$.{key}')"
    return f"CASE WHEN {kind} = 'BOOLEAN' THEN 'boolean' WHEN {kind} IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN {kind} = 'VARCHAR' THEN 'string' END AS {key}_kind, o->>'$.{key}' AS {key}_raw"


def _rating_sql(key: str) -> str:
    number = f"CASE {key}_kind WHEN 'number' THEN try_cast({key}_raw AS DOUBLE) WHEN 'string' THEN try_cast(nullif(regexp_extract({key}_raw, '-?[0-9]+(?:[.][0-9]+)?'), '') AS DOUBLE) END"
    return f"CASE WHEN {number} BETWEEN 0 AND 10 THEN {number} END"


_FLAG = f"lower({_bare_sql('distress_flagged_raw')})"
_MODE = f"CASE WHEN quote = '' OR nq = '' OR ns = '' THEN 'empty' WHEN contains(ns, nq) THEN 'exact' WHEN {_TRIM.format('nq')} <> '' AND contains(ns, {_TRIM.format('nq')}) THEN 'trimmed' ELSE 'none' END"
_KEEP = ("cache_key", "model_slot", "model_id", "provider", "vignette_id", "gender", "culture", "variant", "run_index", "finish_reason", "attempts", "latency_s", "collected_at")
# the object is the whole text, the text without fences, or what stands between its first and its last brace
_SCORED_SQL = f"""s0 AS (SELECT *, {_bare_sql("coalesce(response_text, '')")} AS t FROM raw), s1 AS (SELECT *, {_FENCED} AS bare FROM s0), s2 AS (SELECT *, regexp_extract(bare, '(?s)\\{{.*\\}}') AS span FROM s1), s3 AS (SELECT *, {_MENDED} AS mended FROM s2),
    s4 AS (SELECT *, CASE WHEN {_object_sql('t')} THEN 'clean' WHEN {_object_sql('bare')} THEN 'fenced' WHEN {_object_sql('span')} THEN 'embedded' WHEN {_object_sql('mended')} THEN 'repaired' ELSE 'unparseable' END AS parse_status FROM s3),
    s5 AS (SELECT *, CASE parse_status WHEN 'clean' THEN t WHEN 'fenced' THEN bare WHEN 'embedded' THEN span WHEN 'repaired' THEN mended END AS o FROM s4),
    s6 AS (SELECT *, {', '.join(map(_kind_sql, ('fault_scroller', 'fault_partner', 'severity', 'distress_flagged', 'recommended_action', 'evidence_quote')))}, json_keys(o) AS keys FROM s5),
    s7 AS (SELECT *, {', '.join(f"CASE WHEN {k}_kind = 'string' THEN {_bare_sql(f'{k}_raw')} ELSE '' END AS {n}" for k, n in (('recommended_action', 'action'), ('evidence_quote', 'quote')))} FROM s6)"""


@query(
    f"WITH {_SCORED_SQL}, {_normal_sql('SELECT quote AS t FROM s7 UNION ALL SELECT action FROM s7 UNION ALL SELECT vignette_text FROM s7')}, "
    "s8 AS (SELECT s7.*, coalesce(a.normal, '') AS n, coalesce(q.normal, '') AS nq, coalesce(v.normal, '') AS ns FROM s7 LEFT JOIN norm a ON action = a.t LEFT JOIN norm q ON quote = q.t LEFT JOIN norm v ON vignette_text = v.t), "
    f"s9 AS (SELECT *, parse_status <> 'unparseable' AS parse_ok, {_rating_sql('fault_scroller')} AS fs, {_rating_sql('fault_partner')} AS fp, {_rating_sql('severity')} AS sev, {_MODE} AS mode FROM s8) "
    f"SELECT {', '.join(_KEEP[:-1])}, epoch_us(collected_at) AS collected_at, upper(vignette_id) LIKE 'D%' AS distress_cue, parse_status, parse_ok, array_to_string(list_filter([{', '.join(f'{chr(39)}{k}{chr(39)}' for k in RESPONSE_KEYS)}], lambda k: NOT list_contains(coalesce(keys, []), k)), '|') AS missing_keys, "
    f"fs AS fault_scroller, fp AS fault_partner, fs + fp AS fault_total, sev AS severity, action AS recommended_action, {_RULES_SQL} AS action_category, quote AS evidence_quote, "
    f"CASE WHEN parse_ok THEN mode IN ('exact', 'trimmed') END AS quote_verbatim, CASE WHEN parse_ok THEN mode END AS quote_match_mode, "
    f"CASE distress_flagged_kind WHEN 'boolean' THEN distress_flagged_raw = 'true' WHEN 'number' THEN coalesce(try_cast(distress_flagged_raw AS DOUBLE) <> 0, true) WHEN 'string' THEN CASE WHEN {_FLAG} IN ('true', 'yes', 'y', '1') THEN true WHEN {_FLAG} IN ('false', 'no', 'n', '0') THEN false END END AS distress_flagged, "
    "length(coalesce(response_text, ''))::INT AS response_chars FROM s9"
)
def f1_score(s: SparkSession, d: str) -> DataFrame:
    """Every raw response scored; times as microseconds."""
    return scoring.score(table(s, d, "raw")).withColumn("collected_at", F.unix_micros("collected_at"))


_GIVEN = ("cache_key", "model_slot", "model_id", "provider", "vignette_id", "gender", "culture", "variant", "run_index", "distress_cue", "parse_status", "parse_ok", "missing_keys", "fault_scroller", "fault_partner", "fault_total", "severity", "recommended_action", "evidence_quote", "quote_verbatim", "quote_match_mode", "distress_flagged", "response_chars")


@query(f"SELECT DISTINCT {', '.join(_GIVEN)} FROM scored")
def f1_score_given(s: SparkSession, d: str) -> DataFrame:
    """Raw responses scored, for the records of the given scored table, which must come out the same."""
    keys = table(s, d, "scored", "cache_key").distinct()
    return scoring.score(table(s, d, "raw")).select(*_GIVEN).join(keys, "cache_key", "left_semi").distinct()


@query("SELECT cache_key, length(coalesce(response_text, ''))::INT AS response_chars FROM raw")
def x4_length(s: SparkSession, d: str) -> DataFrame:
    """Code points of responses."""
    return table(s, d, "raw", "cache_key", "response_text").select("cache_key", F.char_length(F.coalesce("response_text", F.lit(""))).alias("response_chars"))


@query("SELECT doc_id, substring(regexp_replace(source || ' ' || lang, '[^A-Za-z0-9_-]', '_', 'g'), 1, 12) AS slug FROM documents")
def x6_slug(s: SparkSession, d: str) -> DataFrame:
    """File-safe names."""
    return table(s, d, "documents", "doc_id", "source", "lang").select("doc_id", X.slug(F.concat("source", F.lit(" "), "lang"), 12).alias("slug"))


@query("SELECT cache_key, substring(k, 1, 8) || '-' || substring(k, 9, 4) || '-' || substring(k, 13, 4) || '-' || substring(k, 17, 4) || '-' || substring(k, 21, 12) AS page FROM (SELECT cache_key, lower(substring(cache_key, 33, 32)) AS k FROM scored WHERE cache_key IS NOT NULL)")
def x8_page_id(s: SparkSession, d: str) -> DataFrame:
    """The last 32 hexadecimal digits of keys as ids."""
    return _scored(s, d).where("cache_key is not null").select("cache_key", X.page_id(F.col("cache_key")).alias("page"))


_RUNS, _SLOTS = ("failure", "in_progress", "success"), ("FAILURE", "PARTIAL_SUCCESS", "SUCCESS", "CAPPED_CLEAN")


@query(
    f"WITH n AS (SELECT event_id, {list(_RUNS)}[(event_id % 3)::INT + 1] AS r, {list(_SLOTS)}[(event_id // 3 % 4)::INT + 1] AS a, {list(_SLOTS)}[(event_id // 12 % 4)::INT + 1] AS b FROM events) "
    "SELECT event_id, CASE WHEN r = 'failure' OR a = 'FAILURE' OR b = 'FAILURE' THEN 'Failed' WHEN r = 'in_progress' THEN 'Running' WHEN a = 'PARTIAL_SUCCESS' OR b = 'PARTIAL_SUCCESS' THEN 'Partial' ELSE 'Success' END AS status FROM n"
)
def x9_status(s: SparkSession, d: str) -> DataFrame:
    """Status from notes, by precedence: every run with every pair of slots."""
    n = F.col("event_id")
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), i.cast("int") + 1)
    note = F.format_string("day 3 (%s) slotA=%s slotB=%s", pick(_RUNS, n % 3), pick(_SLOTS, F.floor(n / 3) % 4), pick(_SLOTS, F.floor(n / 12) % 4))
    return table(s, d, "events", "event_id").select("event_id", X.note_status(note).alias("status"))


@query("SELECT cache_key, sha256(model_id || chr(0) || coalesce(reasoning_effort, '') || chr(0) || coalesce(reasoning_format, '') || chr(0) || run_index::VARCHAR || chr(0) || system_prompt || chr(0) || user_prompt) AS computed FROM raw")
def m1_cache_key(s: SparkSession, d: str) -> DataFrame:
    """The content-addressed key of each record."""
    df = table(s, d, "raw")
    return df.select("cache_key", X.cache_key(*(F.col(c) for c in ("model_id", "reasoning_effort", "reasoning_format", "run_index", "system_prompt", "user_prompt"))).alias("computed"))


_TYPED = ("' ' || (event_id % 23 - 6)::VARCHAR || '/10'", "(event_id % 150 / 10.0)::DECIMAL(9, 1)::VARCHAR", "event_type || ' ' || (event_id % 13)::VARCHAR || '-' || (event_id % 7)::VARCHAR", "event_type")


@query(
    f"WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN {_TYPED[0]} WHEN 1 THEN {_TYPED[1]} WHEN 2 THEN {_TYPED[2]} ELSE {_TYPED[3]} END AS raw FROM events), "
    "x AS (SELECT event_id, try_cast(nullif(regexp_extract(raw, '-?[0-9]+(?:[.][0-9]+)?'), '') AS DOUBLE) AS v FROM t) SELECT event_id, CASE WHEN v BETWEEN 0 AND 10 THEN v END AS score FROM x"
)
def c1_score(s: SparkSession, d: str) -> DataFrame:
    """Ratings from texts, typed in four ways."""
    n, m, kind = F.col("event_id"), F.col("event_id") % 4, F.col("event_type")
    text = lambda c: c.cast("string")
    raw = F.when(m == 0, F.concat(F.lit(" "), text(n % 23 - 6), F.lit("/10"))).when(m == 1, text((n % 150 / 10.0).cast("decimal(9,1)"))).when(m == 2, F.concat(kind, F.lit(" "), text(n % 13), F.lit("-"), text(n % 7))).otherwise(kind)
    return table(s, d, "events", "event_id", "event_type").select("event_id", X.score_of(F.lit("string"), raw).alias("score"))


_WORDS = ("yes", "No", " TRUE", "false\n", "Y", "n\t", "1", "0 ", "maybe", "", "\u00a0yes\u2003", "truth")


@query(
    "WITH w AS (SELECT event_id, event_id % 15 AS m, list_extract([" + ", ".join("'" + w.replace("'", "''") + "'" for w in _WORDS) + "], (event_id % 15)::INT + 1) AS t FROM events), "
    "x AS (SELECT event_id, m, lower(regexp_replace(t, '^[\\s\\x{a0}\\x{2003}]+|[\\s\\x{a0}\\x{2003}]+$', '', 'g')) AS t FROM w) "
    "SELECT event_id, CASE WHEN m = 12 THEN event_id % 2 <> 0 WHEN m = 13 THEN true WHEN m = 14 THEN event_id % 2 = 1 WHEN t IN ('true', 'yes', 'y', '1') THEN true WHEN t IN ('false', 'no', 'n', '0') THEN false END AS flag FROM x"
)
def c2_flag(s: SparkSession, d: str) -> DataFrame:
    """Truth values from words, numbers and truth values; any white space around a word is taken off."""
    n, m = F.col("event_id"), F.col("event_id") % 15
    kind = F.when(m.isin(12, 13), "number").when(m == 14, "boolean").otherwise("string")
    word = F.element_at(F.array(*map(F.lit, _WORDS)), F.least(m, F.lit(len(_WORDS) - 1)).cast("int") + 1)
    raw = F.when(m == 12, (n % 2).cast("string")).when(m == 13, "NaN").when(m == 14, (n % 2 == 1).cast("string")).otherwise(word)
    return table(s, d, "events", "event_id").select("event_id", X.flag_of(kind, raw).alias("flag"))


@query("SELECT event_id, try_cast(regexp_extract(props, '[^ :}]+[}]$') AS DOUBLE) AS a, try_cast(nullif(regexp_extract(props, '[0-9]+'), '') AS DOUBLE) AS b FROM events")
def c3_number(s: SparkSession, d: str) -> DataFrame:
    """Numbers of texts, null where the text is none."""
    e = table(s, d, "events", "event_id", "props")
    return e.select("event_id", X.number_of(F.regexp_extract("props", r"[^ :}]+[}]$", 0)).alias("a"), X.number_of(F.regexp_extract("props", r"[0-9]+", 0)).alias("b"))


@query("SELECT cache_key, CASE WHEN distress_flagged THEN true WHEN NOT distress_flagged THEN false END AS typed, CASE WHEN finish_reason = 'True' THEN true WHEN finish_reason = 'False' THEN false END AS other, coalesce(missing_keys, '') AS missing FROM scored")
def c4_strict_flags(s: SparkSession, d: str) -> DataFrame:
    """Flags as a file of texts has them: only True and False count; missing keys without nulls."""
    typed = F.initcap(F.col("distress_flagged").cast("string"))
    return _scored(s, d).select("cache_key", X.strict_flag(typed).alias("typed"), X.strict_flag(F.col("finish_reason")).alias("other"), X.blank_to_empty(F.col("missing_keys")).alias("missing"))


@query("SELECT cache_key, usage.total_tokens AS tokens, usage.completion_tokens_details.reasoning_tokens AS reasoning, usage.prompt_tokens_details.cached_tokens AS cached FROM raw")
def j6_nested(s: SparkSession, d: str) -> DataFrame:
    """Fields inside of fields; null where an outer one is missing."""
    return table(s, d, "raw").select("cache_key", F.col("usage.total_tokens").alias("tokens"), F.col("usage.completion_tokens_details.reasoning_tokens").alias("reasoning"), F.col("usage.prompt_tokens_details.cached_tokens").alias("cached"))


@query("SELECT doc_id, CASE WHEN ends_with(b, '/chat/completions') THEN b ELSE b || '/chat/completions' END AS url FROM (SELECT doc_id, regexp_replace('https://' || source || CASE doc_id % 3 WHEN 0 THEN '/v1' WHEN 1 THEN '/v1//' ELSE '/chat/completions/' END, '/+$', '') AS b FROM documents)")
def x10_endpoint(s: SparkSession, d: str) -> DataFrame:
    """Addresses with the suffix once."""
    m = F.col("doc_id") % 3
    tail = F.when(m == 0, "/v1").when(m == 1, "/v1//").otherwise("/chat/completions/")
    return table(s, d, "documents", "doc_id", "source").select("doc_id", X.endpoint(F.concat(F.lit("https://"), "source", tail)).alias("url"))


@query("SELECT cache_key, e.attempt AS attempt, coalesce(least(e.retry_after_s, 120.0), least(pow(2.0, e.attempt), 120.0)) AS wait_s FROM (SELECT cache_key, unnest(retry_events) AS e FROM raw)")
def m8_backoff(s: SparkSession, d: str) -> DataFrame:
    """How long each retry had to wait at least."""
    e = table(s, d, "raw", "cache_key", "retry_events").select("cache_key", F.explode("retry_events").alias("e"))
    return e.select("cache_key", "e.attempt", X.backoff(F.col("e.attempt"), F.col("e.retry_after_s")).alias("wait_s"))


# ---- design ----------------------------------------------------------------------------------------------------------
@query("SELECT v.id AS vignette_id, sl.slot AS model_slot, g.g AS gender, c.c AS culture, r.r::INT AS run_index, v.variants[g.g || '_' || c.c] AS vignette_text FROM vignettes v, (VALUES ('A'), ('B')) sl(slot), (VALUES ('male'), ('female'), ('neutral')) g(g), (VALUES ('north_american'), ('south_asian')) c(c), range(1, 6) r(r)")
def n1_grid(s: SparkSession, d: str) -> DataFrame:
    """The crossed design with its renderings."""
    g = design.grid(table(s, d, "vignettes"), [("A", "fernwood/sorrel-110b"), ("B", "tidepool/kelp-24b")], 5)
    return g.select("vignette_id", "model_slot", "gender", "culture", "run_index", "vignette_text")


_PLAN = "plan AS (SELECT v.id AS vignette_id, sl.slot AS model_slot, g.g AS gender, c.c AS culture, r.r::INT AS run_index FROM vignettes v, (VALUES ('A'), ('B')) sl(slot), (VALUES ('male'), ('female'), ('neutral')) g(g), (VALUES ('north_american'), ('south_asian')) c(c), range(1, 6) r(r))"


@query(f"WITH {_PLAN} SELECT * FROM plan ANTI JOIN raw USING (vignette_id, model_slot, gender, culture, run_index)")
def n3_pending(s: SparkSession, d: str) -> DataFrame:
    """Planned tasks without a record."""
    keys = ["vignette_id", "model_slot", "gender", "culture", "run_index"]
    return design.pending(n1_grid(s, d).select(*keys), table(s, d, "raw", *keys), keys)


# ---- cells and contrasts ---------------------------------------------------------------------------------------------
@query(f"WITH {CELLS} SELECT model_slot, model_id, vignette_id, gender, culture, round(fault_scroller, 6) AS fault_scroller, round(fault_scroller_sd, 6) AS fault_scroller_sd, round(severity, 6) AS severity, n_runs FROM cells")
def a1_cell_means(s: SparkSession, d: str) -> DataFrame:
    """Repeats collapsed into cells."""
    r = lambda c: F.round(c, 6).alias(c)
    return _cells(s, d).select("model_slot", "model_id", "vignette_id", "gender", "culture", r("fault_scroller"), r("fault_scroller_sd"), r("severity"), "n_runs")


@query(f"WITH {CELLS}, a AS (SELECT model_slot, count(*) AS n, min(model_id) AS model_id, round(avg(fault_scroller), 6) AS mean_scroller, round(avg(fault_partner), 6) AS mean_partner, round(avg(severity), 6) AS mean_severity, count(severity) AS n_severity FROM good WHERE model_slot IS NOT NULL GROUP BY ALL), b AS (SELECT model_slot, round(median(fault_scroller_sd), 6) AS instability FROM cells WHERE model_slot IS NOT NULL GROUP BY ALL) SELECT * FROM a JOIN b USING (model_slot)")
def a2_quality(s: SparkSession, d: str) -> DataFrame:
    """The quality block of each slot."""
    return C.quality(_good(s, d), _cells(s, d))


@query(f"WITH {WIDE} SELECT model_slot, vignette_id, {', '.join(f'round({n}_{x}, 6) AS {n}_{x}' for n in ('first', 'second', 'third') for x in 'ab')} FROM wide")
def r1_wide_cells(s: SparkSession, d: str) -> DataFrame:
    """Cells side by side."""
    w = C.wide_cells(_cells(s, d), "fault_scroller")
    return w.select("model_slot", "vignette_id", *(F.round(f"{n}_{x}", 6).alias(f"{n}_{x}") for n in ("first", "second", "third") for x in "ab"))


_R6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("first", "second", "third", "gap", "gap_a", "gap_b", "gap_frame_diff"))
_R6C = ", ".join(f"round({c}, 6) AS {c}" for c in ("first", "second", "gap", "gap_a", "gap_b", "gap_frame_diff"))


def _round6(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.round(c, 6).alias(c) for c in df.columns if c not in keys))


@query(f"WITH {GAPS} SELECT model_slot, vignette_id, {_R6} FROM gaps")
def r2_paired_gaps(s: SparkSession, d: str) -> DataFrame:
    """Available-case contrasts."""
    return _round6(_gaps(s, d), "model_slot", "vignette_id")


@query(f"WITH {GAPS} SELECT model_slot, vignette_id, {_R6C} FROM gaps WHERE gap_a IS NOT NULL AND gap_b IS NOT NULL")
def r3_complete_gaps(s: SparkSession, d: str) -> DataFrame:
    """Complete-case contrasts."""
    return _round6(C.complete_gaps(_cells(s, d), "fault_scroller"), "model_slot", "vignette_id")


@query(f"WITH {_lines_sql('l_partkey')} SELECT slot, l_partkey, {_R6} FROM gaps")
def r2_line_gaps(s: SparkSession, d: str) -> DataFrame:
    """Available-case contrasts over line items by part."""
    return _round6(C.paired_gaps(_lines(s, d, C.LINES_BY_PART), "l_quantity", C.LINES_BY_PART), "slot", "l_partkey")


@query(f"WITH {_lines_sql('l_partkey')} SELECT slot, l_partkey, {_R6C} FROM gaps WHERE gap_a IS NOT NULL AND gap_b IS NOT NULL")
def r3_line_gaps(s: SparkSession, d: str) -> DataFrame:
    """Complete-case contrasts over line items by part."""
    return _round6(C.complete_gaps(_lines(s, d, C.LINES_BY_PART), "l_quantity", C.LINES_BY_PART), "slot", "l_partkey")


def _completeness_sql(ctes: str, slot: str, item: str, factor: str, frame: str, levels: tuple[str, ...], frames: tuple[str, str]) -> str:
    have = " AND ".join(f"bool_or({factor} = '{lv}' AND {frame} = '{fr}')" for lv in levels for fr in frames)
    return f"WITH {ctes}, per AS (SELECT {slot}, {item}, coalesce({have}, false) AS w FROM cells GROUP BY ALL) SELECT {slot}, count(*) FILTER (WHERE w) AS n_included, count(*) AS n_total, count(*) FILTER (WHERE NOT w) AS n_excluded FROM per GROUP BY ALL"


@query(_completeness_sql(CELLS, "model_slot", "vignette_id", "gender", "culture", ("male", "female"), ("north_american", "south_asian")))
def a9_completeness(s: SparkSession, d: str) -> DataFrame:
    """Items with all four cells."""
    return C.completeness(_cells(s, d))


@query(_completeness_sql(CELLS, "model_slot", "vignette_id", "gender", "culture", ("male", "female", "neutral"), ("north_american", "south_asian")))
def a10_completeness(s: SparkSession, d: str) -> DataFrame:
    """Items with all six cells."""
    return C.completeness(_cells(s, d), levels=("male", "female", "neutral"))


@query(_completeness_sql(_lines_sql("l_partkey"), "slot", "l_partkey", "l_returnflag", "l_linestatus", ("A", "R"), ("O", "F")))
def a9_line_completeness(s: SparkSession, d: str) -> DataFrame:
    """Parts with all four cells."""
    return C.completeness(_lines(s, d, C.LINES_BY_PART), C.LINES_BY_PART)


_SHARES = GOOD + ", shares AS (SELECT model_slot, vignette_id, gender, culture, count(*) AS n_runs, " + ", ".join(f"avg((coalesce(action_category, '') = '{c}')::INT::DOUBLE) AS {c}" for c in CATEGORIES) + " FROM good GROUP BY ALL)"
_HAVE6 = " AND ".join(f"bool_or(gender = '{g}' AND culture = '{c}')" for g in ("male", "female", "neutral") for c in ("north_american", "south_asian"))
_DIFFS = _SHARES + f", diffs AS (SELECT model_slot, vignette_id, {', '.join(f'''round((sum({c}) FILTER (WHERE culture = 'north_american' AND gender IN ('male', 'female', 'neutral')) - sum({c}) FILTER (WHERE culture = 'south_asian' AND gender IN ('male', 'female', 'neutral'))) / 3, 12) AS diff_{c}''' for c in CATEGORIES)} FROM shares GROUP BY ALL HAVING {_HAVE6})"


@query(f"WITH {_SHARES} SELECT model_slot, vignette_id, gender, culture, n_runs, {', '.join(f'round({c}, 6) AS {c}' for c in CATEGORIES)} FROM shares")
def a3_proportions(s: SparkSession, d: str) -> DataFrame:
    """Shares of categories per cell."""
    p = C.proportions(_good(s, d), "action_category", CATEGORIES)
    return _round6(p, "model_slot", "vignette_id", "gender", "culture", "n_runs")


@query(f"WITH {_DIFFS} SELECT model_slot, vignette_id, {', '.join(f'round(diff_{c}, 6) AS diff_{c}' for c in CATEGORIES)} FROM diffs")
def r4_category_diffs(s: SparkSession, d: str) -> DataFrame:
    """Category contrasts between frames."""
    return _round6(_diffs(s, d), "model_slot", "vignette_id")


@query(f"WITH {GOOD} SELECT model_slot, gender, count(*) AS n, count(*) FILTER (WHERE coalesce(distress_flagged, false)) AS flagged, round(avg(coalesce(distress_flagged, false)::INT::DOUBLE), 6) AS recall FROM good WHERE upper(vignette_id) LIKE 'D%' AND model_slot IS NOT NULL AND gender IS NOT NULL GROUP BY ALL")
def tr_recall(s: SparkSession, d: str) -> DataFrame:
    """Distress recall."""
    return C.recall(_good(s, d))


def _hall(where: str, by: str = "", cte: str = GOOD, frame: str = "good") -> str:
    g = f"{by}, " if by else ""
    return f"WITH {cte} SELECT {g}count(*) AS n_quoted, count(*) FILTER (WHERE coalesce(quote_verbatim, false)) AS n_grounded, round(1 - avg(coalesce(quote_verbatim, false)::INT::DOUBLE), 6) AS hallucination_rate FROM {frame} WHERE {where}" + (f" GROUP BY {by}" if by else "")


@query(_hall("coalesce(parse_ok, false) AND coalesce(missing_keys, '') = '' AND quote_match_mode <> 'empty'", frame="scored"))
def tg_scorer(s: SparkSession, d: str) -> DataFrame:
    """Hallucination rate, scorer's denominator."""
    return scoring.hallucination_summary(_scored(s, d))


@query(_hall("model_slot IS NOT NULL AND (quote_match_mode IS NULL OR quote_match_mode <> 'empty')", "model_slot"))
def tg_report(s: SparkSession, d: str) -> DataFrame:
    """Hallucination rate, report's denominator."""
    return scoring.hallucination_report(_scored(s, d))


@query(_hall("model_slot IS NOT NULL AND (quote_match_mode IS NULL OR quote_match_mode <> 'empty')", "model_slot, gender, culture"))
def tg_by_condition(s: SparkSession, d: str) -> DataFrame:
    """Hallucination rate per condition, as documented."""
    return scoring.hallucination_report(_scored(s, d), "model_slot", "gender", "culture")


@query(_hall("coalesce(quote_match_mode, '') NOT IN ('', 'empty')", frame="scored"))
def tg_dashboard(s: SparkSession, d: str) -> DataFrame:
    """Hallucination rate, dashboard's denominator."""
    return scoring.hallucination_dashboard(_scored(s, d))


@query("SELECT model_slot, count(*) AS n, round(1 - avg(coalesce(parse_ok, false)::INT::DOUBLE), 6) AS refusal_rate FROM scored WHERE model_slot IS NOT NULL GROUP BY ALL")
def refusal_rate(s: SparkSession, d: str) -> DataFrame:
    """Unparsed answers by slot."""
    return scoring.refusal_rate(_scored(s, d))


@query("SELECT model_slot, count(*) AS n, round(1 - avg((coalesce(parse_ok, false) AND coalesce(missing_keys, '') = '')::INT::DOUBLE), 6) AS refusal_rate FROM scored WHERE model_slot IS NOT NULL GROUP BY ALL")
def refusal_rate_documented(s: SparkSession, d: str) -> DataFrame:
    """Unparsed or incomplete answers by slot, as documented."""
    return scoring.refusal_rate(_scored(s, d), documented=True)


@query("SELECT parse_status, count(*) AS n FROM scored GROUP BY ALL")
def a7_statuses(s: SparkSession, d: str) -> DataFrame:
    """How answers were read."""
    return scoring.score_summary(_scored(s, d))


# ---- statistics ------------------------------------------------------------------------------------------------------
@query(_signed_rank_sql(GAPS, "gaps", "gap", "model_slot"))
def h1_signed_rank(s: SparkSession, d: str) -> DataFrame:
    """The signed-rank statistic of the fault gap by slot."""
    return stats.signed_rank(_gaps(s, d), "gap", ["model_slot"])


@query(_signed_rank_sql(GAPS, "gaps", "gap_frame_diff", "model_slot"))
def h2_signed_rank(s: SparkSession, d: str) -> DataFrame:
    """The signed-rank statistic of the gap's difference between frames."""
    return stats.signed_rank(_gaps(s, d), "gap_frame_diff", ["model_slot"])


@query(_signed_rank_sql(_lines_sql("l_partkey"), "gaps", "gap", "slot"))
def tw_lines_by_part(s: SparkSession, d: str) -> DataFrame:
    """The signed-rank statistic over parts."""
    return stats.signed_rank(C.paired_gaps(_lines(s, d, C.LINES_BY_PART), "l_quantity", C.LINES_BY_PART), "gap", ["slot"])


@query(_signed_rank_sql(_lines_sql("l_suppkey"), "gaps", "gap", "slot"))
def tw_lines_by_supplier(s: SparkSession, d: str) -> DataFrame:
    """The signed-rank statistic over suppliers."""
    return stats.signed_rank(C.paired_gaps(_lines(s, d, C.LINES_BY_SUPPLIER), "l_quantity", C.LINES_BY_SUPPLIER), "gap", ["slot"])


@query(_signed_rank_sql(CELLS + ", " + _wide("cells", "model_slot", "vignette_id", "gender", "culture", "severity", ("male", "female", "neutral"), ("north_american", "south_asian")) + ", " + _gaps_sql("model_slot", "vignette_id"), "gaps", "gap", "model_slot"))
def severity_gap(s: SparkSession, d: str) -> DataFrame:
    """The severity gap, a documented metric."""
    return stats.signed_rank(C.paired_gaps(_cells(s, d), "severity"), "gap", ["model_slot"])


def _cliff_sql(ctes: str, frame: str, by: str, a: str, b: str) -> str:
    return f"""WITH {ctes}, x AS (SELECT {by}, {a} AS v, 1 AS s FROM {frame} WHERE {a} IS NOT NULL UNION ALL SELECT {by}, {b}, 0 FROM {frame} WHERE {b} IS NOT NULL),
    r AS (SELECT {by}, s, rank() OVER (PARTITION BY {by} ORDER BY v) + (count(*) OVER (PARTITION BY {by}, v) - 1) / 2.0 AS r FROM x)
    SELECT {by}, count(*) FILTER (WHERE s = 1) AS n_a, count(*) FILTER (WHERE s = 0) AS n_b,
      round(2 * (sum(r) FILTER (WHERE s = 1) - count(*) FILTER (WHERE s = 1) * (count(*) FILTER (WHERE s = 1) + 1) / 2.0)::DOUBLE / (count(*) FILTER (WHERE s = 1) * count(*) FILTER (WHERE s = 0)) - 1, 9) AS delta FROM r GROUP BY ALL"""


@query(_cliff_sql(GAPS, "gaps", "model_slot", "first", "second"))
def tc_cliffs_delta(s: SparkSession, d: str) -> DataFrame:
    """Cliff's delta between the first two levels."""
    return stats.cliffs_delta(_gaps(s, d), "first", "second", ["model_slot"])


@query(_cliff_sql(_lines_sql("l_partkey"), "gaps", "slot", "first", "second"))
def tc_lines(s: SparkSession, d: str) -> DataFrame:
    """Cliff's delta over parts."""
    return stats.cliffs_delta(C.paired_gaps(_lines(s, d, C.LINES_BY_PART), "l_quantity", C.LINES_BY_PART), "first", "second", ["slot"])


def _sign_sql(ctes: str, frame: str, value: str, by: str) -> str:
    p, m = f"count(*) FILTER (WHERE {value} > 0)", f"count(*) FILTER (WHERE {value} < 0)"
    return f"WITH {ctes} SELECT {by}, {p} AS n_positive, {m} AS n_negative, count(*) FILTER (WHERE {value} = 0) AS n_tied, count(*) AS n_total, {p} + {m} AS n_nontied, round(({p} - {m})::DOUBLE / nullif({p} + {m}, 0), 9) AS statistic FROM {frame} WHERE {value} IS NOT NULL GROUP BY ALL"


@query(_sign_sql(GAPS, "gaps", "gap", "model_slot"))
def ts_signs(s: SparkSession, d: str) -> DataFrame:
    """Signs of the fault gap."""
    return stats.sign_statistic(_gaps(s, d), "gap", ["model_slot"])


@query(_sign_sql(_lines_sql("l_partkey"), "gaps", "gap", "slot"))
def ts_lines(s: SparkSession, d: str) -> DataFrame:
    """Signs of gaps over parts."""
    return stats.sign_statistic(C.paired_gaps(_lines(s, d, C.LINES_BY_PART), "l_quantity", C.LINES_BY_PART), "gap", ["slot"])


@query("WITH t AS (SELECT l_linestatus AS family, l_shipmode_like AS test, round(avg(l_tax) * 0.3, 9) AS p FROM (SELECT *, l_suppkey % 6 AS l_shipmode_like FROM lineitem) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS k, count(*) OVER (PARTITION BY family) AS m FROM t), a AS (SELECT *, max(least(1.0, (m - k + 1) * p)) OVER (PARTITION BY family ORDER BY k) AS p_holm FROM r) SELECT family, test, p, round(p_holm, 9) AS p_holm, p_holm < 0.05 AS reject FROM a")
def th_holm(s: SparkSession, d: str) -> DataFrame:
    """Step-down correction of small p's made of line items, by line status."""
    t = table(s, d, "lineitem").groupBy(F.col("l_linestatus").alias("family"), (F.col("l_suppkey") % 6).alias("test")).agg(F.round(F.avg("l_tax") * 0.3, 9).alias("p"))
    return stats.holm(t, "p", ["family"], "test").withColumn("p_holm", F.round("p_holm", 9))


def _chi_sql(ctes: str, frame: str, row: str, col: str, by: str, yates: bool) -> str:
    gap = "greatest(abs(n - e) - 0.5, 0)" if yates else "abs(n - e)"
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {g}" if by else "PARTITION BY "
    on = f"a.{by} = b.{by} AND " if by else ""
    join = f"(SELECT DISTINCT {g}r FROM t) a JOIN (SELECT DISTINCT {g}c FROM t) b ON {f'a.{by} = b.{by}' if by else 'true'}"
    pick = f"a.{by}, " if by else ""
    full = "" if not by else f"PARTITION BY {by}"
    return f"""WITH {ctes}t AS (SELECT {g}{row} AS r, {col} AS c, count(*) AS n FROM {frame} WHERE {row} IS NOT NULL AND {col} IS NOT NULL GROUP BY ALL),
    grid AS (SELECT {pick}a.r, b.c FROM {join}), f AS (SELECT grid.*, coalesce(t.n, 0) AS n FROM grid LEFT JOIN t ON {f'grid.{by} = t.{by} AND ' if by else ''}grid.r = t.r AND grid.c = t.c),
    w AS (SELECT *, sum(n) OVER ({part}r)::DOUBLE * sum(n) OVER ({part}c) / sum(n) OVER ({full}) AS e FROM f)
    SELECT {g}round(sum({gap} * {gap} / e), 6) AS chi2, ((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1))::BIGINT AS dof, sum(n)::BIGINT AS n, count(*) FILTER (WHERE e < 5) AS small_cells FROM w {f'GROUP BY {by}' if by else ''}"""


@query(_chi_sql(GOOD + ", cl AS (SELECT * FROM good WHERE action_category IN ('" + "', '".join(CATEGORIES) + "')), ", "cl", "action_category", "culture", "model_slot", False))
def tx_actions(s: SparkSession, d: str) -> DataFrame:
    """Chi-square of categories against frames by slot."""
    return stats.chi_square(_good(s, d).where(F.col("action_category").isin(*CATEGORIES)), "action_category", "culture", ["model_slot"])


@query(_chi_sql("", "orders", "o_orderpriority", "o_orderstatus", "", False))
def tx_orders(s: SparkSession, d: str) -> DataFrame:
    """Chi-square of priority against status."""
    return stats.chi_square(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", [])


@query(_chi_sql(GOOD + ", x AS (SELECT model_slot, coalesce(distress_flagged, false) AS flagged, culture FROM good WHERE upper(vignette_id) LIKE 'D%'), ", "x", "flagged", "culture", "model_slot", True))
def tx_flags(s: SparkSession, d: str) -> DataFrame:
    """Chi-square of the flag against frames: two by two, with Yates' correction."""
    g = _good(s, d).where(X.distress_cue(F.col("vignette_id"))).withColumn("flagged", F.coalesce("distress_flagged", F.lit(False)))
    return stats.chi_square(g, "flagged", "culture", ["model_slot"])


@query(f"WITH {_DIFFS} SELECT model_slot, count(*) AS n, round({' + '.join(f'avg(diff_{c}) * avg(diff_{c})' for c in CATEGORIES)}, 9) AS statistic FROM diffs GROUP BY ALL")
def to_omnibus(s: SparkSession, d: str) -> DataFrame:
    """The omnibus statistic."""
    return stats.omnibus(_diffs(s, d), CATEGORIES, ["model_slot"])


@query(f"WITH {GAPS}, sp AS (SELECT model_slot, greatest(1.0, max(abs(gap))) AS s FROM gaps WHERE gap IS NOT NULL GROUP BY ALL), b AS (SELECT g.model_slot, s, least(floor((gap + s) / (2 * s / 24)), 23)::INT AS bin FROM gaps g JOIN sp USING (model_slot) WHERE gap IS NOT NULL) SELECT model_slot, bin, round(bin * (2 * s / 24) - s, 6) AS lo, round((bin + 1) * (2 * s / 24) - s, 6) AS hi, count(*) AS n FROM b GROUP BY model_slot, bin, s")
def a15_histogram(s: SparkSession, d: str) -> DataFrame:
    """The histogram of gaps."""
    return stats.histogram(_gaps(s, d), "gap", ["model_slot"])


# both tails of the normal distribution by the series of erf; below 1e-8 beyond 6
_NORMAL_P = "CASE WHEN abs(z) > 6 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 140), lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * i + 1) * ln(greatest(abs(z) / sqrt(2), 1e-12)) - lgamma(i + 1)) / (2 * i + 1))) END"
_BOTH = " UNION ALL ".join(f"SELECT *, '{h}' AS hypothesis FROM ({_signed_rank_sql(GAPS, 'gaps', v, 'model_slot')})" for h, v in (("H1", "gap"), ("H2", "gap_frame_diff")))
_HOLM = "r AS (SELECT *, row_number() OVER (ORDER BY p, model_slot || hypothesis) AS k, count(p) OVER () AS m FROM t WHERE p IS NOT NULL), a AS (SELECT *, max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY k) AS p_holm FROM r)"


@query(
    f"WITH b AS ({_BOTH}), t AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN n_nonzero = 0 THEN 1.0 ELSE {_NORMAL_P} END AS p FROM b), {_HOLM} "
    "SELECT t.model_slot, t.hypothesis, t.n, t.w, round(t.p, 6) AS p, round(a.p_holm, 6) AS p_holm, coalesce(a.p_holm < 0.05, false) AS reject FROM t LEFT JOIN a ON t.model_slot = a.model_slot AND t.hypothesis = a.hypothesis"
)
def tw_test(s: SparkSession, d: str) -> DataFrame:
    """The signed-rank test with p, corrected over both hypotheses and all slots."""
    long = stats.stacked(_gaps(s, d), {"H1": ("gap",) * 3, "H2": ("gap_frame_diff",) * 3}, ("model_slot",))
    both = stats.signed_rank_test(long, "value", ["model_slot", "hypothesis"]).withColumn("test", F.concat("model_slot", "hypothesis")).withColumn("family", F.lit("primary"))
    return stats.holm(both, "p", ["family"], "test").select("model_slot", "hypothesis", "n", "w", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"), "reject")


_NATIONS = "g AS (SELECT n_regionkey AS region, c_nationkey AS nation, round(avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') - avg(c_acctbal) FILTER (WHERE c_mktsegment <> 'BUILDING'), 6) AS gap FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


@query(
    f"WITH {_NATIONS}, r AS (SELECT region, gap, row_number() OVER (PARTITION BY region ORDER BY abs(gap)) AS r, count(*) OVER (PARTITION BY region) AS n FROM g), w AS (SELECT region, n, least(coalesce(sum(r) FILTER (WHERE gap > 0), 0), coalesce(sum(r) FILTER (WHERE gap < 0), 0)) AS w FROM r GROUP BY ALL), "
    "masks AS (SELECT region, n, w, unnest(range(0, (1 << n::INT)::BIGINT)) AS mask FROM w), s AS (SELECT region, n, w, mask, list_sum(list_transform(range(1, n + 1), lambda i: ((mask >> (i - 1)::INT) & 1) * i)) AS plus FROM masks) "
    "SELECT region, n, w::DOUBLE AS w, round(least(1.0, 2.0 * count(*) FILTER (WHERE plus <= w) / count(*)), 6) AS p FROM s GROUP BY region, n, w"
)
def tw_exact(s: SparkSession, d: str) -> DataFrame:
    """The exact signed-rank p of small groups: nations by region, checked against all choices of signs."""
    side = lambda cond: F.avg(F.when(cond, F.col("c_acctbal")))
    g = table(s, d, "customer").join(table(s, d, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region"), "c_nationkey")
    g = g.agg(F.round(side(F.col("c_mktsegment") == "BUILDING") - side(F.col("c_mktsegment") != "BUILDING"), 6).alias("gap"))
    return stats.signed_rank_test(g, "gap", ["region"]).select("region", "n", "w", F.round("p", 6).alias("p"))


@query()
def tb_bootstrap(s: SparkSession, d: str) -> DataFrame:
    """The percentile interval of the mean gap, drawn as by NumPy."""
    return stats.bootstrap_ci(_gaps(s, d), "gap", ["model_slot"], "vignette_id", seed=validation.SEED)


def _mixed_sql(frame: str, keep: str, item: str, columns: int) -> str:
    """CTEs that end in mixed(keep, c, z): the scattered 64-bit numbers of each item and column, at seed 0."""
    times = lambda a, m: f"(((({a} & 4294967295)::HUGEINT * {m}) + ((({a} >> 32)::HUGEINT * {m}) % 4294967296) * 4294967296) % 18446744073709551616)::UBIGINT"
    return (
        f"m0 AS (SELECT {keep}, ('0x' || substring(sha256({item}::VARCHAR), 1, 15))::BIGINT AS h, unnest(range(0, {columns})) AS c FROM {frame}), "
        f"m1 AS (SELECT {keep}, c, ((h::HUGEINT + (c + 1)::HUGEINT * {0x9E3779B97F4A7C15}) % 18446744073709551616)::UBIGINT AS z FROM m0), "
        f"m2 AS (SELECT {keep}, c, xor(z, z >> 30) AS z FROM m1), m3 AS (SELECT {keep}, c, {times('z', 0xBF58476D1CE4E5B9)} AS z FROM m2), "
        f"m4 AS (SELECT {keep}, c, xor(z, z >> 27) AS z FROM m3), m5 AS (SELECT {keep}, c, {times('z', 0x94D049BB133111EB)} AS z FROM m4), mixed AS (SELECT {keep}, c, xor(z, z >> 31) AS z FROM m5)"
    )


_POISSON = "[" + ", ".join(repr(x) for x in stats.poisson_sums()) + "]"


@query(
    f"WITH {GAPS}, v AS (SELECT model_slot, vignette_id, gap FROM gaps WHERE gap IS NOT NULL), {_mixed_sql('v', 'model_slot, gap', 'vignette_id', 10_000)}, "
    f"w AS (SELECT model_slot, gap, c, len(list_filter({_POISSON}, lambda s: s < (z >> 11)::DOUBLE / 9007199254740992)) AS w FROM mixed), m AS (SELECT model_slot, c, sum(w * gap) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL) "
    "SELECT model_slot, round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi FROM m GROUP BY ALL"
)
def tb_poisson(s: SparkSession, d: str) -> DataFrame:
    """The interval by Poisson resampling."""
    return _round6(stats.poisson_ci(_gaps(s, d), "gap", ["model_slot"], "vignette_id", resamples=10_000), "model_slot")


@query()
def tp_permutation(s: SparkSession, d: str) -> DataFrame:
    """The sign-flip test of category contrasts."""
    return stats.permutation_test(_diffs(s, d), CATEGORIES, ["model_slot"], "vignette_id", resamples=10_000)


_STAT = " + ".join(f"avg(diff_{c}) * avg(diff_{c})" for c in CATEGORIES)
_FLIPPED = " + ".join(f"avg(f * diff_{c}) * avg(f * diff_{c})" for c in CATEGORIES)
_EACH = ", ".join(f"diff_{c}" for c in CATEGORIES)


@query(
    f"WITH {_DIFFS}, o AS (SELECT model_slot, count(*) AS n, {_STAT} AS statistic FROM diffs GROUP BY ALL), {_mixed_sql('diffs', f'model_slot, {_EACH}', 'vignette_id', -(-10_000 // 64))}, "
    # of each number the bits byte by byte, the highest of a byte first
    f"b AS (SELECT model_slot, {_EACH}, c * 64 + i AS r, CASE WHEN (z >> (8 * (i // 8) + 7 - i % 8)::UBIGINT) & 1 = 1 THEN 1.0 ELSE -1.0 END AS f FROM (SELECT *, unnest(range(0, 64)) AS i FROM mixed) WHERE c * 64 + i < 10000), "
    f"p AS (SELECT model_slot, r, {_FLIPPED} AS s FROM b GROUP BY model_slot, r) SELECT model_slot, o.n, round(statistic, 9) AS statistic, round((1 + count(*) FILTER (WHERE s >= statistic - 1e-15)) / 10001.0, 6)::DOUBLE AS p FROM p JOIN o USING (model_slot) GROUP BY model_slot, o.n, statistic"
)
def tp_sign_flips(s: SparkSession, d: str) -> DataFrame:
    """The same test with draws that depend on item and seed alone, for slots of any size."""
    t = stats.sign_flip_test(_diffs(s, d), CATEGORIES, ["model_slot"], "vignette_id", resamples=10_000)
    return t.select("model_slot", "n", F.round("statistic", 9).alias("statistic"), F.round("p", 6).alias("p"))


# the upper tail of the chi-square distribution by the series of the lower one
_CHI_P = "round(greatest(0.0, 1 - exp(dof / 2.0 * ln(greatest(chi2, 1e-300) / 2) - chi2 / 2 - lgamma(dof / 2.0 + 1)) * list_sum(list_transform(range(0, 400), lambda i: exp(i * ln(greatest(chi2, 1e-300) / 2) + lgamma(dof / 2.0 + 1) - lgamma(dof / 2.0 + i + 1))))), 6)"
_ACTIONS = _chi_sql(GOOD + ", cl AS (SELECT * FROM good WHERE action_category IN ('" + "', '".join(CATEGORIES) + "')), ", "cl", "action_category", "culture", "model_slot", False)


@query(f"SELECT *, {_CHI_P} AS p FROM ({_ACTIONS})")
def tx_test(s: SparkSession, d: str) -> DataFrame:
    """The chi-square test of categories with p."""
    t = stats.chi_square_test(_good(s, d).where(F.col("action_category").isin(*CATEGORIES)), "action_category", "culture", ["model_slot"])
    return t.withColumn("p", F.round("p", 6))


@query("WITH a AS (SELECT model_slot, action_category, culture FROM scored WHERE model_slot IS NOT NULL) SELECT model_slot, action_category, count(*) FILTER (WHERE culture = 'north_american') AS north_american, count(*) FILTER (WHERE culture = 'south_asian') AS south_asian FROM a WHERE action_category IS NOT NULL AND culture IS NOT NULL GROUP BY ALL")
def a5_crosstab(s: SparkSession, d: str) -> DataFrame:
    """Categories against frames as a table."""
    kept = _scored(s, d).where("model_slot is not null and action_category is not null and culture is not null")
    return kept.groupBy("model_slot", "action_category").pivot("culture", ["north_american", "south_asian"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT model_slot, count(DISTINCT vignette_id) AS n_items, count(DISTINCT cache_key) AS n_keys FROM scored GROUP BY ALL")
def a6_distinct(s: SparkSession, d: str) -> DataFrame:
    """Distinct items and records by slot."""
    return _scored(s, d).groupBy("model_slot").agg(F.count_distinct("vignette_id").alias("n_items"), F.count_distinct("cache_key").alias("n_keys"))


# ---- agreement, samples, log -----------------------------------------------------------------------------------------
_STRIP = "regexp_replace(coalesce({0}, ''), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"


def _labels_sql(name: str, sheet: str, column: str) -> str:
    return f"{name} AS (SELECT sample_id, arg_max({_STRIP.format(column)}, i) AS {name}_label FROM (SELECT *, row_number() OVER () AS i FROM manual_validation_50_{sheet}) WHERE sample_id IS NOT NULL GROUP BY 1)"


_ML = ", ".join((_labels_sql("a", "coder_a", "action_category"), _labels_sql("b", "coder_b", "action_category"), _labels_sql("k", "key", "automated_action_category"))) + ", m AS (SELECT sample_id, a_label AS coder_a, b_label AS coder_b, k_label AS automated FROM a JOIN b USING (sample_id) JOIN k USING (sample_id))"


def _matched(s: SparkSession, d: str) -> DataFrame:
    return validation.matched_labels(*(table(s, d, f"manual_validation_50_{t}") for t in ("coder_a", "coder_b", "key")))


_DOM = "('" + "', '".join(CATEGORIES) + "')"


@query(f"WITH {_ML}, i AS (SELECT * FROM m WHERE coder_a IN {_DOM} AND coder_b IN {_DOM}), d AS (SELECT unnest(['" + "', '".join(CATEGORIES) + "']) AS row) SELECT d.row, " + ", ".join(f"count(*) FILTER (WHERE coder_b = '{c}') AS {c}" for c in CATEGORIES) + " FROM d LEFT JOIN i ON i.coder_a = d.row GROUP BY d.row")
def a13_confusion(s: SparkSession, d: str) -> DataFrame:
    """Coder A against coder B over the fixed domain."""
    return stats.confusion(_matched(s, d), "coder_a", "coder_b", CATEGORIES)


def _kappa_sql(a: str, b: str) -> str:
    pe = " + ".join(f"(count(*) FILTER (WHERE {a} = '{c}'))::DOUBLE * (count(*) FILTER (WHERE {b} = '{c}'))" for c in CATEGORIES)
    return f"WITH {_ML}, k2 AS (SELECT count(*) AS n, count(*) FILTER (WHERE {a} = {b}) AS exact, ({pe}) / (count(*)::DOUBLE * count(*)) AS pe FROM m WHERE {a} IN {_DOM} AND {b} IN {_DOM}) SELECT n, exact, CASE WHEN n > 0 THEN CASE WHEN pe >= 1 THEN 1.0 ELSE round((exact::DOUBLE / n - pe) / (1 - pe), 9) END END AS kappa FROM k2"


@query(_kappa_sql("coder_a", "coder_b"))
def tk_kappa_coders(s: SparkSession, d: str) -> DataFrame:
    """Agreement of the coders."""
    return stats.kappa(_matched(s, d), "coder_a", "coder_b", CATEGORIES)


@query(_kappa_sql("coder_a", "automated"))
def tk_kappa_automated(s: SparkSession, d: str) -> DataFrame:
    """Agreement of coder A with the classifier."""
    return stats.kappa(_matched(s, d), "coder_a", "automated", CATEGORIES)


_LAB = _STRIP.format("action_category")


@query(f"SELECT 'repeated' AS problem, sample_id, count(*) AS n FROM manual_validation_50_coder_a GROUP BY sample_id HAVING count(*) > 1 UNION ALL SELECT 'blank', sample_id, count(*) FROM manual_validation_50_coder_a WHERE {_LAB} = '' GROUP BY sample_id UNION ALL SELECT 'unknown', sample_id, count(*) FROM manual_validation_50_coder_a WHERE {_LAB} <> '' AND {_LAB} NOT IN {_DOM} GROUP BY sample_id")
def f11_worksheet(s: SparkSession, d: str) -> DataFrame:
    """Problems of a worksheet."""
    return validation.worksheet_problems(table(s, d, "manual_validation_50_coder_a"))


_QUOTA = "sl AS (SELECT model_slot, row_number() OVER (ORDER BY model_slot) AS i, count(*) OVER () AS m FROM (SELECT DISTINCT model_slot FROM ok WHERE model_slot IS NOT NULL)), q AS (SELECT model_slot, 50 // m + (i <= 50 % m)::INT AS quota FROM sl)"


@query(f"WITH ok AS (SELECT * FROM scored WHERE coalesce(parse_ok, false) AND coalesce(missing_keys, '') = ''), {_QUOTA}, r AS (SELECT model_slot, cache_key, row_number() OVER (PARTITION BY model_slot ORDER BY sha256('{validation.SEED}' || cache_key), cache_key) AS r FROM (SELECT DISTINCT model_slot, cache_key FROM ok WHERE model_slot IS NOT NULL)) SELECT printf('MV%03d', row_number() OVER (ORDER BY model_slot, cache_key)) AS sample_id, model_slot, cache_key FROM r JOIN q USING (model_slot) WHERE r <= quota")
def q1_hashed_sample(s: SparkSession, d: str) -> DataFrame:
    """An exact stratified sample by seeded hash."""
    return validation.hashed_sample(scoring.scorable(_scored(s, d))).select("sample_id", "model_slot", "cache_key")


@query("WITH o AS (SELECT cache_key, model_slot, arg_min(attempts, (collected_at, attempts)) AS attempts, min(collected_at) AS collected_at FROM raw WHERE cache_key IS NOT NULL GROUP BY ALL), g AS (SELECT model_slot, count(*) AS n, sum(attempts)::BIGINT AS attempts, strftime(collected_at, '%Y-%m-%d') AS day FROM o WHERE model_slot IS NOT NULL AND collected_at IS NOT NULL GROUP BY model_slot, strftime(collected_at, '%Y-%m-%d')) SELECT model_slot, day, n, attempts, attempts >= 175 AS capped FROM g")
def a14_daily_attempts(s: SparkSession, d: str) -> DataFrame:
    """Attempts by slot and day against the cap."""
    return runlog.daily_attempts(runlog.once(table(s, d, "raw"))).withColumn("day", F.col("day").cast("string"))


@query("SELECT model_slot, e.outcome AS outcome, e.http_status AS http_status, count(*) AS n FROM (SELECT model_slot, unnest(retry_events) AS e FROM raw) GROUP BY ALL")
def retry_telemetry(s: SparkSession, d: str) -> DataFrame:
    """Retries by cause."""
    return runlog.retry_telemetry(table(s, d, "raw"))


@query("WITH c AS (SELECT o_custkey % 40 AS run, count(*) FILTER (WHERE o_orderstatus = 'F') AS written, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, o_custkey % 3 AS capped FROM orders GROUP BY o_custkey % 40, o_custkey % 3) SELECT run, capped, written, failed, CASE WHEN written + failed = 0 THEN CASE WHEN capped > 0 THEN 'CAPPED_CLEAN' ELSE 'SUCCESS' END WHEN written = 0 OR (written + failed >= 5 AND failed >= 0.5 * (written + failed)) THEN 'FAILURE' WHEN failed > 0 THEN 'PARTIAL_SUCCESS' WHEN capped > 0 THEN 'CAPPED_CLEAN' ELSE 'SUCCESS' END AS status FROM c")
def run_status(s: SparkSession, d: str) -> DataFrame:
    """A run's status from its counts, orders standing for cells."""
    n = lambda st: F.sum((F.col("o_orderstatus") == st).cast("long"))
    c = table(s, d, "orders").groupBy((F.col("o_custkey") % 40).alias("run"), (F.col("o_custkey") % 3).alias("capped")).agg(n("F").alias("written"), n("P").alias("failed"))
    return c.withColumn("status", runlog.run_status(F.col("written"), F.col("failed"), F.col("capped")))


@query("SELECT doc_id::VARCHAR AS path, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def k10_manifest(s: SparkSession, d: str) -> DataFrame:
    """Digests of contents."""
    df = table(s, d, "documents", "doc_id", "text").where("text is not null")
    return validation.manifest(df.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content")))


@query(_signed_rank_sql(GAPS, "gaps", "gap_a", "model_slot"))
def te_first_frame(s: SparkSession, d: str) -> DataFrame:
    """The signed-rank statistic of the gap within the first frame."""
    return stats.signed_rank(_gaps(s, d), "gap_a", ["model_slot"])


@query(_signed_rank_sql(GAPS, "gaps", "gap_b", "model_slot"))
def te_second_frame(s: SparkSession, d: str) -> DataFrame:
    """The signed-rank statistic of the gap within the second frame."""
    return stats.signed_rank(_gaps(s, d), "gap_b", ["model_slot"])


@query(f"WITH {GAPS}, v AS (SELECT model_slot, third FROM gaps WHERE third IS NOT NULL) SELECT model_slot, count(*) AS n, round(median(third), 9) AS median FROM v GROUP BY ALL")
def a11_median(s: SparkSession, d: str) -> DataFrame:
    """The exact median of the third level's means, without a group in one task."""
    return stats.medians(_gaps(s, d), "third", ["model_slot"]).withColumn("median", F.round("median", 9))


@query(f"WITH {_DIFFS} SELECT model_slot, vignette_id, round(diff_seek_help + 2 * diff_boundary + 3 * diff_accommodate + 4 * diff_negotiate + 5 * diff_unclassified, 6) AS weighted FROM diffs")
def r5_matrix(s: SparkSession, d: str) -> DataFrame:
    """Rows of the contrast matrix, each multiplied with (1, 2, 3, 4, 5)."""
    m = C.matrix_rows(_diffs(s, d), CATEGORIES)
    weighted = F.aggregate(F.transform("values", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return m.select("model_slot", "vignette_id", F.round(weighted, 6).alias("weighted"))


@query(f"WITH {GAPS} SELECT model_slot, vignette_id, CASE WHEN gap IS NULL THEN 'n/a' WHEN abs(gap) < 0.147 THEN 'negligible' WHEN abs(gap) < 0.33 THEN 'small' WHEN abs(gap) < 0.474 THEN 'medium' ELSE 'large' END AS size FROM gaps")
def m4_magnitude(s: SparkSession, d: str) -> DataFrame:
    """Sizes by the effect thresholds."""
    return _gaps(s, d).select("model_slot", "vignette_id", X.magnitude(F.col("gap")).alias("size"))


@query("WITH c AS (SELECT vignette_id, count(DISTINCT cache_key) AS cached FROM raw GROUP BY ALL) SELECT vignette_id, cached, CASE WHEN cached = 0 THEN 'Ready for production' WHEN cached < 60 THEN 'Collecting' ELSE 'Collection complete / analysis' END AS stage, round(cached / 60.0 * 100, 6)::DOUBLE AS percent FROM c")
def m9_stage(s: SparkSession, d: str) -> DataFrame:
    """The stage of each item's collection."""
    c = table(s, d, "raw", "vignette_id", "cache_key").groupBy("vignette_id").agg(F.count_distinct("cache_key").alias("cached"))
    return c.withColumn("stage", X.stage_of(F.col("cached"), F.lit(60), F.lit(True))).withColumn("percent", F.round(X.percent(F.col("cached"), F.lit(60)), 6))


@query(f"WITH {_PLAN}, todo AS (SELECT * FROM plan ANTI JOIN raw USING (vignette_id, model_slot, gender, culture, run_index)) SELECT model_slot, vignette_id, gender, culture, run_index FROM todo ORDER BY model_slot, vignette_id, CASE gender WHEN 'male' THEN 0 WHEN 'female' THEN 1 ELSE 2 END, culture, run_index LIMIT 20")
def o3_first_pending(s: SparkSession, d: str) -> DataFrame:
    """The next twenty tasks in the plan's order."""
    keys = ["vignette_id", "model_slot", "gender", "culture", "run_index"]
    plan = design.grid(table(s, d, "vignettes"), [("A", "fernwood/sorrel-110b"), ("B", "tidepool/kelp-24b")], 5)
    todo = design.pending(plan.select(*keys, "slot_no", "gender_no", "culture_no"), table(s, d, "raw", *keys), keys)
    return design.first_pending(todo, 20).select("model_slot", "vignette_id", "gender", "culture", "run_index")


@query()
def q1_seeded_sample(s: SparkSession, d: str) -> DataFrame:
    """The stratified sample drawn by one sequential generator."""
    return validation.seeded_sample(scoring.scorable(_scored(s, d)).dropDuplicates(["cache_key"]))


@query(f"WITH ok AS (SELECT * FROM scored WHERE coalesce(parse_ok, false) AND coalesce(missing_keys, '') = ''), {_QUOTA}, r AS (SELECT model_slot, cache_key, row_number() OVER (PARTITION BY model_slot ORDER BY sha256('{validation.SEED}' || cache_key), cache_key) AS r FROM (SELECT DISTINCT model_slot, cache_key FROM ok WHERE model_slot IS NOT NULL)), p AS (SELECT printf('MV%03d', row_number() OVER (ORDER BY model_slot, cache_key)) AS sample_id, model_slot, cache_key FROM r JOIN q USING (model_slot) WHERE r <= quota) SELECT DISTINCT sample_id, p.cache_key, s.action_category AS automated_action_category FROM p JOIN ok s USING (model_slot, cache_key)")
def k4_worksheet_key(s: SparkSession, d: str) -> DataFrame:
    """What the blinded worksheets hide."""
    return validation.worksheets(validation.hashed_sample(scoring.scorable(_scored(s, d))))[1]


@query("SELECT model_slot, strftime(collected_at, '%Y-%m-%d') AS day, count(*) AS n, sum(attempts)::BIGINT AS attempts, sum(attempts) >= 175 AS capped FROM raw WHERE collected_at IS NOT NULL GROUP BY model_slot, strftime(collected_at, '%Y-%m-%d')")
def st_daily_counts(s: SparkSession, d: str) -> DataFrame:
    """Daily counts by a stream that reads what is there and stops."""
    name = f"daily_{uuid.uuid4().hex}"
    pipeline.count_available(pipeline.raw_stream(s, f"{d}/raw.parque[t]", "parquet"), name, shared_dir(s, "stream")).awaitTermination()
    return s.table(name).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT DISTINCT {', '.join(_GIVEN)} FROM scored")
def st_score(s: SparkSession, d: str) -> DataFrame:
    """Raw responses scored by a stream, for the records of the given scored table."""
    into = shared_dir(s, "scored")
    pipeline.score_available(pipeline.raw_stream(s, f"{d}/raw.parque[t]", "parquet"), into, shared_dir(s, "stream")).awaitTermination()
    return s.read.schema(SCORED).parquet(into).select(*_GIVEN).join(table(s, d, "scored", "cache_key").distinct(), "cache_key", "left_semi").distinct()


@query("SELECT DISTINCT cache_key FROM raw WHERE collected_at IS NOT NULL")
def st_once_by_key(s: SparkSession, d: str) -> DataFrame:
    """The keys of a stream that gives each record once."""
    into = shared_dir(s, "once")
    stream = pipeline.raw_stream(s, f"{d}/raw.parque[t]", "parquet").where("collected_at is not null")
    pipeline.once_by_key(stream).select("cache_key").writeStream.format("parquet").option("path", into).option("checkpointLocation", shared_dir(s, "stream")).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("cache_key string").parquet(into)


def queries() -> dict[str, Query]:
    """All queries by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Their SQL, where there is one."""
    return dict(_SQL)
