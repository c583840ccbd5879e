"""Declared schemas of the pipeline's tables; inference is never used."""

from __future__ import annotations

RAW = (
    "cache_key string, model_slot string, model_id string, provider string, vignette_id string, gender string, culture string, variant string, run_index int, "
    "temperature double, reasoning_effort string, reasoning_format string, system_prompt string, user_prompt string, vignette_text string, response_text string, finish_reason string, "
    "usage struct<queue_time: double, prompt_tokens: bigint, prompt_time: double, completion_tokens: bigint, completion_time: double, total_tokens: bigint, total_time: double, "
    "completion_tokens_details: struct<reasoning_tokens: bigint>, prompt_tokens_details: struct<cached_tokens: bigint>>, http_status int, attempts int, "
    "retry_events array<struct<attempt: int, outcome: string, http_status: int, error_class: string, retry_after_s: double>>, latency_s double, collected_at timestamp"
)
SCORED = (
    "cache_key string, model_slot string, model_id string, provider string, vignette_id string, gender string, culture string, variant string, run_index int, distress_cue boolean, "
    "parse_status string, parse_ok boolean, missing_keys string, fault_scroller double, fault_partner double, fault_total double, severity double, recommended_action string, "
    "action_category string, evidence_quote string, quote_verbatim boolean, quote_match_mode string, distress_flagged boolean, finish_reason string, attempts int, latency_s double, "
    "response_chars int, collected_at timestamp"
)
VIGNETTES = "id string, distress boolean, variants map<string,string>"
#: The keys a response must give, in order, and the categories, in order.
RESPONSE_KEYS = ("fault_scroller", "fault_partner", "severity", "recommended_action", "evidence_quote", "distress_flagged")
CATEGORIES = ("seek_help", "boundary", "accommodate", "negotiate", "unclassified")
GENDERS, CULTURES = ("male", "female", "neutral"), ("north_american", "south_asian")
