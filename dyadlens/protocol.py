"""The protocol: a nested document read once, as typed parameters of plans, scores and tests."""

from __future__ import annotations

from dataclasses import dataclass, field

from .operators.cells import Design
from .schemas import CATEGORIES, CULTURES, GENDERS, RESPONSE_KEYS
from .sources import files


@dataclass(frozen=True)
class Protocol:
    """Whatever a document leaves out has the default of a design that is not locked."""

    locked: bool = False
    models: tuple[tuple[str, str], ...] = ()
    efforts: dict[str, str | None] = field(default_factory=dict)
    forms: dict[str, str | None] = field(default_factory=dict)
    genders: tuple[str, ...] = GENDERS
    cultures: tuple[str, ...] = CULTURES
    runs: int = 5
    target: int = 0
    seed: int = 20260914
    system: str = ""
    template: str = "{vignette}"
    required_keys: tuple[str, ...] = RESPONSE_KEYS
    categories: tuple[str, ...] = CATEGORIES
    alpha: float = 0.05
    resamples: int = 10_000
    level: float = 0.95
    daily_cap: int = 175
    paths: dict[str, str] = field(default_factory=dict)

    def unfilled(self) -> list[str]:
        """slots whose model is still to be named."""
        return [slot for slot, model in self.models if not str(model or "").strip() or str(model).strip().upper() == "TBD"]

    @property
    def design(self) -> Design:
        """The paired design: the first two levels of the first factor are compared, within both levels of the second."""
        g, c = self.genders, self.cultures
        return Design(first=g[0], second=g[1], third=g[2] if len(g) > 2 else "", frame_a=c[0], frame_b=c[1])


def read(path: str) -> Protocol:
    """From a YAML document; a missing file is an error."""
    doc = files.protocol(path)
    got = lambda *keys: _at(doc, keys)
    models = got("models") or []
    factors = got("design", "factors") or {}
    ci = got("statistics", "confidence_intervals") or {}
    given = {
        "locked": doc.get("locked") is True or None,
        "models": tuple((m["slot"], m["id"]) for m in models) or None,
        "efforts": {m["slot"]: m.get("reasoning_effort") for m in models} or None,
        "forms": {m["slot"]: m.get("reasoning_format") for m in models} or None,
        "genders": tuple(factors.get("gender", ())) or None, "cultures": tuple(factors.get("culture", ())) or None,
        "runs": got("design", "runs_per_cell"), "target": got("design", "total_calls"), "seed": got("design", "seed"),
        "system": got("prompts", "system"), "template": got("prompts", "user_template"), "required_keys": tuple(got("prompts", "required_keys") or ()) or None,
        "categories": tuple(got("metrics", "action_category", "categories") or ()) or None,
        "alpha": got("statistics", "alpha"), "resamples": ci.get("resamples"), "level": ci.get("level"),
        "daily_cap": got("rate_limits", "daily_request_cap_per_model"), "paths": got("paths"),
    }
    return Protocol(**{k: v for k, v in given.items() if v is not None})


def _at(doc: object, keys: tuple[str, ...]) -> object:
    for k in keys:
        doc = doc.get(k) if isinstance(doc, dict) else None
    return doc
