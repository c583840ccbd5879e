"""Tolerant extraction of one JSON object from a model's answer.

Native JSON functions accept trailing garbage, so they cannot tell a clean object from an embedded one; this is the
one place of the scoring path that needs Python. Statuses: clean, fenced, embedded, repaired, unparseable.
"""

from __future__ import annotations

import json
import re

#: The fence syntax, the cap of candidate spans and the literals that are repaired.
FENCE = re.compile(r"^\s*```[a-zA-Z0-9_-]*\s*|\s*```\s*$", re.MULTILINE)
MAX_SPANS = 5
PY_LITERALS = {"True": "true", "False": "false", "None": "null"}

_MARKS = re.compile(r'\\.|["{}]', re.DOTALL)
_LITERAL = re.compile(r"\b(" + "|".join(PY_LITERALS) + r")\b")
_COMMA = re.compile(r",\s*(?=[}\]])")


def _load(text: str) -> dict | None:
    try:
        got = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _valid(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def spans(text: str) -> list[tuple[int, int]]:
    """Balanced spans by their start, inner ones included, at most MAX_SPANS; braces inside a span's strings don't count.

    One pass. What is inside a string depends on where a span starts: seen from a start, a brace counts if as many
    quotation marks (but for an even number) lie before it as before the start. So braces of either parity are matched
    among themselves. A brace behind a backslash starts a span, too, but closes none; it waits beside the one it stands in.
    """
    stacks: tuple[list, list] = ([], [])  # of (start, whether it counts)
    ends: dict[int, int] = {}
    parity = 0
    for m in _MARKS.finditer(text):
        mark = m.group()
        if mark == '"':
            parity ^= 1
        elif mark == "{":
            stacks[parity].append((m.start(), True))
        elif mark == "\\{":
            stacks[parity].append((m.start() + 1, False))
        elif mark == "}":
            stack = stacks[parity]
            while stack:
                start, counts = stack.pop()
                ends[start] = m.end()
                if counts:
                    break
    return [(a, ends[a]) for a in sorted(ends)[:MAX_SPANS]]


def repair(text: str) -> dict | None:
    """Drop commas before a closing mark, turn Python's literals into JSON's."""
    return _load(_LITERAL.sub(lambda m: PY_LITERALS[m.group()], _COMMA.sub("", text)))


def extract_object(text: str | None) -> tuple[dict | None, str]:
    """The first object of a text and how it was found; null, empty and object-free texts are unparseable."""
    whole = (text or "").strip()
    if not whole:
        return None, "unparseable"
    if (got := _load(whole)) is not None:
        return got, "clean"
    bare = FENCE.sub("", whole).strip()
    if bare != whole and (got := _load(bare)) is not None:
        return got, "fenced"
    for a, b in spans(bare):
        piece = bare[a:b]
        if (got := _load(piece)) is not None:
            return got, "clean" if (a, b) == (0, len(bare)) else "embedded"
        if not _valid(piece) and (got := repair(piece)) is not None:
            return got, "repaired"
    return None, "unparseable"
