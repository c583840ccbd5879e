"""What a response holds: its object, the prose around it, and whether it is whole. Shared by problems 1 and 3."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.jsonx import FENCE, extract_object, spans

RATINGS = ("fault_scroller", "fault_partner", "severity")
VALUES = (*RATINGS, "recommended_action", "evidence_quote")
#: Marks that end a sentence in the scripts at hand, and closers that may follow them.
TERMINAL = ".!?…。！？｡．؟۔।॥։።᙮"
CLOSERS = "\"'”’»›)]}）】」』〉》*_`"
#: Scripts that end sentences without a mark.
UNMARKED = re.compile(r"[฀-໿ក-៿က-႟]")


@dataclass
class Answer:
    """object: the parsed object, if any. open: an object was begun and never closed. prose: text outside of it."""

    object: dict | None
    open: bool
    lead: str
    trail: str
    strings: dict[str, str] = field(default_factory=dict)


def is_open(text: str) -> bool:
    """A brace or a string is still open at the end, read from the first brace on; no regard to what is in it."""
    at = text.find("{")
    if at < 0:
        return False
    depth, quoted = 0, False
    for m in re.finditer(r'\\.|["{}]', text[at:], re.DOTALL):
        mark = m.group()
        if mark == '"':
            quoted = not quoted
        elif not quoted and mark == "{":
            depth += 1
        elif not quoted and mark == "}":
            depth -= 1
            if depth == 0:
                return False
    return True


def read_answer(text: str) -> Answer:
    """Split a response into object and prose."""
    got, _ = extract_object(text)
    bare = FENCE.sub("", text.strip()).strip()
    found = spans(bare)
    if got is None and not found:
        return Answer(None, is_open(bare), bare, "")
    a, b = found[0] if found else (0, len(bare))
    strings = {k: v for k, v in got.items() if isinstance(v, str)} if got else {}
    return Answer(got, False, bare[:a].strip(), bare[b:].strip(), strings)


def is_number(value: object) -> bool:
    """A rating can be read from it: a number, or a text with digits."""
    if isinstance(value, bool) or value is None:
        return False
    return isinstance(value, (int, float)) or isinstance(value, str) and bool(re.search(r"\d", value))


def ends_whole(text: str) -> bool:
    """The text's last sentence is closed, or its script needs no mark."""
    t = text.rstrip().rstrip(CLOSERS).rstrip()
    return not t or t[-1] in TERMINAL or bool(UNMARKED.match(t[-1]))
