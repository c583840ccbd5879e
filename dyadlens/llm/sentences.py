"""Problem 9: sentence boundaries across languages and scripts.

A pushdown automaton reads a text once. Its stack holds open quotations and brackets; lines give list and heading
levels; a trie of abbreviations, read backwards from a full stop, and the scripts' own end marks decide where a
sentence ends. It emits (start, end) offsets in code points of the original text.

A blank line ends every sentence, a list entry or a heading is one, a single line break may stand inside one. A stop
inside an open quotation or bracket ends nothing; direct speech and its tag are one sentence. Null and blank texts have
no sentence. Texts are read whole, at any length; repeated rows repeat their result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame

from ..session import map_rows

SCHEMA = "doc_id long, n long, start_char long, end_char long, sentence string"

#: Abbreviations by what may follow them, without their last stop.
#: title: a name follows, whatever its case. number: a number or a word of the same sentence follows.
#: soft: the sentence goes on unless a capital follows. never: the sentence goes on.
ABBREVIATIONS = {
    "title": "Mr Mrs Ms Dr Prof Rev St Hon Capt Gen Sen Gov Jr Fr Sr Sra Srta Dra D Dña M MM Mme Mlle Mgr Hr Hrn Fr Frau Herr Hl Ud Uds Vd د أ डॉ श्री श्रीमती पं ڈاکٹر".split(),
    "digit": "no No nos Nos".split(),
    "number": "nr Nr núm Núm n° p pp P S s/p cf Cf Fig fig Figs figs sec Sec col cols vol Vol ver Ver approx Approx ca Ca env Env ch Ch art Art Abb Abs Bd Kap eq Eq ed Ed pág págs par tab Tab ص पृ सं क्र رقم".split(),
    "never": "e.g i.e z.B d.h u.a p.ej vs Vs viz bzw bspw vgl Vgl incl inkl esp resp prev max min.max al c.à.d c.-à-d eg u.U o.ä".split(),
    "soft": "a.m p.m A.M P.M etc Etc usw etc u.s.w min mins ft hr hrs sec secs lb lbs oz in kg km mph dept est Inc Ltd Co Corp Ave Blvd U.S U.K U.N E.U EE.UU h Std Min Sek Mio Mrd J.-C ibid".split(),
    "month": "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec janv févr avr juil oct nov déc ene abr ago sept".split(),
}
#: the ones written with a space inside
_SPACED = {"never": ("z. B", "d. h", "u. a", "p. ej", "c. à d"), "soft": ("a. m", "p. m")}
_SPACED_AHEAD = re.compile(r"(?:z\.\s{0,3}B|d\.\s{0,3}h|u\.\s{0,3}a|o\.\s{0,3}ä|p\.\s{0,3}ej|[ap]\.\s{0,3}m|i\.\s{0,3}e|e\.\s{0,3}g|c\.\s{0,3}à\s{0,3}d)\.")
_SPACED_BACK = re.compile(r"(?<![\w.])(?:z\.\s{1,3}B|d\.\s{1,3}h|u\.\s{1,3}a|o\.\s{1,3}ä|p\.\s{1,3}ej|[ap]\.\s{1,3}m)\.$")
_WORD_START = re.compile(r"[^\W\d_]+$")
#: Nouns that a single letter may follow as a label.
_LABELS = "slot|coder|item|part|class|plan|vitamin|model|type|group|section|level|row|column|page|series|version|appendix|figure|variant|team|batch"
_LABELLED = re.compile(rf"\b(?:{_LABELS})$", re.I)
#: Month names that follow an ordinal number with a stop.
ORDINAL_NEXT = re.compile(r"(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jh|Jahrhundert|Klasse|Mal|Stock|Tag|Woche)\b")
#: Marks. Stops end a sentence where white space follows; full marks do anywhere.
STOPS = ".!?…؟"
FULL = "。！？｡．।॥۔"
ENDS = STOPS + FULL + "‼⁇⁈⁉⸮"
OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“", "《": "》", "〈": "〉", "‹": "›"}
CLOSE = set(OPEN.values()) | {'"', "”", "’", "'", "*", "_", "`"}
QUOTES = set("「『«“„‹")
#: Verbs of tags after direct speech, and pronouns that lead to one.
SPEECH = re.compile(
    r"\s*(?:[A-Z][\w'’.-]*(?:\s+[A-Z][\w'’.-]*)?|he|she|they|I|we|it|the \w+(?: \w+)?|his \w+|her \w+|their \w+|one of them|(?:my|our|your) \w+)\s+(?:had |has |then |only |just |quietly |softly |finally )?"
    r"(?:says?|said|asks?|asked|repl(?:ied|ies)|whisper(?:ed|s)|shout(?:ed|s)|murmur(?:ed|s)|mutter(?:ed|s)|answer(?:ed|s)|add(?:ed|s)|cri(?:ed|es)|call(?:ed|s)|insist(?:ed|s)|snap(?:ped|s)|yell(?:ed|s)|laugh(?:ed|s)|sigh(?:ed|s)|wrote|writes|demanded|wondered|begged|admitted|explained|told|repeated|joked|hissed|remarked|noted|went on)\b"
)
SPEECH_CJK = re.compile(r"\s*(?:と|って|、|，|[^\s。！？」』”]{0,8}(?:说|問|问|道|喊|答|叫|笑|言|低语|回答))")
#: Fixed values, of informal writing, where sentences begin in small letters: words that open one by themselves, turned
#: round questions, names of files and variables, and the words that may begin one where no abbreviation stands before.
_DISCOURSE = r"tl;dr|lol|idk|imo|imho|btw|honestly|anyone (?:else|here)|anybody (?:else|here)|so (?:my|i|we|he|she|they)"
_QUESTION = r"(?:is|are|am|was|were|do|does|did|has|have|can|could|should|would)\s(?:it|this|that|he|she|there|we|you|they|i|any\w*)"
_FILE = r"[\w.-]+\.(?:csv|log|json|parquet|yaml|py|md|txt)"
_PLAIN = r"so|edit|update|anyone|anybody|we|i|my|you|he|she|they|it|this|that|there|also|ok|okay|yes|no|yeah|nope|thanks|please|what|why|how|who|when|where|does|did|the|a|an|our|your|his|her|their|sorry|maybe|just|still|anyway|well|but|and then"
STARTERS = re.compile(rf"(?:{_DISCOURSE}|{_QUESTION}|{_PLAIN}|[\w.-]+_\w+|{_FILE})(?![\w'’])", re.I)
#: The same where an abbreviation that may end a sentence stands before: only what can't go on with one.
PLAIN_STARTERS = re.compile(rf"(?:{_FILE}\b|(?:{_DISCOURSE}|{_QUESTION})(?![\w'’])|(?:{_LABELS})\s[A-Z]\b)")
_LIST = re.compile(r"[ \t]*(?:[-*•‣◦▪–—·+](?=[ \t])|\d{1,3}[.)](?=[ \t])|[A-Za-z]\)(?=[ \t])|\(\w{1,3}\)(?=[ \t])|[०-९]{1,2}[.)]|[٠-٩۰-۹]{1,2}[.)\-])[ \t]*")
_MARKED = re.compile(r"[ \t]*#{1,6}[ \t]")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x85  ]|$)")
_THAI = re.compile(r"[฀-๿]")
_SPACE = re.compile(r"\s+")
_LETTER = re.compile(r"[^\W\d_]")
_TOKEN = re.compile(r"\S+")
_NEXT_WORD = re.compile(r"\s*[\"'“”„«»‹›(\[{¿¡—–\-*_`「『]*")


_PAIRED = re.compile("[" + re.escape("".join({*OPEN, *OPEN.values(), '"'})) + "]")
_MARK = re.compile("[" + re.escape("".join({*OPEN, *OPEN.values(), '"', *ENDS})) + "]")
_MARK_OR_SPACE = re.compile(_MARK.pattern + r"|\s")


def _trie() -> dict:
    root: dict = {}
    for kind, words in ABBREVIATIONS.items():
        for w in (*words, *_SPACED.get(kind, ())):
            node = root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node.setdefault("", kind)
    return root


_ABBREVIATION = _trie()


def abbreviation(text: str, start: int, stop: int) -> str | None:
    """The kind of the longest abbreviation that ends at the full stop at `stop`, as a word of its own."""
    node, kind, i = _ABBREVIATION, None, stop - 1
    while i >= start and (node := node.get(text[i])) is not None:
        if "" in node and (i == start or not (text[i - 1].isalnum() or text[i - 1] in "_.@/'’")):
            kind = node[""]
        i -= 1
    return kind


def _paragraphs(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, alone) of runs of lines no boundary of lines divides; alone: a heading line."""
    begin = end = None
    for m in _LINE.finditer(text):
        a, b = m.span()
        if a == b:
            break
        line = m.group()
        if not line.strip():
            if begin is not None:
                yield begin, end, False
            begin = None
            continue
        if _MARKED.match(line):
            if begin is not None:
                yield begin, end, False
            yield a, b, True
            begin = None
            continue
        if begin is not None and _LIST.match(line) and not _wrapped(text, begin, a, line):
            yield begin, end, False
            begin = None
        if begin is None:
            begin = a
        end = b
    if begin is not None:
        yield begin, end, False


def _wrapped(text: str, begin: int, at: int, line: str) -> bool:
    """A line that looks like a list entry but goes on with a sentence: a dash or number that wrapping put first."""
    if _LIST.match(text, begin):
        return False
    mark = line.lstrip()[:1]
    end = at
    while end > begin and text[end - 1].isspace():
        end -= 1
    before = text[max(begin, end - 8) : end]
    if before.endswith(".") and (abbreviation(text, begin, end - 1) or _WORD_START.search(before, len(before) - 2, len(before) - 1)):
        return True
    if mark.isdigit() or mark in "-–—+" or mark.isalpha():
        return before[-1:] not in ".!?:;…。！？।۔؟\"'”)"
    return False


def _pairs(text: str, a: int, b: int) -> dict[int, int]:
    """opening -> closing place of quotations and brackets that close within the paragraph."""
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    waits: Counter = Counter()  # how often each closing mark is waited for in the stack

    def close(mark: str, at: int) -> None:
        while True:  # what was opened in between stays open
            c, opened = stack.pop()
            waits[c] -= 1
            if c == mark:
                found[opened] = at
                return

    for m in _PAIRED.finditer(text, a, b):
        i, c = m.start(), m.group()
        if waits[c]:
            close(c, i)
        elif c == '"' or c in OPEN:
            want = OPEN.get(c, c)
            stack.append((want, i))
            waits[want] += 1
    return found


def _words_up_to(text: str, start: int, stop: int, most: int) -> int:
    """How many words stand between, counted no further than `most`."""
    return sum(1 for _ in islice(_TOKEN.finditer(text, start, stop), most))


def _ends_at_stop(text: str, start: int, stop: int, after: int, end: int, quoted: bool, led: bool = False) -> bool:
    """Whether the marks that end before `after` end the sentence begun at `start`; stop: place of the last mark.

    quoted: the marks stand inside of a quotation that closed; led: words stand before it.
    """
    mark = text[stop]
    nxt = _NEXT_WORD.match(text, after).end()
    if nxt >= end:
        return True
    c = text[nxt]
    small = c.islower() and not text[nxt + 1 : nxt + 2].isupper()
    opened = any(x in "\"“„«‹「『¿¡—" for x in text[after:nxt])
    first = stop
    while first > start and text[first - 1] in ENDS:
        first -= 1
    run = text[first : stop + 1]
    if quoted:
        if text[after : after + 1] in (",", ";", ":"):
            return False
        if not led and not opened and SPEECH.match(text, after):
            return False
        if small and not STARTERS.match(text, nxt):
            return False
        return True
    if len(run) > 1 and set(run) <= {"."} or "…" in run:
        return not small
    if mark == "." and len(run) == 1:
        kind = abbreviation(text, start, stop)
        digit = c.isdigit()
        upper = c.isupper()
        if kind in ("title", "never"):
            return False
        if (w := _WORD_START.search(text, max(start, stop - 12), stop)) and _SPACED_AHEAD.match(text, w.start()):
            return False
        if w := _SPACED_BACK.search(text[max(start, stop - 12) : stop + 1]):
            if w.group()[0] not in "ap" or not text[stop - 1] == "m":
                return False
            kind = "soft"
        if kind == "digit":
            return not (digit or re.match(r"[A-Z]\d", text[nxt : nxt + 2]))
        if kind == "number":
            return not (digit or small or c in "(§#" or re.match(r"[A-Z]?\d|[IVXLC]+\b", text[nxt : nxt + 8]))
        if kind == "month":
            return not (digit or small) and _words_up_to(text, start, stop, 4) > 3
        if kind == "soft":
            if small and PLAIN_STARTERS.match(text, nxt):
                return True
            if digit or small:
                return False
            lead = text[start : start + 8].lstrip("\"'“ ")
            return not (_words_up_to(text, start, stop, 6) <= 5 and re.match(r"(?:By|At|Around|Before|After|Since|Until|From)\b", lead))
        near = max(start, stop - 64)  # what the following rules look at; a longer sentence has words before it
        before = text[near:stop]
        last = before[-1:]
        if last.isdigit():
            if ORDINAL_NEXT.match(text, nxt):
                return False
            if near == start and before.lstrip().isdigit() and len(before.strip()) <= 3:
                return False  # a list number
        if len(before) >= 1 and last.isalpha() and last.isupper() and (len(before) == 1 or not before[-2].isalnum()):
            lead = before[:-1].rstrip()
            if _LABELLED.search(lead[-12:]):
                return True
            if re.match(r"[A-Z]\.\s", text[nxt : nxt + 3]):
                return False
            if (not lead or re.search(r"(?:^|[\s(\"“])[A-Z]\.$", lead) or re.search(r"(?:\band|\bby|,|Mr\.|Mrs\.|Ms\.|Dr\.)$", lead)) and upper:
                return False
        if _THAI.match(last):
            return False
        if "ऀ" <= last <= "ॿ" and (digit or last in "ृंॉ"):
            return False
    return True


def _cut_paragraph(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    closing = _pairs(text, a, b)
    closers = {v: k for k, v in closing.items()}
    start = a
    depth = 0
    i = a
    m = _LIST.match(text, a)
    if m:
        i = m.end()
    thai = bool(_THAI.search(text, a, b))
    marks = _MARK_OR_SPACE if thai else _MARK
    while (m := marks.search(text, i, b)) is not None:
        i = m.start()
        c = text[i]
        if i in closing:
            depth += 1
            i += 1
            continue
        if i in closers:
            depth -= 1
            # the quotation closes: was there an end mark before it?
            if depth == 0 and i > a and text[i - 1] in ENDS and text[closers[i]] not in "([{（【":
                after = i + 1
                while after < b and (text[after] in ENDS or text[after] in CLOSE and after not in closing):
                    if after in closers:
                        depth -= 1
                    after += 1
                outer = text[after - 1] in ENDS
                full = text[i - 1] in FULL or text[i - 1] in "！？"
                spaced = after >= b or text[after].isspace()
                if outer and (spaced or text[after - 1] in FULL):
                    if _ends_at_stop(text, start, after - 1, after, b, False):
                        yield start, after
                        start = after
                elif full and not outer:
                    if after >= b or not SPEECH_CJK.match(text, after) and not text[after] in "，、,；;：:とって":
                        yield start, after
                        start = after
                elif spaced and _ends_at_stop(text, start, i - 1, after, b, True, _LETTER.search(text, start, closers[i]) is not None):
                    yield start, after
                    start = after
                i = after
                continue
            i += 1
            continue
        if depth == 0 and c in ENDS:
            stop = i
            while stop + 1 < b and text[stop + 1] in ENDS:
                stop += 1
            after = stop + 1
            while after < b and text[after] in CLOSE and after not in closing and (after in closers or text[after] in "'’*_`\"”»"):
                if text[after] in "*_`'" and after + 1 < b and text[after + 1].isalnum():
                    break
                if after in closers:
                    depth -= 1
                after += 1
            spaced = after >= b or text[after].isspace()
            if text[stop] in FULL or spaced or text[stop] in "؟!?" and _wide(text[after]):
                if text[stop] in FULL and text[stop] != "．" or _ends_at_stop(text, start, stop, after, b, False):
                    yield start, after
                    start = after
            i = after
            continue
        if thai and depth == 0 and c.isspace() and i > start and _thai_end(text, i, b):
            yield start, i
            start = i
        i += 1
    if text[start:b].strip():
        yield start, b


def _wide(c: str) -> bool:
    return "぀" <= c <= "鿿" or "가" <= c <= "힯"


def _thai_end(text: str, i: int, b: int) -> bool:
    """White space between Thai words ends a sentence, except before a repetition mark or beside a number."""
    j = i
    while j < b and text[j].isspace():
        j += 1
    if j >= b:
        return False
    before, after = text[i - 1], text[j]
    if not (_THAI.match(before) and _THAI.match(after)):
        return False
    return after not in "ๆฯ"


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in code points, without white space around it."""
    if not text or text.isspace():
        return []
    out = []
    for a, b, alone in _paragraphs(text):
        for s, e in [(a, b)] if alone else _cut_paragraph(text, a, b):
            while s < e and (text[s].isspace() or text[s] in "﻿​"):
                s += 1
            while e > s and (text[e - 1].isspace() or text[e - 1] in "﻿​"):
                e -= 1
            if s < e:
                out.append((s, e))
    return out


def _kernel(cols: dict[str, list]) -> Iterator[tuple]:
    for doc, text in zip(cols["doc_id"], cols["text"]):
        for n, (s, e) in enumerate(sentences(text), 1):
            yield doc, n, s, e, text[s:e]


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, n, start_char, end_char, sentence) of every document; no shuffle."""
    return map_rows(documents.select("doc_id", "text").where("text is not null"), _kernel, SCHEMA)
