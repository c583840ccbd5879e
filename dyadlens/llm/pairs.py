"""Problem 1: broken prompt and response pairs.

Ordered rules over each pair, every one that triggers is named: emptiness, unclosed delimiters, refusal phrases in
several languages, copied prompt text, script or language mismatch, abrupt endings. `first` is the pair's kind.

The finish reason is evidence, never a verdict: `content_filter` makes an answer that judges nothing a refusal, `length`
an unrated one without an end truncated; a whole judgement is none, whatever its reason. An answer in the language of a
prompt that isn't English is no mismatch. Null and blank responses are empty. A null prompt can't be copied from; a null
finish_reason is no evidence. Responses of any length are read whole. Rows that repeat give the same verdict and count once by cache_key; null keys drop.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_rows
from .answers import RATINGS, VALUES, Answer, ends_whole, is_number, read_answer
from .endings import Endings, endings_of
from .language import not_english
from .look import one_look

#: The kinds there are, in order of precedence; an abrupt ending comes last.
KINDS = ("empty", "truncated", "refusal", "copied", "other_language")
#: Fixed values, of English: not to want, be able or be allowed to; what a judgement is made of; and what declines alone.
#: A sentence with one of the first and one of the second declines.
UNWILLING = (
    r"can(?:'t|not| not)", r"(?:wo|would|should|could|do)n't", r"(?:will|would|should|could|must|do|am|are|is) not", r"unable", r"not (?:able|allowed|permitted|comfortable|appropriate|my place|mine|for me|something|going)", r"isn't (?:mine|for me|my place|right|fair)",
    r"(?:rather|prefer|choose|chose|have|decided) not", r"declin(?:e|es|ed|ing)", r"refus(?:e|es|ed|ing|al)", r"abstain", r"refrain", r"pass on", r"keeps? me from", r"prevents? me", r"against my", r"(?:outside|beyond) (?:of )?(?:what|my)", r"does(?:n't| not) extend",
    r"no (?:\w+ )?(?:way|ratings?|scores?|verdicts?|judge?ments?)", r"(?:would be|is|feels?) wrong", r"leave\b.{0,60}\b(?:undone|unanswered|blank|open|empty|out)",
)
JUDGING = r"judg\w*|rat(?:e|es|ed|ing|ings)|scor(?:e|es|ed|ing)|assess\w*|evaluat\w*|grad(?:e|es|ed|ing)|rank\w*|verdicts?|blame|guilt\w*|faults?|sides?|numbers?|answers?|keys?|requests?|assign\w*|assist\w*|comply|provide|opinions?"
ALONE = r"\bi (?:\w+ )?(?:decline|refuse)\b|\b(?:have|must|need|ought|going) to (?:decline|refuse|pass)\b|\bmust (?:decline|pass|refuse)\b|\bi(?:'d| would) (?:rather|prefer) not\b|\bi (?:can't|cannot|won't|will not) (?:help|do) (?:with )?(?:this|that)\b"
#: Phrases that decline in other languages; matched in the lower-cased consistent form.
REFUSALS = {
    "es": [r"\bno (?:puedo|debo|quiero)\b", r"\blo siento\b", r"\bprefiero no\b"],
    "fr": [r"\bje ne (?:peux|veux|souhaite)\b", r"\bdésolée?\b", r"\bje préfère ne pas\b", r"\bje refuse\b"],
    "de": [r"\bich (?:kann|möchte|werde|darf)\b.{0,40}\bnicht\b", r"\btut mir leid\b", r"\blehne\b.{0,20}\bab\b"],
    "pt": [r"\bnão (?:posso|quero|devo)\b", r"\bsinto muito\b", r"\bdesculpe\b"],
    "it": [r"\bnon (?:posso|voglio)\b", r"\bmi dispiace\b"],
    "tr": [r"\büzgünüm\b", r"\bdeğerlendiremem\b", r"\byapamam\b"],
    "id": [r"\bsaya tidak (?:bisa|dapat|ingin)\b", r"\bmaaf\b"],
    "hi": [r"नहीं कर सकत", r"क्षमा", r"माफ़", r"\bnahi(?:n)? kar sakt"],
    "ur": [r"نہیں کر سکت", r"معذرت"],
    "ar": [r"لا (?:أستطيع|يمكنني|أقدر)", r"عذر", r"آسف"],
    "zh": [r"抱歉", r"无法", r"不能评", r"拒绝"],
    "ja": [r"申し訳", r"できません", r"お断り", r"控え"],
    "th": [r"ขออภัย", r"ไม่สามารถ"],
    "ru": [r"не могу", r"извините", r"отказ"],
}
_REFUSAL = re.compile("|".join([ALONE, *(p for ps in REFUSALS.values() for p in ps)]))
_UNWILLING, _JUDGING = re.compile(r"\b(?:" + "|".join(UNWILLING) + r")\b"), re.compile(rf"\b(?:{JUDGING})\b")
_SENTENCE = re.compile(r"[^.!?\n]+")
_RATED = re.compile(r"\d+ (?:of|out of|/) ?\d+|\d+/10|\bnext step\b")
_WORDS = re.compile(r"\w+")
_ENTRY = re.compile(r'"(\w+)"\s*:\s*"((?:[^"\\]|\\.)*)', re.DOTALL)
#: What is written where nothing is said.
BLANKS = frozenset("null none nil n/a na answer response output json object result undefined nan empty tbd".split())


def _said(value: object) -> bool:
    """Something is given: a number, a true or false, or a text with a letter or digit."""
    if isinstance(value, str):
        return bool(_WORDS.search(one_look(value))) and value.strip().lower().strip(".:") not in BLANKS
    if isinstance(value, (list, dict)):
        return any(map(_said, value.values() if isinstance(value, dict) else value))
    return value is not None


def _declined(text: str) -> list[str]:
    """Phrases and sentences of the lower-cased consistent form that decline to judge."""
    found = [m.group() for m in _REFUSAL.finditer(text)]
    return found + [w for m in _SENTENCE.finditer(text) if _UNWILLING.search(w := m.group().strip()) and _JUDGING.search(w)]


def _empty(text: str, a: Answer) -> bool:
    if a.open:
        return False
    if a.object is not None:
        given = [v for k, v in a.object.items() if k != "distress_flagged"]
        return not any(map(_said, given))
    bare = re.sub(r"<[^<>]*>|```\w*|[\[\]{}\"'`<>]", " ", one_look(text)).lower()
    return all(w.strip(".:;,-_*#") in BLANKS | {""} for w in bare.split())


def _copied(text: str, prompt: str, size: int, share: float) -> bool:
    """Most runs of `size` words stand in the prompt as well, in the consistent form, whatever the case."""
    words = _WORDS.findall(one_look(text).lower())
    if len(words) < size:
        return False
    own = _WORDS.findall(one_look(prompt).lower())
    runs = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
    n = len(words) - size + 1
    return sum(tuple(words[i : i + size]) in runs for i in range(n)) >= share * n


def defects(prompt: str | None, response: str | None, finish: str | None, run_words: int = 5, share: float = 0.6, endings: Endings | None = None) -> list[str]:
    """Every kind of defect of a pair, each by its own rule; none for a usable one.

    The first is the pair's kind: empty, left open, refusal, copied, other language, abrupt ending, in this order.
    """
    if response is None or not response.strip():
        return ["empty"]
    if _plain(prompt or "", response, endings):
        return []
    a = read_answer(response)
    if _empty(response, a):
        prose = " ".join((a.lead, a.trail)).strip() if a.object is not None else ""
        beside = set(defects(prompt, prose, finish, run_words, share, endings)) - {"empty", "truncated"}
        cut = ["truncated"] if a.object is not None and a.trail and not ends_whole(a.trail) else []
        return ["empty", *(k for k in KINDS if k in beside), *cut]
    found = []
    if a.open:
        found.append("truncated")
    o, strings = a.object, a.strings
    rated = o is not None and any(is_number(v) and not _of_prompt(v, prompt) for v in map(o.get, RATINGS))
    if a.open:
        strings, rated = _readable(response)
    boxed = o is not None or a.open
    if boxed:
        keys = [k for k in VALUES if k in strings]
        said = " ".join(strings[k] for k in keys) if keys else " ".join(strings.values())
    else:
        said = " ".join((a.lead, a.trail)).strip()
    low = one_look(said).lower()
    if said and not rated:
        judged = not boxed and bool(_RATED.search(low))
        echo = _copied(said, prompt or "", run_words, share)
        story = one_look(prompt or "").lower()
        quote = strings.get("evidence_quote", "") if boxed else ""
        rest = " ".join(v for k, v in strings.items() if k != "evidence_quote" and (not keys or k in keys)) if quote else said
        declines = [] if judged else _declined(one_look(rest).lower())
        if quote:  # the story's own phrases in a quote are no refusal
            declines += [w for w in _declined(one_look(quote).lower()) if w not in story]
        if declines and not echo:
            found.append("refusal")
        if prompt:
            if boxed:
                texts = [v for v in strings.values() if _said(v)]
                own = " ".join(_WORDS.findall(prompt.lower()))
                template = o is not None and bool(texts) and all(" ".join(_WORDS.findall(t.lower())) in own for t in texts)
            if boxed and (template or echo) or not boxed and (_copied(said, prompt, run_words, 0.9) if judged else echo):
                found.append("copied")
        if declines and echo:  # phrases of the prompt's are no refusal
            if any(m not in story for m in declines):
                found.append("refusal")
    elif o is not None and rated is False and o and prompt and all(isinstance(v, str) for v in o.values()):
        found.append("copied")
    asked = any(k in (strings if a.open else o or ()) for k in VALUES)
    judgement = strings.get("recommended_action", "") if asked else said
    if judgement and not_english(one_look(judgement)) and not (prompt and not_english(one_look(prompt))):
        found.append("other_language")
    if not a.open and (_broken(a, prompt or "", endings) or finish == "length" and said and not rated and not ends_whole(said)):
        found.append("truncated")
    told = {"refusal", "copied", "other_language"} & set(found)
    if o is not None and not rated and not asked and a.strings and not told:
        found.append("refusal")  # an object that speaks but gives none of the values asked for
    elif finish == "content_filter" and said and not rated and not _RATED.search(low) and not found:
        found.append("refusal")  # it was filtered and judges nothing, whatever it says
    return found


def _of_prompt(value: object, prompt: str | None) -> bool:
    """A rating typed as text that is the prompt's own wording: several words of it in a row."""
    return isinstance(value, str) and bool(prompt) and len(value.split()) > 2 and value.strip().casefold() in prompt.casefold()


def _readable(text: str) -> tuple[dict[str, str], bool]:
    """What an object left open still holds: its texts by key, the last one maybe in part, and whether it is rated."""
    rest = text[text.find("{") :]
    strings = {}
    for k, v in _ENTRY.findall(rest):
        try:
            strings[k] = json.loads(f'"{v}"', strict=False)
        except ValueError:
            strings[k] = v
    return strings, any(re.search(rf'"{k}"\s*:\s*"?[^",}}]*\d', rest) for k in RATINGS)


def _plain(prompt: str, response: str, endings: Endings | None) -> bool:
    """The common case, told at once: a bare object, rated, English, whose quote is a whole passage of the prompt."""
    if response[0] != "{" or response[-1] != "}":
        return False
    try:
        o = json.loads(response)
    except (ValueError, RecursionError):
        return False
    if not isinstance(o, dict) or not any(type(o.get(k)) is int for k in RATINGS):
        return False
    action, quote = o.get("recommended_action"), o.get("evidence_quote")
    if not isinstance(action, str) or not isinstance(quote, str) or not_english(one_look(action)) or endings and endings.cut(action):
        return False
    quote = quote.strip()
    return quote[-1:] in (".", "!", "?") and quote in prompt


def _broken(a: Answer, story: str, endings: Endings | None) -> bool:
    """An abrupt ending: of the prose, of a remark, or of a quote that stops inside one of the story's sentences."""
    if a.object is None:
        return not ends_whole(a.lead)
    if a.trail and not ends_whole(a.trail) or quote_cut(a.strings.get("evidence_quote", ""), story):
        return True
    return endings is not None and any(endings.cut(v) for k, v in a.strings.items() if k != "evidence_quote" and k in VALUES)


def quote_place(quote: str, story: str) -> str:
    """Where a quote stops in its story: `end` of a sentence, before its `mark` alone, inside it at a `word` or in the
    `mid`dle of one; `other` if it is not found (`short` and `open` ones among these apart) and `none` without a story."""
    bare = quote.strip()
    if len(bare) < 2 or not story:
        return "none"
    if bare[-1] in ".!?" and bare in story:
        return "end"
    q, s = one_look(bare).casefold(), one_look(story).casefold()
    for bare in (q, q.strip("\"'")):
        at = s.find(bare) if bare else -1
        rest = ""
        while at >= 0:
            rest = s[at + len(bare) :]
            if not rest or bare[-1] in ".!?\"'" and rest[0] in " \n":
                return "end"
            if re.match(r"[.!?]+[\"']?(?:\s|$)", rest):
                return "mark"
            at = s.find(bare, at + 1)
        if rest:
            return "mid" if rest[0].isalnum() and bare[-1].isalnum() else "word"
    return "short" if len(q.split()) < 3 else "other" if ends_whole(q) else "open"


def quote_cut(quote: str, story: str) -> bool:
    """The quote stops before its sentence does by more than the closing mark; one that isn't found, without an end mark."""
    return quote_place(quote, story) in ("word", "mid", "open")


def _kernel(cols: dict[str, list], endings: Endings) -> Iterator[tuple]:
    for key, prompt, text, finish in zip(cols["cache_key"], cols["user_prompt"], cols["response_text"], cols["finish_reason"]):
        kinds = defects(prompt, text, finish, endings=endings)
        if kinds:
            yield key, kinds[0], kinds


def broken_pairs(raw: DataFrame) -> DataFrame:
    """(cache_key, first, defects) of each defective pair, a key once. Only verdicts are shuffled.

    How whole values end is counted over all rows before (see endings.py).
    """
    df = raw.select("cache_key", "user_prompt", "response_text", "finish_reason").where("cache_key is not null")
    out = map_rows(df, _kernel, "cache_key string, first string, defects array<string>", endings_of(raw.select("response_text")))
    return out.groupBy("cache_key").agg(F.min(F.struct("first", "defects")).alias("x")).select("cache_key", "x.*")
