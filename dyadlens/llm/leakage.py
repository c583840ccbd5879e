"""Problem 8: passages of evaluation items inside documents.

One Aho-Corasick automaton over the items' normalised text (letters and digits of the consistent form, without spaces,
so that spacing, hyphens, widths, look-alikes, case and markup don't count) holds every run of three words that has a
word of the item's own; a document is scanned once, and hits are mapped back to words and to offsets of the original
text. A passage of twelve words of which a quarter is altered keeps at least one run of three. From each hit the
passage is extended both ways over altered, added and dropped words; that exact check decides.

Items share sentence frames and phrases: a passage counts only if the words that are the item's own (their runs stand
in few items) are repeated too; an item without any such word, as one that is listed many times, counts as its own
altogether. An opening that several items share is taken off. In scripts without spaces (Chinese, Japanese, Thai and
the like) each character is a step of the text and counts as half a word.

Items are a fixed list, refused beyond `most_items`; the automaton is built once per Python worker, in time linear in
their text. Null and blank documents hold nothing; documents are scanned whole; repeated documents each count by
doc_id. Null item texts drop; an empty list gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_rows
from .look import INVISIBLE, one_look

RUN = 3
SCHEMA = "doc_id long, item_id long, start_char long, end_char long, words long, same long, own long, own_same long"
_TAG = re.compile(r"</?[A-Za-z]{1,8}>")
_WORD = re.compile(rf"[^\W_](?:[\w{INVISIBLE}̀-ͯ]|['’](?=\w))*")
_LETTERS = re.compile(r"[\W_]+")


#: Blocks of scripts that set no spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f]")
#: Of such a script: a character with the marks that belong to it; of others: a run of letters.
_STEP = re.compile(_UNSPACED.pattern + "[\u0300-\u036f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1\u0eb4-\u0ebc\u0ec8-\u0ecd\u102b-\u103e\u17b6-\u17d3\u3099\u309a]*|" + f"(?:(?!{_UNSPACED.pattern}).)+", re.DOTALL)


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words, or characters of scripts without spaces, and their places in the original text."""
    bare = _TAG.sub(lambda m: " " * len(m.group()), text)
    words, places = [], []
    for m in _WORD.finditer(bare):
        w = m.group()
        if w.isascii():
            w = w.lower() if w.isalnum() else _LETTERS.sub("", w.lower())
        elif _UNSPACED.search(w):
            at = m.start()
            for step in _STEP.finditer(w):
                if one := _LETTERS.sub("", one_look(step.group()).casefold()):
                    words.append(one)
                    places.append((at + step.start(), at + step.end()))
            continue
        else:
            w = _LETTERS.sub("", one_look(w).casefold())
        if w:
            words.append(w)
            places.append(m.span())
    return words, places


def stream_of(text: str) -> str:
    """The words without what is between them: the text that the automaton reads. Quicker than by words."""
    bare = _TAG.sub(" ", text)
    return _LETTERS.sub("", bare.lower() if bare.isascii() else one_look(bare).casefold())


def size_of(words: list[str]) -> list[float]:
    """What each word counts: a character of a script without spaces is half a word."""
    return [0.5 if len(w) < 4 and not w.isascii() and _UNSPACED.match(w) else 1.0 for w in words]


class Items:
    """The automaton, the items' words, what they count, and which of them are their own."""

    def __init__(self, items: list[tuple[int, str]], shared_openings: int = 3, opening: int = 8, few: float = 0.05) -> None:
        listed = {i: words_of(t)[0] for i, t in items if t}
        # how many items begin with the same words: one count at each node of their trie
        root: dict = {}
        for w in listed.values():
            node = root
            for x in w:
                node = node.setdefault(x, {None: 0})
                node[None] += 1
        self.words: dict[int, list[str]] = {}
        for i, w in listed.items():
            node, n = root, 0
            while n < len(w) and node[w[n]][None] >= shared_openings:
                node = node[w[n]]
                n += 1
            # items that are the same throughout share no opening
            self.words[i] = w[n:] if opening <= n < len(w) else w
        held: dict[tuple, set[int]] = defaultdict(set)
        for i, w in self.words.items():
            for k in range(len(w) - RUN + 1):
                held[tuple(w[k : k + RUN])].add(i)
        most = max(2, few * len(self.words))
        self.own: dict[int, list[bool]] = {}
        self.size: dict[int, list[float]] = {}
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.words.items():
            mine = [True] * len(w)
            for k in range(len(w) - RUN + 1):
                if len(held[tuple(w[k : k + RUN])]) > most:
                    mine[k : k + RUN] = [False] * RUN
            if not any(mine):
                mine = [True] * len(w)
            self.own[i], self.size[i] = mine, size_of(w)
            for k in range(len(w) - RUN + 1):
                if any(mine[k : k + RUN]):
                    at["".join(w[k : k + RUN])].append((i, k))
        self.automaton = ahocorasick.Automaton()
        for pattern, where in at.items():
            self.automaton.add_word(pattern, (len(pattern), where))
        if at:
            self.automaton.make_automaton()
        self.empty = not at


def _extend(doc: list[str], item: list[str], i: int, j: int, step: int) -> tuple[list[tuple[int, int]], int]:
    """Matched places beyond (i, j) in one direction, over altered, added and dropped words; stops where they outweigh.

    Also how many of them lie before the altered words begin to outweigh.
    """
    got: list[tuple[int, int]] = []
    credit, best, kept = 6.0, 0.0, 0
    score = 0.0
    while True:
        i, j = i + step, j + step
        if not (0 <= i < len(doc) and 0 <= j < len(item)):
            break
        if doc[i] == item[j]:
            got.append((i, j))
            score += 1
            if score > best:
                best, kept = score, len(got)
            continue
        # nearest place where the texts meet again: fewest words skipped on both sides
        for a, b in _SKIPS:
            x, y = i + a * step, j + b * step
            if 0 <= x < len(doc) and 0 <= y < len(item) and doc[x] == item[y]:
                x2, y2 = x + step, y + step
                if max(a, b) == 1 and a == b or not (0 <= x2 < len(doc) and 0 <= y2 < len(item)) or doc[x2] == item[y2] or max(a, b) <= 1:
                    break
        else:
            break
        score -= 2.0 * max(a, b)
        if score < best - credit:
            break
        i, j = x - step, y - step
    return got, kept


_SKIPS = sorted(((a, b) for a in range(4) for b in range(4) if a or b), key=lambda s: (max(s), abs(s[0] - s[1])))


def passages(text: str, items: Items, least: int = 12) -> Iterator[tuple]:
    """(item, start_char, end_char, words, same, own, own_same) of every alignment with each item that is hit."""
    if items.empty:
        return
    if next(items.automaton.iter(stream_of(text)), None) is None:
        return
    doc, places = words_of(text)
    stream = "".join(doc)
    doc_size = size_of(doc)
    begins, n = [], 0
    for w in doc:
        begins.append(n)
        n += len(w)
    done: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for end, (size, where) in items.automaton.iter(stream):
        at = bisect_right(begins, end - size + 1) - 1
        for item, k in where:
            if len(done[item]) > 16:  # hits come in order: alignments that ended before this one are of no more use
                done[item] = [x for x in done[item] if x[1] >= at - 2 * RUN]
            if any(a <= at <= b and abs(at - k - d) <= 6 for a, b, d in done[item]):
                continue
            w, own, size = items.words[item], items.own[item], items.size[item]
            if doc[at] != w[k]:  # spacing differs here; take the hit at its last word
                if (last := bisect_right(begins, end) - 1) >= 0 and doc[last] == w[k + RUN - 1]:
                    i, j = last, k + RUN - 1
                else:
                    continue
            else:
                i, j = at, k
            (back, near_back), (on, near_on) = _extend(doc, w, i, j, -1), _extend(doc, w, i, j, 1)

            def row_of(m: int, n: int) -> tuple:
                pairs = back[:m][::-1] + [(i, j)] + on[:n]
                (i0, j0), (i1, j1) = pairs[0], pairs[-1]
                span = max(sum(size[j0 : j1 + 1]), sum(doc_size[i0 : i1 + 1]))
                mine = sum(s for s, o in zip(size[j0 : j1 + 1], own[j0 : j1 + 1]) if o)
                return item, places[i0][0], places[i1][1], span, sum(size[y] for _, y in pairs), mine, sum(size[y] for _, y in pairs if own[y])

            row = row_of(near_back, near_on)
            i0, i1 = (back[near_back - 1] if near_back else (i, j))[0], (on[near_on - 1] if near_on else (i, j))[0]
            done[item].append((i0, i1, i - j))
            if sum(size[y] for _, y in (*back, (i, j), *on)) >= 0.75 * least and not leaked(row, least):  # altered words lie near an end: the longest passage that passes with them
                wider = [r for m in range(near_back, len(back) + 1) for n in range(near_on, len(on) + 1) if leaked(r := row_of(m, n), least)]
                row = max(wider, key=lambda r: r[3], default=row)
            if row[3] >= 3:
                yield row


def leaked(row: tuple, least: int = 12) -> bool:
    """The exact check: long enough, mostly the same, and the item's own words among the same ones.

    Up to a quarter of an alignment's words may be altered; the item's own words keep shared frames apart.
    """
    _, _, _, words, same, own, own_same = row
    return words >= least and same >= 0.75 * words and own_same >= max(2, 0.6 * own)


def explained(rows: list[tuple]) -> list[tuple]:
    """Without alignments of which half lies inside better ones with other items: those share their frame only.

    One with as many words the same is no better: items with the same text all stay.
    """
    kept: list[tuple] = []
    for row in sorted(rows, key=lambda r: (-r[4], -r[6], r[0])):
        a, b = row[1], row[2]
        if sum(max(0, min(b, k[2]) - max(a, k[1])) for k in kept if k[0] != row[0] and k[4] > row[4]) < 0.5 * (b - a):
            kept.append(row)
    return kept


_built: dict[tuple, Items] = {}


def _kernel(cols: dict[str, list], listed: tuple, least: int) -> Iterator[tuple]:
    if listed not in _built:
        _built.clear()
        _built[listed] = Items(list(listed))
    for doc, text in zip(cols["doc_id"], cols["text"]):
        if text and not text.isspace():
            best: dict[int, tuple] = {}
            for row in explained([r for r in passages(text, _built[listed], least) if r[3] >= least]):
                if leaked(row, least) and (row[0] not in best or (row[6], row[4]) > (best[row[0]][6], best[row[0]][4])):
                    best[row[0]] = row
            for row in best.values():
                yield doc, *row[:3], *map(int, row[3:])


def leaks(documents: DataFrame, items: DataFrame, least: int = 12, most_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, words, same, own, own_same): the longest leaked passage of each pair."""
    rows = items.select("item_id", "text").where("item_id is not null and text is not null").distinct().limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError(f"more than {most_items} items")
    return map_rows(documents.select("doc_id", "text"), _kernel, SCHEMA, tuple(sorted(tuple(r) for r in rows)), least)


def leaked_items(found: DataFrame) -> DataFrame:
    """(item_id, n_docs, longest): the report of items that leaked."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("words").alias("longest"))
