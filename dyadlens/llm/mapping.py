"""Problem 5: freely typed values mapped to a canonical list.

Two tries, each searched by a Levenshtein automaton. The first holds the words of the reference entries and, as alias
paths to the same meanings, words and phrases of English that mean the same (wording.py) and those of an alias list, if
one is given; its automaton (in bit-vector form) works on letters and brings slips back to words. The second holds each
entry as its meanings in a fixed order, so that word order doesn't count; its automaton works on words, which may be
left out or added. A third, of the whole labels without spaces, catches what is glued or broken off. All entries within
a distance that grows with the length are returned, nearest first. The list of aliases is empty unless the caller gives
one: no entry has wordings of its own in this package.

A value is read whole, and without what stands before a verb of advising ("they could ...") and behind a joined clause
or a dash. One that ends as the beginning of one entry alone counts as that entry. Null and blank values give no row;
values that match nothing, texts in another script among them, give 'none'. Ties between entries go to the smaller
distance, then the code. Case, underscores, spaces, widths and look-alikes don't count. Texts of any length are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_rows
from .look import one_look
from .wording import LIGHT, SAME, SMALL, stem

#: Verbs after which an advice begins, courtesies, and words that may begin a clause after it.
ADVISING = frozenset("should could can may might must shall ought suggest help step all".split())
TRAILS = ("please", "thanks", "thank you")
OPENERS = frozenset("so and starting even before when until because if but while after that".split())
#: The share of an entry's weight that may be missing, and what an added word weighs.
MISSING, ADDED = 0.46, 0.35
NONE = "none"


def plain(text: str) -> str:
    """Lower-case words of the consistent form, joined by single spaces."""
    t = one_look(text).casefold().replace("_", " ").replace("&", " and ")
    return " ".join(re.sub(r"[^\w']+", " ", t).split())


def allowed(n: int) -> int:
    """The distance allowed for a value of n characters."""
    return 0 if n < 4 else 1 if n < 8 else 2 if n < 14 else max(2, n * 16 // 100)


class Trie:
    """Paths to entries, searched by a nondeterministic Levenshtein automaton held in k + 1 bit vectors."""

    def __init__(self, paths: Iterable[tuple[str, str]]) -> None:
        self.root: dict = {}
        self.whole: dict[str, set[str]] = {}
        for path, code in paths:
            self.whole.setdefault(path, set()).add(code)
            node = self.root
            for c in path:
                node = node.setdefault(c, {})
            node.setdefault("", set()).add(code)

    def _codes(self, node: dict) -> set[str]:
        found, stack = set(), [node]
        while stack:
            n = stack.pop()
            for c, child in n.items():
                if c:
                    stack.append(child)
                else:
                    found |= child
        return found

    def search(self, text: str, k: int, prefix: bool = False) -> list[tuple[int, str]]:
        """(distance, code) of all entries within k; with prefix, of entries of which text is the beginning."""
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << i
        goal = 1 << len(text)
        found: dict[str, int] = {}
        start = tuple((1 << (d + 1)) - 1 for d in range(k + 1))
        stack = [(self.root, start)]
        while stack:
            node, rows = stack.pop()
            hit = next((d for d, r in enumerate(rows) if r & goal), None)
            if hit is not None:
                for code in self._codes(node) if prefix else node.get("", ()):
                    if found.get(code, 99) > hit:
                        found[code] = hit
            for c, child in node.items():
                if not c:
                    continue
                m = masks.get(c, 0)
                old = rows[0]
                new = (old & m) << 1
                nxt, alive = [new], new
                for r in rows[1:]:
                    # a letter matched, put in, exchanged, or left out
                    here = ((r & m) << 1) | old | (old << 1) | (nxt[-1] << 1)
                    nxt.append(here)
                    alive |= here
                    old = r
                if alive:
                    stack.append((child, tuple(nxt)))
        return sorted((d, code) for code, d in found.items())


class Words:
    """The trie of words: meanings by the letters that lead to them."""

    def __init__(self, labels: Iterable[str], groups: Iterable[str] = SAME) -> None:
        self.phrases: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        self.same: dict[str, str] = {}
        surfaces = {w for label in labels for w in label.split()}
        for group in groups:
            phrases = [plain(p).split() for p in group.split(",")]
            name = stem(phrases[0][0]) if len(phrases[0]) == 1 else "_".join(phrases[0])
            for words in phrases:
                if len(words) == 1:
                    self.same.setdefault(stem(words[0]), name)
                else:
                    self.phrases.setdefault(stem(words[0]), []).append((tuple(map(stem, words)), name))
                surfaces.update(words)
        for found in self.phrases.values():
            found.sort(key=lambda p: -len(p[0]))
        self.small, self.light = {stem(w) for w in SMALL | ADVISING} | SMALL | ADVISING, {stem(w) for w in LIGHT}
        self.surfaces = surfaces | SMALL | ADVISING | LIGHT
        self.known = {stem(w) for w in self.surfaces}
        self.trie = Trie((w, stem(w)) for w in self.surfaces if len(w) > 3)
        self.stems = Trie((w, w) for w in self.known if len(w) > 3)
        self._memo: dict[str, tuple[str, ...]] = {}

    def weight(self, meaning: str) -> float:
        """Of a word: verbs that stand for each other weigh less."""
        return 0.4 if meaning in self.light else 1.0

    def mended(self, word: str) -> tuple[str, ...]:
        """The stem of a word, or those of the nearest ones that it may be a slip of."""
        if (got := self._memo.get(word)) is None:
            got = self._mended(word)
            if len(self._memo) < 1 << 16:
                self._memo[word] = got
        return got

    def _mended(self, word: str) -> tuple[str, ...]:
        own = stem(word)
        if word in self.surfaces or len(word) < 4 or not word.isalpha():
            return (own,)
        swapped = sorted({stem(w) for i in range(len(word) - 1) if (w := word[:i] + word[i + 1] + word[i] + word[i + 2 :]) in self.surfaces})
        if swapped or own in self.known:
            return (*swapped, own) if swapped else (own,)
        for trie, w in ((self.trie, word), *((self.trie, word[: -len(e)]) for e in ("ed", "ing", "s") if word.endswith(e)), (self.stems, own)):
            if near := trie.search(w, allowed(len(w))):
                return tuple(sorted({x for d, x in near if d == near[0][0]}))
        return (own,)

    def begun(self, word: str) -> set[str]:
        """The stems of the words that begin with a broken-off one."""
        return {w for _, w in self.trie.search(word, 0, prefix=True)} if len(word) > 1 else set()

    def variants(self, words: list[str]) -> Iterator[list[str]]:
        """The words' stems, each word by its first; then those that another stem of one word gives."""
        options = [self.mended(w) for w in words]
        first = [o[0] for o in options]
        yield first
        for i, o in enumerate(options):
            for other in o[1:]:
                yield [*first[:i], other, *first[i + 1 :]]

    def meanings(self, words: list[str], stems: list[str]) -> list[str]:
        """Longest phrases first, then words; small words drop."""
        out, i = [], 0
        while i < len(stems):
            if stems[i] in ("un", "non", "not") and i + 1 < len(stems) and (joined := stem("un" + words[i + 1])) in self.known:
                out.append(self.same.get(joined, joined))
                i += 2
                continue
            for phrase, name in self.phrases.get(stems[i], ()):
                if tuple(stems[i : i + len(phrase)]) == phrase:
                    out.append(name)
                    i += len(phrase)
                    break
            else:
                if words[i] not in SMALL and stems[i] not in self.small:
                    out.append(self.same.get(stems[i], stems[i]))
                i += 1
        return out


class Mapper:
    """Entries of one field. entries: (code, label); aliases: (code, other wording), none by default.

    groups: words and phrases that mean the same, a group a line, parted by commas.
    """

    def __init__(self, entries: Iterable[tuple[str, str]], aliases: Iterable[tuple[str, str]] = (), groups: Iterable[str] = SAME) -> None:
        entries = list(entries)
        self.labels = {label for _, label in entries}
        wordings = [(code, plain(t)) for code, t in (*entries, *aliases)]
        self.words = Words((t for _, t in wordings), groups)
        self.whole: dict[str, set[str]] = {}
        for code, t in wordings:
            self.whole.setdefault(t, set()).add(code)
        self.glued = Trie((t.replace(" ", ""), code) for code, t in wordings)
        self.most_words = 4 * max((len(t.split()) for _, t in wordings), default=0) + 4
        self.longest = max((len(t) for _, t in wordings), default=0)
        self.advising = {stem(w) for w in ADVISING}
        self.root: dict = {}
        for code, t in wordings:
            node, meant = self.root, sorted(set(self.words.meanings(t.split(), [stem(w) for w in t.split()])))
            for m in meant:
                node = node.setdefault(m, {})
            if meant:
                node.setdefault("", []).append((code, sum(map(self.words.weight, meant))))
        self._limits(self.root)
        self.known: dict[str, str] = {}

    def _limits(self, node: dict) -> float:
        """Notes at each node the largest weight of an entry below it, which bounds the search."""
        most = max((w for _, w in node.get("", ())), default=0.0)
        for m, child in node.items():
            if m:
                most = max(most, self._limits(child))
        node[None] = most
        return most

    def nearest(self, meant: Iterable[str]) -> dict[str, float]:
        """code -> distance (the share of the entry's weight) of all entries within MISSING: the automaton over words."""
        value = sorted(set(meant))
        if not value:
            return {}
        weight, found = self.words.weight, {}
        left = [0.0] * (len(value) + 1)  # what the rest of the value weighs, if no entry has it
        for i in range(len(value) - 1, -1, -1):
            left[i] = left[i + 1] + ADDED * weight(value[i])
        stack = [(self.root, 0, 0.0)]
        while stack:
            node, at, cost = stack.pop()
            for code, whole in node.get("", ()):
                share = (cost + left[at]) / whole
                if share <= MISSING and share < found.get(code, 9.0):
                    found[code] = share
            for m, child in node.items():
                if not m:
                    continue
                i, c = at, cost
                while i < len(value) and value[i] < m:
                    c += ADDED * weight(value[i])
                    i += 1
                if i < len(value) and value[i] == m:
                    i += 1
                else:
                    c += weight(m)
                if c <= MISSING * child[None]:
                    stack.append((child, i, c))
        return found

    def readings(self, value: str) -> list[list[str]]:
        """The value's words whole, and without what stands before an advice and behind it.

        A reading of more than `most_words` words, four times the longest entry's, lies beyond the distance of all.
        """
        words = plain(value).split()
        n = len(words)
        starts = {0, *(i + 1 + (words[i + 1 : i + 2] in (["to"], ["they"])) for i in range(n) if self.words.mended(words[i])[0] in self.advising)}
        ends = {n, *(i for i in range(1, n) if words[i] in OPENERS)}
        if (dash := re.search(r"\s[-–—]\s", value)) and (before := len(plain(value[: dash.start()]).split())):
            ends.add(before)
        for t in TRAILS:
            k = len(t.split())
            ends |= {e - k for e in ends if e > k and near(" ".join(words[e - k : e]), t)}
        begins, stops = sorted(starts), sorted(ends)
        out = []
        for a in begins:  # only stops within reach, so that long texts take linear time
            reach = bisect_right(stops, a + self.most_words)
            out += [words[a:b] for b in reversed(stops[bisect_right(stops, a, 0, reach) : reach])]
        return out

    def matches(self, value: str) -> list[tuple[float, str]]:
        """(distance, code) of all entries within the allowed distance of any reading of the value, nearest first."""
        found: dict[str, float] = {}
        readings = self.readings(value)
        for words in readings:
            for code in self.whole.get(" ".join(words), ()):
                found[code] = 0.0
        open_end = bool(value.rstrip()) and value.rstrip()[-1].isalnum()
        for words in readings:
            for stems in self.words.variants(words):
                meant = self.words.meanings(words, stems)
                for code, d in self.nearest(meant).items():
                    found[code] = min(d, found.get(code, d))
                if open_end and meant and meant[-1] not in self.words.known:  # a last word that breaks off
                    for full in self.words.begun(words[-1]):
                        for code, d in self.nearest([*meant[:-1], self.words.same.get(full, full)]).items():
                            found[code] = min(d, found.get(code, d))
        if not found:
            for words in readings:
                t = "".join(words)
                if t and len(t) <= self.longest + allowed(len(t)):
                    for d, code in self.glued.search(t, allowed(len(t))):
                        found[code] = min(d / len(t), found.get(code, 1.0))
        if not found and open_end:
            for words in readings:
                t = "".join(words)
                if 4 <= len(t) <= self.longest and (got := self.glued.search(t, allowed(len(t)) // 2, prefix=True)) and len({c for d, c in got if d == got[0][0]}) == 1:
                    found.setdefault(got[0][1], got[0][0] / len(t))
        return sorted((round(d, 6), c) for c, d in found.items())

    def code(self, value: str) -> str:
        """The nearest entry's code, or 'none'."""
        if (got := self.known.get(value)) is None:
            found = self.matches(value)
            got = found[0][1] if found else NONE
            if len(self.known) < 1 << 18:
                self.known[value] = got
        return got


def near(text: str, phrase: str) -> bool:
    """Within the allowed distance of a phrase."""
    if text == phrase:
        return True
    return abs(len(text) - len(phrase)) <= 2 and text[:1] + text[-1:] != "" and distance(text, phrase) <= min(3, max(2, len(phrase) // 6))


@lru_cache(1 << 16)
def distance(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mappers(entries: Iterable[tuple[str, str, str]], aliases: Iterable[tuple[str, str, str]] = (), groups: Iterable[str] = SAME) -> dict[str, Mapper]:
    """By field, from (field, code, label) and (field, code, other wording)."""
    entries, aliases = list(entries), list(aliases)
    of = lambda rows, f: [(c, t) for g, c, t in rows if g == f]
    return {f: Mapper(of(entries, f), of(aliases, f), groups) for f in sorted({f for f, _, _ in entries})}


_held: dict[tuple, dict[str, Mapper]] = {}


def _by_field(lists: tuple) -> dict[str, Mapper]:
    if lists not in _held:  # once a worker
        _held.clear()
        _held[lists] = mappers(*lists)
    return _held[lists]


def _kernel(cols: dict[str, list], lists: tuple) -> Iterator[tuple]:
    by_field = _by_field(lists)
    for key, *values in zip(cols["cache_key"], *(cols[f] for f in by_field)):
        for (name, mapper), value in zip(by_field.items(), values):
            if value and not value.isspace():
                yield name, key, value, mapper.code(value), value in mapper.labels


def reference_list(canonical: DataFrame, wording: str = "label", most: int = 100_000) -> tuple:
    """(field, code, wording) on the driver: a fixed list that must fit there; a longer one than `most` is refused."""
    rows = canonical.select("field", "code", wording).where(f"field is not null and code is not null and {wording} is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the reference list has more than {most} entries")
    return tuple(sorted(tuple(r) for r in rows))


def _lists(canonical: DataFrame, aliases: DataFrame | None, groups: Iterable[str]) -> tuple[tuple, tuple, tuple]:
    return reference_list(canonical), () if aliases is None else reference_list(aliases, "alias"), tuple(groups)


def mapped_values(scored: DataFrame, canonical: DataFrame, aliases: DataFrame | None = None, groups: Iterable[str] = SAME) -> DataFrame:
    """(field, cache_key, value, code, exact) of each value that isn't blank, for every field of the list.

    aliases: (field, code, alias), further wordings of entries, if there are any. groups: see Mapper.
    """
    lists = _lists(canonical, aliases, groups)
    fields = sorted({f for f, _, _ in lists[0]})
    if not fields:
        return scored.sparkSession.createDataFrame([], "field string, cache_key string, value string, code string, exact boolean")
    df = scored.select("cache_key", *fields).where("cache_key is not null")
    return map_rows(df, _kernel, "field string, cache_key string, value string, code string, exact boolean", lists)


def _candidates(cols: dict[str, list], lists: tuple) -> Iterator[tuple]:
    by_field = _by_field(lists)
    for field, value in zip(cols["field"], cols["value"]):
        for d, code in by_field[field].matches(value):
            yield field, value, code, d


def candidates(scored: DataFrame, canonical: DataFrame, aliases: DataFrame | None = None, groups: Iterable[str] = SAME) -> DataFrame:
    """(field, value, code, distance): for each distinct value all entries within the allowed distance."""
    lists = _lists(canonical, aliases, groups)
    values = [scored.select(F.lit(f).alias("field"), F.col(f).alias("value")) for f in sorted({f for f, _, _ in lists[0]})]
    if not values:
        return scored.sparkSession.createDataFrame([], "field string, value string, code string, distance double")
    both = values[0]
    for v in values[1:]:
        both = both.unionByName(v)
    return map_rows(both.where("value rlike '\\\\S'").distinct(), _candidates, "field string, value string, code string, distance double", lists)


def unmatched(scored: DataFrame, canonical: DataFrame) -> DataFrame:
    """(field, value, n): the report of values with no entry, by how often they stand."""
    found = mapped_values(scored, canonical).where(F.col("code") == NONE)
    return found.groupBy("field", "value").agg(F.count("*").alias("n"))
