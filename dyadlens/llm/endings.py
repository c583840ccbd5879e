"""How whole values end: counted over all distinct responses, used to check candidates for a cut value (problems 1 and 3)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import extract_object
from ..session import map_rows
from .answers import ends_whole
from .mapping import OPENERS, TRAILS, Trie, near, plain


_DIGITS = re.compile(r"\d+")


class Endings:
    """Last word pairs of values that end whole, the words of all values, and the pairs of words that others follow.

    A last pair counts if its value has an end mark, or if it stands `often` times: a value that is cut ends in a pair of
    its own. Both bounds grow with the input (see endings_of).
    """

    def __init__(self, values: Iterable[str], often: int = 8) -> None:
        seen: Counter = Counter()
        for v in values:
            for kind, item in parts_of(v):
                seen[kind, item] += 1
        self._take((kind, item) for (kind, item), n in seen.items() if kind == "marked" or n >= often)

    @classmethod
    def of(cls, counted: Iterable[tuple[str, str]]) -> Endings:
        """From (kind, item) of all that reach their bound."""
        e = cls(())
        e._take(counted)
        return e

    def _take(self, counted: Iterable[tuple[str, str]]) -> None:
        pairs, words, inner = set(), set(), set()
        for kind, item in counted:
            (words if kind == "word" else inner if kind == "inner" else pairs).add(item)
        self.pairs, self.words, self.inner = frozenset(pairs), frozenset(words), frozenset(inner)
        self.begun = frozenset(w[:i] for w in self.words for i in range(1, len(w))) - self.words
        self._trie: Trie | None = None
        self._nears: dict[str, list[str]] = {}
        self._memo: dict[str, bool] = {}
        self._cuts: dict[str, bool] = {}
        self._signs: dict[str, str] = {}

    def __reduce__(self) -> tuple:
        return _restored, (self.pairs, self.words, self.begun, self.inner)

    def _known(self, pair: str) -> bool:
        if pair in self.pairs:
            return True
        if (got := self._memo.get(pair)) is None:
            a, _, b = pair.partition(" ")
            # a word that others begin with is no slip of one of them
            got = bool(b) and b not in self.begun and any(f"{x} {y}" in self.pairs for x in self._near(a) for y in self._near(b))
            if len(self._memo) < 1 << 16:
                self._memo[pair] = got
        return got

    def _near(self, word: str) -> list[str]:
        """Words of known pairs that the word may be a slip of: none below four letters, two or four edits above."""
        if (got := self._nears.get(word)) is None:
            if self._trie is None:
                self._trie = Trie((w, w) for w in {w for p in self.pairs for w in p.split()})
            got = [w for _, w in self._trie.search(word, 0 if len(word) < 4 else 2 if len(word) < 8 else 4)]
            if len(self._nears) < 1 << 16:
                self._nears[word] = got
        return got

    def sign(self, value: str) -> str:
        """How a value ends, for the classifier: "." for an end mark, else whether it ends in a known pair, in a word that
        others begin with, in a known word, in a pair that elsewhere goes on, and whether a clause was joined to it."""
        if (got := self._signs.get(value)) is None:
            if ends_whole(value):
                got = "."
            else:
                w = _words(value)
                last = w[-1] if w else ""
                got = f"{self._known(' '.join(w[-2:])):d}{last in self.begun:d}{last in self.words:d}{' '.join(w[-2:]) in self.inner:d}{_joined(w):d}"
            if len(self._signs) < 1 << 16:
                self._signs[value] = got
        return got

    def cut(self, value: str) -> bool:
        """The value stops in a clause that was joined to it, or inside a word."""
        if (got := self._cuts.get(value)) is None:
            got = self._cut(value)
            if len(self._cuts) < 1 << 16:
                self._cuts[value] = got
        return got

    def _cut(self, value: str) -> bool:
        if not value.strip() or ends_whole(value) or not value[-1:].isascii():
            return False
        w = _words(value)
        if len(w) < 2:
            return False
        known = self._known(" ".join(w[-2:]))
        begun = w[-1] in self.begun
        if _joined(w):
            return not known or begun
        return begun and not known


@lru_cache(2)  # tasks of one worker share what was looked up
def _restored(pairs: frozenset, words: frozenset, begun: frozenset, inner: frozenset) -> Endings:
    e = Endings(())
    e.pairs, e.words, e.begun, e.inner = pairs, words, begun, inner
    return e


def endings_of(texts: DataFrame, often: int = 8, per: int = 20_000, distinct: int | None = None) -> Endings:
    """Counted over every response of the frame's one column, equal ones once, whatever their keys.

    distinct: how many distinct responses there are, if that is known.

    A pair or word must stand in `often` of `per` distinct responses (three at least: once or twice may be the same cut),
    a pair with an end mark in one of `per` (one at least), so the bounds mean the same at every size and what goes to
    the driver is bounded. Only hashes and values are shuffled.
    """
    t = texts.toDF("t").where("t is not null").select(F.xxhash64("t").alias("h"), "t")
    scale = (distinct_texts(texts) if distinct is None else distinct) / per
    values = map_rows(t, _values, "h long, v string").distinct().groupBy("v").agg(F.count("*").alias("n"))
    seen = map_rows(values, _parts, "kind string, item string, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))
    bound = F.when(F.col("kind") == "marked", F.lit(max(1.0, scale))).otherwise(F.lit(max(3.0, often * scale)))
    return Endings.of((r["kind"], r["item"]) for r in seen.where(F.col("n") >= bound).select("kind", "item").collect())


def distinct_texts(texts: DataFrame) -> int:
    """How many distinct texts a one-column frame holds; only hashes are shuffled."""
    t = texts.toDF("t").where("t is not null")
    return t.select(F.xxhash64("t").alias("h")).distinct().count()


def _values(cols: dict[str, list]) -> Iterator[tuple]:
    for h, t in zip(cols["h"], cols["t"]):
        for v in actions([t]):
            yield h, v


def _parts(cols: dict[str, list]) -> Iterator[tuple]:
    for v, n in zip(cols["v"], cols["n"]):
        for kind, item in parts_of(v):
            yield kind, item, n


def _words(value: str) -> list[str]:
    """The value's words without a courtesy at its end; all numbers count as one word."""
    return _peel(_DIGITS.sub("0", plain(value)).split())


def _joined(words: list[str]) -> bool:
    """A clause is joined to the advice, or the word that would join it is broken off at the end."""
    last = words[-1] if len(words) > 2 else ""
    return any(x in OPENERS for x in words[2:]) or len(last) > 2 and any(o.startswith(last) for o in OPENERS)


def _peel(words: list[str]) -> list[str]:
    for t in TRAILS:
        n = len(t.split())
        if len(words) > n and near(" ".join(words[-n:]), t):
            return words[:-n]
    return words


def parts_of(value: str) -> Iterator[tuple[str, str]]:
    """(kind, item) to count of a value: its words, its last pair as `marked` or `bare`, and the pairs that others follow."""
    w = _words(value)
    if w:
        yield "marked" if value.rstrip()[-1] in ".!?" else "bare", " ".join(w[-2:])
        for x in w:
            yield "word", x
        for i in range(1, len(w) - 1):
            yield "inner", f"{w[i - 1]} {w[i]}"


def actions(texts: Iterable[str]) -> Iterable[str]:
    """The recommended action of each response that has an object."""
    for t in texts:
        got, _ = extract_object(t)
        if got and isinstance(v := got.get("recommended_action"), str) and v.strip():
            yield v
