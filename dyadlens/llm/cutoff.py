"""Problem 3: texts cut off by field limits or in transfer.

A hashed logistic regression decides. It reads the pieces of every record (the response itself, the prose around its
object, its text values) by their closing characters and punctuation, their own length and the record's tokens against
the limits that texts run to, and two statistics as features among the others: how whole values end in this corpus
(endings.py) and where a quote stops in its story. It is trained on intact pieces and artificial cuts of them, half of
them in a random place, half at a field limit.

Intact pieces, to be cut, are those that bear no sign of a cut; doubtful ones are left out of training. The threshold of
each kind of piece comes from cross-fitted scores of its intact pieces (`train`). A record is cut if a piece reaches its
threshold; the only check after that is that the piece holds words at all.

The weights and thresholds come from all distinct responses: pieces and cuts with equal features count as one vector that
stands n times, so the fit is over vectors with their counts, which grow far slower than the input. A response counts
once, so neither copies nor the file layout matter. Every row is scored. Null and blank responses are no cases and have
no score. Null finish_reason and usage are features of their own. Repeated keys count once in `cut_responses`; shares by
source count distinct keys. Empty tables give empty results.
"""

from __future__ import annotations

import math
import random
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_rows
from .answers import RATINGS, Answer, ends_whole, read_answer
from .endings import Endings, distinct_texts, endings_of
from .pairs import quote_cut, quote_place

BITS = 14
#: Parts of the responses, by their hash, of which each is scored by weights from the others.
FOLDS = 4
KINDS = ("open", "prose", "remark", "quote", "value", "whole")
#: An example in bytes: its kind, whether it is cut, its twelve feature numbers.
_VECTOR = struct.Struct("<BB12H")
#: Token limits that responses run to, and lengths in characters that fields are often limited to.
TOKEN_LIMITS = (256, 512, 1024, 2048, 4096, 8192)
FIELD_LIMITS = frozenset((32, 40, 48, 50, 56, 60, 64, 72, 80, 96, 100, 120, 128, 140, 150, 160, 180, 200, 240, 250, 255, 256, 280, 300, 400, 500, 512, 1000, 1024, 2000, 2048, 4000, 4096))
_LIMITS = sorted(FIELD_LIMITS)
#: Keys whose values are no wording, even where they are typed as text.
UNWORDED = frozenset((*RATINGS, "distress_flagged"))
SCHEMA = "cache_key string, model_slot string, score double, cut boolean"


def _shape(c: str) -> str:
    return "a" if c.isalpha() else "0" if c.isdigit() else "_" if c.isspace() else c


def features(kind: str, text: str, limit: str, endings: Endings, story: str) -> tuple[int, ...]:
    """Hashed feature numbers of one piece; always equally many."""
    end = text[-8:].rstrip()[-3:]
    shape = "".join(map(_shape, end))
    sign = endings.sign(text) if kind == "value" else quote_place(text, story) if kind == "quote" else f"{ends_whole(text[-24:]):d}"
    braces = f"{text.count('{') - text.count('}')}{text.count('[') - text.count(']')}"
    return _numbers(kind, shape, min(12, len(text).bit_length()), limit, text.count('"') & 1, braces, sign, len(text) in FIELD_LIMITS)


@lru_cache(1 << 16)
def _numbers(kind: str, shape: str, bits: int, limit: str, quotes: int, braces: str, sign: str, at_limit: bool) -> tuple[int, ...]:
    """The features that so many pieces share, hashed once."""
    known, begun, word, goes_on, joined = sign if len(sign) == 5 and kind == "value" else "....."
    parts = (
        f"k{kind}", f"s{kind}{shape}", f"n{kind}{bits}", f"l{limit}", f"kl{kind}{limit}{shape[-1:]}", f"q{quotes}{kind}",
        f"p{kind}{braces}", f"v{kind}{sign}", f"f{kind}{at_limit:d}{sign}",
        # of the ways a value ends those that go together, so that rare combinations are learned from common ones
        f"b{kind}{begun}{known}", f"o{kind}{joined}{known}", f"i{kind}{goes_on}{word}",
    )
    return tuple(zlib.crc32(p.encode()) & ((1 << BITS) - 1) for p in parts)


def limit_of(finish: str | None, tokens: int | None) -> str:
    """The finish reason, and how near the record's tokens are to the next limit, in steps."""
    if tokens is None:
        return f"{finish}?"
    limit = next((x for x in TOKEN_LIMITS if x >= tokens), 0)
    share = tokens / limit if limit else 2.0
    return f"{finish}{'=' if share == 1 else '>' if share > 1 else '~' if share >= 0.97 else '+' if share >= 0.8 else '<'}"


def pieces(text: str, a: Answer) -> list[tuple[str, str]]:
    """(kind, piece) of a response: all that may break off."""
    out = [("open" if a.open else "prose", text if a.open else a.lead)] if a.object is None else []
    if a.object is not None:
        if a.trail:
            out.append(("remark", a.trail))
        out += [("quote" if k == "evidence_quote" else "value", v) for k, v in a.strings.items() if len(v) > 1 and k not in UNWORDED]
        out.append(("whole", text))
    return [(k, p) for k, p in out if p.strip()]


def cut_at(piece: str, rng: random.Random) -> str | None:
    """An artificial cut inside of a sentence: in a random place, or at a field limit; None if the piece is too short."""
    if len(piece) <= 6:
        return None
    limits = _LIMITS[bisect_right(_LIMITS, len(piece) // 3) : bisect_left(_LIMITS, len(piece) - 1)]
    at = rng.choice(limits) if limits and rng.random() < 0.5 else rng.randrange(max(2, len(piece) // 3), len(piece) - 1)
    cut = piece[:at].rstrip()
    return cut if cut and not ends_whole(cut) else None


def intact(kind: str, piece: str, story: str, endings: Endings) -> bool:
    """Fit to be cut for training: nothing in the piece says that it is cut already. Doubtful pieces are left out."""
    if kind == "open":
        return False
    if kind == "whole":
        return piece.rstrip()[-1:] in "}`" or ends_whole(piece)
    if kind == "quote":
        return not quote_cut(piece, story)
    return not endings.cut(piece) if kind == "value" else ends_whole(piece)


def examples(text: str, finish: str | None, tokens: int | None, story: str | None, endings: Endings, cuts: int = 1, seed: int = 7) -> Iterator[tuple[str, int, list[int]]]:
    """(kind, cut, features) of a response's intact pieces (0) and of `cuts` artificial cuts of each (1)."""
    a = read_answer(text)
    lim = limit_of(finish, tokens)
    rng = random.Random(zlib.crc32(text.encode()) ^ seed)
    for kind, piece in pieces(text, a):
        if not intact(kind, piece, story or "", endings):
            continue
        yield kind, 0, features(kind, piece, lim, endings, story or "")
        if kind == "quote" and (bare := piece.rstrip(".!? ")) != piece and len(bare) > 1:  # lacks its closing mark only
            yield kind, 0, features(kind, bare, lim, endings, story or "")
        as_kind = "open" if kind == "whole" else kind
        for cut in {c for _ in range(cuts) if (c := cut_at(piece, rng))}:
            yield as_kind, 1, features(as_kind, cut, lim, endings, story or "")


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-5, steps: int = 1000, kept: int = 20) -> np.ndarray:
    """Weights of the logistic regression over vectors that stand n times each; the two classes count alike.

    L-BFGS on the mean loss with an L2 penalty, from zero, until it stands still: the loss has one minimum, which does
    not depend on any order of the vectors.
    """
    used, at = np.unique(x, return_inverse=True)
    at, sign = at.reshape(x.shape), 2 * y - 1
    share = min(max(float((n * y).sum() / n.sum()), 1e-3), 1 - 1e-3)
    weight = n / n.sum() * np.where(y == 1, 0.5 / share, 0.5 / (1 - share))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = sign * w[at].sum(1)
        gap = -sign * weight * np.exp(-np.logaddexp(0, z))
        return float((weight * np.logaddexp(0, -z)).sum() + ridge / 2 * w @ w), np.bincount(at.ravel(), np.repeat(gap, x.shape[1]), len(used)) + ridge * w

    w = np.zeros(len(used))
    value, g = loss(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, shares = g.copy(), []
        for d, e in reversed(moves):
            shares.append(d @ way / (d @ e))
            way -= shares[-1] * e
        if moves:
            way *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1])
        for (d, e), a in zip(moves, reversed(shares)):
            way += d * (a - e @ way / (d @ e))
        step, slope = 1.0, g @ way
        while (got := loss(w - step * way))[0] > value - 1e-4 * step * slope and step > 1e-9:
            step /= 2
        if np.abs(g).max() < 1e-7 or got[0] >= value:
            break
        d, e = -step * way, got[1] - g
        w, (value, g) = w + d, got
        if d @ e > 0:
            moves = [*moves, (d, e)][-kept:]
    out = np.zeros(1 << BITS)
    out[used] = w
    return out


def quantile(z: np.ndarray, n: np.ndarray, share: float) -> float:
    """np.quantile of values that stand n times each."""
    order = np.argsort(z)
    upto = np.cumsum(n[order])
    place = share * (upto[-1] - 1)
    low, high = (float(z[order][np.searchsorted(upto, p, "right")]) for p in (np.floor(place), np.ceil(place)))
    return low + (high - low) * float(place - np.floor(place))


def train(
    data: list[tuple[str, int, Sequence[int]]], times: Sequence[int] | None = None, fold: Sequence[int] | None = None, folds: int = FOLDS, alarms: float = 6e-4
) -> tuple[np.ndarray, dict[str, float]]:
    """(weights, threshold of the linear score by kind of piece) from (kind, cut, features).

    times: how often each of them stands (once); fold: the fold it is in (in turns).
    A kind's threshold is the score that a share of `alarms` of its intact pieces pass, each scored by weights that were
    fitted without it; 0, the even chance, at least.
    """
    if not data:
        return np.zeros(1 << BITS), {}
    x, y = np.array([f for *_, f in data], np.int64), np.array([t for _, t, _ in data], float)
    n = np.ones(len(y)) if times is None else np.array(times, float)
    kinds, part, z = np.array([k for k, *_ in data]), np.arange(len(y)) % folds if fold is None else np.array(fold), np.zeros(len(y))
    for k in range(folds):
        if (part == k).any() and (part != k).any():
            z[part == k] = fit(x[part != k], y[part != k], n[part != k])[x[part == k]].sum(1)
    thresholds = {}
    for kind in sorted(set(kinds.tolist())):
        own = (kinds == kind) & (y == 0)
        thresholds[kind] = max(0.0, quantile(z[own], n[own], 1 - alarms)) if own.any() else 0.0
    return fit(x, y, n), thresholds


def _wordy(kind: str, piece: str) -> bool:
    """The check after the score: a piece of several words that isn't a mere label; an object left open always is."""
    return kind == "open" or any(c.isalpha() for c in piece) and len(piece.split()) > 1 and not piece.endswith(":")


def verdict(text: str, finish: str | None, tokens: int | None, story: str | None, weights: list[float], thresholds: dict[str, float], endings: Endings) -> tuple[float, bool]:
    """(highest score of the pieces, whether one of them reaches its kind's threshold)."""
    a = read_answer(text)
    lim = limit_of(finish, tokens)
    best, cut = -30.0, False
    for kind, piece in pieces(text, a):
        z = 0.0
        for f in features(kind, piece, lim, endings, story or ""):
            z += weights[f]
        best = max(best, z)
        cut = cut or z >= thresholds.get(kind, 0.0) and z > 0 and _wordy(kind, piece)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, best)))), cut


def _kernel(cols: dict[str, list], weights: np.ndarray, thresholds: dict[str, float], endings: Endings) -> Iterator[tuple]:
    w = weights.tolist()
    for key, slot, text, finish, tokens, story in zip(*(cols[c] for c in ("k", "slot", "t", "f", "n", "story"))):
        if text is None or not text.strip():
            yield key, slot, None, False
        else:
            yield key, slot, *verdict(text, finish, tokens, story, w, thresholds, endings)


@lru_cache(1 << 16)
def _packed(kind: str, cut: int, numbers: tuple[int, ...]) -> bytes:
    return _VECTOR.pack(KINDS.index(kind), cut, *numbers)


def _examples(cols: dict[str, list], endings: Endings, cuts: int) -> Iterator[tuple]:
    for h, text, finish, tokens, story in zip(*(cols[c] for c in ("h", "t", "f", "n", "story"))):
        if text and text.strip():
            yield h, b"".join(_packed(*x) for x in examples(text, finish, tokens, story, endings, cuts))


def _counted(cols: dict[str, list]) -> Iterator[tuple]:
    seen = Counter((h % FOLDS, all_of[i : i + _VECTOR.size]) for h, all_of in zip(cols["h"], cols["all"]) for i in range(0, len(all_of), _VECTOR.size))
    for (part, vector), n in seen.items():
        yield part, vector, n


def counted_examples(df: DataFrame, endings: Endings, cuts: int) -> DataFrame:
    """(fold, vector, n): how often each vector of features comes from the distinct responses of a frame (t, f, n, story).

    A response's examples are all in one fold. No text is shuffled.
    """
    read = map_rows(df.where("t is not null").select(F.xxhash64("t").alias("h"), "t", "f", "n", "story"), _examples, "h long, all binary", endings, cuts)
    return map_rows(read.groupBy("h").agg(F.min("all").alias("all")), _counted, "fold int, vector binary, n long").groupBy("fold", "vector").agg(F.sum("n").alias("n"))


def model_of(df: DataFrame) -> tuple[np.ndarray, dict[str, float], Endings]:
    """(weights, thresholds, endings) of a frame (t, f, n, story), from all its distinct responses.

    Of few responses each piece is cut in more than one place. Only vectors of hashed features with their counts come to
    the driver; how many differ hangs on the ways that pieces end, not on the rows.
    """
    n = distinct_texts(df.select("t"))
    endings = endings_of(df.select("t"), distinct=n)
    got = sorted(zip(*counted_examples(df, endings, max(1, min(20, 2_000 // max(1, n)))).toArrow().to_pydict().values()))
    data = [(KINDS[kind], cut, numbers) for kind, cut, *numbers in (_VECTOR.unpack(vector) for _, vector, _ in got)]
    return *train(data, [n for *_, n in got], [part for part, *_ in got]), endings


def scored_cuts(raw: DataFrame) -> DataFrame:
    """(cache_key, model_slot, score, cut) of every row: the highest score of its pieces, and the verdict."""
    df = raw.select(
        F.col("cache_key").alias("k"), F.col("model_slot").alias("slot"), F.col("response_text").alias("t"), F.col("finish_reason").alias("f"),
        F.col("usage.completion_tokens").alias("n"), F.col("vignette_text").alias("story"),
    )
    return map_rows(df, _kernel, SCHEMA, *model_of(df))


def cut_responses(raw: DataFrame) -> DataFrame:
    """Distinct cache_key of broken-off responses."""
    return scored_cuts(raw).where("cut and cache_key is not null").select("cache_key").distinct()


def cut_share(raw: DataFrame) -> DataFrame:
    """(model_slot, n, n_cut, share) over distinct keys."""
    per_key = scored_cuts(raw).where("cache_key is not null").groupBy("cache_key", "model_slot").agg(F.max("cut").alias("cut"))
    return per_key.groupBy("model_slot").agg(
        F.count("*").alias("n"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share")
    )
