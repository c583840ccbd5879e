"""Problem 7: documents laid into containers of one token capacity with little room left.

Minimum bin slack: for each container the largest piece left is laid in first, then a bitset subset-sum over the
lengths still available finds the fullest feasible combination, which is taken out. Only texts above the capacity are
split, into full containers of their own and a rest that is packed like any other piece.

Texts are measured by a public tokenizer whose file is a parameter. Documents are dealt by hash to shards of about
`shard_docs` documents, each packed by itself: the loss is at most one part-filled container a shard. Only ids and
lengths are shuffled. Null and empty texts measure 0 and come with the first container of their shard. Repeated
documents are packed each. The result is the same in every run: pieces are ordered by length and id.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_rows

#: The vocabulary file; never copied into the package.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PLACED = "doc_id long, piece long, token_start long, token_end long, n_tokens long, container long"

_encodings: dict[str, object] = {}


def encoding(path: str):  # noqa: ANN201
    """The tokenizer of a rank file, once per worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _measure(cols: dict[str, list], path: str) -> Iterator[tuple]:
    enc = encoding(path)
    for doc, text in zip(cols["doc_id"], cols["text"]):
        yield doc, len(enc.encode_ordinary(text)) if text else 0


def lengths(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens)."""
    return map_rows(documents.select("doc_id", "text").where("doc_id is not null"), _measure, "doc_id long, n_tokens long", tokenizer)


def fullest(counts: list[int], distinct: list[int], room: int) -> list[int]:
    """The lengths, of those at hand, whose sum is the largest that fits into `room`. counts: by length; distinct: descending."""
    reach, mask, full = 1, (1 << (room + 1)) - 1, 1 << room
    steps: list[tuple[int, int, int]] = []  # (reach before, length, times)
    for n in distinct:
        if n > room:
            continue
        left, times = min(counts[n], room // n), 1
        while left > 0:
            take = min(times, left)
            steps.append((reach, n, take))
            reach = (reach | reach << n * take) & mask
            left -= take
            times *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    chosen: list[int] = []
    for before, n, take in reversed(steps):
        if not before >> at & 1:
            chosen += [n] * take
            at -= n * take
    return chosen


def pack(sizes: list[tuple[int, object]], capacity: int) -> Iterator[tuple[int, object]]:
    """(container, piece) of all pieces, each no larger than the capacity; pieces of length 0 go to container 0."""
    by_size: dict[int, list] = defaultdict(list)
    for n, piece in sorted(sizes, key=lambda x: (x[0], x[1]), reverse=True):
        by_size[n].append(piece)
    for piece in by_size.pop(0, ()):
        yield 0, piece
    counts = [0] * (capacity + 1)
    for n, pieces in by_size.items():
        counts[n] = len(pieces)
    distinct = sorted(by_size, reverse=True)
    container = 0
    while distinct:
        first = distinct[0]
        counts[first] -= 1
        got = [first, *fullest(counts, distinct, capacity - first)] if capacity > first else [first]
        for n in got[1:]:
            counts[n] -= 1
        for n in got:
            yield container, by_size[n].pop()
        if any(not counts[n] for n in set(got)):
            distinct = [n for n in distinct if counts[n]]
        container += 1


def containers(documents: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER, shard_docs: int = 20_000) -> DataFrame:
    """(doc_id, piece, token_start, token_end, n_tokens, container) of every piece."""
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    shards = max(1, -(-documents.count() // shard_docs))
    sized = lengths(documents, tokenizer).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["shard"].iloc[0]) << 32
        pieces: list[tuple[int, tuple]] = []
        for doc, n in zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist()):
            for k in range(max(1, -(-n // capacity))):
                pieces.append((min(capacity, n - k * capacity), (doc, k)))
        rows = [(doc, k, k * capacity, k * capacity + size, size, base + c) for size, (c, (doc, k)) in _with_size(pieces, capacity)]
        return pd.DataFrame(rows, columns=["doc_id", "piece", "token_start", "token_end", "n_tokens", "container"])

    return sized.groupBy("shard").applyInPandas(run, PLACED)


def _with_size(pieces: list[tuple[int, tuple]], capacity: int) -> Iterator[tuple[int, tuple]]:
    size = {p: n for n, p in pieces}
    for c, p in pack(pieces, capacity):
        yield size[p], (c, p)


def fill(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(containers, full, tokens, used): how many, how many without room, the tokens, and the share of room used."""
    per = placed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return per.agg(
        F.count("*").alias("containers"), F.sum((F.col("n") == capacity).cast("long")).alias("full"), F.sum("n").alias("tokens"),
        F.round(F.sum("n") / (F.count("*") * F.lit(capacity)), 6).alias("used"),
    )
