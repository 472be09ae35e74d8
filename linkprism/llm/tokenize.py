"""Encoding a corpus with a public byte-level BPE (problem 8).

Method: monoid tree reduction. A text is halved recursively down to leaves that the
tokenizer encodes at once; neighbours are joined by re-encoding a window around the
seam that grows until the pieces outside it provably stand. Decoding concatenates
bytes up the same tree.

Why a window suffices: the tokenizer splits a text from left to right into pieces by
a pattern without look-behind and encodes each piece alone. A piece that ends at
least ``LOOK`` characters before the end of the left part was cut without seeing its
end, so it stays. On the right, once a piece of the joined text starts where a piece
of the right part started, everything after it is cut alike.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF_CHARS = 4096
_SHIPPED: set[tuple[str, str]] = set()
#: Characters the splitting pattern may look past a piece: a contraction's letters or the character after white space.
LOOK = 4
#: The splitting pattern of byte-level BPE vocabularies of this kind (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoded:
    """Monoid element: a text, the starts of its pieces, and per piece the first index of its ids."""

    __slots__ = ("text", "starts", "firsts", "ids")

    def __init__(self, text: str, starts: list[int], firsts: list[int], ids: list[int]):
        self.text, self.starts, self.firsts, self.ids = text, starts, firsts, ids


class Tokenizer:
    """Byte-level BPE from a rank file; special token strings in a text are ordinary text."""

    def __init__(self, path: str = VOCABULARY, leaf: int = LEAF_CHARS):
        import regex
        import tiktoken

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.leaf = leaf
        self._split = regex.compile(PATTERN)
        self._bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._piece = lru_cache(maxsize=200_000)(lambda s: tuple(self._bpe.encode_ordinary(s)))

    def _encode(self, text: str) -> Encoded:
        starts, firsts, ids = [], [], []
        for m in self._split.finditer(text):
            starts.append(m.start())
            firsts.append(len(ids))
            ids.extend(self._piece(m.group()) if m.end() - m.start() <= 64 else self._bpe.encode_ordinary(m.group()))
        return Encoded(text, starts, firsts, ids)

    def join(self, a: Encoded, b: Encoded) -> Encoded:
        """Associative; the empty text is neutral."""
        if not a.text or not b.text:
            return a if a.text else b
        n = len(a.text)
        # The first piece on the left that is not proven: its end lies within LOOK of the seam.
        ends = a.starts[1:] + [n]
        k = bisect_left(ends, n - LOOK + 1)
        seam, width = a.text[a.starts[k]:], 64
        while True:
            window = seam + b.text[:width]
            whole = width >= len(b.text)
            mid = self._encode(window)
            for i, s in enumerate(mid.starts):
                end = mid.starts[i + 1] if i + 1 < len(mid.starts) else len(window)
                if s < len(seam):
                    continue
                if not whole and end > len(window) - LOOK:
                    break  # this piece may still change: a wider window
                j = bisect_left(b.starts, s - len(seam))
                if j < len(b.starts) and b.starts[j] == s - len(seam):
                    return self._glue(a, k, mid, i, b, j)
            if whole:
                return self._glue(a, k, mid, len(mid.starts), b, len(b.starts))
            width *= 2

    @staticmethod
    def _glue(a: Encoded, k: int, mid: Encoded, i: int, b: Encoded, j: int) -> Encoded:
        """The pieces before k of a, before i of the window and from j of b."""
        off, n = a.starts[k], len(a.text)
        ids = a.ids[: a.firsts[k]]
        base = len(ids)
        cut = mid.firsts[i] if i < len(mid.firsts) else len(mid.ids)
        tail = b.firsts[j] if j < len(b.firsts) else len(b.ids)
        ids = ids + mid.ids[:cut] + b.ids[tail:]
        return Encoded(
            a.text + b.text,
            a.starts[:k] + [off + s for s in mid.starts[:i]] + [n + s for s in b.starts[j:]],
            a.firsts[:k] + [base + f for f in mid.firsts[:i]] + [base + cut - tail + f for f in b.firsts[j:]],
            ids,
        )

    def tree(self, text: str) -> Encoded:
        if len(text) <= self.leaf:
            return self._encode(text)
        half = len(text) // 2
        return self.join(self.tree(text[:half]), self.tree(text[half:]))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; empty and null texts have no ids."""
        if not text:
            return []
        return self._bpe.encode_ordinary(text) if len(text) <= self.leaf else self.tree(text).ids

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        """Inverse of ``encode``: bytes are concatenated up the tree, then read as UTF-8."""

        def up(lo: int, hi: int) -> bytes:
            if hi - lo <= self.leaf:
                return self._bpe.decode_bytes(ids[lo:hi])
            mid = (lo + hi) // 2
            return up(lo, mid) + up(mid, hi)

        return up(0, len(ids)).decode("utf-8")


@lru_cache(maxsize=4)
def tokenizer(path: str = VOCABULARY, leaf: int = LEAF_CHARS) -> Tokenizer:
    """One per Python worker."""
    return Tokenizer(path, leaf)


def _shipped(df: DataFrame, path: str) -> Callable[[], str]:
    """Send the vocabulary file to the executors, once per application; gives the path there."""
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHIPPED:
        _SHIPPED.add(key)
        spark.sparkContext.addFile(path)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return lambda: SparkFiles.get(name)


def encoded(df: DataFrame, text: str, path: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """``df`` with ``ids``; null and empty texts get an empty list, other columns stay."""

    here = _shipped(df, path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(here(), leaf)
        for s in batches:
            yield pd.Series([t.encode(x) for x in s], dtype=object)

    return df.withColumn("ids", ids(F.col(text)))


def decoded(df: DataFrame, ids: str, path: str = VOCABULARY) -> DataFrame:
    """``df`` with ``decoded_text``; an empty list or null gives the empty text."""

    here = _shipped(df, path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(here())
        for s in batches:
            yield pd.Series([t.decode(list(x)) if x is not None else "" for x in s], dtype=object)

    return df.withColumn("decoded_text", text(F.col(ids)))


def counted(df: DataFrame, text: str, path: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """``df`` with ``n_tokens``; 0 for null and empty texts."""

    here = _shipped(df, path)

    @F.pandas_udf("long")
    def n(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(here(), leaf)
        for s in batches:
            yield pd.Series([t.count(x) for x in s], dtype="int64")

    return df.withColumn("n_tokens", n(F.col(text)))
