"""Byte-level BPE by a priority queue of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how byte_bpe texts are split before merging; no merge crosses a piece.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces up to so many bytes, and so many of them, are remembered per Python worker.
MEMO_BYTES, MEMO_SIZE = 64, 200_000


class BytePairEncoder:
    """A vocabulary of byte strings with ids, in which the lower id merges first."""

    def __init__(self, vocabulary: bytes, pattern: str = PIECES) -> None:
        """`vocabulary`: lines of a base64 token and its id."""
        self.ids = {base64.b64decode(t): int(i) for t, i in map(bytes.split, vocabulary.splitlines() if vocabulary else [])}
        self.texts = {i: t for t, i in self.ids.items()}
        self.byte = [self.ids[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.joined: dict[tuple[int, int], int | None] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; of none and of an empty one, no ids. Strings like special tokens are ordinary text. Half of a
        surrogate pair, which UTF-8 can't hold, counts as a question mark."""
        out: list[int] = []
        memo = self.memo
        for m in self.pattern.finditer(text or ""):
            piece = m.group()
            known = memo.get(piece)
            if known is None:
                raw = piece.encode("utf-8", "replace")
                whole = self.ids.get(raw)
                known = (whole,) if whole is not None else tuple(self.merge(raw))
                if len(raw) <= MEMO_BYTES:
                    if len(memo) >= MEMO_SIZE:
                        memo.clear()
                    memo[piece] = known
            out.extend(known)
        return out

    def _rank(self, a: int, b: int) -> int | None:
        pair = (a, b)
        if pair not in self.joined:
            if len(self.joined) >= MEMO_SIZE:
                self.joined.clear()
            self.joined[pair] = self.ids.get(self.texts[a] + self.texts[b])
        return self.joined[pair]

    def merge(self, raw: bytes) -> Iterator[int]:
        """Ids of one piece, by always merging the leftmost pair of the lowest rank: O(n log n)."""
        symbols = [self.byte[b] for b in raw]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self._rank(symbols[i], symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue  # stale: one of the two has merged since
            symbols[i], symbols[j] = rank, -1
            k = after[i] = after[j]
            after[j] = n
            if k < n:
                before[k] = i
                if (r := self._rank(rank, symbols[k])) is not None:
                    heapq.heappush(queue, (r, i, rank, symbols[k]))
            h = before[i]
            if h >= 0 and (r := self._rank(symbols[h], rank)) is not None:
                heapq.heappush(queue, (r, h, symbols[h], rank))
        i = 0
        while i < n:
            yield symbols[i]
            i = after[i]

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids: their strings one after another."""
        return b"".join(self.texts[i] for i in ids or []).decode("utf-8", "replace")


_loaded: dict[int, BytePairEncoder] = {}


def _encoder(shared) -> BytePairEncoder:
    """One encoder per Python worker and vocabulary."""
    key = hash(shared.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = BytePairEncoder(shared.value)
    return _loaded[key]


def share(spark: SparkSession, path: str):
    """A vocabulary file of the driver, for all executors. Its size is fixed: a few hundred KB to a few MB."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def token_ids(text: Column, vocabulary) -> Column:
    """Ids of each text as an array of integers, empty for null and empty texts."""

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(vocabulary)
        for texts in parts:
            yield pd.Series([encoder.encode(t) for t in texts])

    return encode(text)


def token_count(text: Column, vocabulary) -> Column:
    """How many ids each text has."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(vocabulary)
        for texts in parts:
            yield pd.Series([len(encoder.encode(t)) for t in texts], dtype="int64")

    return count(text)


def decoded(ids: Column, vocabulary) -> Column:
    """Texts of ids; null and empty arrays give an empty text."""

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(vocabulary)
        for arrays in parts:
            yield pd.Series([encoder.decode(None if a is None else list(a)) for a in arrays])

    return decode(ids)


def encode_corpus(df: DataFrame, id_column: str, text_column: str, vocabulary) -> DataFrame:
    """`id_column` and `ids`, one row per row of df: whole texts, copies and null ids too; other columns aren't read."""
    return df.select(F.col(id_column), token_ids(F.col(text_column), vocabulary).alias("ids"))
