"""Byte-level BPE encoding with a public vocabulary.

A text is split by the vocabulary's pattern; each piece that is no token itself
is merged over a segment tree: its leaves hold the ranks of adjacent pairs, its
root the leftmost pair of lowest rank, and a merge updates at most three leaves
in logarithmic time, so that a piece of many thousand bytes costs no quadratic
time.  Pieces met before are looked up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabularies lie; every function takes another path.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 60
#: Bytes of pieces and ids that a task remembers.
MEMO_BYTES = 64 << 20


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The vocabulary file (some hundred kB, whatever the corpus), to be sent to the tasks."""
    return Path(path).read_bytes()


class PairTree:
    """Segment tree whose root is the smallest ``rank * size + place`` of its leaves."""

    __slots__ = ("size", "node")

    def __init__(self, keys: list[int]) -> None:
        size = 1
        while size < len(keys):
            size *= 2
        self.size = size
        self.node = [NONE] * size + keys + [NONE] * (size - len(keys))
        node = self.node
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def put(self, place: int, key: int) -> None:
        node, i = self.node, self.size + place
        node[i] = key
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a < b else b
            if node[i] == low:
                break
            node[i] = low
            i >>= 1


class Encoder:
    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [ranks.get(piece[i : i + 2]) for i in range(n - 1)]
        tree = PairTree([NONE if r is None else r * n + i for i, r in enumerate(rank)])
        while (top := tree.node[1]) != NONE:
            i = top % n
            j = after[i]
            part[i] += part[j]
            part[j] = None
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, NONE)
            if k < n:
                before[k] = i
                r = ranks.get(part[i] + part[k])
                tree.put(i, NONE if r is None else r * n + i)
            else:
                tree.put(i, NONE)
            h = before[i]
            if h >= 0:
                r = ranks.get(part[h] + part[i])
                tree.put(h, NONE if r is None else r * n + h)
        return tuple(ranks[p] for p in part if p is not None)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none.  A lone surrogate counts as U+FFFD."""
        if not text:
            return []
        memo, out = self.memo, []
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                size = 200 + 4 * len(piece) + 8 * len(ids)
                if size <= MEMO_BYTES // 1000:
                    self.held += size
                    if self.held > MEMO_BYTES:
                        memo.clear()
                        self.held = size
                    memo[piece] = ids
            out += ids
        return out


def _encoder(shared) -> Encoder:
    return Encoder(shared.value)


def encode_texts(df: DataFrame, row_id: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(row id, ids)`` of every row; ``ids`` is empty, never null, for null and empty texts."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = [encoder.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.fromiter((i for r in rows for i in r), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[row_id, "ids"])

    return df.select(row_id, text).mapInArrow(scan, f"`{row_id}` bigint, ids array<int>")


def count_tokens(df: DataFrame, row_id: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(row id, n_tokens)`` of every row; 0 for null and empty texts."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            sizes = [len(encoder.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=[row_id, "n_tokens"])

    return df.select(row_id, text).mapInArrow(scan, f"`{row_id}` bigint, n_tokens int")
