"""Token counts of whole texts by heap-and-linked-list byte-pair merging.

A piece's bytes are symbols in a linked list; a heap holds the adjacent pairs that can merge. The
lowest rank (leftmost of equals) is popped, its pair becomes one symbol, and the pairs with the new
neighbours enter the heap. The count is the number of initial symbols minus the number of merges;
no token sequence is made. Counts of short pieces are kept in a bounded table per worker.

Special strings of the vocabulary inside a text count one token each, as the library does by
default. Defined results: a null or empty text has 0 bytes and 0 tokens; null ids, ties and repeated
rows are counted row by row; an empty table gives an empty table. Input columns named like an added
one are replaced.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text, _tokenizer

#: Pieces whose counts a worker keeps, and the longest of them in characters.
KEPT_PIECES = 1 << 19
KEPT_CHARS = 64


class Counter(dict):
    """Piece -> number of tokens."""

    def __init__(self, vocabulary: _tokenizer.Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.pattern = regex.compile(_tokenizer.PATTERN)

    def __missing__(self, piece: str) -> int:
        n = merge(piece.encode(), self.vocabulary)[0]
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        parts, total = self.vocabulary.plain_parts(text)
        for part in parts:
            for segment in _tokenizer.segments(part):
                total += sum(map(self.__getitem__, self.pattern.findall(segment)))
        return total


def merge(piece: bytes, vocabulary: _tokenizer.Vocabulary) -> tuple[int, list[int]]:
    """Merge a piece until no pair can merge any more: how many symbols are left, and the list of
    symbols, in which those that were taken up by their left neighbour are -1."""
    merges, n = vocabulary.merges, len(piece)
    symbol = [vocabulary.byte_ids[b] for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = symbol[i], symbol[i + 1]
        if pair in merges:
            heap.append((merges[pair][0], i, pair))
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, (left, right) = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != left or j >= n or symbol[j] != right:
            continue  # one of the two has merged meanwhile
        symbol[i], symbol[j] = merges[left, right][1], -1
        done += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair = symbol[i], symbol[k]
            if pair in merges:
                heapq.heappush(heap, (merges[pair][0], i, pair))
        h = before[i]
        if h >= 0:
            pair = symbol[h], symbol[i]
            if pair in merges:
                heapq.heappush(heap, (merges[pair][0], h, pair))
    return n - done, symbol


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(_tokenizer.vocabulary(path))


def count_tokens(docs: DataFrame, text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """The input's columns but the text, and ``n_bytes`` (UTF-8) and ``n_tokens`` (long)."""
    path = tokenizer_path or _tokenizer.default_path()
    carried = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens")]
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField(c, T.LongType(), False) for c in ("n_bytes", "n_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for part in _text.slices(batches, text_col):
            texts = pc.fill_null(part.column(text_col), "")
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in carried), pc.binary_length(texts).cast(pa.int64()),
                 pa.array([count(t.as_py()) for t in texts], pa.int64())], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in [*carried, text_col])).mapInArrow(run, schema)
