"""Harmonic packing of documents into sequences of fixed capacity.

A document is its token ids and an end id. Class k takes pieces longer than capacity/(k+1) and up to
capacity/k, and a bin of class k is full with k pieces. Documents are cut so that nearly all tokens
lie in pieces of exactly a class's longest length: whole sequences, then halves, quarters and so on
down to ``SMALLEST``; the rest of a document is a short piece, whose class (16 or more to a bin) wastes
little. Every worker (task) fills its bins independently as documents stream by, so nothing is
shuffled and a worker holds at most one open bin per class. At its end the open bins' pieces are
laid end to end and cut at the capacity, so a worker pads one sequence besides the short classes.

Defined results: a null or empty text is the end id alone; rows with a null id and repeated rows are
packed like others; an empty table gives no pieces. Very long texts are tokenised in segments cut
where no token can change; runs of a million equal characters are merged piece by piece. Only the id and the text are read; other columns are not returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text, _tokenizer, token_count

CAPACITY = 2048
#: Documents are cut at halves, quarters, ... of the capacity down to this share of it.
SMALLEST = 16
#: A worker gets at least about so many documents, lest small inputs end in many half-filled sequences.
WORKER_ROWS = 2000
#: ... or for each so many bytes of text, if that gives more tasks.
WORKER_BYTES = 32 << 20


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of a whole text, special strings included."""
    v = _tokenizer.vocabulary(path)
    if len(text) <= _tokenizer.SEGMENT_CHARS or v.plain_parts(text)[1]:  # a special string may hold white space
        return _encode(text, path)
    return np.concatenate([_encode(s, path) for s in _tokenizer.segments(text)])


def _encode(text: str, path: str) -> np.ndarray:
    try:
        return _tokenizer.encoder(path).encode_to_numpy(text, allowed_special="all").astype(np.uint32)
    except ValueError:
        return _encode_by_pieces(text, path)


def _encode_by_pieces(text: str, path: str) -> np.ndarray:
    """For texts with runs (of one letter, of white space) that are too long for the library's pattern."""
    v = _tokenizer.vocabulary(path)
    pattern = token_count.counter(path).pattern
    out: list[int] = []
    for part in v.parts(text):
        if part in v.special:
            out.append(v.special[part])
        else:
            for m in pattern.finditer(part):
                out += [i for i in token_count.merge(m[0].encode(), v)[1] if i >= 0]
    return np.array(out, np.uint32)


def cut_lengths(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    k = 2
    while k <= smallest:
        if n >= capacity // k:
            out.append(capacity // k)
            n -= capacity // k
        k *= 2
    return [*out, n] if n else out


class Packer:
    """One worker's bins. Finished sequences leave through ``rows``."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.sequence = capacity, worker << 32
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        for length in cut_lengths(len(ids), self.capacity):
            k = self.capacity // length
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, start, ids[start:start + length].astype("<u4").tobytes(), len(ids)))
            if len(bin_) == k:
                self._close(self.open.pop(k))
            start += length

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, n, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def finish(self) -> None:
        """Lay the open bins' pieces end to end, cut at the capacity."""
        pieces, room = [], self.capacity
        for k in sorted(self.open):
            for doc_id, start, ids, n in self.open[k]:
                while ids:
                    own = ids[:4 * room]
                    pieces.append((doc_id, start, own, n))
                    room -= len(own) // 4
                    start, ids = start + len(own) // 4, ids[len(own):]
                    if not room:
                        self._close(pieces)
                        pieces, room = [], self.capacity
        if pieces:
            self._close(pieces)
        self.open = {}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
         end_id: int = 1, capacity: int = CAPACITY, as_array: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ``ids`` (unsigned little-endian 32-bit, or an array of int), doc_tokens, sequence_id, offset.

    The table is counted first; give a stored table, not a plan that is dear to run twice.
    """
    path = tokenizer_path or _tokenizer.default_path()
    schema = T.StructType([docs.schema[id_col]] + [T.StructField(c, t) for c, t in (
        ("start", T.LongType()), ("length", T.LongType()), ("ids", T.ArrayType(T.IntegerType()) if as_array else T.BinaryType()), ("doc_tokens", T.LongType()),
        ("sequence_id", T.LongType()), ("offset", T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), capacity)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) if packer.rows else [()] * 7
            packer.rows = []
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            if as_array:
                ends = np.append(0, np.cumsum(arrays[2].to_numpy()))
                arrays[3] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(columns[3]), "<i4")))
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        id_type = pa.int64()
        for part in _text.slices(batches, text_col):
            id_type = part.column(id_col).type
            for doc_id, text in zip(part.column(id_col).to_pylist(), part.column(text_col), strict=True):
                packer.add(doc_id, np.append(token_ids(text.as_py() or "", path), np.uint32(end_id)))
            yield flush()
        packer.finish()
        yield flush()

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(f"`{text_col}`"))).alias("bytes")).first()
    return rows.coalesce(max(total["n"] // WORKER_ROWS, math.ceil((total["bytes"] or 0) / WORKER_BYTES), 1)).mapInArrow(run, schema)
