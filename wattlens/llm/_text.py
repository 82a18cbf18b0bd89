"""Vectorised text helpers for Arrow batches inside tasks.

A batch of texts is one UTF-8 buffer plus row offsets, as Arrow stores it. Words, lines and their
hashes are numpy arrays over that buffer, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BYTE_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept up to a few slices of length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def free_name(name: str, taken: Iterable[str]) -> str:
    """A column name that is none of those taken."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (all bits depend on all bits)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each row starts (one entry more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0]:offs[-1]], offs - offs[0]


def slices(batches: Iterable[pa.RecordBatch | pa.Table], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Cut batches into runs of rows whose texts hold at most ``limit`` bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        total = np.cumsum(size.to_numpy(zero_copy_only=False) if isinstance(size, pa.Array) else size.to_numpy())
        first = 0
        while first < batch.num_rows:
            before = total[first - 1] if first else 0
            last = max(int(np.searchsorted(total, before + limit, "right")), first + 1)
            yield batch.slice(first, last - first)
            first = last


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of marked bytes; runs end at row borders."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = True
    start = np.flatnonzero(inside & before)
    return start, np.flatnonzero(inside & after) + 1, rows_of(offs, start)


def rows_of(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, at, "right") - 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~SPACE[buf], offs)


def byte_prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[buf] * _power_table(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes have equal hashes wherever they stand."""
    shift = _power_table(_BASE_INVERSE, len(prefix))[start]
    return mix((prefix[end] - prefix[start]) * shift + (end - start).astype(np.uint64))


#: Spans over this length are hashed by XXH64: a polynomial modulo 2**64 can't tell some long patterns apart.
LONG_SPAN = 64


def safe_hash(buf: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``span_hash`` where equal hashes shall mean equal bytes, whatever the spans hold."""
    out = span_hash(prefix, start, end)
    for i in np.flatnonzero(end - start > LONG_SPAN).tolist():
        out[i] = xxhash.xxh64_intdigest(buf[start[i]:end[i]].tobytes())
    return out


def gram_hash(values: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of every n consecutive values (one fewer than n rows shorter)."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_table(_BASE, len(values)), out=prefix[1:])
    k = len(values) - n + 1
    return mix((prefix[n:] - prefix[:k]) * _power_table(_BASE_INVERSE, k))


def joined_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each starts and ends there."""
    length = end - start
    new_end = np.cumsum(length + 1) - 1
    new_start = new_end - length
    out = np.full(int(new_end[-1]) + 1 if len(length) else 0, 0x20, buf.dtype)
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    hole = np.zeros(len(out), bool)
    hole[new_end] = True
    out[~hole] = buf[inside]
    return out, new_start, new_end


def count_per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    if weights is None:
        return np.bincount(rows, minlength=n).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
    edge = np.searchsorted(rows, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def sum_between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Marked entries in each span."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]
