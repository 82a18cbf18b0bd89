"""Suffix-array dedup: bytes that an earlier document has too, in strings of 50 bytes.

Texts are UTF-8 bytes; matches never cross documents. Each byte covered by a 50-byte string that also
starts in a document with a smaller id goes; overlaps count and strings are judged on the input.

The suffixes are sorted blockwise with a difference cover. ``_repeats`` first sets aside every suffix
whose 50-byte prefix no other document can have (its minimiser stands in one document only) and
deals the rest into blocks such that equal prefixes meet. In a block (``suffix_order``):

* the cover sample is ranked first: suffixes whose position modulo 31 is in a perfect difference set,
  so any two positions reach sampled positions by one common shift below 31;
* one suffix bucket at a time (suffixes with the same leading bytes) is sorted by 32 bytes, and ties
  longer than that are resolved by the precomputed sample ranks, never by reading on;
* neighbours in suffix order that agree on 50 bytes form a class, and the class's smallest document
  id decides which occurrences go.

Defined results: a null text is empty; rows with a null id are kept whole and remove nothing; rows
with one id do not remove each other; an empty table gives an empty table. Input columns named
like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _repeats, _text
from ._repeats import WINDOW

#: Bytes in a minimiser gram.
GRAM = 20
#: Bytes compared before sample ranks decide; at least the cover's period.
DIRECT_WORDS = 4
#: Suffixes in one bucket (more only where they share their first two bytes).
BUCKET = 1 << 18

#: A perfect difference set modulo 31.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)

_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True
#: Smallest shift that takes positions with these two remainders into the cover.
SHIFT = np.array([[next(s for s in range(PERIOD) if _IN_COVER[(a + s) % PERIOD] and _IN_COVER[(b + s) % PERIOD])
                   for b in range(PERIOD)] for a in range(PERIOD)])


class _Block:
    """Strings laid end to end; a suffix reaches to its string's end."""

    def __init__(self, data: bytes, lengths: np.ndarray):
        self.n = len(data)
        padded = data + bytes(16)
        self.word = np.ndarray((self.n + 8,), ">u8", padded, strides=(1,))
        self.end = np.repeat(np.cumsum(lengths), lengths)

    def key(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The eight bytes at each position, zero from ``end`` on."""
        left = np.clip(end - at, 0, 8)
        w = self.word[np.minimum(at, self.n)].astype(np.uint64)
        shift = ((8 - left) * 8).astype(np.uint64)
        return np.where(left == 0, np.uint64(0), w >> np.minimum(shift, np.uint64(63)) << np.minimum(shift, np.uint64(63)))

    def sample_ranks(self) -> np.ndarray:
        """Rank of every sampled suffix among them (others: 0). Equal suffixes have equal ranks."""
        at = np.flatnonzero(_IN_COVER[np.arange(self.n) % PERIOD])
        end = self.end[at]
        depth = -(-int((end - at).max(initial=0)) // 8)

        def load(k: int, x: np.ndarray) -> np.ndarray:
            return self.key(at[x] + 8 * k, end[x]) if k < depth else (end[x] - at[x]).astype(np.uint64)

        out = np.zeros(self.n, np.int64)
        out[at] = _repeats.refine(load, len(at), depth + 1)
        return out


def suffix_order(data: bytes, lengths: np.ndarray, at: np.ndarray, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the positions ``at`` (indexes into it), and for each place whether its first
    32 bytes differ from those of the place before. Suffixes must be longer than the cover's period."""
    block = _Block(data, lengths)
    sample = block.sample_ranks()
    head = block.key(at, block.end[at])
    by_head = np.argsort(head, kind="stable")
    lead = (head[by_head] >> np.uint64(48)).astype(np.int64)
    border = np.flatnonzero(np.append(True, lead[1:] != lead[:-1])) if len(at) else np.zeros(0, np.int64)
    order, new = np.empty(len(at), np.int64), np.empty(len(at), bool)
    a = 0
    while a < len(at):  # one suffix bucket at a time
        later = border[(border > a) & (border <= a + bucket)]
        b = len(at) if a + bucket >= len(at) else int(later[-1]) if len(later) else int(np.append(border[border > a], len(at))[0])
        order[a:b], new[a:b] = _sort_bucket(block, sample, at, by_head[a:b])
        a = b
    return order, new


def _sort_bucket(block: _Block, sample: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pos = at[own]
    end = block.end[pos]
    rank = _repeats.refine(lambda k, x: block.key(pos[x] + 8 * k, end[x]), len(pos), DIRECT_WORDS)
    direct = rank.copy()
    # Long ties: split each by a pivot, comparing sample ranks after the shift that suits both positions.
    size = np.bincount(rank, minlength=len(pos))
    open_ = np.flatnonzero(size[rank] > 1)
    while len(open_):
        open_ = open_[np.argsort(rank[open_], kind="stable")]
        r = rank[open_]
        head = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        n = np.diff(np.append(head, len(r)))
        p, q = pos[open_], np.repeat(pos[open_[head + n // 2]], n)
        shift = SHIFT[p % PERIOD, q % PERIOD]
        side = np.sign(sample[p + shift] - sample[q + shift])
        group = np.repeat(np.arange(len(head)), n)
        less = np.bincount(group, side < 0, len(head)).astype(np.int64)
        equal = np.bincount(group, side == 0, len(head)).astype(np.int64)
        rank[open_] = r + np.where(side < 0, 0, np.where(side == 0, less[group], (less + equal)[group]))
        open_ = open_[side != 0]
        if len(open_):
            size = np.bincount(rank[open_], minlength=len(pos))
            open_ = open_[size[rank[open_]] > 1]
    by_rank = np.argsort(rank, kind="stable")
    new = np.ones(len(pos), bool)
    new[1:] = direct[by_rank][1:] != direct[by_rank][:-1]
    return own[by_rank], new


class Bytes(_repeats.Repeats):
    added = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("spans", _repeats.SPANS), ("kept", T.BinaryType())]

    def supermers(self, buf, offs):
        n = max(len(buf) - WINDOW + 1, 0)
        valid = np.zeros(n + 1, np.int8)
        size = np.diff(offs)
        whole = size >= WINDOW
        np.add.at(valid, offs[:-1][whole], 1)
        np.add.at(valid, offs[1:][whole] - WINDOW + 1, -1)
        grams = _text.gram_hash(_text.BYTE_VALUE[buf], GRAM)
        anchor, first, count = _repeats.minimiser_runs(grams, np.cumsum(valid[:n], dtype=np.int8) > 0, WINDOW - GRAM + 1)
        return _repeats.Supermers(buf, _text.rows_of(offs, first), anchor, first, first + count + WINDOW - 1, first, count,
                                  lambda unit: (unit, unit + WINDOW))

    def classes(self, data, lengths):
        windows = lengths - WINDOW + 1
        at = np.repeat(np.cumsum(lengths) - lengths, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        order, new = suffix_order(data, lengths, at)
        word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        p = at[order]
        for shift in (32, 40, WINDOW - 8):  # the first 32 bytes are compared already
            new[1:] |= word[p[1:] + shift] != word[p[:-1] + shift]
        cls = np.empty(len(at), np.int64)
        cls[order] = np.cumsum(new)
        return windows, cls

    def _gone(self, buf, first):
        mark = np.zeros(len(buf) + 1, np.int64)
        np.add.at(mark, first, 1)
        np.add.at(mark, first + WINDOW, -1)
        return np.cumsum(mark[:-1]) > 0

    def cut(self, buf, offs, first):
        gone = self._gone(buf, first)
        n = len(offs) - 1
        a, b, row = _text.runs(gone, offs)
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()),
                                         pa.StructArray.from_arrays([pa.array(a - offs[row]), pa.array(b - offs[row])], ["start", "end"]))
        removed = _text.sum_between(gone, offs[:-1], offs[1:])
        return [pa.array(np.diff(offs), pa.int64()), pa.array(removed, pa.int64()), spans, self.left(buf, offs, gone)]

    def left(self, buf, offs, gone):
        return _column(buf, offs, ~gone, pa.large_binary()).cast(pa.binary())


class Texts(Bytes):
    """Leaves text: characters of which a byte is removed go whole."""

    added = [*Bytes.added[:-1], ("text", T.StringType())]

    def left(self, buf, offs, gone):
        character = np.cumsum((buf & 0xC0) != 0x80) - 1
        cut = np.zeros(len(buf), bool)
        cut[character[gone]] = True
        return _column(buf, offs, ~cut[character], pa.large_string()).cast(pa.string())


def _column(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray, type_: pa.DataType) -> pa.Array:
    """The kept bytes of every row."""
    size = _text.sum_between(keep, offs[:-1], offs[1:])
    return pa.Array.from_buffers(type_, len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(buf[keep])])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = _repeats.PART_BYTES, as_text: bool = False) -> DataFrame:
    """Replace the text by ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs of bytes) and ``kept`` (the remaining
    bytes). With ``as_text`` the remaining text stays in the text column instead, without characters cut in part."""
    rows = _repeats.run(docs, Texts if as_text else Bytes, id_col, text_col, part_bytes)
    return rows.withColumnRenamed("text", text_col) if as_text else rows
