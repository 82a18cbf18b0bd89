"""Substring dedup: words that an earlier document has too, in windows of 50 words.

Super-k-mer partitioning. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Consecutive windows sharing a
minimiser (the smallest hash among a window's 8-word grams) travel as one packed string to the
minimiser's bucket, where the windows are sorted and counted word by word (see ``_repeats`` for the
exchanges and for what keeps hot passages small).

Each word covered by a window that also starts in a document with a smaller id goes; windows are
judged on the input. Defined results: a null text has no words; rows with a null id are kept whole
and remove nothing; rows with one id do not remove each other; an empty table gives an empty table.
Input columns named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _repeats, _text
from ._repeats import WINDOW

#: Words in a minimiser gram.
GRAM = 8


class Words(_repeats.Repeats):
    added = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("spans", _repeats.SPANS), ("kept", T.BinaryType())]

    def supermers(self, buf, offs):
        start, end, row = _text.words(buf, offs)
        grams = _text.gram_hash(_text.span_hash(_text.byte_prefix(buf), start, end), GRAM)
        text, start, end = _text.joined_words(buf, start, end)
        n = max(len(row) - WINDOW + 1, 0)
        anchor, first, count = _repeats.minimiser_runs(grams, row[:n] == row[len(row) - n:], WINDOW - GRAM + 1)
        return _repeats.Supermers(text, row[first], anchor, start[first], end[first + count + WINDOW - 2], first, count,
                                  lambda unit: (start[unit], end[unit + WINDOW - 1]))

    def classes(self, data, lengths):
        edge = np.append(0, np.cumsum(lengths))
        # strings lie end to end without a space between them
        out, names, counts = [], {}, []
        for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            own = data[a:b].split(b" ")
            out += [names.setdefault(w, len(names)) for w in own]
            counts.append(len(own))
        word, n = np.array(out, np.uint64), np.array(counts, np.int64)
        windows = n - WINDOW + 1
        at = np.repeat(np.cumsum(n) - n, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        pair = (word[:-1] << np.uint64(32)) | word[1:]
        return windows, _repeats.refine(lambda k, x: pair[at[x] + 2 * k], len(at), WINDOW // 2)

    def cut(self, buf, offs, first):
        start, end, row = _text.words(buf, offs)
        n = len(offs) - 1
        mark = np.zeros(len(row) + 1, np.int64)
        np.add.at(mark, first, 1)
        np.add.at(mark, first + WINDOW, -1)
        gone = np.cumsum(mark[:-1]) > 0
        edge = np.searchsorted(row, np.arange(n + 1))
        a, b, where = _text.runs(gone, edge)
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(where, np.arange(n + 1)), pa.int32()),
                                         pa.StructArray.from_arrays([pa.array(a - edge[where]), pa.array(b - edge[where])], ["start", "end"]))
        text, new_start, _ = _text.joined_words(buf, start[~gone], end[~gone])
        left = row[~gone]
        # without the space after each row's last word
        last = np.flatnonzero(np.append(left[1:] != left[:-1], True)) if len(left) else left
        drop = np.zeros(len(text), bool)
        drop[np.append(new_start[1:], len(text))[last] - 1] = True
        size = _text.count_per_row(left, n, np.diff(np.append(new_start, len(text)))) if len(left) else np.zeros(n, np.int64)
        size[left[last]] -= 1
        kept = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(text[~drop])])
        return [pa.array(np.diff(edge), pa.int64()), pa.array(_text.count_per_row(row, n, gone), pa.int64()), spans, kept.cast(pa.binary())]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = _repeats.PART_BYTES) -> DataFrame:
    """Replace the text by ``n_words``, ``n_removed``, ``spans`` (runs of removed words) and ``kept`` (UTF-8, kept words joined by one space)."""
    return _repeats.run(docs, Words, id_col, text_col, part_bytes)
