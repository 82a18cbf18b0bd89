"""Compression classifier for document quality.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is
compressed block by block with each; the difference of the compressed sizes, divided by the text's
size, tells which dictionary knows it better. Isotonic regression on labelled texts that trained
neither dictionary turns the difference into the probability of label 1.

Learning uses rows whose crc32(id) modulo 5 is not 0: at most about ``PER_LABEL`` texts a label,
chosen by a hash of the id, and at most ``BLOCKS`` blocks, spread evenly over it, of each text that
goes into a dictionary. These bounds hold for the model only; scoring compresses whole texts, and
calibration does, too. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have difference 0; of several labels of one id the smallest
counts; null ids are scored but not learned from; repeated rows and ties are judged row by row;
without labels of both kinds every score is the share of label 1 (0.5 without any); an empty table
gives an empty table. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _learn, _text

#: Bounds of the training sample.
PER_LABEL = 3000
BLOCKS = 16
#: Bytes compressed at once: short enough that a block can't do without the dictionary.
BLOCK_BYTES = 256
DICTIONARY_BYTES = 110 << 10
LEVEL = 3
#: Texts that share a calibration step at least.
MIN_STEP = 10


class Model(NamedTuple):
    good: bytes
    bad: bytes
    at: np.ndarray      #: differences, ascending, and
    value: np.ndarray   #: the probability of label 1 there

    def calibrate(self, difference: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(difference, self.at, self.value), 0.0, 1.0)


@functools.lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False)


def difference(buf: np.ndarray, offs: np.ndarray, good: bytes, bad: bytes) -> np.ndarray:
    """(compressed with ``bad`` - compressed with ``good``) / bytes, of every whole text."""
    data = memoryview(np.ascontiguousarray(buf))
    by_good, by_bad = _compressor(good).compress, _compressor(bad).compress
    out = np.zeros(len(offs) - 1)
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        gain = 0
        for x in range(a, b, BLOCK_BYTES):
            block = data[x:min(x + BLOCK_BYTES, b)]
            gain += len(by_bad(block)) - len(by_good(block))
        out[i] = gain / max(b - a, 1)
    return out


def train_dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary, or the plain text of too few blocks to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:] or b"        "


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending x and non-decreasing means of y, in steps of ``MIN_STEP`` texts at least."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    pools: list[list[float]] = []   # sum of y, sum of x, n, largest x
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        if pools and (pools[-1][2] < MIN_STEP or pools[-1][3] == a):
            p = pools[-1]
            p[0], p[1], p[2], p[3] = p[0] + b, p[1] + a, p[2] + 1, a
        else:
            pools.append([b, a, 1, a])
    out: list[list[float]] = []
    for p in pools:
        out.append(p)
        while len(out) > 1 and out[-2][0] * out[-1][2] >= out[-1][0] * out[-2][2]:
            last = out.pop()
            out[-1] = [out[-1][0] + last[0], out[-1][1] + last[1], out[-1][2] + last[2], last[3]]
    return np.array([p[1] / p[2] for p in out]), np.array([p[0] / p[2] for p in out])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          per_label: int = PER_LABEL) -> Model:
    """Two passes over the sampled texts: blocks for the dictionaries, then differences for the calibration."""
    known = (labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull() & ~_learn.held_out(id_col))
             .groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.min(F.col(f"`{label_col}`").cast("int")).alias("label")))
    # not every label need have a text
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    keys = _learn.sample_keys(known.join(rows.select("id"), "id", "left_semi"), "id", "label", per_label, "quality")
    # the sample's bound counts ids: of a repeated one, one text counts
    one = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"), "text"))
    sample = (rows.join(F.broadcast(keys), "id").groupBy("id", "class").agg(one.alias("one")).select("id", "class", "one.text")
              .withColumn("half", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text"):
            buf, offs = _text.utf8(part.column("text"))
            data, found = buf.tobytes(), []
            for i, (label, a, b) in enumerate(zip(part.column("class").to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                starts = range(a, b, BLOCK_BYTES)
                for x in [starts[k] for k in sorted({k * len(starts) // BLOCKS for k in range(BLOCKS)})] if starts else []:
                    found.append((part.column("id")[i].as_py(), x - a, label, data[x:min(x + BLOCK_BYTES, b)]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                             names=["id", "at", "label", "block"])

    blocks = sorted(map(tuple, sample.where("half = 0").mapInArrow(cut, "id long, at long, label int, block binary").collect()))
    good, bad = (train_dictionary([bytes(b) for _, _, label, b in blocks if label == want]) for want in (1, 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(difference(*_text.utf8(part.column("text")), good, bad)), part.column("class")],
                                             names=["id", "x", "label"])

    found = sorted(map(tuple, sample.where("half = 1").select("id", "text", "class").mapInArrow(measure, "id long, x double, label int").collect()))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = shares.get(1, 0) / max(sum(shares.values()), 1) if shares else 0.5
    kinds = {label for _, _, label in found}
    if len(kinds) < 2 or not all(any(b[2] == k for b in blocks) for k in (0, 1)):
        return Model(good, bad, np.array([0.0]), np.array([share]))
    x, y = np.array([f[1] for f in found]), np.array([f[2] for f in found], float)
    # the sample takes labels in other shares than the corpus has: weigh them back
    at, value = isotonic(x, y)
    odds = (share / (1 - share)) / (y.mean() / (1 - y.mean())) if 0 < share < 1 else 1.0
    return Model(good, bad, at, value * odds / (value * odds + 1 - value))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's columns but the text, ``score`` and the raw ``difference``."""
    carried = [c for c in docs.columns if c not in (text_col, "score", "difference")]
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField(c, T.DoubleType(), False) for c in ("score", "difference")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, text_col):
            d = difference(*_text.utf8(part.column(text_col)), model.good, model.bad)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(model.calibrate(d)), pa.array(d)], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in [*carried, text_col])).mapInArrow(run, schema)
