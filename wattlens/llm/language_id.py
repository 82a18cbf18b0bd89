"""Language identification of whole texts, with spans for mixed-language text.

A word is a run of letters and their marks, with a letter at least. Its script (fixed code point ranges) narrows the candidates to the
languages that use the script in training. A word's score for a candidate is the log-likelihood of
its character grams (two to four, with word borders). Viterbi over the words, with a penalty for
each switch of language, labels every word; equal neighbours make spans. A text's language is the
one with most letters in its spans, and its score is that language's share of the letters.

The model is learned from rows with a language whose crc32(id) modulo 5 is not 0: a sample of at most
about ``PER_LANGUAGE`` texts of every language, as hashed gram counts. With more than ``FULL_LANGUAGES``
languages each has fewer buckets, so the model's size stays bounded (``BUCKETS * FULL_LANGUAGES`` numbers an order).
Predictions see the text alone. A long text is scored in runs of words, so memory beside its own words stays bounded.

Defined results: null, empty or letterless texts (also those of marks or emoji alone) get ``und``, score 0 and no spans, and so do all
texts if nothing could be learned; a language column with over ``MOST_LANGUAGES`` values is an error; ids are only carried, so null ids and repeated rows are judged
row by row; ties go to the language that sorts first; an empty table gives an empty table. Input
columns named like an added one are replaced.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _learn, _text

UND = "und"
#: Bounds of the training sample and so of the model.
PER_LANGUAGE = 2000
#: Languages that have all buckets, and values of a language column that can't be one.
FULL_LANGUAGES = 64
MOST_LANGUAGES = 1 << 14
#: Sampled ids that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 1 << 20
#: Character gram orders, and hash buckets of each.
ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
#: Log-likelihood lost by a change of language between two words.
SWITCH_PENALTY = 6.0
#: Overlapping grams of several orders say the same thing again.
GRAM_WEIGHT = 1 / 3
#: A language uses a script if so large a share of its training words is in it.
SCRIPT_SHARE = 0.002
_SMOOTHING = 0.5
_EXCLUDED = -1e4
#: A longer text is scored in runs of about so many bytes.
RUN_BYTES = 1 << 17

#: First code point of ranges and their script.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x2100, "Latin"), (0x2C00, "Other"), (0x2C60, "Latin"),
    (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Han"), (0x3040, "Kana"), (0x3100, "Other"),
    (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
)
_SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_RANGE_START = np.array([a for a, _ in SCRIPTS])
_RANGE_SCRIPT = np.array([_SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: is it a letter, is it a letter or a mark of one, and its lower-case form."""
    letter, part, lower = np.zeros(0x110000, bool), np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        letter[c], part[c] = kind == "L", kind in "LM"
        low = ch.lower()
        if len(low) == 1 and low != ch:
            lower[c] = ord(low)
    return letter, part, lower


class Words(NamedTuple):
    start: np.ndarray   #: code points of each row, counted over the batch
    end: np.ndarray
    row: np.ndarray
    script: np.ndarray
    grams: list[np.ndarray]   #: one bucket per position of ``slots`` and order, or -1
    slots: np.ndarray   #: first position of each word
    offsets: np.ndarray  #: code points before each row


def words_of(buf: np.ndarray, offs: np.ndarray) -> Words:
    """The words of a batch of texts, with their scripts and gram buckets."""
    letter, part, lower = _tables()
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")
    before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=before[1:])
    offsets = before[offs]
    start, end, row = _text.runs(part[points], offsets)
    own = _text.sum_between(letter[points], start, end) > 0  # marks alone are no word
    start, end, row = start[own], end[own], row[own]
    text, slots, _ = _text.joined_words(lower[points], start, end)
    length = end - start + 1
    place = np.arange(len(text)) - np.repeat(slots, length)
    c = np.concatenate([np.full(max(ORDERS), 0x20, np.uint64), text.astype(np.uint64)])
    n, grams = len(text), []
    for order in ORDERS:
        h = np.full(n, order, np.uint64)
        for k in range(order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[max(ORDERS) - k:max(ORDERS) - k + n]
        bucket = (_text.mix(h) % np.uint64(BUCKETS)).astype(np.int32)
        bucket[place < order - 2] = -1  # it would reach into the word before
        grams.append(bucket)
    script = _RANGE_SCRIPT[np.searchsorted(_RANGE_START, points[start], "right") - 1]
    return Words(start, end, row, script, grams, slots, offsets)


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray   #: (orders, buckets + 1, languages) log-likelihoods, buckets a power of two; the last bucket is 0
    allowed: np.ndarray  #: (scripts, languages)
    prior: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """(words, languages) scores."""
        total = np.zeros((len(words.grams[0]), len(self.languages)), np.float32)
        for table, buckets in zip(self.scores, words.grams, strict=True):
            total += table[buckets if len(table) == BUCKETS + 1 else np.where(buckets < 0, -1, buckets & (len(table) - 2))]
        out = np.add.reduceat(total, words.slots, axis=0).astype(np.float64) * GRAM_WEIGHT if len(words.slots) else np.zeros((0, len(self.languages)))
        may = self.allowed[words.script]
        out = np.where(may, out, _EXCLUDED)
        out[~may.any(axis=1)] = 0.0  # a script nobody uses tells nothing
        return out


def viterbi(scores: np.ndarray, row: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; all texts of a batch take a step at once."""
    if not len(scores):
        return np.zeros(0, np.int64)
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    count = np.diff(np.append(head, len(row)))
    order = np.argsort(-count, kind="stable")
    head, count = head[order], count[order]
    active = np.searchsorted(-count, -np.arange(count[0]), "left")  # texts with more than t words
    came = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int16)
    own = np.arange(scores.shape[1])
    state = scores[head] + prior
    for t in range(1, int(count[0])):
        k = active[t]
        s = state[:k]
        best = s.argmax(axis=1)
        switch = s[np.arange(k), best] - penalty
        stay = s >= switch[:, None]
        at = head[:k] + t
        came[at] = np.where(stay, own, best[:, None])
        state[:k] = np.where(stay, s, switch[:, None]) + scores[at]
    label = np.zeros(len(scores), np.int64)
    now = state.argmax(axis=1)
    for t in range(int(count[0]) - 1, -1, -1):
        k = active[t]
        at = head[:k] + t
        label[at] = now[:k]
        now[:k] = came[at, now[:k]] if t else now[:k]
    return label


def buckets_for(languages: int) -> int:
    """Hash buckets of each order: all of them up to ``FULL_LANGUAGES``, then half as many for each doubling."""
    return max(BUCKETS >> max(math.ceil(math.log2(max(languages, 1) / FULL_LANGUAGES)), 0), 256)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """Gram counts of the sampled texts, summed by Spark; what reaches the driver is bounded by buckets times languages."""
    rows = docs.where(~_learn.held_out(id_col))
    n_languages = rows.select(F.col(f"`{lang_col}`")).where(F.col(f"`{id_col}`").isNotNull()).na.drop().distinct().count()
    if n_languages > MOST_LANGUAGES:
        raise ValueError(f"{lang_col!r} has {n_languages} values: it names no languages")
    buckets = buckets_for(n_languages)
    keys = _learn.sample_keys(rows, id_col, lang_col, per_language, "language").distinct()
    sample = (rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("class"), F.col(f"`{text_col}`").alias("text"))
              .join(F.broadcast(keys) if n_languages * per_language <= MOST_BROADCAST else keys, ["id", "class"], "left_semi"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text"):
            names, which = np.unique(np.array(part.column("class").to_pylist(), object).astype(str), return_inverse=True)
            words = words_of(*_text.utf8(part.column("text")))
            of = which[words.row]
            per_slot = np.repeat(of, np.diff(np.append(words.slots, len(words.grams[0]))))
            kinds, keys_, langs, sums = [], [], [], []
            for kind, own, key, top in [(o, per_slot, g, buckets) for o, g in zip(ORDERS, words.grams, strict=True)] + [(0, of, words.script, len(_SCRIPT_NAMES))]:
                keep = key >= 0
                key = key[keep] & (buckets - 1) if kind else key[keep]
                pair, n = np.unique(own[keep].astype(np.int64) * top + key, return_counts=True)
                kinds.append(np.full(len(pair), kind))
                keys_.append(pair % top)
                langs.append(pair // top)
                sums.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(names[np.concatenate(langs)].tolist(), pa.string()), pa.array(np.concatenate(kinds), pa.int32()),
                                              pa.array(np.concatenate(keys_), pa.int32()), pa.array(np.concatenate(sums), pa.int64())], names=["lang", "kind", "key", "n"])

    counts = (sample.select("class", "text").mapInArrow(count, "lang string, kind int, key int, n long")
              .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(counts["lang"].unique())
    which = counts["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(np.int64)
    kind, key, n = (counts[c].to_numpy(np.int64) for c in ("kind", "key", "n"))
    scores = np.zeros((len(ORDERS), buckets + 1, len(languages)), np.float32)
    for i, order in enumerate(ORDERS):
        table = np.full((buckets, len(languages)), _SMOOTHING)
        own = kind == order
        np.add.at(table, (key[own], which[own]), n[own])
        scores[i, :-1] = np.log(table / table.sum(axis=0))
    share = np.zeros((len(_SCRIPT_NAMES), len(languages)))
    own = kind == 0
    np.add.at(share, (key[own], which[own]), n[own])
    words = share.sum(axis=0)
    allowed = share >= np.maximum(SCRIPT_SHARE * words, 1)
    return Model(languages, scores, allowed, np.zeros(len(languages)))


#: What ``identify`` adds.
ADDED = T.StructType([
    T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), False)])


def _scored(model: Model, buf: np.ndarray, offs: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of a batch and their scores. One long text is taken in runs that end at spaces; its words keep no grams."""
    if len(offs) != 2 or len(buf) <= 2 * RUN_BYTES:
        words = words_of(buf, offs)
        return words, model.emissions(words) if model.languages else np.zeros((len(words.row), 0))
    spaces = np.flatnonzero(buf == 0x20)
    after = spaces[np.minimum(np.searchsorted(spaces, np.arange(RUN_BYTES, len(buf), RUN_BYTES)), len(spaces) - 1)] if len(spaces) else []
    cuts = np.unique(np.concatenate([[0], after, [len(buf)]]).astype(np.int64))
    parts, scores, before = [], [], 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w = words_of(buf[a:b], np.array([0, b - a]))
        scores.append(model.emissions(w).astype(np.float32) if model.languages else np.zeros((len(w.row), 0)))
        parts.append(w._replace(start=w.start + before, end=w.end + before, grams=[], slots=w.slots[:0]))
        before += w.offsets[-1]
    cat = {c: np.concatenate([getattr(w, c) for w in parts]) for c in ("start", "end", "row", "script")}
    whole, at = np.empty((len(cat["row"]), scores[0].shape[1]), np.float32), 0
    for i, piece in enumerate(scores):
        whole[at:at + len(piece)] = piece
        at, scores[i] = at + len(piece), None  # freed on the way
    return Words(**cat, grams=[], slots=parts[0].slots, offsets=np.array([0, before])), whole


def _label(model: Model, buf: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
    n, size = len(offs) - 1, len(model.languages)
    words, scores = _scored(model, buf, offs)
    if not size:
        return [pa.array([UND] * n), pa.array(np.zeros(n)), pa.array([[]] * n, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]
    label = viterbi(scores, words.row, model.prior, SWITCH_PENALTY)
    del scores
    letters = np.bincount(words.row * size + label, words.end - words.start, n * size).reshape(n, size)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    score = letters[np.arange(n), best] / np.maximum(total, 1)
    names = np.array([*model.languages, UND], object)
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (words.row[1:] != words.row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(label))[:len(head)] - 1
    base = words.offsets[words.row[head]]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(words.row[head], np.arange(n + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(names[label[head]].tolist(), pa.string()), pa.array(words.start[head] - base), pa.array(words.end[tail] - base)], ["lang", "start", "end"]))
    return [pa.array(names[np.where(total > 0, best, size)].tolist(), pa.string()), pa.array(score), spans]


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's columns but the text, and lang_pred, score and spans (code point offsets)."""
    carried = [c for c in docs.columns if c not in (text_col, *ADDED.names)]
    schema = T.StructType([docs.schema[c] for c in carried] + ADDED.fields)
    limit = max(_text.SLICE_BYTES * 4 // max(len(model.languages), 4), 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, text_col, limit):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *_label(model, *_text.utf8(part.column(text_col)))], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in [*carried, text_col])).mapInArrow(run, schema)
