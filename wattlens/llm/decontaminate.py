"""Benchmark decontamination: training passages that hold a benchmark item.

The items (in sections of at most ``SECTION + SECTION_TAIL`` words) are a BM25 inverted index whose impacts are
divided by the section's own score, so 1 is a section found whole and one threshold suits all.
Every training passage (``PASSAGE`` words, every ``STRIDE``; an item's section always lies whole in one)
is a query. Block-max WAND returns all sections at or above ``THRESHOLD``: cursors move by the
highest impact of a term and of a block of its postings. A first vectorised round over all passages
of a batch drops those that can't reach the threshold: terms are split in two, such that the frequent
ones together never give a section more than half the threshold, and only sections that the others
bring near enough stay. No passage is dropped that has a section above the threshold.

An item found that way counts as a leak if its question and its answer both overlap the document:
each has at least ``OVERLAP`` of its 5-word shingles there. A text after the item's last question
mark is its answer, otherwise the last quarter of its words.

Words are runs of ASCII letters, digits and non-ASCII characters, in lower case, compared by 64-bit
hashes. The index is built from shards of at most about ``SHARD_BYTES`` of items, one after the other,
so its size is bounded whatever the benchmark's.

Defined results: null and empty texts and items of no or one word have no hits (one word is no question with its
answer). An item of two or three words is found where its one or two question words, side by side, and its answer word
stand in one passage, not necessarily together. Items with equal texts
are each reported; rows with null ids and repeated rows are searched row by row; an empty table on
either side gives no hits. An input column named ``hits`` is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlens.session import cut_lineage

from . import _text

SHINGLE = 5
OVERLAP = 0.8
THRESHOLD = 0.5
SECTION = 64
#: Shorter rests of an item stay with the section before.
SECTION_TAIL = 16
STRIDE = SECTION + SECTION_TAIL
PASSAGE = 2 * STRIDE
#: Postings in a block.
BLOCK = 64
SHARD_BYTES = 16 << 20
#: Postings that the first round holds at once.
ROUND_ENTRIES = 1 << 21
K1, B = 1.2, 0.75
_EPS = 1e-9

_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_WORD[0x80:] = True

HITS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())]))
_ARROW_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))


def word_hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every word, and the byte (in lower case) at which it starts in its row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buf, offs = _text.utf8(pc.utf8_lower(column.cast(pa.large_string())))
    start, end, row = _text.runs(_WORD[buf], offs)
    return _text.safe_hash(buf, _text.byte_prefix(buf), start, end), row, start - offs[row]


class Part(NamedTuple):
    """The shingles of a question or an answer."""

    size: int
    shingles: np.ndarray

    def overlap(self, words: np.ndarray) -> float:
        if not len(self.shingles):
            return 0.0  # an item of one word has no question, so no text can hold both
        return float(np.isin(self.shingles, _text.gram_hash(words, self.size)).mean())


def _part(words: np.ndarray) -> Part:
    size = max(min(SHINGLE, len(words)), 1)
    return Part(size, np.unique(_text.gram_hash(words, size)))


class Index(NamedTuple):
    terms: np.ndarray        #: hashes, ascending
    head: np.ndarray         #: first posting of each term (one more at the end)
    section: np.ndarray      #: postings: section, ascending within a term, and
    impact: np.ndarray       #: its normalised BM25 impact
    top: np.ndarray          #: highest impact of each term
    block_head: np.ndarray   #: first block of each term
    block_top: np.ndarray    #: highest impact of each block
    essential: np.ndarray    #: terms that the first round looks at
    rest: np.ndarray         #: what all other terms can give each section at most
    item: np.ndarray         #: item of each section
    ids: list
    question: list[Part]
    answer: list[Part]


def build(items: list[tuple[int, str]], df: dict[int, int] | None = None, n_sections: int | None = None, mean_length: float | None = None) -> Index:
    """The index of one shard. df, n_sections and mean_length are those of all shards (default: this one's)."""
    texts = [t or "" for _, t in items]
    hashes, row, at = word_hashes(pa.array(texts, pa.string()))
    edge = np.searchsorted(row, np.arange(len(items) + 1))
    question, answer, bounds, item = [], [], [], []
    for i, text in enumerate(texts):
        a, b = int(edge[i]), int(edge[i + 1])
        mark = len(text[:text.rfind("?")].lower().encode()) if "?" in text else -1
        cut = a + int(np.searchsorted(at[a:b], mark, "right")) if mark >= 0 else b
        if not a < cut < b:
            cut = b - math.ceil((b - a) / 4)
        question.append(_part(hashes[a:cut]))
        answer.append(_part(hashes[cut:b]))
        while a < b:
            e = b if b - a <= SECTION + SECTION_TAIL else a + SECTION
            bounds.append((a, e))
            item.append(i)
            a = e
    length = np.array([b - a for a, b in bounds], np.int64)
    word = hashes[: int(length.sum())]
    terms, which = np.unique(word, return_inverse=True)
    section = np.repeat(np.arange(len(bounds)), length)
    pair, tf = np.unique(which * max(len(bounds), 1) + section, return_counts=True)
    term, section = pair // max(len(bounds), 1), pair % max(len(bounds), 1)
    head = np.searchsorted(term, np.arange(len(terms) + 1))
    n = n_sections if n_sections is not None else len(bounds)
    own_df = np.array([df[int(t)] for t in terms.view(np.int64)], float) if df is not None else np.diff(head).astype(float)
    idf = np.log1p((n - own_df + 0.5) / (own_df + 0.5))
    mean = mean_length if mean_length is not None else (length.mean() if len(length) else 1.0)
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[section] / mean))
    impact /= np.bincount(section, impact, len(bounds))[section]
    top = np.maximum.reduceat(impact, head[:-1]) if len(terms) else np.zeros(0)
    blocks = -(-np.diff(head) // BLOCK)
    block_head = np.append(0, np.cumsum(blocks))
    starts = np.repeat(head[:-1], blocks) + BLOCK * (np.arange(block_head[-1]) - np.repeat(block_head[:-1], blocks))
    block_top = np.maximum.reduceat(impact, starts) if len(starts) else np.zeros(0)
    essential, rest = np.ones(len(terms), bool), np.zeros(len(bounds))
    for t in np.argsort(-np.diff(head), kind="stable").tolist():  # frequent terms first
        a, b = head[t], head[t + 1]
        if (rest[section[a:b]] + impact[a:b] > THRESHOLD / 2).any():
            break
        essential[t] = False
        rest[section[a:b]] += impact[a:b]
    return Index(terms, head, section, impact, top, block_head, block_top, essential, rest, np.array(item, np.int64), [i for i, _ in items], question, answer)


def retrieve(index: Index, terms: list[int], threshold: float = THRESHOLD) -> dict[int, float]:
    """Block-max WAND: every section whose terms among ``terms`` (distinct) reach the threshold, with its score."""
    threshold -= _EPS
    found: dict[int, float] = {}
    # a cursor: current section, position, end, term
    cursors = [[int(index.section[index.head[t]]), int(index.head[t]), int(index.head[t + 1]), t] for t in terms]
    tops = index.top

    def seek(c: list[int], target: int) -> None:
        if c[0] < target:
            c[1] += int(index.section[c[1]:c[2]].searchsorted(target))
            c[0] = int(index.section[c[1]]) if c[1] < c[2] else -1

    while True:
        cursors = [c for c in cursors if c[0] >= 0]
        cursors.sort()
        bound, pivot = 0.0, -1
        for j, c in enumerate(cursors):
            bound += tops[c[3]]
            if bound >= threshold:
                pivot = j
                break
        if pivot < 0:
            return found
        at = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
            pivot += 1
        bound, beyond = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 62
        for c in cursors[:pivot + 1]:
            p = c[1] if c[0] == at else c[1] + int(index.section[c[1]:c[2]].searchsorted(at))
            if p < c[2]:
                first = int(index.head[c[3]])
                k = (p - first) // BLOCK
                bound += index.block_top[index.block_head[c[3]] + k]
                beyond = min(beyond, int(index.section[min(first + (k + 1) * BLOCK, c[2]) - 1]) + 1)
        if bound < threshold:
            for c in cursors[:pivot + 1]:
                seek(c, beyond)
        elif cursors[0][0] == at:
            own = cursors[:pivot + 1]
            score = sum(float(index.impact[c[1]]) for c in own)
            if score >= threshold:
                found[at] = score
            for c in own:
                seek(c, at + 1)
        else:
            for c in cursors[:pivot + 1]:
                seek(c, at)


def _passages(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of every passage."""
    edge = np.searchsorted(row, np.arange(n + 1))
    size = np.diff(edge)
    count = np.where(size > 0, np.maximum(-(-(size - STRIDE) // STRIDE), 1), 0)
    of = np.repeat(np.arange(n), count)
    first = edge[of] + STRIDE * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    return of, first, np.minimum(first + PASSAGE, edge[of + 1])


def _first_round(index: Index, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Passages (ascending, with an essential term each) of which a section may reach the threshold.

    Postings are expanded for a run of passages at a time, ``ROUND_ENTRIES`` of them (or one passage's), however long the lists.
    """
    size = index.head[term + 1] - index.head[term]
    total, alive, a = np.cumsum(size), [np.zeros(0, np.int64)], 0
    while a < len(passage):
        b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + ROUND_ENTRIES, "right")), a + 1)
        b = int(np.searchsorted(passage, passage[b - 1], "right"))  # whole passages
        own, n = index.head[term[a:b]], size[a:b]
        p = np.repeat(own - np.cumsum(n) + n, n) + np.arange(n.sum())
        key, where = np.unique(np.repeat(passage[a:b], n) * len(index.item) + index.section[p], return_inverse=True)
        part = np.bincount(where, index.impact[p], len(key))
        alive.append(np.unique((key // len(index.item))[part + index.rest[key % len(index.item)] >= THRESHOLD - _EPS]))
        a = b
    return np.concatenate(alive)


def search(index: Index, column: pa.Array | pa.ChunkedArray) -> list[list[dict]]:
    """The verified hits of every text of a batch."""
    n = len(column)
    out: list[list[dict]] = [[] for _ in range(n)]
    if not len(index.terms) or not n:
        return out
    words, row, _ = word_hashes(column)
    of, first, end = _passages(row, n)
    if not len(of):
        return out
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    term = np.where(index.terms[at] == words, at, -1)
    # first round: what the essential terms give each section, over all passages that a word is in
    w = np.flatnonzero((term >= 0) & index.essential[term])
    last = np.searchsorted(first, w, "right") - 1
    pairs = [last * len(index.terms) + term[w]]
    earlier = (last > 0) & (end[last - 1] > w)
    pairs.append((last[earlier] - 1) * len(index.terms) + term[w[earlier]])
    pair = np.unique(np.concatenate(pairs))
    alive = _first_round(index, pair // len(index.terms), pair % len(index.terms))
    # second round: block-max WAND over all terms of the passages left
    found: dict[tuple[int, int], float] = {}
    for x in alive.tolist():
        own = np.unique(term[first[x]:end[x]])
        for section, score in retrieve(index, own[own >= 0].tolist()).items():
            pair_ = int(of[x]), int(index.item[section])
            found[pair_] = max(score, found.get(pair_, 0.0))
    edge = np.searchsorted(row, np.arange(n + 1))
    for (r, i), score in sorted(found.items()):
        doc = words[edge[r]:edge[r + 1]]
        q, a = index.question[i].overlap(doc), index.answer[i].overlap(doc)
        if q >= OVERLAP and a >= OVERLAP:
            out[r].append({"item_id": index.ids[i], "score": score, "question_overlap": q, "answer_overlap": a})
    return out


def _shards(items: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> Iterator[Index]:
    """An index per shard, with the document frequencies of all shards."""
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(math.ceil(size / shard_bytes), 1)
    if n == 1:
        yield build(sorted(((r["id"], r["text"]) for r in rows.collect()), key=str))
        return

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text"):
            found = build(list(zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True)))
            count = np.diff(found.head)
            yield pa.RecordBatch.from_arrays([pa.array(found.terms.view(np.int64)), pa.array(count.astype(np.int64))], names=["term", "df"])

    df = cut_lineage(rows.mapInArrow(terms, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text"):
            words = len(word_hashes(part.column("text"))[0])
            sections = len(build(list(zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True))).item)
            yield pa.RecordBatch.from_arrays([pa.array([words]), pa.array([sections])], names=["words", "sections"])

    total = rows.mapInArrow(sizes, "words long, sections long").agg(F.sum("words").alias("w"), F.sum("sections").alias("s")).first()
    shard = rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    for k in range(n):
        own = shard.where(F.col("shard") == k).drop("shard")
        needed = own.mapInArrow(terms, "term long, df long").select("term").distinct()
        counts = {r["term"]: r["df"] for r in df.join(needed, "term", "left_semi").collect()}
        yield build(sorted(((r["id"], r["text"]) for r in own.collect()), key=str), counts, total["s"], total["w"] / max(total["s"], 1))


def annotate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
             shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The input's columns and ``hits``: the benchmark items that each text holds."""
    carried = [c for c in docs.columns if c != "hits"]
    rows = docs.select(*(F.col(f"`{c}`") for c in carried))
    schema = T.StructType([*rows.schema.fields, T.StructField("hits", HITS)])
    rows = rows.withColumn("hits", F.lit(None).cast(HITS))
    for k, index in enumerate(_shards(items, item_id_col, item_text_col, shard_bytes)):
        if k:  # one index in memory at a time
            rows = cut_lineage(rows)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for part in _text.slices(batches, text_col):
                hits = [(old or []) + new for old, new in zip(part.column("hits").to_pylist(), search(index, part.column(text_col)), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(hits, _ARROW_HITS)], names=schema.names)

        rows = rows.mapInArrow(run, schema)
    return rows


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without a hit."""
    return annotate(docs, items, text_col, item_id_col, item_text_col).where(F.size("hits") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
