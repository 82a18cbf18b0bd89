"""Jaccard join of word n-gram sets by set-relation skipping.

A text's set is its distinct shingles of consecutive words (ASCII capitals lowered); a text with fewer
words gives its whole word sequence as one. Two texts link when 100 * |intersection| is at least
``percent`` * |union|. All links are found; copies and whole clusters are never spelled out as pairs.

1. **Classes.** Texts with equal sets (128-bit digest of the sorted shingles) are one class. Shuffled
   texts are first freed of copies slice by slice, so a text of a third of all rows stays small.
2. **Census.** Every part of the texts sends its distinct shingles, 32-bit names packed by bucket, and gets
   back the magnitude of how many sets have each. That gives one global order: rare shingles first. (Two
   shingles of one name count as one everywhere, which only moves them in the order.)
3. **Index lists.** Two linked sets share a shingle in their prefixes (the first n - ceil(n * percent / 100) + 1).
   Prefix shingles that no other set has are dropped, and with them nearly all texts.
4. **Block skipping.** A list is cut into blocks of sets of one size in which its shingle stands at one position. Both
   bound the overlap of two sets, so a block that fits no block of its list is skipped whole.
5. **First answers.** Each list's set with the least position (the one with the fewest rarer shingles) is
   its head. Every other set is measured against its list's head, so the work is linear in the lists; links
   give components. A list within one component needs no more; others are cut into blocks of one component and
   size class, and pairs of blocks that don't fit are skipped as before.
6. **Derived answers.** For a pair left over, both sets' overlaps with the list's head are known. They bound
   the pair's own overlap from both sides, which mostly decides it; the rest is measured.

Steps 1 to 3 move packed columns between parts and buckets, steps 4 to 6 are joins and aggregates. A hot
list is only ever grouped or joined by Spark, never held by one task. Tables between steps are checkpointed
into the shared folder, so lost executors cost their tasks only.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; its
component is its own id. Rows with a null id take part; a component's id is its smallest non-null one (null if
there is none). Repeated rows share a component. An empty table gives an empty table. Input columns
named like an added one are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlens.session import cut_lineage

from . import _text
from ._components import components

#: Bytes of text in a part at least, and the root rule that keeps the entries between parts and buckets from getting too small.
PART_BYTES = 4 << 20
ENTRY_BYTES = 290
MIN_PARTS = 12
_NAME_BITS = np.uint64(32)
_NAME = np.uint64((1 << 32) - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
ADDED = ("n_shingles", "component_id")


def _sequence(word: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of n consecutive words from each place."""
    h = np.full(len(at), n, np.uint64)
    for j in range(n):
        h = _text.mix(h * _SPREAD + word[at + j])
    return h


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, and where each text's begin (one entry more than texts)."""
    low = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
    start, end, row = _text.words(low, offs)
    n = len(offs) - 1
    n_words = np.bincount(row, minlength=n).astype(np.int64)
    first = np.cumsum(n_words) - n_words
    word = _text.safe_hash(low, _text.byte_prefix(low), start, end)
    size = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    edge = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(edge[-1], np.uint64)
    if len(row) >= k:
        at = np.flatnonzero(row[:len(row) - k + 1] == row[k - 1:])
        out[edge[row[at]] + at - first[row[at]]] = _sequence(word, at, k)
    for m in range(1, k):
        short = np.flatnonzero(n_words == m)
        if len(short):
            out[edge[short]] = _sequence(word, first[short], m)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[edge[:-1][size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[edge]


def _name(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _keys(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Bucket and 32-bit name of each shingle in one number."""
    return ((tokens >> np.uint64(40)) % np.uint64(parts) << _NAME_BITS) | (tokens >> np.uint64(8)) & _NAME


def _planes(names: np.ndarray) -> bytes:
    """Sorted 32-bit names byte by byte, the highest bytes first: those repeat, so a shuffle's compression takes them away."""
    return np.ascontiguousarray(names.astype(">u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(">u4")[:, 0]


def _required(n: np.ndarray | int, percent: int):
    """The least overlap of a set of n shingles with a linked set."""
    return -(-n * percent // 100)


class _Job:
    def __init__(self, k: int, percent: int, parts: int):
        self.k, self.percent, self.parts = k, percent, parts

    def deal(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that differ within a slice, and their part. Where a copy goes depends on its slice, too, so copies spread."""
        task = TaskContext.get()
        salt = (task.partitionId() if task else 0) << 32
        for batch in _text.slices(batches, "text"):
            buf, offs = _text.utf8(batch.column("text"))
            data, seen, rows, part = buf.tobytes(), set(), [], []
            for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                h = xxhash.xxh3_128_intdigest(data[a:b])
                if b > a and h not in seen:
                    seen.add(h)
                    rows.append(i)
                    part.append((h + salt * 0x9E3779B97F4A7C15 >> 7) % self.parts)
            salt += 1
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column("text").take(pa.array(rows, pa.int64()))], names=["part", "text"])

    def _sets(self, table: pa.Table) -> Iterator[tuple[np.ndarray, list[tuple[bytes, int, int]]]]:
        """Slice by slice: shingles, and name and span of each set not seen before in the part."""
        seen: set[bytes] = set()
        for t in _text.slices([table], "text"):
            tokens, edge = shingle_sets(*_text.utf8(t.column("text")), self.k)
            found = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b > a and (name := _name(tokens[a:b])) not in seen:
                    seen.add(name)
                    found.append((name, a, b))
            yield tokens, found

    def census(self, table: pa.Table) -> pa.Table:
        found = []
        for tokens, sets in self._sets(table):
            own = np.zeros(len(tokens) + 1, np.int8)
            for _, a, b in sets:
                own[a] += 1
                own[b] -= 1
            mine = tokens[np.cumsum(own[:-1], dtype=np.int8).astype(bool)]
            found.append(_keys(mine, self.parts))
        key = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
        count = np.minimum(np.diff(np.append(head, len(key))), 255).astype(np.uint8)
        key = key[head]
        edge = np.searchsorted(key, np.arange(self.parts + 1, dtype=np.uint64) << _NAME_BITS)
        rows = [(b, _planes(key[i:j] & _NAME), count[i:j].tobytes()) for b, (i, j) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if j > i]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()),
                         "part": pa.array(np.full(len(rows), table.column("part")[0].as_py()), pa.int32()),
                         "names": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    @staticmethod
    def reply(table: pa.Table) -> pa.Table:
        """For each part's shingles, in the order sent: 0 if one set has it, else the magnitude of the number of sets."""
        counts = table.column("counts").to_pylist()
        size = np.array([len(x) for x in counts])
        name = np.concatenate([_from_planes(x) for x in table.column("names").to_pylist()]).astype(np.uint32)
        own = np.frombuffer(b"".join(counts), np.uint8).astype(np.int64)
        order = np.argsort(name, kind="stable")
        same = np.concatenate([[True], name[order][1:] != name[order][:-1]])
        head = np.flatnonzero(same)
        total = np.add.reduceat(own[order], head)
        grade = np.empty(len(name), np.uint8)
        grade[order] = np.log2(total).astype(np.uint8)[np.cumsum(same) - 1]
        edge = np.concatenate([[0], np.cumsum(size)])
        return pa.table({"part": table.column("part"), "bucket": table.column("bucket"),
                         "grades": pa.array([grade[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    def lists(self, table: pa.Table, news: pa.Table) -> pa.Table:
        """Sets that share a prefix shingle with another set, with those shingles and their positions."""
        mine, sets_of = [], []
        for t, sets in self._sets(table):
            mine.append(np.concatenate([t[a:b] for _, a, b in sets]) if sets else np.zeros(0, np.uint64))
            sets_of.append(sets)
        # the replies stand in the order of the distinct keys
        key = np.concatenate([_keys(t, self.parts) for t in mine]) if mine else np.zeros(0, np.uint64)
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        news = news.take(pa.compute.sort_indices(news, [("bucket", "ascending")])) if news.num_rows else news
        grades = np.empty(len(key), np.uint8)
        grades[order] = np.frombuffer(b"".join(news.column("grades").to_pylist()), np.uint8)[np.cumsum(new) - 1]
        del key, order, new
        rows: list[tuple] = []
        for tokens, sets, grade in zip(mine, sets_of, np.split(grades, np.cumsum([len(t) for t in mine])[:-1]) if mine else [], strict=True):
            size = np.array([b - a for _, a, b in sets], np.int64)
            edge = np.concatenate([[0], np.cumsum(size)])
            prefix = size - _required(size, self.percent) + 1
            alone = np.concatenate([[0], np.cumsum(grade == 0)])[edge]
            for i in np.flatnonzero(np.diff(alone) < prefix):
                a, b = edge[i], edge[i + 1]
                # equal grades keep hash order, so all sets agree on the order
                order = np.argsort(grade[a:b], kind="stable")[:prefix[i]]
                pos = np.flatnonzero(grade[a:b][order] > 0)
                rows.append((sets[i][0], int(size[i]), tokens[a:b].view(np.int64), tokens[a:b][order[pos]].view(np.int64), pos.astype(np.int32)))
        entry = pa.struct([("token", pa.int64()), ("pos", pa.int32())])
        edge = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int32)
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([r[3] for r in rows]) if rows else [], pa.int64()),
                                           pa.array(np.concatenate([r[4] for r in rows]) if rows else [], pa.int32())], fields=list(entry))
        return pa.table({"name": pa.array([r[0] for r in rows], pa.binary()), "n": pa.array([r[1] for r in rows], pa.int64()),
                         "tokens": pa.array([r[2] for r in rows], pa.list_(pa.int64())), "prefix": pa.ListArray.from_arrays(pa.array(edge), flat)})


def named_sets(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """``row`` (the input's columns but the text and the added ones), ``n`` shingles, ``name`` (null if none), ``bytes``."""
    carried = [c for c in docs.columns if c != text_col and c not in ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "text"):
            buf, offs = _text.utf8(part.column("text"))
            tokens, edge = shingle_sets(buf, offs, k)
            names = [_name(tokens[a:b]) if b > a else None for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.diff(edge), pa.int64()), pa.array(names, pa.binary()), pa.array(np.diff(offs), pa.int64())],
                                             names=["row", "n", "name", "bytes"])

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("n", T.LongType()), T.StructField("name", T.BinaryType()),
                                                T.StructField("bytes", T.LongType())]))


def _linked(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (n + m - overlap)


def _fit(n: Column, cap: Column, m: Column, m_cap: Column, percent: int) -> Column:
    """Do sizes and positions allow a link? A cap is the largest partner that a set's own position allows."""
    return (m <= cap) & (n <= m_cap) & (100 * F.least(n, m) >= percent * F.greatest(n, m))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n, m) with the exact ``overlap`` of the two sets."""
    left, right = sets.select(F.col("name").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("name").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", F.size(F.array_intersect("ta", "tb")).cast("long").alias("overlap"))


def index_lists(docs: DataFrame, text_col: str, k: int, percent: int, parts: int) -> DataFrame:
    """Distinct sets that share a prefix shingle with another: ``name, n, tokens, prefix`` (those shingles, and positions)."""
    job = _Job(k, percent, parts)
    by_part = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(lambda b: job.deal(b), "part int, text string").groupBy("part")
    census = by_part.applyInArrow(lambda t: job.census(t), "bucket int, part int, names binary, counts binary")
    replies = census.groupBy("bucket").applyInArrow(lambda t: job.reply(t), "part int, bucket int, grades binary")
    found = by_part.cogroup(replies.groupBy("part")).applyInArrow(
        lambda t, news: job.lists(t, news), "name binary, n long, tokens array<long>, prefix array<struct<token:long,pos:int>>")
    return found.dropDuplicates(["name"])


def _size_class(percent: int) -> Column:
    """Linked sets are of one class or of neighbouring ones (the base exceeds the largest ratio of their sizes)."""
    return F.floor(F.log(1.01 * max(100 / percent, 1.25), F.col("n"))).alias("size")


def _live(entries: DataFrame, percent: int) -> DataFrame:
    """Entries of a list that sizes and positions let link with another entry of it, found block by block.

    A block holds the entries of one size and position, so there are few in a list of any length.
    """
    blocks = entries.groupBy("token", "n", "cap").agg(F.count("*").alias("sets")).withColumn("size", _size_class(percent))
    larger = blocks.select("token", F.col("n").alias("m"), F.col("cap").alias("m_cap"), "size")
    # the smaller set of a pair looks into its own class and the next
    met = (blocks.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") + 1))).join(larger, ["token", "size"])
           .where((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & ((F.col("cap") != F.col("m_cap")) | (F.col("sets") > 1))))
           .where(_fit(F.col("n"), F.col("cap"), F.col("m"), F.col("m_cap"), percent)))
    live = met.select(F.explode(F.array(F.struct("token", "n", "cap"), F.struct("token", F.col("m").alias("n"), F.col("m_cap").alias("cap")))).alias("b"))
    return entries.join(live.select("b.*").distinct(), ["token", "n", "cap"], "left_semi")


def set_links(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that are linked, from ``index_lists``."""
    cap = F.floor((100 + percent) * (F.col("n") - F.col("pos")) / percent) - F.col("n")
    entries = cut_lineage(_live(sets.select("name", "n", F.inline("prefix")).select("token", "name", "n", cap.alias("cap"), "pos"), percent))
    heads = entries.groupBy("token").agg(F.min(F.struct("pos", "n", "name", "cap")).alias("h"))
    entries = cut_lineage(entries.join(heads, "token").select(
        "token", "name", "n", "cap", F.col("h.name").alias("head"), F.col("h.n").alias("head_n"), F.col("h.cap").alias("head_cap")))
    first = (entries.where((F.col("name") != F.col("head")) & _fit(F.col("n"), F.col("cap"), F.col("head_n"), F.col("head_cap"), percent))
             .select(F.col("name").alias("a"), F.col("head").alias("b"), "n", F.col("head_n").alias("m")).distinct())
    answers = cut_lineage(_measured(first, sets))
    near = answers.where(_linked(F.col("overlap"), F.col("n"), F.col("m"), percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    known = components(near)

    by_head = answers.select(F.col("a").alias("name"), F.col("b").alias("head"), "overlap")
    entries = (entries.join(known.withColumnRenamed("node", "name"), "name", "left").join(by_head, ["name", "head"], "left")
               .select("token", "name", "n", "cap", "head_n", F.coalesce("component", "name").alias("component"),
                       F.when(F.col("name") == F.col("head"), F.col("n")).otherwise(F.col("overlap")).alias("overlap"), _size_class(percent)))
    open_ = entries.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("token")
    entries = cut_lineage(entries.join(open_, "token", "left_semi"))
    blocks = entries.groupBy("token", "component", "size").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("cap").alias("cap"))
    a, b = blocks.alias("a"), blocks.alias("b")
    met = (a.join(b, "token").where(F.col("a.component") < F.col("b.component"))
           .where((F.col("b.least") <= F.col("a.cap")) & (F.col("a.least") <= F.col("b.cap")))
           .where((100 * F.col("a.most") >= percent * F.col("b.least")) & (100 * F.col("b.most") >= percent * F.col("a.least")))
           .select("token", F.col("a.component").alias("component"), F.col("a.size").alias("size"), F.col("b.component").alias("other"), F.col("b.size").alias("other_size")))
    x = entries.select("token", "component", "size", "head_n", *(F.col(c).alias(f"x_{c}") for c in ("name", "n", "cap", "overlap")))
    y = entries.select("token", F.col("component").alias("other"), F.col("size").alias("other_size"), *(F.col(c).alias(f"y_{c}") for c in ("name", "n", "cap", "overlap")))
    pairs = (met.join(x, ["token", "component", "size"]).join(y, ["token", "other", "other_size"])
             .where(_fit(F.col("x_n"), F.col("x_cap"), F.col("y_n"), F.col("y_cap"), percent)))
    most = F.least("x_overlap", "y_overlap") + F.least(F.col("x_n") - F.col("x_overlap"), F.col("y_n") - F.col("y_overlap"))
    bounded = pairs.select(F.col("x_name").alias("a"), F.col("y_name").alias("b"), F.col("x_n").alias("n"), F.col("y_n").alias("m"),
                           F.when(F.col("x_overlap").isNull() | F.col("y_overlap").isNull(), F.least("x_n", "y_n")).otherwise(most).alias("most"),
                           F.coalesce(F.col("x_overlap") + F.col("y_overlap") - F.col("head_n"), F.lit(0)).alias("least"))
    left = (bounded.groupBy("a", "b", "n", "m").agg(F.min("most").alias("most"), F.max("least").alias("least"))
            .where(_linked(F.col("most"), F.col("n"), F.col("m"), percent)))
    left = cut_lineage(left)
    sure = _linked(F.col("least"), F.col("n"), F.col("m"), percent)
    more = (_measured(left.where(~sure), sets).where(_linked(F.col("overlap"), F.col("n"), F.col("m"), percent)).select("a", "b")
            .unionByName(left.where(sure).select("a", "b")))
    more = cut_lineage(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return known if more.isEmpty() else components(near.unionByName(more))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The input's columns but the text, ``n_shingles`` and ``component_id``: the smallest id reachable by links."""
    rows = cut_lineage(named_sets(docs, text_col, k))
    size = rows.agg(F.sum("bytes")).first()[0] or 0
    parts = max(MIN_PARTS, math.ceil(size / max(PART_BYTES, math.isqrt(ENTRY_BYTES * size))))
    known = set_links(cut_lineage(index_lists(docs, text_col, k, percent, parts)), percent)
    own = F.col(f"row.`{id_col}`")
    least = rows.where("name IS NOT NULL").groupBy("name").agg(F.min(own).alias("least"))
    members = least.join(known.withColumnRenamed("node", "name"), "name", "left").select("name", "least", F.coalesce("component", "name").alias("component"))
    ids = members.groupBy("component").agg(F.min("least").alias("component_id"))
    by_name = members.join(ids, "component").select("name", "component_id")
    return (rows.join(by_name, "name", "left")
            .select("row.*", F.col("n").alias("n_shingles"), F.when(F.col("name").isNull(), own).otherwise(F.col("component_id")).alias("component_id")))
