"""SimHash near-dedup with vantage-point trees.

Fingerprints: ASCII capitals are lowered, words are ``[^\\x20\\x09-\\x0D]+``, features are shingles of
consecutive words joined by one space (repeats count; fewer words: the whole sequence), hashed by
XXH64 with seed 42. A bit is 1 if set in over half the hashes; no words give fingerprint zero.

Links: rows meet by fingerprint first, so copies are one entry. A vantage-point tree over the
distinct fingerprints deals them into shards: at each node a fingerprint goes inside or outside by
its Hamming distance to the vantage point. Triangle bounds say which inside fingerprints can have
a partner outside: those (within the radius of the border) visit the outer shards, too. A shard
searches its own fingerprints and its visitors exactly, with a tree of its own, and returns a
spanning forest of the links it finds (never all pairs of a dense group). Star contraction joins the
forests of all shards.

The upper tree is built from a bounded sample of fingerprints (``TREE_SAMPLE``); the sample only
decides how evenly shards are filled, not which pairs are found.

Defined results: a null text is empty; rows with a null id take part, but a component is the
smallest non-null id in it (null if there is none); repeated rows share one component; an empty
table gives an empty table. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlens.session import cut_lineage

from . import _text
from ._components import components

SEED = 42
#: Fingerprints from which the upper tree takes its vantage points, at most.
TREE_SAMPLE = 16384
#: Fingerprints wanted in a shard; shards are at most ``TREE_SAMPLE / 4``.
SHARD = 16384
#: Fingerprints compared one by one at the bottom of a shard's own tree.
LEAF = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def fingerprints_of(buf: np.ndarray, offs: np.ndarray, shingle: int) -> np.ndarray:
    """64-bit fingerprints of the texts of one buffer."""
    n = len(offs) - 1
    start, end, row = _text.words(buf, offs)
    text, start, end = _text.joined_words(_LOWER[buf], start, end)
    edge = np.searchsorted(row, np.arange(n + 1))
    n_words = np.diff(edge)
    size = np.minimum(n_words, shingle)
    at = np.flatnonzero(_shingle_starts(row, edge, n_words, shingle))
    stop = end[at + size[row[at]] - 1]
    data = memoryview(text.tobytes())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(start[at].tolist(), stop.tolist(), strict=True)), np.uint64, len(at))
    out = np.zeros(n, np.uint64)
    if len(at):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = np.flatnonzero(n_words > 0)
        head = np.searchsorted(row[at], full)
        count = np.diff(np.append(head, len(at)))
        ones = np.add.reduceat(bits, head, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little")
        out[full] = np.ascontiguousarray(packed).view("<u8")[:, 0]
    return out


def _shingle_starts(row: np.ndarray, edge: np.ndarray, n_words: np.ndarray, shingle: int) -> np.ndarray:
    """Words at which a whole shingle starts, or the first word of a shorter text."""
    place = np.arange(len(row)) - edge[row]
    return (place + shingle <= n_words[row]) | (place == 0)


def fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3, name: str = "fingerprint") -> DataFrame:
    """The input's columns but the text, and the fingerprint as a (signed) long."""
    carried = [c for c in docs.columns if c not in (text_col, name)]
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField(name, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, text_col):
            value = fingerprints_of(*_text.utf8(part.column(text_col)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(value)], names=[*carried, name])

    return docs.select(*(F.col(f"`{c}`") for c in [*carried, text_col])).mapInArrow(run, schema)


def _vantage(points: np.ndarray) -> tuple[np.uint64, int]:
    """The best of a few vantage points (whose border has the fewest points around it), and its border distance."""
    best = None
    for at in np.linspace(0, len(points) - 1, 8).astype(int):
        d = np.bitwise_count(points ^ points[at])
        border = int(np.median(d)) + 1
        inside = np.count_nonzero(d < border)
        near = np.count_nonzero((d < border) & (d >= border - 3))
        score = (min(inside, len(points) - inside) > 0, -near - abs(2 * inside - len(points)) / 2)
        if best is None or score > best[0]:
            best = score, points[at], border
    return best[1], best[2]


def build_tree(points: np.ndarray, depth: int) -> list[tuple[int, int] | None]:
    """Vantage points and borders of a binary tree in heap order; None where a branch ends early."""
    tree: list[tuple[int, int] | None] = [None] * (2 ** depth - 1)
    open_ = [(0, points)]
    while open_:
        node, own = open_.pop()
        if node >= len(tree) or len(own) < 2:
            continue
        point, border = _vantage(own)
        d = np.bitwise_count(own ^ point)
        if not (d >= border).any():
            continue
        tree[node] = int(point), border
        open_ += [(2 * node + 1, own[d < border]), (2 * node + 2, own[d >= border])]
    return tree


def route(tree: list[tuple[int, int] | None], points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each point goes: (index of the point, shard, is it at home there). Inside points near a border visit the outside."""
    found: list[tuple[np.ndarray, int, np.ndarray]] = []
    open_ = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while open_:
        node, at, home = open_.pop()
        if not len(at):
            continue
        if node >= len(tree) or tree[node] is None:
            found.append((at, node, home))
            continue
        point, border = tree[node]
        d = np.bitwise_count(points[at] ^ np.uint64(point)).astype(np.int64)
        inside = np.where(home, d < border, d - radius < border)
        outside = np.where(home, d >= border, d + radius >= border)
        visit = home & (d < border) & (d + radius >= border)
        open_ += [(2 * node + 1, at[inside], home[inside]),
                  (2 * node + 2, np.concatenate([at[outside], at[visit]]), np.concatenate([home[outside], np.zeros(visit.sum(), bool)]))]
    return (np.concatenate([x[0] for x in found]), np.concatenate([np.full(len(x[0]), x[1]) for x in found]),
            np.concatenate([x[2] for x in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


class _Forest:
    """Union-find over positions; joins come in batches of pairs."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def _roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            nxt = self.up[r]
            if (nxt == r).all():
                self.up[x] = r
                return r
            r = nxt

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._roots(a), self._roots(b)
            differ = a != b
            a, b = np.maximum(a, b)[differ], np.minimum(a, b)[differ]
            self.up[a] = b  # of several, one holds; the rest come again

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(len(self.up))
        r = self._roots(x.copy())
        return x[r != x], r[r != x]


def search(points: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (pairs of positions) of all links between points of which one at least is at home."""
    forest = _Forest(len(points))
    open_ = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while open_:
        own, visitors = open_.pop()
        if not len(own) or len(own) + len(visitors) < 2:
            continue
        if len(own) > LEAF:
            point, border = _vantage(points[own])
            d, v = (np.bitwise_count(points[x] ^ point).astype(np.int64) for x in (own, visitors))
            if (d < border).any() and (d >= border).any():
                near = own[(d < border) & (d + radius >= border)]
                open_ += [(own[d < border], visitors[v - radius < border]),
                          (own[d >= border], np.concatenate([visitors[v + radius >= border], near]))]
                continue
        every = np.concatenate([own, visitors])
        for a in range(0, len(own), LEAF):
            mine = own[a:a + LEAF]
            for b in range(a, len(every), 1 << 13):
                other = every[b:b + (1 << 13)]
                i, j = np.nonzero(np.bitwise_count(points[mine][:, None] ^ points[other][None, :]) <= radius)
                keep = mine[i] != other[j]
                forest.join(mine[i[keep]], other[j[keep]])
    return forest.edges()


def _links(prints: DataFrame, radius: int) -> DataFrame:
    """(u, v): a spanning forest of every shard's links between distinct fingerprints ``fp``."""
    n = prints.count()
    shards = min(max(math.ceil(n / SHARD), 1), TREE_SAMPLE // 4)
    depth = max(math.ceil(math.log2(max(shards, 12))), 1)
    sample = prints.select("fp").orderBy(F.xxhash64("fp", F.lit("tree")), "fp").limit(TREE_SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    tree = build_tree(sample.view(np.uint64), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            at, shard, home = route(tree, np.ascontiguousarray(fp).view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(fp[at]), pa.array(home)], names=["shard", "fp", "home"])

    def find(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        order = np.argsort(fp)  # the root of each tree is its smallest fingerprint
        fp = fp[order]
        a, b = search(np.ascontiguousarray(fp).view(np.uint64), table.column("home").to_numpy()[order], radius)
        return pa.table({"u": pa.array(fp[a]), "v": pa.array(fp[b])})

    dealt = prints.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(find, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The input's columns but the text, ``fingerprint`` (long), ``component_id``: the smallest id reachable over links of at most ``radius`` bits, and
    ``component_print``: the component's smallest (signed) fingerprint."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("fingerprint", "component_id", "component_print")))
    rows = cut_lineage(fingerprint(docs, text_col, shingle))
    least = rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(F.col(f"`{id_col}`")).alias("least_id"))
    found = components(_links(least, radius))
    members = least.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    named = members.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_print = members.join(named, "component").select(F.col("fp").alias("fingerprint"), "component_id", F.col("component").alias("component_print"))
    return rows.join(by_print, "fingerprint").select(*rows.columns, "component_id", "component_print")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The input's rows without all but one of each component: that with the smallest id.

    Where no row of a component has an id, one of its rows stays, and so does one of several rows
    with the smallest id.
    """
    key, text = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))
    rows = near_duplicates(docs.select(key.alias("__id"), text.alias("__hash"), F.col(f"`{text_col}`").alias("__text")), "__id", "__text", shingle, radius)
    chosen = (rows.where(F.col("__id").eqNullSafe(F.col("component_id")))
              .groupBy("__id", "component_print").agg(F.min("__hash").alias("__hash")))
    on = [_text.free_name(n, docs.columns) for n in ("__key", "__hash", "__none")]  # beside any columns of the user's
    chosen = chosen.select(F.coalesce("__id", "__hash").alias(on[0]), F.col("__hash").alias(on[1]), F.col("__id").isNull().alias(on[2]))
    known = docs.withColumns(dict(zip(on, (F.coalesce(key, text), text, key.isNull()), strict=True)))
    return known.join(chosen, on, "left_semi").dropDuplicates(on).select(*(F.col(f"`{c}`") for c in docs.columns))


def hex64(value: F.Column) -> F.Column:
    """16 lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
