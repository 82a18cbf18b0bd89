"""Centroid clustering with a LAESA pivot table, in exact integers.

Vectors become integer vectors once. Their distances to a few fixed pivots are computed once, too, and
stored beside them: the pivot table. In every round a centroid's own pivot distances give, by the
triangle inequality, a lower bound of its distance to each vector: the largest difference of the two
rows of pivot distances. The centroid of the least bound is measured first; another centroid is measured
only if its bound does not exceed the best distance so far. Measured distances are exact integers, and
bounds are lowered by more than their rounding error, so the result equals that of measuring all pairs.

A round reads the table once. Each task adds up its vectors per centroid, so ``k`` sums a task are
shuffled, whatever the size of a cluster or the number of equal vectors, and the driver receives
``k * dim`` sums. Centroids and pivots, ``k * dim`` numbers, travel with the tasks. The table and the
final assignment are checkpointed into the shared folder, so lost executors cost their tasks only.

Defined results: a null vector, one of another length, or one with a null, NaN or infinite component is
left out. Starting centroids are the kept vectors with the smallest ``sha256(seed:id)``; rows of one id
are taken in the order of their components, and rows without an id come last. Fewer than ``k`` kept
vectors give fewer centroids; an equal starting vector's cluster stays empty, as ties go to the smaller
number. An empty table gives an empty table. A component whose integer exceeds 2**27 in size is an
error, as squared distances might not fit a long. Input columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlens.session import cut_lineage

#: Pivots of the table.
PIVOTS = 12
#: Largest component: with 64 of them a squared distance stays below 2**62.
LARGEST = 1 << 27
#: Vectors measured at once in a task.
BLOCK = 4096
#: Bounds are lowered by this share of the distances that they are made of; a square root errs by 2**-52.
SLACK = 1e-9

_ZERO = 1 << 31

ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid")


def integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and ``floor(scale * x)`` of their components."""
    keep = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column.filter(pa.array(keep)))
    x = pc.fill_null(flat.cast(pa.float64(), safe=False), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(scale * x)
    finite = np.isfinite(x).all(axis=1)
    keep[np.flatnonzero(keep)] = finite
    whole = whole[finite]
    if (np.abs(whole) > LARGEST).any():
        raise ValueError(f"a vector component exceeds {LARGEST} in size after scaling by {scale}")
    return keep, whole.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows (or to one row)."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(squared(vectors, p).astype(np.float64)) for p in pivots], axis=1)


def choose_pivots(start: np.ndarray, n: int) -> np.ndarray:
    """Starting centroids far from each other: each next one has the largest distance to those chosen."""
    chosen = [0]
    least = squared(start, start[0])
    while len(chosen) < min(n, len(start)) and least.max() > 0:
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, squared(start, start[chosen[-1]]))
    return start[chosen]


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each vector's nearest centroid, and how many pairs were measured.

    table, own: pivot distances of vectors and of centroids.
    """
    label, best, measured = [], [], 0
    for a in range(0, len(vectors), BLOCK):
        v, t = vectors[a:a + BLOCK], table[a:a + BLOCK]
        bound = np.zeros((len(v), len(centroids)))
        for p in range(t.shape[1]):
            np.maximum(bound, np.abs(t[:, p, None] - own[None, :, p]), out=bound)
        bound -= SLACK * (1 + t.max(axis=1, initial=0)[:, None] + own.max(axis=1, initial=0)[None, :])
        np.maximum(bound, 0, out=bound)
        first = np.argmin(bound, axis=1)
        at, d = first.copy(), squared(v, centroids[first])
        measured += len(v)
        for c in range(len(centroids)):
            # the best distance shrinks on the way, and with it what survives
            x = np.flatnonzero((bound[:, c] <= np.sqrt(d) * (1 + SLACK)) & (first != c))
            if len(x):
                found = squared(v[x], centroids[c])
                better = (found < d[x]) | ((found == d[x]) & (c < at[x]))
                at[x[better]], d[x[better]] = c, found[better]
                measured += len(x)
        label.append(at)
        best.append(d)
    none = np.zeros(0, np.int64)
    return (np.concatenate(label) if label else none), (np.concatenate(best) if best else none), measured


def _matrix(column: pa.Array, kind: str | type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _packed(vectors: np.ndarray) -> pa.Array:
    """Big-endian and without sign, so that bytes sort as the components do."""
    return _binary((vectors + _ZERO).astype(">u4"))


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    return _matrix(column, ">u4", dim).astype(np.int64) - _ZERO


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5,
            dim: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """Kept rows: the input's columns but the vector, ``cluster`` (int), ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid``."""
    carried = [c for c in rows.columns if c != vector_col and c not in ADDED]
    own_schema = [rows.schema[c] for c in carried]

    def to_integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, v = integers(batch.column("vector"), dim, scale)
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(keep)), _packed(v)], names=["row", "vector"])

    # one column holds all carried ones, so that no name of theirs meets one of the table's
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.col(f"`{vector_col}`").alias("vector"))
    kept = cut_lineage(packed.mapInArrow(to_integers, T.StructType([packed.schema["row"], T.StructField("vector", T.BinaryType())])))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"row.`{id_col}`").cast("string")), 256)
    started = kept.select(order.alias("h"), "vector").orderBy(F.col("h").asc_nulls_last(), "vector").limit(k).collect()
    start = _unpacked(pa.array([r.vector for r in started], pa.binary()), dim)
    out = T.StructType([*own_schema, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
                        T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()),
                        T.StructField("centroid", T.ArrayType(T.LongType()))])
    if not len(start):
        return rows.sparkSession.createDataFrame([], out)
    pivots = choose_pivots(start, PIVOTS)

    def to_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pivot_distances(_unpacked(batch.column("vector"), dim), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(found)], names=[*batch.schema.names, "pivots"])

    table = cut_lineage(kept.mapInArrow(to_table, T.StructType([*kept.schema.fields, T.StructField("pivots", T.BinaryType())])))
    centroids = start
    for _ in range(rounds):
        moved = _moved(table, centroids, pivots)
        if (moved == centroids).all():
            break
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pivot_distances(centroids, pivots)
        for batch in batches:
            label, distance, _ = nearest(_unpacked(batch.column("vector"), dim),
                                         _matrix(batch.column("pivots"), np.float64, len(pivots)), centroids, own)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(label, pa.int32()), pa.array(distance)],
                                             names=["row", "cluster", "distance"])

    assigned = cut_lineage(table.select("row", "vector", "pivots").mapInArrow(
        assign, T.StructType([kept.schema["row"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])))
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    known = rows.sparkSession.createDataFrame([(c, s, sum(sums.values()), centroids[c].tolist()) for c, s in sums.items()],
                                              T.StructType([out["cluster"], *out.fields[-3:]]))
    return assigned.join(known, "cluster").select("row.*", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The exact floored means of each centroid's vectors; empty centroids stay."""
    dim = centroids.shape[1]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pivot_distances(centroids, pivots)
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            v = _unpacked(batch.column("vector"), dim)
            label, _, _ = nearest(v, _matrix(batch.column("pivots"), np.float64, len(pivots)), centroids, own)
            np.add.at(sums, label, v)
            counts += np.bincount(label, minlength=len(counts))
        c = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(counts[c]), pa.array(sums[c].tolist(), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])

    partial = table.select("vector", "pivots").mapInArrow(add_up, "cluster int, n long, sums array<long>")
    total = (partial.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i")
             .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    moved = centroids.copy()
    for r in total:
        moved[r.cluster, r.i] = int(r.s) // r.n
    return moved
