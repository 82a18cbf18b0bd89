"""Centroid clustering against measuring every pair in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from wattlens.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=40, rounds=5, dim=64, scale=256):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(scale * float(np.float32(x))) for x in v)))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        label = [j for _, j in assign()]
        for j in range(len(cents)):
            own = [v for (_, v), x in zip(kept, label, strict=True) if x == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = assign()
    total = sum(d for d, _ in found)
    return sorted(((i, j, d, sum(e for e, x in found if x == j), total, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, found, strict=True)), key=str)


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, queries.op12_centroid_clustering(spark, str(tmp_path)).collect()), key=str)


def vectors(n, spread, seed):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(7)]
    return [(i, [x + rnd.gauss(0, spread) for x in rnd.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_query_matches_brute_force(spark, tmp_path, spread):
    """Clusters and noise; a third of the rows is one vector."""
    rows = vectors(200, spread, 3) + [(1000 + i, [0.25] * 64) for i in range(100)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_odd_rows(spark, tmp_path):
    """Null and short vectors, null and non-finite components, ids that are null or repeat, negative and large components."""
    rows = vectors(60, 0.5, 4)
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.5] * 63 + [None]), (905, [math.nan] + [0.5] * 63), (906, [-math.inf] + [0.5] * 63)]
    rows += [(None, [0.1] * 64), (None, [-0.1] * 64), (5, [0.2] * 64), (5, [-0.2] * 64), (7, rows[7][1]), (907, [-500000.0] * 64), (908, [500000.0] * 64), (909, [-0.0] * 64)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_fewer_rows_than_centroids_and_ties(spark, tmp_path):
    """Equal starting vectors: the smaller number takes all, the others stay empty."""
    rows = [(i, [float(i % 3)] * 64) for i in range(9)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_no_kept_vector(spark, tmp_path):
    assert run(spark, tmp_path, [(1, [0.5]), (2, None)]) == []


def test_components_out_of_range_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="exceeds"):
        run(spark, tmp_path, [(1, [1e9] * 64)])


def test_names_that_clash(spark):
    data = [(i, [float(i)] * 4, "r", "v", "p", "c") for i in range(6)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>, row string, vector string, pivots string, cluster string")
    out = centroids.cluster(rows, k=2, rounds=2, dim=4, scale=1).collect()
    assert out[0].asDict().keys() == {"vec_id", "row", "vector", "pivots", "cluster", "distance", "cluster_inertia", "inertia", "centroid"}
    assert {(r["row"], r.vector, r.pivots) for r in out} == {("r", "v", "p")} and {r["cluster"] for r in out} == {0, 1}


def test_pivots_skip_most_pairs_of_clustered_vectors():
    rng = np.random.default_rng(5)
    middles = rng.integers(-4000, 4000, (40, 64))
    v = (middles[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 64))).astype(np.int64)
    c = middles.astype(np.int64)
    p = centroids.choose_pivots(c, centroids.PIVOTS)
    label, best, measured = centroids.nearest(v, centroids.pivot_distances(v, p), c, centroids.pivot_distances(c, p))
    d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (label == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert measured < 0.1 * d.size
