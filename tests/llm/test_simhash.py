import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wattlens.llm import queries, simhash
from wattlens.llm._components import components


def brute_print(text, k=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    """Union-find over all pairs; index -> smallest index reachable."""
    up = list(range(len(prints)))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(prints))]


def corpus():
    r = random.Random(11)
    vocab = ["The", "of", "Ü", "naïve", "x"] + [f"w{i}" for i in range(200)]
    rows = [None, "", " \n", "one", "One", "two words", "a b c"]
    for _ in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(1, 400))]
        rows.append(" ".join(w))
        for _ in range(r.randint(0, 2)):
            v = list(w)
            v[r.randrange(len(v))] = "changed"
            rows.append("\t".join(v).upper() if r.random() < 0.3 else "  ".join(v))
    return list(enumerate(rows + rows[20:30]))


def test_fingerprints_and_components_match_brute_force(docs):
    rows = corpus()
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(rows).repartition(4)).collect()}
    prints = [brute_print(t) for _, t in rows]
    comp = brute_components(prints)
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i].fingerprint & (2 ** 64 - 1) == prints[i]
        assert got[i].component_id == comp[i]
    assert len(set(comp)) < len(rows) - 10


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    prints = [brute_print(t) for _, t in rows]
    comp = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, comp)}


def test_null_ids_repeats_empty_and_clashing(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    df = docs([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "other words here now")]).withColumn("fingerprint", F.lit("x"))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_shards_lose_no_link(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 2 ** 63, 150, dtype=np.uint64)
    near = base ^ (np.uint64(1) << r.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 150).astype(np.uint64))
    points = np.unique(np.concatenate([base, near, r.integers(0, 4096, 700).astype(np.uint64)]))
    pairs = {(i, j) for i in range(len(points)) for j in range(i) if np.bitwise_count(points[i] ^ points[j]) <= radius}
    tree = simhash.build_tree(points[::3], 4)
    at, shard, home = simhash.route(tree, points, radius)
    assert sorted(at[home].tolist()) == list(range(len(points)))  # one home each
    met, joined = set(), []
    for s in np.unique(shard):
        own = at[shard == s]
        a, b = simhash.search(points[own], home[shard == s], radius)
        joined += list(zip(own[a].tolist(), own[b].tolist()))
        assert len(a) < len(own)
    up = list(range(len(points)))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in joined:
        up[find(a)] = find(b)
    other = list(range(len(points)))
    def find2(x):
        while other[x] != x:
            x = other[x]
        return x
    for a, b in pairs:
        other[find2(a)] = find2(b)
    same = lambda f: sorted(tuple(sorted(i for i in range(len(points)) if f(i) == r)) for r in {f(i) for i in range(len(points))})
    assert same(find) == same(find2)


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    up = {}
    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    want = {x: find(x) for x in up}
    assert all(got.get(x, x) == c for x, c in want.items()) and set(got) <= set(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_very_long_text(docs):
    r = random.Random(3)
    long_ = " ".join(f"w{r.randrange(9000)}" for _ in range(60_000))
    got = sorted(simhash.near_duplicates(docs([(7, long_), (3, long_ + " end"), (5, "x" * 300_000)])).collect())
    assert [r.fingerprint & (2 ** 64 - 1) for r in got] == [brute_print(t) for t in (long_ + " end", "x" * 300_000, long_)]
    assert [r.component_id for r in got] == [3, 5, 3]


def test_representatives_of_ties_and_repeats(docs):
    rows = [(4, "a b c d"), (2, "a b c d"), (2, "a b c d"), (2, "quite another text of words"), (None, "a b c d"), (None, "no id here at all"), (None, "no id here at all")]
    got = sorted((str(r.doc_id), r.text) for r in simhash.representatives(docs(rows)).collect())
    assert got == [("2", "a b c d"), ("2", "quite another text of words"), ("None", "no id here at all")]
    assert simhash.representatives(docs([])).count() == 0


def test_internal_names_as_input_columns(spark):
    names = ["__key", "__hash", "__none", "__id", "__text", "fp", "least_id", "component", "node", "shard", "home", "u", "v"]
    data = [(1, "a b c d"), (2, "a b c d"), (None, "e f g h"), (4, None)]
    rows = spark.createDataFrame(data, "doc_id long, text string").select("*", *(F.lit(n).alias(n) for n in names))
    kept = simhash.representatives(rows).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept if r.doc_id) == [(False, 1), (False, 4)] and len(kept) == 3
    assert all(r[n] == n for r in kept for n in names) and kept[0].asDict().keys() == {"doc_id", "text", *names}
    assert all(r[n] == n for r in simhash.near_duplicates(rows).collect() for n in names)
