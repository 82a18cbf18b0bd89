"""The Jaccard join against comparing every pair of sets in Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattlens.llm import ngram_join, queries
from wattlens.session import ship_package

from .conftest import DOCS

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset()


def brute(rows, k=5, percent=80):
    """(id, n_shingles, component_id) of (id, text) rows."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((doc_id, len(sets[i]), least.get(root(i))) for i, (doc_id, _) in enumerate(rows)), key=str)


def run(docs, **kw):
    ship_package(docs.sparkSession)
    return sorted(map(tuple, ngram_join.join(docs.select("doc_id", "text"), **kw).collect()), key=str)


def family(rnd, base, n, edits):
    """Copies of a word list with up to ``edits`` words replaced, dropped or added."""
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            at = rnd.randrange(len(words))
            words[at:at + rnd.randrange(2)] = [f"e{rnd.randrange(40)}"] * rnd.randrange(2)
        yield " ".join(words)


def test_whole_query(spark):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op13_ngram_jaccard_join(spark, SF).collect()), key=str)
    assert got == brute(data)
    assert any(i != c for i, _, c in got)


@pytest.mark.parametrize("seed", range(3))
def test_families_around_the_threshold(spark, docs, seed, monkeypatch):
    """Chains of near copies on both sides of 0.8, of several sizes, with a passage that all share; several parts and block sizes."""
    monkeypatch.setattr(ngram_join, "PART_BYTES", 20_000)
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    texts = []
    for f in range(12):
        base = [f"w{f}x{rnd.randrange(60)}" for _ in range(rnd.choice([6, 12, 30, 80, 200]))]
        base[len(base) // 2:len(base) // 2] = common if f % 2 else []
        texts += family(rnd, base, 25, max(len(base) // 12, 2))
    texts += [" ".join([f"u{i}"] * 3 + common) for i in range(30)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows) - 50
    assert run(docs(rows)) == want


def test_derived_answers_measure_what_bounds_leave_open(spark, docs):
    """Sets that link with each other but not with the head of their list."""
    rnd = random.Random(7)
    core = [f"k{i}" for i in range(60)]
    texts = [" ".join(core)]
    for f in range(8):
        tail = [f"t{f}x{i}" for i in range(18)]
        texts += [" ".join(core + tail + [f"z{f}y{j}"]) for j in range(6)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    assert len({c for _, _, c in want}) == 9
    assert run(docs(rows)) == want


def test_odd_rows(spark, docs):
    """Null, empty and blank texts, short texts, null and repeated ids, repeated rows, capitals, odd white space, a very long text, long words."""
    long_text = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\x0btwo"), (6, "one two three"), (7, "É a b c d e"), (8, "é a b c d e"), (None, "one two"),
            (None, None), (None, "only without id"), (None, "ONLY without\fid"), (9, long_text), (10, long_text + " tail"), (10, "repeated id"), (11, "one\xa0two"),
            (12, "same row here again and again"), (12, "same row here again and again"), (13, "x" * 5000 + " a b c d e"), (14, "x" * 4999 + "y a b c d e")]
    assert run(docs(rows)) == brute(rows)


def test_thuemorse_words_differ(spark, docs):
    """Patterns on which a polynomial hash modulo a power of two cannot tell words apart."""
    bits = [0]
    for _ in range(11):
        bits += [1 - b for b in bits]
    a = "".join("ab"[b] for b in bits)
    rows = [(1, a + " p q r s"), (2, a.translate(str.maketrans("ab", "ba")) + " p q r s")]
    assert run(docs(rows)) == brute(rows)
    assert len(set(ngram_join.shingle_sets(*_buffer([t for _, t in rows]), 5)[0].tolist())) == 2


def _buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def test_sets_of_slices(spark):
    texts = ["a b c d e a b c d e", "", "x", "a b c d", " a b c d e ", "q w e r t y u i o p" * 40]
    tokens, edge = ngram_join.shingle_sets(*_buffer(texts), 5)
    assert np.diff(edge).tolist() == [len(shingles(t)) for t in texts]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        assert (np.diff(tokens[a:b].astype(object)) > 0).all()


def test_empty_table(spark, docs):
    assert run(docs([])) == []
    assert run(docs([(1, None)])) == [(1, 0, 1)]


def test_other_shingles_and_thresholds(spark, docs):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    rows = list(enumerate(family(rnd, base, 40, 12)))
    assert run(docs(rows), k=2, percent=60) == brute(rows, 2, 60)
    assert run(docs(rows), k=1, percent=100) == brute(rows, 1, 100)


def test_names_that_clash(spark):
    names = ["row", "name", "n", "tokens", "prefix", "part", "bucket", "component", "node", "u", "v", "bytes", "token", "head"]
    ship_package(spark)
    rows = spark.createDataFrame([(1, "a b c"), (2, "A b c")], "doc_id long, text string").select("*", *(F.lit(c).alias(c) for c in names), F.lit("x").alias("n_shingles"))
    out = ngram_join.join(rows).collect()
    assert sorted((r.doc_id, r["component_id"], r["n_shingles"], r["row"], r["name"], r["u"]) for r in out) == [(1, 1, 1, "row", "name", "u"), (2, 1, 1, "row", "name", "u")]


def test_copies_leave_a_slice_once(spark):
    """A text of a third of all rows is dealt once a slice, and not always to the same part."""
    job = ngram_join._Job(5, 80, 16)
    same = pa.RecordBatch.from_arrays([pa.array(["a b c d e f"] * 1000)], names=["text"])
    out = list(job.deal(iter([same] * 40)))
    assert all(b.num_rows == 1 for b in out) and len({b.column("part")[0].as_py() for b in out}) > 4
