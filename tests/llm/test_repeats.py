"""The substring and the suffix operator against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from wattlens.llm import _repeats, substring_dedup, suffix_dedup

from .conftest import by_id


def cover(units_by_row, window=50):
    """Removed units of each (id, units) row."""
    first = {}
    for i, units in units_by_row:
        if i is not None:
            for a in range(len(units) - window + 1):
                k = units[a:a + window]
                first[k] = min(first.get(k, i), i)
    out = []
    for i, units in units_by_row:
        gone = set()
        for a in range(len(units) - window + 1):
            if i is not None and first[units[a:a + window]] < i:
                gone.update(range(a, a + window))
        out.append(gone)
    return out


def words_of(text):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def corpus(seed=3):
    r = random.Random(seed)
    vocab = ["the", "of", "ü", "word", "naïve", "x", "été", "and", "b"] + [f"w{i}" for i in range(300)]
    def prose(n):
        return " ".join(r.choice(vocab) for _ in range(n))
    shared = [prose(n) for n in (50, 51, 60, 49, 130, 8)]
    rows = [(i, None) for i in (5, 6)] + [(7, ""), (8, "one"), (9, "a" * 400), (10, "b" + "a" * 200), (11, "é" * 90), (12, "xé" + "é" * 60)]
    for i in range(20, 90):
        rows.append((i, "  ".join(x for k in range(r.randint(1, 4)) for x in (prose(r.randint(0, 90)), r.choice(shared)))))
    whole = prose(300)
    rows += [(100 + i, whole) for i in range(30)] + [(140, whole + " tail"), (15, whole[:500] + "changed" + whole[500:])]
    rows += [(None, whole), (None, shared[4]), (200, "abab" * 60), (201, "baba" * 60), (202, "\x00" * 120), (203, "\x00" * 60), (204, whole.replace(" ", "\n"))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("part_bytes", [1 << 20, 2000])
def test_words_match_brute_force(docs, part_bytes):
    rows = corpus()
    gone = cover([(i, words_of(t)) for i, t in rows])
    want = sorted((str(i), len(words_of(t)), len(g), " ".join(w for k, w in enumerate(words_of(t)) if k not in g).encode()) for (i, t), g in zip(rows, gone))
    got = substring_dedup.dedup(docs(rows).repartition(5), part_bytes=part_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, bytes(r.kept)) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize("part_bytes", [1 << 20, 2000])
def test_bytes_match_brute_force(docs, part_bytes):
    rows = corpus()
    data = [(i, (t or "").encode()) for i, t in rows]
    gone = cover(data)
    want = sorted((str(i), len(b), len(g), bytes(x for k, x in enumerate(b) if k not in g),
                   sum(1 for k in g if k - 1 not in g)) for (i, b), g in zip(data, gone))
    got = suffix_dedup.dedup(docs(rows).repartition(5), part_bytes=part_bytes).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept), len(r.spans)) for r in got) == want


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_empty_repeated_and_clashing(spark, docs, op):
    assert op.dedup(docs([])).count() == 0
    long_ = " ".join(f"word{i}" for i in range(80))
    df = docs([(1, long_), (1, long_), (3, long_)]).withColumn("kept", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("other", F.lit("o"))
    rows = op.dedup(df).collect()
    assert sorted((r.doc_id, len(r.kept) > 0, r.other) for r in rows) == [(1, True, "o"), (1, True, "o"), (3, False, "o")]
    only_short = op.dedup(docs([(1, "a"), (2, "a")])).collect()
    assert [r.n_removed for r in only_short] == [0, 0]


@pytest.mark.parametrize("bucket", [1, 7, 1 << 18])
def test_suffix_order_is_lexicographic(bucket):
    r = random.Random(5)
    base = [bytes(r.choice(b"ab") for _ in range(r.randint(50, 90))) for _ in range(30)]
    base += [b"a" * 80, b"a" * 64, b"ab" * 40, b"\x00" * 70, b"\xff" * 60] + [base[0][:60], base[0][3:60]]
    strings = [s for s in dict.fromkeys(base) if len(s) >= 50]
    lengths = np.array([len(s) for s in strings])
    starts = np.cumsum(lengths) - lengths
    at = np.concatenate([a + np.arange(n - 49) for a, n in zip(starts, lengths)])
    suffix = {int(a + k): s[k:] for a, s in zip(starts, strings) for k in range(len(s) - 49)}
    order, _ = suffix_dedup.suffix_order(b"".join(strings), lengths, at, bucket)
    got = [suffix[int(at[o])] for o in order]
    assert got == sorted(suffix.values())


def test_cover_reaches_every_pair():
    assert sorted({(a - b) % 31 for a in suffix_dedup.COVER for b in suffix_dedup.COVER}) == list(range(31))
    assert suffix_dedup.SHIFT.max() < 31 <= 8 * suffix_dedup.DIRECT_WORDS


def test_refine_ranks_strings():
    r = np.random.default_rng(1)
    keys = r.integers(0, 3, (200, 5)).astype(np.uint64)
    rank = _repeats.refine(lambda k, x: keys[x, k], 200, 5)
    rows = [tuple(k) for k in keys.tolist()]
    assert rank.tolist() == [sorted(rows).index(k) for k in rows]


def test_text_is_left_without_cut_characters(docs):
    # 25 two-byte characters shared at odd byte offsets: the window cuts none of them, but a window may end inside one
    shared = "aé" * 30
    rows = [(1, "x" + shared), (2, "ü" + shared + "ß"), (3, shared[1:] + "é")]
    data = [(i, t.encode()) for i, t in rows]
    for (i, b), gone, r in zip(data, cover(data), sorted(suffix_dedup.dedup(docs(rows), as_text=True).collect())):
        left, at = "", 0
        for ch in b.decode():
            n = len(ch.encode())
            left += ch if not gone & set(range(at, at + n)) else ""
            at += n
        assert (r.doc_id, r.text, r.n_removed) == (i, left, len(gone))


def test_very_long_texts(docs):
    r = random.Random(9)
    long_ = " ".join(r.choice(["the", "of", "é"]) + str(r.randrange(5000)) for _ in range(40_000))
    rows = [(2, long_), (9, long_[:100_000] + "?" + long_[100_000:]), (5, long_[50_000:50_400]), (3, "z" * 200_000), (4, "z" * 100)]
    data = [(i, t.encode()) for i, t in rows]
    want = {i: len(g) for (i, _), g in zip(data, cover(data))}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs(rows)).collect()} == want and want[4] == 100
    units = [(i, words_of(t)) for i, t in rows]
    want = {i: len(g) for (i, _), g in zip(units, cover(units))}
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(docs(rows)).collect()} == want and want[9] > 39_000


def hot_line(n):
    """A line of 60 bytes (60 words) in n documents, with other surroundings in each."""
    r = random.Random(4)
    def noise(k):
        return " ".join(f"{r.randrange(36 ** 4):x}" for _ in range(k))
    line = " ".join(r.choice("abcdefghij") + str(k % 7) for k in range(60))
    return [(i, f"{noise(60)} {line} {noise(60)}") for i in range(n)]


@pytest.mark.parametrize("kind", [suffix_dedup.Bytes, substring_dedup.Words])
def test_a_hot_minimiser_is_spread(kind):
    rows, parts = hot_line(6000), 12
    job = kind("doc_id", "text", parts)
    tables = [pa.table({"doc_id": pa.array([i for i, _ in rows[p::parts]], pa.int64()), "text": [t for _, t in rows[p::parts]],
                        "__part": pa.array([p] * len(rows[p::parts]), pa.int32())}) for p in range(parts)]
    def dealt(out, key):
        out = pa.concat_tables(out)
        return {k: out.filter(pc.equal(out.column(key), k)) for k in pc.unique(out.column(key)).to_pylist()}
    news = dealt([job.shared(t) for t in dealt([job.census(t) for t in tables], "bucket").values()], "__part")
    sent = dealt([job.travel(t, news[p]) for p, t in enumerate(tables)], "bucket")
    size = [sum(len(x) // 4 for x in t.column("lengths").to_pylist()) for t in sent.values()]
    strings = [np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("anchors").to_pylist()]), return_counts=True)[1].max() for t in sent.values()]
    assert max(strings) < _repeats.HOT and max(size) < 0.1 * sum(size)


@pytest.mark.parametrize("hot", [2, 40])
def test_hot_minimisers_match_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(_repeats, "HOT", hot)
    rows = corpus(8) + [(1000 + i, t) for i, t in hot_line(60)]
    data = [(i, (t or "").encode()) for i, t in rows]
    want = sorted((str(i), bytes(x for k, x in enumerate(b) if k not in g)) for (i, b), g in zip(data, cover(data)))
    got = suffix_dedup.dedup(docs(rows).repartition(5), part_bytes=4000).collect()
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == want
    units = [(i, words_of(t)) for i, t in rows]
    want = sorted((str(i), " ".join(w for k, w in enumerate(u) if k not in g).encode()) for (i, u), g in zip(units, cover(units)))
    got = substring_dedup.dedup(docs(rows).repartition(5), part_bytes=4000).collect()
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == want


def test_rows_of_one_id_and_without_id_spread(docs):
    words = " ".join(f"w{i}" for i in range(90))
    rows = [(1, f"{words} {k}") for k in range(300)] + [(None, None)] * 150 + [(None, words)] * 150
    df = docs(rows).repartition(3)
    sizes = [r["count"] for r in _repeats.dealt(df, "doc_id", "text", 12).groupBy("__part").count().collect()]
    assert sum(sizes) == 300 and max(sizes) < 60
    for op, n in ((substring_dedup, "n_words"), (suffix_dedup, "n_bytes")):
        got = op.dedup(docs([*rows, (2, words)])).collect()
        assert len(got) == 601 and {r.n_removed for r in got if r.doc_id != 2} == {0}
        assert [r.n_removed == r[n] > 0 for r in got if r.doc_id == 2] == [True]


def test_internal_names_as_input_columns(spark):
    """Columns named like those that the exchanges use keep their names and values."""
    names = ["__part", "bucket", "part", "one", "several", "anchors", "hot", "pieces", "masks", "ids", "lengths", "data", "one_log", "several_log"]
    passage = " ".join(f"word{i}" for i in range(60))
    rows = spark.createDataFrame([(1, passage), (2, "x " + passage), (None, passage)], "doc_id long, text string").select(
        "*", *(F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names))
    for op in (substring_dedup.dedup, suffix_dedup.dedup):
        out = {r.doc_id: r for r in op(rows).collect()}
        assert out[2].n_removed > 0 and out[1].n_removed == out[None].n_removed == 0
        for i, r in out.items():
            assert all(r[n] == f"{n} of {'none' if i is None else i}" for n in names)
        assert [c for c in op(rows).columns if c in names] == names


def test_ids_that_are_no_numbers_are_an_error(spark):
    rows = spark.createDataFrame([("x1", "a b")], "doc_id string, text string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        substring_dedup.dedup(rows).collect()
    assert [r.doc_id for r in substring_dedup.dedup(spark.createDataFrame([("12", "a b")], "doc_id string, text string")).collect()] == ["12"]
