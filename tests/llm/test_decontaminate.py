import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattlens.llm import decontaminate as d
from wattlens.llm import queries

ITEMS = "item_id long, text string"


def words_of(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())


def sections(words):
    out, a = [], 0
    while a < len(words):
        e = len(words) if len(words) - a <= d.SECTION + d.SECTION_TAIL else a + d.SECTION
        out.append(words[a:e])
        a = e
    return out


def brute(docs, items):
    """Every (document, item) whose section scores enough in a passage and whose question and answer overlap."""
    secs = [(i, s) for i, (_, t) in enumerate(items) for s in sections(words_of(t))]
    n, mean = len(secs), sum(len(s) for _, s in secs) / max(len(secs), 1)
    df = {}
    for _, s in secs:
        for w in set(s):
            df[w] = df.get(w, 0) + 1
    def impact(w, s):
        tf = s.count(w)
        return math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(s) / mean))
    impacts = [{w: impact(w, s) for w in set(s)} for _, s in secs]
    def overlap(part, doc):
        k = max(min(5, len(part)), 1)
        sh = {tuple(part[i:i + k]) for i in range(len(part) - k + 1)}
        return len(sh & {tuple(doc[i:i + k]) for i in range(len(doc) - k + 1)}) / len(sh) if sh else 1.0
    out = set()
    for key, t in docs:
        w = words_of(t)
        for a in range(0, max(len(w) - d.STRIDE, 1), d.STRIDE):
            passage = set(w[a:a + d.PASSAGE])
            for (i, _), own in zip(secs, impacts):
                if own and sum(v for x, v in own.items() if x in passage) / sum(own.values()) >= d.THRESHOLD - 1e-9:
                    iw, text = words_of(items[i][1]), items[i][1]
                    cut = len(words_of(text[:text.rfind("?") + 1])) if "?" in text else 0
                    if not 0 < cut < len(iw):
                        cut = len(iw) - math.ceil(len(iw) / 4)
                    if overlap(iw[:cut], w) >= .8 and overlap(iw[cut:], w) >= .8:
                        out.add((key, items[i][0]))
    return sorted(out, key=str)


def corpus():
    r = random.Random(8)
    vocab = ["the", "of", "and", "é", "a1"] + [f"w{i}" for i in range(400)]
    def prose(n):
        return " ".join(r.choice(vocab[:5] if r.random() < .4 else vocab) for _ in range(n))
    items = [(i, prose(r.choice([3, 9, 15, 30, 55, 64, 80, 81, 150]))) for i in range(60)]
    items += [(60, "What is the w1 of w2? It is w3 w4"), (61, "Only a question w7 w8 w9?"), (62, ""), (63, "?!"), (64, items[3][1]), (None, "w5 w6 null w7")]
    docs = []
    for k in range(80):
        parts = [prose(r.randint(0, 200))]
        for _ in range(r.randint(0, 3)):
            t = r.choice(items)[1].split()
            how = r.random()
            if t and how < .3:
                t[r.randrange(len(t))] = "CHANGED"
            elif how < .4:
                t = t[: len(t) // 2]
            parts += [" ".join(t).upper() if how > .9 else ",  ".join(t), prose(r.randint(0, 300))]
        docs.append((k, " ".join(parts)))
    return docs + [(200, None), (201, ""), (202, "!!")], items


@pytest.mark.parametrize("shard_bytes", [1 << 24, 4000])
def test_hits_match_brute_force(spark, docs, shard_bytes):
    rows, items = corpus()
    want = brute(rows, items)
    assert len(want) > 40
    got = d.annotate(docs(rows).repartition(3), spark.createDataFrame(items, ITEMS), shard_bytes=shard_bytes).select("doc_id", F.explode("hits.item_id").alias("i")).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_query_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(((r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, sf).collect()), key=str)
    assert got == brute(rows, items) and got


def test_wand_returns_all_at_or_above_the_threshold():
    r = random.Random(1)
    items = [(i, " ".join(r.choice(["the", "of"] + [f"t{k}" for k in range(90)]) for _ in range(r.randint(1, 70)))) for i in range(400)]
    index = d.build(items)
    for _ in range(60):
        terms = sorted(r.sample(range(len(index.terms)), r.randint(1, 60)))
        score = {}
        for t in terms:
            for p in range(index.head[t], index.head[t + 1]):
                score[int(index.section[p])] = score.get(int(index.section[p]), 0.0) + float(index.impact[p])
        for threshold in (0.3, 0.5, 0.9):
            got = d.retrieve(index, terms, threshold)
            assert got == pytest.approx({s: v for s, v in score.items() if v >= threshold - 1e-9})


def test_edge_cases(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    rows = [(None, "alpha beta gamma delta epsilon zeta"), (2, "clean"), (2, "clean"), (3, None), (4, "x " * 100000)]
    df = docs(rows).withColumn("hits", F.lit("mine"))
    assert sorted(str(r.doc_id) for r in d.remove(df, items).collect()) == ["2", "2", "3", "4"]
    assert d.remove(docs(rows), none).count() == 5 and d.annotate(docs([]), items).count() == 0
    assert d.remove(docs(rows), items).columns == docs(rows).columns


def test_items_of_one_word_are_no_question_with_an_answer(spark, docs):
    items = spark.createDataFrame([(1, "Yes"), (2, "yes"), (3, "Really yes"), (4, ""), (5, None)], ITEMS)
    found = d.annotate(docs([(1, "I said yes to a walk."), (2, "yes"), (3, "really, he said yes")]), items).collect()
    assert {r.doc_id: sorted(h.item_id for h in r.hits) for r in found} == {1: [], 2: [], 3: [3]}
    assert sorted(r.doc_id for r in d.remove(docs([(1, "I said yes to a walk."), (2, "yes"), (3, "really, he said yes")]), items).collect()) == [1, 2]


def test_first_round_in_runs_of_passages(monkeypatch):
    """The same passages whatever the run's size, and memory that a large benchmark doesn't multiply."""
    r = random.Random(4)
    vocabulary = [f"w{int(r.paretovariate(0.9))}" for _ in range(40_000)]
    index = d.build([(i, " ".join(r.choices(vocabulary, k=40))) for i in range(3000)])
    words, row, _ = d.word_hashes(pa.array([" ".join(r.choices(vocabulary, k=20_000)), "w1 w2 w3"]))
    of, first, end = d._passages(row, 2)
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    term = np.where(index.terms[at] == words, at, -1)
    w = np.flatnonzero((term >= 0) & index.essential[term])
    pair = np.unique((np.searchsorted(first, w, "right") - 1) * len(index.terms) + term[w])
    passage, t = pair // len(index.terms), pair % len(index.terms)
    whole = d._first_round(index, passage, t)
    entries, peaks = (index.head[t + 1] - index.head[t]).sum(), []
    for limit in (1, entries // 50, entries):
        monkeypatch.setattr(d, "ROUND_ENTRIES", int(limit))
        tracemalloc.start()
        assert d._first_round(index, passage, t).tolist() == whole.tolist()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[2] / 5
    assert d._first_round(index, passage[:0], t[:0]).tolist() == []
