"""The Merkle manifest against a plain tree built row by row."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wattlens.llm import merkle, queries

from .conftest import DOCS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes):
    """Each leaf's siblings, level by level, and what remains."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            run = at[i] // 8 * 8
            path.append(("".join(nodes[run:at[i]]), "".join(nodes[at[i] + 1:run + 8])))
            at[i] //= 8
        nodes = [h("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return paths, nodes[0]


def expected(rows):
    """Rows of the query for (doc_id, text, lang, source, n_chars) rows."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], leaf(r[0], r[3], r[2], r[4], r[1]), r))
    langs = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    grown = []
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        grown.append(tree([x[1] for x in groups[lang]]))
    if not langs:
        return []
    upper, root = tree([top for _, top in grown])
    out = []
    for lang, (paths, top), above in zip(langs, grown, upper, strict=True):
        for (doc_id, own, r), path in zip(groups[lang], paths, strict=True):
            path = path + above
            text = r[1]
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                text = text.translate(LOWER)
            folded = leaf(doc_id, r[3], lang, r[4], text)
            for left, right in path:
                folded = h(left + folded + right)
            out.append((doc_id, own, top, root, h("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, queries.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("n", [1, 8, 9, 65, 600])
def test_sizes_of_groups(spark, tmp_path, n):
    """Full runs, a last run of one, several levels; one language has all rows but a few."""
    rows = [(i, f"Text {i} ÄB", "en", "s", i) for i in range(n)] + [(n + 1, "x", "de", None, 1), (n + 2, "Y", None, "t", None)]
    random.Random(n).shuffle(rows)
    assert run(spark, tmp_path, rows) == expected(rows)


def test_nulls_ties_and_odd_texts(spark, tmp_path):
    """Null ids and fields, empty and long texts, repeated ids, wholly repeated rows, names that sort bytewise."""
    rows = [(None, "A", "en", "s", 1)] * 3 + [(None, None, "en", None, None), (7, "A", "en", "s", 1), (7, "B", "en", "s", 1)] + [(9, "Same", "en", "s", 4)] * 20
    rows += [(10, "", "Z", "s", 0), (11, "q" * 300_000 + "É", "é", "s", 5), (12, None, "a", "s", None), (13, "K", "", "s", 1), (-5, "K", "zz\U0001f600", "s", 1), (14, "L", "zz￮", "s", 1)]
    assert run(spark, tmp_path, rows) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_blocks_of_windows_hold_whole_runs(spark, monkeypatch):
    """Several blocks in a level, and other columns with the names of added and internal ones."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), *(F.lit(c).alias(c) for c in (
        "g", "o", "row", "digest", "pos", "size", "tie", "at", "run", "upper", "top", "left", "right", "first", "n", "part", "path", "root", "leaf", "subroot")))
    out = merkle.manifest(rows, merkle.leaf_digest(F.col("doc_id")), F.col("lang"), [F.col("doc_id")]).collect()
    paths, root = tree([leaf(i) for i in range(300)])
    assert len(out) == 300
    for r in out:
        assert (r["leaf"], r["subroot"], r["root"], r["digest"], r["upper"]) == (leaf(r.doc_id), root, root, "digest", "upper")
        assert [(s.left, s.right) for s in r.path] == paths[r.doc_id]


def test_folding_finds_tampered_rows(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    out = merkle.manifest(rows, merkle.leaf_digest(F.col("doc_id")), F.col("lang"), [F.col("doc_id")])
    claim = merkle.leaf_digest(F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") + 1000).otherwise(F.col("doc_id")))
    bad = out.where(merkle.fold(claim, F.col("path")) != F.col("root")).select("doc_id").collect()
    assert sorted(r.doc_id for r in bad) == list(range(0, 100, 10))


def test_no_task_holds_a_language(spark):
    """The plan's windows are partitioned by blocks, never by the group alone."""
    rows = spark.range(100).select(F.col("id").alias("pos"), F.lit("en").alias("g"), F.lit("d").alias("digest"), F.lit(100).alias("size"))
    plan = merkle._with_siblings(rows)._jdf.queryExecution().executedPlan().toString()
    exchange = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert exchange and all("FLOOR" in line or "_w0" in line for line in exchange)
