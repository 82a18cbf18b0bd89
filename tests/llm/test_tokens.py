import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattlens.llm import _tokenizer, packing, queries, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def strange():
    r = random.Random(1)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "1", "²", "é", "日本", "😀", "́", "\x00", "\x1c", "\x85", "　", "<|endoftext|>", "<|", "!!", "﻿", "ſ", "Ⅷ"]
    out = ["", " ", "a" * 3000, "ab" * 700, " " * 500, "\n \n", "<|endoftext|>", "<|endoftext|><|endoftext|>x"]
    return out + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(400)]


def test_counts_and_ids_match_the_library(library):
    count = token_count.counter(PATH).count
    for t in strange():
        ids = library.encode(t, add_special_tokens=False).ids
        assert count(t) == len(ids), t
        assert packing.token_ids(t, PATH).tolist() == ids, t


def test_runs_too_long_for_the_pattern(library):
    # the library's own merging of such runs is slow: compare the pieces' path on ordinary texts, and long runs by length
    for t in strange():
        assert packing._encode_by_pieces(t, PATH).tolist() == library.encode(t, add_special_tokens=False).ids, t
    run = "a" * 1_200_000 + "<|endoftext|>" + " " * 1_100_000 + "b"
    ids = packing.token_ids(run, PATH)
    assert len(ids) == token_count.counter(PATH).count(run)
    v = _tokenizer.vocabulary(PATH)
    names = {i: b for b, i in v.ranks().items()} | {i: s.encode() for s, i in v.special.items()}
    assert b"".join(names[i] for i in ids.tolist()).decode() == run


def test_every_code_point_splits_alike(library):
    count = token_count.counter(PATH).count
    for block in range(0, 0x110000, 0x400):
        t = "".join(f"a{c}b {c}1{c}{c} !{c}" for c in map(chr, range(block, block + 0x400)) if not 0xD800 <= ord(c) < 0xE000)
        assert count(t) == len(library.encode(t, add_special_tokens=False).ids), hex(block)


def test_segments_change_nothing(library):
    for t in strange():
        assert "".join(_tokenizer.segments(t, 5)) == t
        if "<|endoftext|>" not in t:
            assert [i for s in _tokenizer.segments(t, 5) for i in library.encode(s, add_special_tokens=False).ids] == library.encode(t, add_special_tokens=False).ids, t


def test_op2_over_whole_table(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op2_token_counts(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert tuple(got[r.doc_id]) == (r.doc_id, len((r.text or "").encode()), n, n > 512)


def test_count_edge_cases(docs):
    df = docs([(None, None), (1, ""), (1, ""), (2, "x " * 50000)]).withColumn("n_tokens", F.lit("old"))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_count.count_tokens(df).collect()) == [("1", 0, 0), ("1", 0, 0), ("2", 100000, 50001), ("None", 0, 0)]
    assert token_count.count_tokens(docs([])).count() == 0


def check_packing(rows, texts, library, capacity=2048):
    """Every id in exactly one piece; sequences gapless, within capacity, each document's ids whole."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    tokens = sum(r.length for r in rows)
    return len(seqs) * capacity - tokens, tokens


def test_op4_over_whole_table(spark, library):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    padding, tokens = check_packing(queries.op4_packing(spark, SF).collect(), texts, library)
    assert padding < 2048 + 0.01 * tokens


def test_packing_edge_cases(docs, library):
    texts = [(1, None), (2, ""), (3, "word " * 9000), (4, "a"), (5, "x" * 5000), (None, "null id"), (6, "<|endoftext|> in the text")]
    rows = packing.pack(docs(texts).repartition(3)).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(rows, texts, library)
    assert packing.pack(docs([])).count() == 0
    twice = packing.pack(docs([(7, "same"), (7, "same")]).withColumn("start", F.lit("mine")).withColumn("ids", F.lit("x"))).collect()
    assert len(twice) == 2 and {r.offset for r in twice} == {0, twice[0].length}


def test_cut_lengths_fill_classes():
    for n in range(0, 5000):
        own = packing.cut_lengths(n)
        assert sum(own) == n and all(0 < x <= 2048 for x in own)
        assert all(2048 % x == 0 for x in own[:-1])


def test_few_long_texts_get_several_tasks(docs, monkeypatch):
    df = docs([(i, f"word {i} " * 300) for i in range(12)]).repartition(4)
    assert packing.pack(df).rdd.getNumPartitions() == 1
    whole = {r.doc_id: r.n for r in packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    monkeypatch.setattr(packing, "WORKER_BYTES", 5000)
    spread = packing.pack(df)
    assert spread.rdd.getNumPartitions() == 4
    assert {r.doc_id: r.n for r in spread.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == whole
