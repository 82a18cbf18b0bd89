"""The pipeline, stage by stage, against brute force on whole tables."""

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from wattlens.llm import _tokenizer, quality_rules

from . import test_decontaminate, test_quality_rules, test_repeats, test_simhash

SF = "/root/testdata/sf0.001"


def without(data, gone):
    """The characters of which no byte is gone."""
    out, at = [], 0
    for ch in data.decode():
        n = len(ch.encode())
        if not gone & set(range(at, at + n)):
            out.append(ch)
        at += n
    return "".join(out)


def brute(rows, items):
    """(id, text) rows after the four filtering stages."""
    def fails(text):
        m = test_quality_rules.brute(text)
        return any(eval(c.replace("AND", "and").replace("OR", "or"), {}, m) for c in quality_rules.RULES.values())
    rows = sorted((i, t) for i, t in rows if not fails(t))
    comp = test_simhash.brute_components([test_simhash.brute_print(t) for _, t in rows])
    rows = [r for k, r in enumerate(rows) if comp[k] == k]
    data = [(i, t.encode()) for i, t in rows]
    rows = []
    for (i, b), gone in zip(data, test_repeats.cover(data)):
        if not gone or len(gone) < len(b):
            rows.append((i, without(b, gone)))
    leaks = {i for i, _ in test_decontaminate.brute(rows, items)}
    return [r for r in rows if r[0] not in leaks]


def test_run_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert 0 < len(want) < len(docs)
    library = Tokenizer.from_file(_tokenizer.default_path())
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sorted(got) == [i for i, _ in want]
    for i, text in want:
        ids = [x for r in sorted(got[i], key=lambda r: r.start) for x in r.ids]
        assert ids == [*library.encode(text, add_special_tokens=False).ids, 1]
        assert all(len(r.ids) == r.length and r.doc_tokens == len(ids) for r in got[i])


def test_stages_keep_columns_and_take_odd_rows(spark, docs, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = [" ".join(f"{w}{i}{k}" for i, w in enumerate("some plain words that make up one text which is long enough".split())) for k in range(3)]
    leak = "before it alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu after it"
    rows = [(1, good[0]), (2, good[0]), (2, good[0]), (3, good[1]), (3, good[1]), (4, None), (None, good[2]), (None, good[2]), (5, ""), (6, leak), (7, "é" * 400), (None, None)]
    df = docs(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.dtypes == df.dtypes, name
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in df.collect()) == sorted([("1", good[0], len(good[0])), ("3", good[1], len(good[1])), ("None", good[2], len(good[2]))])
    assert corpus_pipeline.pack(spark, df, str(tmp_path)).count() == 3
    assert corpus_pipeline.pack(spark, df.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, docs, name, stage):
    assert stage(spark, docs([]), SF).count() == 0
