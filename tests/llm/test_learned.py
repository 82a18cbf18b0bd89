"""Language ID and the quality classifier: held-out accuracy, spans, exact parts, edge cases."""

import itertools
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattlens.llm import _learn, _text, language_id, quality_classifier, queries
from wattlens.session import cut_lineage

SF = "/root/testdata/sf0.01"


def test_held_out_is_crc32_of_the_text_id(spark):
    ids = list(range(-20, 400))
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", _learn.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return language_id.learn(documents)


def test_op1_on_held_out_documents(spark, documents):
    got = queries.op1_language_id(spark, SF).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == documents.count() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_spans_of_mixed_text(documents, model, docs):
    parts = {lang: [r.text[:400] for r in documents.where(F.col("lang") == lang).where("length(text) > 500").orderBy("doc_id").limit(3).collect()] for lang in ("de", "es")}
    mixed = parts["de"][1] + "\n" + parts["es"][1]
    r = language_id.identify(docs([(1, mixed)]), model).first()
    de = sum(s.end - s.start for s in r.spans if s.lang == "de" and s.start < 400)
    es = sum(s.end - s.start for s in r.spans if s.lang == "es" and s.start > 380)
    assert de > 250 and es > 250 and 0.3 < r.score < 0.8
    assert all(0 <= s.start < s.end <= len(mixed) for s in r.spans)


def test_language_edge_cases(model, docs):
    rows = [(1, None), (2, ""), (3, "123 !!! 456"), (None, "The of and the"), (4, "The of and the"), (4, "The of and the"), (5, "日本語"), (6, "😀 the"), (7, "x" * 300000)]
    df = docs(rows).withColumn("score", F.lit("old"))
    got = language_id.identify(df, model).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i in (1, 2, 3):
        assert by[i][0].lang_pred == "und" and by[i][0].score == 0.0 and by[i][0].spans == []
    assert len(by[4]) == 2 and by[4][0] == by[4][1] and by[None][0].lang_pred == by[4][0].lang_pred == "en"
    assert by[5][0].lang_pred in model.languages and by[7][0].lang_pred in model.languages
    assert language_id.identify(docs([]), model).count() == 0
    nothing = language_id.learn(docs([]))
    assert [r.lang_pred for r in language_id.identify(docs([(1, "the of")]), nothing).collect()] == ["und"]


def test_scripts_narrow_candidates(docs):
    rows = [(i, t) for i, t in enumerate(["слово дело тело"] * 20 + ["word deed body"] * 20)]
    df = docs(rows).withColumn("lang", F.when(F.col("doc_id") < 20, "ru").otherwise("en"))
    m = language_id.learn(df)
    got = language_id.identify(docs([(100, "новый"), (101, "new")]), m).collect()
    assert [r.lang_pred for r in sorted(got)] == ["ru", "en"]


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(3)
    row = np.repeat([0, 2, 3], [5, 1, 4])
    scores, prior = r.normal(size=(10, 3)), r.normal(size=3)
    label = language_id.viterbi(scores, row, prior, 0.7)
    for k in (0, 2, 3):
        own = scores[row == k]
        def value(path, own=own):
            return prior[path[0]] + sum(own[i, x] for i, x in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(3), repeat=len(own)), key=value)
        assert value(tuple(label[row == k])) == pytest.approx(value(best))


def test_texts_without_a_letter_are_und(model, docs):
    """Marks and emoji are no letters; a mark beside a letter is part of its word."""
    rows = list(enumerate(["\u2764\ufe0f 123", "1\ufe0f\u20e3", "\u0301", "\u0301\u0308 \u093e", "12 \u0903 34", "e\u0301t\u0301", "7\u0301 cafe\u0301"]))
    got = {r.doc_id: r for r in language_id.identify(docs(rows), model).collect()}
    for i in range(5):
        assert (got[i].lang_pred, got[i].score, got[i].spans) == ("und", 0.0, [])
    assert all(got[i].lang_pred in model.languages for i in (5, 6))
    assert [(s.start, s.end) for s in got[6].spans] == [(3, 8)]


def test_every_language_is_learned(spark):
    """70 languages of one word family each, the rarest with few texts; fewer buckets for more languages."""
    data = [(k * 100 + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}{chr(97 + k % 26)}" for w in ("ta", "mo", "ri", "su")), f"l{k:02}")
            for k in range(70) for i in range(6 + k % 5)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    m = language_id.learn(df)
    assert len(m.languages) == 70 and m.scores.shape[1] == language_id.BUCKETS // 2 + 1
    got = language_id.identify(df, m).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(got)
    assert [language_id.buckets_for(n) for n in (0, 1, 64, 65, 128, 129, 1 << 14)] == [1 << 16, 1 << 16, 1 << 16, 1 << 15, 1 << 15, 1 << 14, 1 << 8]


def test_long_texts_are_scored_in_runs(model, docs, monkeypatch):
    """The same words, spans and language as at once, and memory that many languages don't multiply by characters."""
    text = "".join(f"The house {i} \u00e4 stra\u00dfe une maison, el perro " for i in range(400))
    texts = [text, "x" * 9000, "y" * 4000 + " " + "the of and " * 200, "  "]
    whole = [language_id.identify(docs([(i, t)]), model).first() for i, t in enumerate(texts)]
    monkeypatch.setattr(language_id, "RUN_BYTES", 1000)
    for t, want in zip(texts, whole, strict=True):
        names, score, spans = (x.to_pylist()[0] for x in language_id._label(model, *_text.utf8(pa.array([t]))))
        assert (names, spans) == (want.lang_pred, [s.asDict() for s in want.spans]) and score == pytest.approx(want.score)


def test_memory_of_a_long_text_with_many_languages():
    r = np.random.default_rng(1)
    m = language_id.Model([f"l{i:02}" for i in range(64)], r.normal(size=(3, language_id.BUCKETS + 1, 64)).astype(np.float32),
                          np.ones((len(language_id._SCRIPT_NAMES), 64), bool), np.zeros(64))
    text = ("lettersinalongword" * 2 + " ") * 17_000  # 630 KB, 17,000 words
    language_id._tables()
    tracemalloc.start()
    language_id._label(m, *_text.utf8(pa.array([text])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 190 << 20, peak  # all characters at once: 630,000 x 64 x 4 bytes, 160 MB, for each of several arrays


def test_op5_scores_equal_a_plain_scorer(spark, documents):
    """Every document's score from the learned model, block by block in plain Python."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m = quality_classifier.learn(documents.select("doc_id", "text"), labels)
    got = {r.doc_id: r for r in queries.op5_quality_classifier(spark, SF).collect()}
    good, bad = quality_classifier._compressor(m.good), quality_classifier._compressor(m.bad)
    for r in documents.select("doc_id", "text").collect():
        b = (r.text or "").encode()
        blocks = [b[x:x + quality_classifier.BLOCK_BYTES] for x in range(0, len(b), quality_classifier.BLOCK_BYTES)]
        gain = sum(len(bad.compress(x)) - len(good.compress(x)) for x in blocks) / max(len(b), 1)
        want = float(m.calibrate(np.array([gain]))[0])
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-9) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)


def test_op1_labels_equal_a_plain_scorer(spark, documents, model):
    """Every document of the query against words, grams and Viterbi in plain Python."""
    got = {r.doc_id: r for r in queries.op1_language_id(spark, SF).collect()}
    n = len(model.languages)
    for r in documents.where("length(text) < 700").select("doc_id", "text").collect():
        words, here = [], None
        for i, ch in enumerate(r.text + " "):
            kind = unicodedata.category(ch)[0]
            if kind in "LM":
                here = here or [i, "", False]
                here[1] += ch
                here[2] |= kind == "L"
            elif here:
                words += [here] if here[2] else []
                here = None
        rows = []
        for start, word, _ in words:
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
            padded, score = " " + low + " ", np.zeros(n)
            for order, table in zip(language_id.ORDERS, model.scores, strict=True):
                for end in range(2, len(padded) + 1):
                    gram = padded[max(end - order, 0):end]
                    if len(gram) == order:
                        h = np.uint64(order)
                        with np.errstate(over="ignore"):
                            for c in reversed(gram):
                                h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(ord(c))
                        score += table[int(_text.mix(np.array([h]))[0] % np.uint64(language_id.BUCKETS))]
            script = language_id._RANGE_SCRIPT[np.searchsorted(language_id._RANGE_START, ord(word[0]), "right") - 1]
            may = model.allowed[script]
            score = np.where(may, score * language_id.GRAM_WEIGHT, language_id._EXCLUDED) if may.any() else np.zeros(n)
            rows.append(score)
        letters = np.zeros(n)
        if rows:
            best = [(rows[0], None)]
            for s in rows[1:]:
                prev = best[-1][0]
                top = int(np.argmax(prev))
                stay = prev >= prev[top] - language_id.SWITCH_PENALTY
                best.append((np.where(stay, prev, prev[top] - language_id.SWITCH_PENALTY) + s, np.where(stay, np.arange(n), top)))
            at = int(np.argmax(best[-1][0]))
            for (_, back), (_, word, _) in zip(reversed(best), reversed(words), strict=True):
                letters[at] += len(word)
                at = at if back is None else int(back[at])
        want = model.languages[int(letters.argmax())] if rows else "und"
        assert got[r.doc_id].lang_pred == want, r.doc_id
        assert got[r.doc_id].score == pytest.approx(letters.max() / letters.sum() if rows else 0.0, abs=0.02)


def test_op5_on_held_out_documents(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op5_quality_classifier(spark, SF).toPandas()
    assert len(got) == documents.count() and got.score.between(0, 1).all()
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert (held.predicted == held.quality).mean() > 0.9 and good.mean() > bad.mean() + 0.4


def test_difference_covers_whole_texts():
    good, bad = b"the quick brown fox jumps over " * 8, b"@@##%%&&**!!" * 20
    texts = ["", "the quick brown fox " * 100, "@@##%%&&** " * 100, "é" * 5000]
    got = quality_classifier.difference(*_text.utf8(pa.array(texts)), good, bad)
    for t, d in zip(texts, got):
        b = t.encode()
        gain = sum(len(quality_classifier._compressor(bad).compress(b[x:x + 256])) - len(quality_classifier._compressor(good).compress(b[x:x + 256])) for x in range(0, len(b), 256))
        assert d == pytest.approx(gain / max(len(b), 1))
    assert got[1] > 0 > got[2]


def test_isotonic_is_monotone_and_keeps_the_mean():
    r = np.random.default_rng(0)
    x = r.normal(size=500).round(1)
    y = (r.random(500) < 1 / (1 + np.exp(-3 * x))).astype(float)
    at, value = quality_classifier.isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(value) > 0).all() and value.min() >= 0 and value.max() <= 1
    assert quality_classifier.isotonic(np.zeros(30), y[:30])[1].tolist() == [y[:30].mean()]


def test_classifier_edge_cases(spark, docs):
    labels = "doc_id long, quality int, toxic int"
    none = quality_classifier.learn(docs([]), spark.createDataFrame([], labels))
    df = docs([(None, None), (1, ""), (1, ""), (2, "text " * 100000)]).withColumn("score", F.lit("x"))
    assert [r.score for r in quality_classifier.score(df, none).collect()] == [0.5] * 4
    assert quality_classifier.score(docs([]), none).count() == 0
    one = quality_classifier.learn(docs([(i, f"word {i}") for i in range(30)]), spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 0, 0), (5, None, 0)], labels))
    assert {r.score for r in quality_classifier.score(df, one).collect()} == {1.0}


def test_classifier_takes_one_text_of_a_repeated_id(spark, documents):
    some = cut_lineage(documents.where("text IS NOT NULL").select("doc_id", "text").orderBy("doc_id").limit(60))
    labels = some.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    first = some.join(labels.where(~_learn.held_out("doc_id")), "doc_id").orderBy("doc_id").limit(4).select("doc_id", "text")
    once, often = (quality_classifier.learn(d, labels) for d in (some, some.unionByName(first.crossJoin(spark.range(50)).select("doc_id", "text"))))
    assert (once.good, once.bad) == (often.good, often.bad)
    assert [x.tolist() for x in once[2:]] == [x.tolist() for x in often[2:]]
