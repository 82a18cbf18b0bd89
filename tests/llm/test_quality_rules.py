import random
import re
from collections import Counter

from pyspark.sql import functions as F

from wattlens.llm import quality_rules as q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    c, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if c[g] > 1:
            cover.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "n_lines": len(lines),
            "n_letters": len(re.findall("[A-Za-z]", text)), "n_upper": len(re.findall("[A-Z]", text)),
            "n_letter_words": sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w),
            "n_echo_words": sum(a == b for a, b in zip(w, w[1:]))}


def texts():
    r = random.Random(7)
    out = [None, "", " \n\t ", "x", "a\nb\na\n \na", "é" * 50, "one two three four five one two three four five", "\x00 \x00",
           "a b " * 4000, "😀 😀 😀 **", "\r\nA\x0bB\x0cC D E"]
    for _ in range(120):
        out.append("".join(r.choice(["a", "b ", "ü", "\n", "c d ", "# ", "AB ", "  ", "a b c d e "]) for _ in range(r.randint(0, 80))))
    return out


def test_measures_match_brute_force(docs):
    ts = texts()
    got = q.ledger(docs(list(enumerate(ts)))).collect()
    assert len(got) == len(ts)
    for row in got:
        assert {m: row[m] for m in q.MEASURES} == brute(ts[row.doc_id]), ts[row.doc_id]


def test_empty_table_null_ids_repeats_and_clashing_columns(spark, docs):
    assert q.ledger(docs([])).count() == 0
    df = docs([(None, "a b"), (1, None), (1, None)]).withColumn("n_words", F.lit("mine")).withColumn("a b", F.lit(1))
    rows = q.ledger(df).collect()
    assert sorted(r.n_words for r in rows) == [0, 0, 2] and all(r["a b"] == 1 for r in rows)


def test_policies_and_ablations(docs):
    good = " ".join(f"word{i}" for i in range(40))
    ts = [good, "few words", "## " + good.replace(" ", " ## "), " ".join(["SHOUT" + "ABCDEFGH"[i % 8] * (i + 1) for i in range(12)])]
    rows = q.ledger(docs(list(enumerate(ts))))
    assert [r.doc_id for r in q.apply_policy(rows, "v1").orderBy("doc_id").collect()] == [0]
    ab = {r.rule: r for r in q.ablations(rows, "v1").collect()}
    assert set(ab) == set(q.RULES) and ab["few_words"].n_failed == 1 and ab["few_words"].n_failed_alone == 1
    assert ab["upper_case"].n_failed == 1 and ab["symbols"].n_kept == 1 and ab["symbols"].n_rows == 4
    masks = [r.fail_bits for r in rows.collect()]
    for i, name in enumerate(q.RULES):
        assert ab[name].n_failed == sum(m >> i & 1 for m in masks)
        assert ab[name].n_failed_alone == sum(m == 1 << i for m in masks)
    assert q.ablations(rows.limit(0), "v1").count() == len(q.RULES)


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_patterns_that_polynomial_hashes_confuse(docs):
    """Different lines and words count as different, whatever their pattern."""
    a, b = thue_morse(4096)
    ts = [a + "\n" + b, a + "\n" + b + "\n" + a, f"w x {a} y z w x {b} y z", f"w x {a} y z w x {a} y z", f"{a} {b} {a} {a}"]
    for row in q.ledger(docs(list(enumerate(ts)))).collect():
        assert {m: row[m] for m in q.MEASURES} == brute(ts[row.doc_id]), row.doc_id
