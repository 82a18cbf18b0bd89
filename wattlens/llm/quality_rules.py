"""Rule bitmask ledger for document quality.

``ledger`` measures every text once and stores the measurements and one failure bit per rule.
Policies are versioned sets of rules (bit masks) applied to the stored bits, so a policy can be
changed, or a rule taken out, without reading any text again. ``ablations`` counts by failure mask
(at most 2**len(RULES) rows) and derives every rule's effect from the masks with bitwise operations.

Defined results: a null or empty text has no words and fails ``few_words``. Rows are judged one by
one, so repeated rows, ties and null ids give one ledger row each. An empty table gives an empty
ledger. Other columns of the input pass through unless their name is one of the ledger's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text

#: Words in a repeated-passage window.
REPEAT_WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_letters", "n_upper", "n_letter_words", "n_echo_words")

#: Rule name -> SQL condition under which a text fails it, over the measurements. The position is the bit.
RULES = {
    "few_words": "n_words < 10",
    "repeated_passages": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "upper_case": "n_words >= 10 AND 10 * n_upper > 4 * n_letters",
    "non_words": "10 * n_letter_words < 7 * n_words",
    "echoed_words": "10 * n_echo_words > 3 * n_words",
    "word_length": "n_words >= 10 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}

#: Policy version -> its rules.
POLICIES = {
    "base": ("few_words", "repeated_passages"),
    "v1": tuple(RULES),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER_OR_WIDE = _LETTER.copy()
_LETTER_OR_WIDE[0x80:] = True
_CODE_POINT = (np.arange(256) & 0xC0) != 0x80


def _again(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does the same key stand earlier in its row; does it stand anywhere else in it."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    earlier, anywhere = np.zeros(len(k), bool), np.zeros(len(k), bool)
    earlier[order], anywhere[order] = same[:-1], same[:-1] | same[1:]
    return earlier, anywhere


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of every text of one buffer. Words and lines are compared by 64-bit hashes, long ones by XXH64."""
    n = len(offs) - 1
    start, end, row = _text.words(buf, offs)
    prefix = _text.byte_prefix(buf)
    n_words = _text.count_per_row(row, n)
    word = _text.safe_hash(buf, prefix, start, end)

    grams = _text.gram_hash(word, REPEAT_WINDOW)
    whole = row[: len(grams)] == row[REPEAT_WINDOW - 1:]
    at = np.flatnonzero(whole)
    _, repeated = _again(grams[at], row[at])
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, at[repeated], 1)
    np.add.at(cover, at[repeated] + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0

    line_start, line_end, line_row = _text.runs(buf != 0x0A, offs)
    with_word = _text.sum_between(~_text.SPACE[buf], line_start, line_end) > 0
    line_start, line_end, line_row = line_start[with_word], line_end[with_word], line_row[with_word]
    earlier, _ = _again(_text.safe_hash(buf, prefix, line_start, line_end), line_row)

    echo = np.zeros(len(word), bool)
    echo[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    lettered = _text.sum_between(_LETTER_OR_WIDE[buf], start, end) > 0

    def per_text(flags: np.ndarray) -> np.ndarray:
        return _text.sum_between(flags, offs[:-1], offs[1:])

    return {
        "n_words": n_words,
        "word_chars": per_text(_CODE_POINT[buf] & ~_text.SPACE[buf]),
        "n_symbols": per_text(_SYMBOL[buf]),
        "n_dup_lines": _text.count_per_row(line_row, n, earlier),
        "n_repeat_words": _text.count_per_row(row, n, covered),
        "n_lines": _text.count_per_row(line_row, n),
        "n_letters": per_text(_LETTER[buf]),
        "n_upper": per_text(_UPPER[buf]),
        "n_letter_words": _text.count_per_row(row, n, lettered),
        "n_echo_words": _text.count_per_row(row, n, echo),
    }


def failure_bits() -> F.Column:
    """All rules as one bit mask over the measurements."""
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def policy_mask(version: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[version])


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` of every row, beside the input's columns."""
    carried = [c for c in docs.columns if c not in (*MEASURES, "fail_bits")]
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, text_col):
            found = measure(*_text.utf8(part.column(text_col)))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[m], pa.int64()) for m in MEASURES)],
                                             names=[*carried, *MEASURES])

    return docs.select(*(F.col(f"`{c}`") for c in carried)).mapInArrow(run, schema).withColumn("fail_bits", failure_bits())


def kept(version: str, bits: str = "fail_bits") -> F.Column:
    """Does a row pass the policy?"""
    return F.col(bits).bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """The ledger rows that pass the policy."""
    return rows.where(kept(version))


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that fail it alone (kept again without the rule), rows the policy keeps."""
    mask = policy_mask(version)
    by_mask = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    wanted = [i for i, name in enumerate(RULES) if name in POLICIES[version]]
    sums = [F.sum("n").alias("n_rows"), F.sum(F.when(F.col("bits") == 0, F.col("n"))).alias("n_kept")]
    for i in wanted:
        bit = F.lit(1 << i).cast("long")
        sums += [F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n"))).alias(f"f{i}"),
                 F.sum(F.when(F.col("bits") == bit, F.col("n"))).alias(f"o{i}")]
    names = list(RULES)
    entries = [F.struct(F.lit(version).alias("policy"), F.lit(names[i]).alias("rule"),
                        F.coalesce(f"f{i}", F.lit(0)).alias("n_failed"), F.coalesce(f"o{i}", F.lit(0)).alias("n_failed_alone"),
                        F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
               for i in wanted]
    return by_mask.agg(*sums).select(F.inline(F.array(*entries)))
