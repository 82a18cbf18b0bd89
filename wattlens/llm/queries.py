"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlens.session import scratch_path, ship_package

from . import (_learn, centroids, decontaminate, language_id, merkle, ngram_join, packing, quality_classifier, quality_rules, simhash, substring_dedup,
               suffix_dedup, token_count, warc)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    rows = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs))
    return rows.select("doc_id", _learn.held_out("doc_id").alias("held_out"), "lang_pred", "score", "spans")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_count.count_tokens(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = decontaminate.annotate(_documents(spark, sf_dir).select("doc_id", "text"), items)
    return rows.select("doc_id", F.inline("hits"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(_documents(spark, sf_dir))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = quality_classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = quality_classifier.score(docs, model)
    return rows.select("doc_id", _learn.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"), shingle=3, radius=2)
    return rows.select("doc_id", simhash.hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = warc.round_trip(spark, pages, scratch_path(spark, f"warc-{uuid.uuid4().hex}"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality_rules.kept("base")).alias("base_failed"), quality_rules.kept("v1").alias("kept"), "fail_bits")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))

    def leaf(text: F.Column) -> F.Column:
        return merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    # texts become digests in the first step and travel no further
    rows = merkle.manifest(docs.select("doc_id", "lang", leaf(F.col("text")).alias("own"), leaf(tampered).alias("claimed")),
                           F.col("own"), F.col("lang"), [F.col("doc_id")])
    folded = rows.withColumn("folded_root", merkle.fold(F.col("claimed"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    digest = F.sha2(F.array_join("centroid", ","), 256)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_documents(spark, sf_dir).select("doc_id", "text"), k=5, percent=80)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

_OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND (page_id IS NULL OR page_id > first_id) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest
"""

_OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM d
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM t)
), counted AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM counted WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words,
         len(l) AS n_lines,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echo_words
  FROM t LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, {bits} AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & {base} <> 0 AS base_failed, fail_bits & {v1} = 0 AS kept, fail_bits
FROM b
""".replace("{bits}", " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(quality_rules.RULES.values()))
            ).replace("{base}", str(quality_rules.policy_mask("base"))).replace("{v1}", str(quality_rules.policy_mask("v1")))

_OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM windows) WHERE m < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM repeated) GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS kept, count(*) AS n
  FROM words ANTI JOIN (SELECT doc_id, unnest(p) AS i FROM gone) g ON words.doc_id = g.doc_id AND words.i = g.i
  GROUP BY words.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

#: Levels that the SQL grows: 8 ** 10 rows of a language, and languages, at most.
_OP11_LEVELS = 10


def _op11_tree(name: str, rows: str) -> str:
    """CTEs that grow ``rows`` (g, pos, digest) to one node a group: {name}_leaf (g, pos, left and right digest lists) and {name}_top."""
    parts = [f"{name}_0 AS (SELECT g, pos, digest, count(*) OVER (PARTITION BY g) AS n FROM ({rows}))"]
    for i in range(_OP11_LEVELS):
        parts.append(f"{name}_{i + 1} AS (SELECT g, pos // 8 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest, (any_value(n) + 7) // 8 AS n"
                     f" FROM {name}_{i} WHERE n > 1 GROUP BY g, pos // 8 UNION ALL SELECT g, pos, digest, n FROM {name}_{i} WHERE n = 1)")
        # a lone node waits for the last level without another hash
        parts.append(f"{name}_s{i} AS (SELECT g, pos, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY g, pos // 8 ORDER BY pos"
                     f" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '' ORDER BY pos) OVER ("
                     f"PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r FROM {name}_{i})")
    joins = "".join(f" JOIN {name}_s{i} s{i} ON s{i}.g = a.g AND s{i}.pos = a.pos // {8 ** i}" for i in range(_OP11_LEVELS))
    lists = ", ".join(f"list_filter([{', '.join(f's{i}.{c}' for i in range(_OP11_LEVELS))}], lambda x: x IS NOT NULL) AS {c}" for c in "lr")
    parts.append(f"{name}_path AS (SELECT a.g, a.pos, {lists} FROM {name}_0 a{joins})")
    parts.append(f"{name}_top AS (SELECT g, digest FROM {name}_{_OP11_LEVELS})")
    return ", ".join(parts)


def _op11_field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


_OP11_LEAF = " || ".join(map(_op11_field, ("doc_id", "source", "lang", "n_chars")))
#: CRC-32 of the decimal id, bit by bit.
_OP11_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),"
             " lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),"
             " lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)")
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_OP11_LEAF} || {_op11_field("text")}) AS leaf,
         sha256({_OP11_LEAF} || {_op11_field(f"CASE WHEN {_OP11_CRC} % 3 = 0 THEN translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}') ELSE text END")}) AS claimed
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), {_op11_tree("a", "SELECT g, pos, leaf AS digest FROM numbered")},
{_op11_tree("b", "SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, digest FROM a_top")},
langs AS (
  SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS pos FROM a_top
), whole AS (
  SELECT doc_id, leaf, claimed, langs.digest AS subroot, b_top.digest AS root, list_concat(a_path.l, b_path.l) AS l, list_concat(a_path.r, b_path.r) AS r
  FROM numbered JOIN a_path ON numbered.g = a_path.g AND numbered.pos = a_path.pos
  JOIN langs ON numbered.g = langs.g JOIN b_path ON langs.pos = b_path.pos CROSS JOIN b_top
), folded AS (
  SELECT *, list_reduce(list_prepend([claimed, ''], list_transform(range(1, len(l) + 1), lambda i: [l[i], r[i]])),
                        lambda x, y: [sha256(y[1] || x[1] || y[2]), ''])[1] AS folded_root,
         array_to_string(list_transform(range(1, len(l) + 1), lambda i: l[i] || r[i]), '') AS siblings
  FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def _op12_sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256) -> str:
    parts = [f"""kept AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dim}
), x AS (
  SELECT k, unnest(range(1, {dim + 1})) AS i, unnest(v) AS x FROM kept
), c0 AS (
  SELECT c, unnest(range(1, {dim + 1})) AS i, unnest(v) AS x
  FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS c FROM kept) WHERE c < {k}
)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
  SELECT k, c, d FROM (SELECT x.k, c.c, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{r} c ON x.i = c.i GROUP BY x.k, c.c)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, c) = 1
)""")
        if r < rounds:
            parts.append(f"""m{r} AS (
  SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} JOIN x ON a{r}.k = x.k GROUP BY c, i
), c{r + 1} AS (
  SELECT c.c, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x)::BIGINT AS x FROM c{r} c LEFT JOIN m{r} m ON c.c = m.c AND c.i = m.i
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} a JOIN kept ON a.k = kept.k JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) f ON a.c = f.c
"""


_OP13_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM t
), sizes AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT u, v FROM shared JOIN sizes a ON u = a.doc_id JOIN sizes b ON v = b.doc_id WHERE 100 * o >= 80 * (a.n + b.n - o)
), reached AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u
)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(t.doc_id, m) AS component_id
FROM t LEFT JOIN sizes ON t.doc_id = sizes.doc_id LEFT JOIN (SELECT u, min(v) AS m FROM reached GROUP BY u) r ON t.doc_id = r.u
"""

ORACLE_SQL = {
    "op7_substring_dedup": _OP7_SQL,
    "op9_warc": _OP9_SQL,
    "op10_quality_rules": _OP10_SQL,
    "op11_merkle_manifest": _OP11_SQL,
    "op12_centroid_clustering": _op12_sql(),
    "op13_ngram_jaccard_join": _OP13_SQL,
}
