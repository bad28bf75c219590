"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainshed.llm import byte_bpe, collocations, decontamination, hard_negatives, language, language_model, mixing, quality, simhash, token_files, topk, toxicity, url_filter
from rainshed.llm.common import fold, read

URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    s = F.col("toxicity.score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"), F.col("toxicity.spans").alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    model = language.fit(docs.where(~held))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.accepted").alias("accepted"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).documents


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.held_out_scores(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.decode(byte_bpe.encode(read(spark, sf_dir, "documents")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_topk": op2_topk,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_token_files": op6_token_files,
    "op7_mixing": op7_mixing,
    "op8_url_filters": op8_url_filters,
    "op9_decontamination": op9_decontamination,
    "op10_lm_scores": op10_lm_scores,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_byte_bpe": op13_byte_bpe,
}

#: The same takes without a schedule: a source's stream is read from its start until its quota is met.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM z),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS cap FROM n),
c AS (
  SELECT *, cap / w AS r, CAST(sum(source_size) OVER () AS DOUBLE) AS tot, sum(w) OVER () AS ws,
         coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         coalesce(sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0
  FROM w),
l AS (SELECT *, (tot - caps) / (ws - w0) AS level, (tot - caps) / (ws - w0) >= r AS stops FROM c),
t AS (
  SELECT source, source_size, round(CASE WHEN stops THEN cap ELSE w * (SELECT arg_min(level, (r, sid)) FROM l WHERE NOT stops) END, 6) AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(least(round(t.target), 3 * t.source_size) AS BIGINT) AS quota,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0::BIGINT ELSE (quota // source_size) * size + greatest(0, least(size, quota % source_size - start)) END AS taken
FROM p
"""

#: Exact containment without any index.
OP9_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
m AS (SELECT DISTINCT least(5, len(w)) AS m FROM iw WHERE len(w) > 0),
d AS (SELECT DISTINCT row, doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS s FROM dw CROSS JOIN m WHERE len(w) >= m),
i AS (SELECT DISTINCT item_id, least(5, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
p AS (SELECT row, any_value(doc_id) AS doc_id, item_id, count(*) AS shared FROM d JOIN i USING (m, s) GROUP BY row, item_id)
SELECT doc_id, item_id, CAST(shared AS INTEGER) AS shared, CAST(n AS INTEGER) AS shingles, shared / n AS containment
FROM p JOIN n USING (item_id) WHERE shared >= 0.8 * n - 1e-9
"""

OP2_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""

OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""

#: Every phrase counted outright.
OP12_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, l.a AS l, r.a AS r, CAST(2000000::HUGEINT * k.a // (l.a::HUGEINT + r.a) AS BIGINT) AS score, k
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ')
  JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT c.lang, c.a, unnest(flatten(list_transform(range(2, c.m), lambda m: list_transform(range(1, c.m - m + 2), lambda j: array_to_string(c.w[j:j + m - 1], ' '))))) AS phrase
  FROM c WHERE c.m > 2),
x AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN t USING (lang) LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op11_hard_negatives": OP11_SQL, "op12_collocations": OP12_SQL, "op2_topk": OP2_SQL, "op7_mixing": OP7_SQL, "op9_decontamination": OP9_SQL}
