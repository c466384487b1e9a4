"""The operators over their whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm import compression, licenses, lm, mixing, ngramjoin, packing, passages, sharding, tiling, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.scores(_table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_and_digest(_table(spark, sf_dir, "documents"), str(tokenizer_path))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Fixed by the contract of the query.
URL_RULES = [urls.Rule(True, "org/"), urls.Rule(False, "example.org/es/"), urls.Rule(False, "example.org/en/1"), urls.Rule(True, "com/fr/"), urls.Rule(False, "com/de/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)
    return out.withColumnRenamed("id", "page_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngramjoin.join(_table(spark, sf_dir, "documents"), settings=ngramjoin.Settings(words=3, percent=90))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lm.train(docs.filter(~lm.held_out("doc_id")).select("text"))
    return lm.scores(docs, model)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), shards=8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
classed AS (
  SELECT *, (size >= 1)::INT + (size >= 3)::INT + (size >= 7)::INT + (size >= 15)::INT + (size >= 31)::INT + (size >= 63)::INT AS class FROM sized),
per0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
per1 AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most,
         (sum(source_size) OVER ())::BIGINT * 150 / 100.0::DOUBLE AS total FROM per0),
per2 AS (
  SELECT *, most / weight::DOUBLE AS ratio FROM per1),
per3 AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / (sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM per2),
per AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN most::DOUBLE
    ELSE least(most::DOUBLE, weight * (SELECT arg_min(level, (ratio, place)) FROM per3 WHERE ratio > level)) END AS target FROM per3),
class0 AS (
  SELECT source, class, sum(size)::BIGINT AS class_size FROM classed GROUP BY source, class),
class1 AS (
  SELECT c.*, p.source_size, p.target, 2 * class_size AS most, class_size * pow(2.0::DOUBLE, class - 6) AS weight
  FROM class0 c JOIN per p ON c.source IS NOT DISTINCT FROM p.source),
class2 AS (
  SELECT *, CASE WHEN weight > 0 THEN most / weight ELSE 0 END AS ratio FROM class1),
class3 AS (
  SELECT *, CASE WHEN sum(weight) OVER after > 0 THEN (target - coalesce(sum(most) OVER before, 0)::BIGINT) / sum(weight) OVER after ELSE 0 END AS level FROM class2
  WINDOW before AS (PARTITION BY source ORDER BY ratio, class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY source ORDER BY ratio, class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
class4 AS (
  SELECT *, arg_min(level, (ratio, class)) FILTER (WHERE ratio > level) OVER (PARTITION BY source) AS line FROM class3),
plan AS (
  SELECT source, class, source_size, target, CASE WHEN class_size > 0 THEN
    least(2.0::DOUBLE, (CASE WHEN ratio <= level THEN most::DOUBLE ELSE least(most::DOUBLE, weight * line) END) / class_size) ELSE 0.0 END AS expected FROM class4),
drawn AS (
  SELECT d.id, d.source, d.size, source_size, target, floor(expected + 1e-9::DOUBLE)::BIGINT AS certain, expected - floor(expected + 1e-9::DOUBLE) AS p,
         (('0x' || substr(md5(coalesce(d.id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM classed d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source AND d.class = plan.class),
ranked AS (
  SELECT *, CASE WHEN p > 1e-9::DOUBLE THEN (u / (1 - u)) / (p / (1 - p)) END AS q,
         target - (sum(certain * size) OVER (PARTITION BY source))::BIGINT AS left1 FROM drawn),
first AS (
  SELECT *, CASE WHEN q IS NOT NULL AND left1 > 0
    AND 2 * (sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY (q IS NULL), q / (1 + q), id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size) + size <= 2 * left1
    THEN 1 ELSE 0 END AS more1 FROM ranked),
gap AS (
  SELECT *, left1 - (sum(more1 * size) OVER (PARTITION BY source))::BIGINT AS left2 FROM first),
able AS (
  SELECT *, q IS NOT NULL AND more1 = 0 AND left2 > 0 AND size <= left2 AS able FROM gap),
second AS (
  SELECT *, CASE WHEN able AND 2 * (sum(CASE WHEN able THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY (NOT able), q / (1 + q), id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size) + size <= 2 * left2
    THEN 1 ELSE 0 END AS more2 FROM able)
SELECT id AS doc_id, size, source_size, target, (certain + more1 + more2) * size AS taken, certain + more1 + more2 AS copies FROM second
"""

_JOIN_SQL = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT row, doc_id, list_sort(CASE WHEN len(w) BETWEEN 1 AND 2 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END) AS s FROM split),
classes AS (
  SELECT s, min(doc_id) AS cls, len(s) AS n FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
tokens AS (
  SELECT cls, n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.cls AS a, b.cls AS b FROM tokens a JOIN tokens b ON a.g = b.g AND a.cls <> b.cls AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (
  SELECT cls AS node, cls AS c FROM classes UNION SELECT links.b, reached.c FROM reached JOIN links ON links.a = reached.node),
component AS (
  SELECT node, min(c) AS c FROM reached GROUP BY node)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(c, sets.doc_id) AS component_id, coalesce(cls, sets.doc_id) AS class_id
FROM sets LEFT JOIN classes ON sets.s = classes.s AND sets.doc_id IS NOT NULL LEFT JOIN component ON node = cls
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_token_output, op4_decontamination, op5_url_filter, op6_mixing, op7_substring_dedup, op8_ngram_join, op9_language_model, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": _MIX_SQL, "op8_ngram_join": _JOIN_SQL}
