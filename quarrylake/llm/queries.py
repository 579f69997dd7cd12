"""The queries of this subpackage, with production parameters, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.llm.licenses import oracle as license_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylake.llm.licenses import license_scan, license_table

    return license_scan(_table(spark, sf_dir, "documents"), license_table(spark))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylake.llm.mixing import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylake.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylake.llm.language import identify

    return identify(_table(spark, sf_dir, "documents"))


def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylake.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylake.llm.toxicity import toxic_passages

    found = toxic_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_tokens", F.size("passages").alias("n_passages"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylake.llm.topk import topk_search

    return topk_search(_table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH vecs AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylake.llm.urlfilter import url_filter

    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter(_table(spark, sf_dir, "pages"), rules)


OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict, length(r.host || r.path) AS n
  FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
)
SELECT page_id, host, path, arg_max(rule, n) AS rule, coalesce(arg_max(verdict, n), 'allow') AS verdict FROM fits GROUP BY page_id, host, path
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarrylake.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylake.llm.jaccard import ngram_jaccard

    return ngram_jaccard(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
    FROM words)
), sizes AS (
  SELECT d.doc_id, count(g.g) AS n FROM documents d LEFT JOIN grams g USING (doc_id) GROUP BY d.doc_id
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes sa ON sa.doc_id = p.a JOIN sizes sb ON sb.doc_id = p.b
  WHERE 100 * i >= 80 * (sa.n + sb.n - i)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, s.n AS n_shingles,
       (SELECT count(*) FROM links l WHERE l.a = s.doc_id) AS n_similar,
       least(s.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = s.doc_id), s.doc_id)) AS component_id
FROM sizes s
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_context_mixing": op2_context_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_balanced_shards": op5_balanced_shards,
    "op6_topk_search": op6_topk_search,
    "op7_url_filter": op7_url_filter,
    "op8_toxic_segments": op8_toxic_segments,
    "op9_packing": op9_packing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "pipeline": pipeline,
}
SQL: dict[str, str] = {
    "op1_license_scan": license_sql(),
    "op6_topk_search": OP6_SQL,
    "op7_url_filter": OP7_SQL,
    "op10_ngram_jaccard": OP10_SQL,
}
