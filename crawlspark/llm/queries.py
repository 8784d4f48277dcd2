"""Queries over the test tables, one per operator, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlspark.llm import html_text, mixing, near_dup, nearest, packing, phrases, sql_texts, suffix_index, toxicity, training_order, url_filter, vector_codes, vector_dup, warc
from crawlspark.plans.inputs import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.draws(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "shards")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model, "score")
    held_out = toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_monotone_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = training_order.materialise(table(spark, sf_dir, "documents"))
    return out.select("sequence_id", "slot", "shard", "byte_offset", "tokens", "ids_crc32")


def op7_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_text_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op9_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rules_table(spark, RULES)
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
SQL_RULES = f"""
WITH rules(verdict, key) AS (VALUES {", ".join(f"('{v}', '{k}')" for v, k in RULES)}),
pages_of AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, row_number() OVER () AS n FROM pages),
fits AS (
  SELECT n, max_by(key, length(key)) AS rule, max_by(verdict, length(key)) AS verdict FROM pages_of, rules
  WHERE (host = split_part(key, '/', 1) OR ends_with(host, '.' || split_part(key, '/', 1)))
    AND starts_with(path, substr(key, instr(key, '/'))) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM pages_of LEFT JOIN fits USING (n)
"""

def op10_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_index.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(codebooks)).alias("codebooks_sha256"))


SQL_NEAR_DUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
"""

SQL_VECTOR_DUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM v LEFT JOIN degree ON degree.a = vec_id LEFT JOIN least ON least.a = vec_id
"""

QUERIES: dict[str, Query] = {
    "op1_splitting_tree": op1_splitting_tree,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_dictionary_warc": op3_dictionary_warc,
    "op4_hyperminhash": op4_hyperminhash,
    "op5_monotone_queue": op5_monotone_queue,
    "op6_feistel_order": op6_feistel_order,
    "op7_pca_tiles": op7_pca_tiles,
    "op8_text_ratio": op8_text_ratio,
    "op9_blocked_bloom": op9_blocked_bloom,
    "op10_stable_projections": op10_stable_projections,
    "op11_suffix_family": op11_suffix_family,
    "op12_fingerprints": op12_fingerprints,
    "op13_ball_kmeans": op13_ball_kmeans,
}
ORACLES: dict[str, str] = {
    "op4_hyperminhash": SQL_NEAR_DUP,
    "op7_pca_tiles": SQL_VECTOR_DUP,
    "op9_blocked_bloom": SQL_RULES,
    "op11_suffix_family": sql_texts.REPEATS,
    "op12_fingerprints": sql_texts.phrases(),
    "op13_ball_kmeans": sql_texts.vector_codes(),
}
