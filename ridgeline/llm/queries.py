"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import (
    chosen_path, fixity, importance, line_quality, mixing, packing, posting_lists, secret_ledger, sharding, swap_packing, tree_forest,
    url_templates, whitening,
)
from ridgeline.llm.common import table
from ridgeline.llm.twins import FOREST_SQL, IMPORTANCE_SQL, JACCARD_SQL, SECRETS_SQL, URL_SQL

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary())


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return secret_ledger.digest(docs, secret_ledger.update(docs))


def op3_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return posting_lists.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.judge(table(spark, folder, "pages"))


def op5_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return line_quality.score(docs, line_quality.train(docs, table(spark, folder, "labels")))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"))


def op7_fixity(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    records = fixity.index(pages)
    return fixity.compare(records, fixity.decayed(pages, records))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.join(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_tree_forest(spark: SparkSession, folder: str) -> DataFrame:
    return tree_forest.near_duplicates(table(spark, folder, "embeddings"))


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.digest(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_swap_packing(spark: SparkSession, folder: str) -> DataFrame:
    return swap_packing.pack(table(spark, folder, "documents"), vocabulary())


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_secret_scan": op2_secret_scan,
    "op3_posting_lists": op3_posting_lists,
    "op4_url_filter": op4_url_filter,
    "op5_line_quality": op5_line_quality,
    "op6_sharding": op6_sharding,
    "op7_fixity": op7_fixity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_mixing": op9_mixing,
    "op10_tree_forest": op10_tree_forest,
    "op11_importance": op11_importance,
    "op12_whitening": op12_whitening,
    "op13_swap_packing": op13_swap_packing,
}

MIXING_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', coalesce(doc_id::VARCHAR, '-'), md5(coalesce(text, '')))) AS turn
  FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS weight FROM per_source
), levels AS (
  SELECT *, cap / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER ()::BIGINT AS budget, sum(weight) OVER () AS heavy FROM weighed
), capped AS (
  SELECT *, sum(cap) OVER (ORDER BY ratio) + ratio * (heavy - sum(weight) OVER (ORDER BY ratio)) <= budget AS is_capped FROM levels
), goals AS (
  SELECT source, source_size, CASE WHEN is_capped THEN cap ELSE
    (budget - coalesce(sum(CASE WHEN is_capped THEN cap END) OVER (), 0)) * weight / sum(CASE WHEN NOT is_capped THEN weight END) OVER () END AS target
  FROM capped
), queue AS (
  SELECT s.*, source_size, target, sum(size) OVER (PARTITION BY s.source ORDER BY turn, doc_id)::BIGINT AS after
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), copies AS (
  SELECT *, after + serving * source_size AS done FROM queue, (VALUES (0), (1)) v(serving) WHERE size > 0 AND target > 0
), served AS (
  SELECT *, sum(size) OVER (ORDER BY done / target, source NULLS LAST, serving, turn, doc_id) AS total
  FROM copies WHERE done - size < target
), words AS (
  SELECT doc_id, turn, source, after, sum(CASE WHEN total <= (SELECT 1.5::DOUBLE * sum(source_size)::BIGINT FROM goals) AND done <= ceil(target)
    THEN size ELSE least(size, greatest(0, floor(target) - (done - size))) END)::BIGINT AS taken
  FROM served GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(w.taken, 0)::BIGINT AS taken
FROM queue q LEFT JOIN words w ON q.doc_id IS NOT DISTINCT FROM w.doc_id AND q.turn = w.turn
  AND q.source IS NOT DISTINCT FROM w.source AND q.after = w.after AND q.size > 0
"""

FIXITY_SQL = r"""
WITH pieces AS (
  SELECT page_id, coalesce(floor(page_id / 1000.0)::BIGINT, -1 - coalesce(length(url), 0) % 1000) AS archive,
         coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl
  FROM pages
), records AS (
  SELECT archive, page_id, html,
         'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'none') || '>' || nl
         || 'WARC-Target-URI: ' || url || nl || 'Content-Length: ' || strlen(html) || nl || nl || html || nl || nl AS record
  FROM pieces
), places AS (
  SELECT archive, page_id, html, strlen(record)::BIGINT AS length,
         row_number() OVER w - 1 AS ordinal, (sum(strlen(record)) OVER w - strlen(record))::BIGINT AS "offset"
  FROM records WINDOW w AS (PARTITION BY archive ORDER BY page_id, sha256(record) ROWS UNBOUNDED PRECEDING)
)
SELECT archive, ordinal, "offset", length, page_id, CASE WHEN page_id % 89 = 7 THEN 'missing' ELSE 'changed' END AS state
FROM places WHERE page_id % 89 = 7 OR (page_id % 97 = 13 AND '#' || substring(html, 2) <> html)
"""

ORACLES: dict[str, str] = {
    "op2_secret_scan": SECRETS_SQL,
    "op4_url_filter": URL_SQL,
    "op7_fixity": FIXITY_SQL,
    "op8_jaccard_join": JACCARD_SQL,
    "op9_mixing": MIXING_SQL,
    "op10_tree_forest": FOREST_SQL,
    "op11_importance": IMPORTANCE_SQL,
}
