"""The corpus queries bound to the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.audit import audit_filters
from lodestone.llm.common import table
from lodestone.llm.fingerprints import fingerprint_documents
from lodestone.llm.huffman import encoded_documents
from lodestone.llm.jaccard import link_documents
from lodestone.llm.language import predict_languages
from lodestone.llm.mixing import mix, quality_domains
from lodestone.llm.negatives import mine_embeddings
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import predict_quality
from lodestone.llm.registry import ORACLES, QUERIES, query
from lodestone.llm.sharding import shard_documents
from lodestone.llm.suffixes import remove_repeats
from lodestone.llm.topk import nearest
from lodestone.llm.warc import archive_pages

__all__ = ["ORACLES", "QUERIES"]


@query("op6_sampled_splitters")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_linear_grouping_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op7_mixture_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


@query("op8_subword_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op3_warc_revisits", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


@query("op4_consistent_parsing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op5_soft_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), quality_domains(table(spark, sf_dir, "labels")))


OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op2_impact_ordered_topk", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 90 * (len(p.sh) + len(q.sh) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node)
SELECT doc_id, CAST(len(any_value(sh)) AS BIGINT) AS n_shingles, min(node) AS component_id FROM r JOIN s USING (doc_id) GROUP BY doc_id
"""


@query("op10_size_aware_jaccard", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS failing
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failing, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o WHERE length(filter_order) = 5),
r AS (SELECT part, filter_order, step, filter_order[step] AS filter,
    CAST(sum(n) FILTER (translate(filter_order[1:step], failing, '') = filter_order[1:step]) AS BIGINT) AS kept,
    CAST(sum(n) FILTER (contains(failing, filter_order[step]) AND translate(filter_order[1:step - 1], failing, '') = filter_order[1:step - 1]) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (contains(failing, filter_order[step])) AS BIGINT) AS fails,
    CAST(sum(n) FILTER (failing = filter_order[step]) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER (contains(failing, filter_order[step]) AND translate(filter_order[1:step - 1], failing, '') = filter_order[1:step - 1]) AS BIGINT) AS good_lost,
    CAST(sum(toxic) FILTER (contains(failing, filter_order[step]) AND translate(filter_order[1:step - 1], failing, '') = filter_order[1:step - 1]) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(fails, 0) - coalesce(removed, 0) AS redundant,
  coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley FROM r
"""


@query("op11_lehmer_filter_audit", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_huffman_ids")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"), tokenizer_path())


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.vec, c.vec), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND (a.vec_id <> c.vec_id OR a.vec <> c.vec OR a.label <> c.label)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op12_coordinate_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_embeddings(table(spark, sf_dir, "embeddings"))
