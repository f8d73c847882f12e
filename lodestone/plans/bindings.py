"""Adapters from the shared tables to the roles the operators expect.

Each adapter exists twice, as a Spark projection and as a SQL common table expression with the
same meaning, so that both engines see the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_TABLES = {"documents", "pages", "conversations"}
SOURCES = ["news", "disclosure", "research_report", "glossary"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared tables.

    On a local master a text table of one file is spread over the cores; elsewhere nothing is moved.
    Filters and column pruning still reach the scan.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and spark.sparkContext.master.startswith("local[") and df.rdd.getNumPartitions() == 1:
        return df.repartition(cores)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source documents: every document of the table, spread over 2024."""
    df = table(spark, sf_dir, "documents")
    other = F.expr("CASE WHEN lang = 'en' THEN 'de' ELSE 'en' END")
    bucket = F.expr("doc_id % 10")
    return df.select(
        "doc_id",
        F.expr("concat('doc:', doc_id)").alias("document_id"),
        F.expr(
            "CASE doc_id % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'disclosure' WHEN 2 THEN 'research_report' ELSE 'glossary' END"
        ).alias("source_type"),
        F.when(bucket < 7, F.array("lang")).when(bucket < 9, F.array(F.col("lang"), other))
        .otherwise(F.array().cast("array<string>")).alias("primary_security_ids"),
        F.when(bucket == 9, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("mentioned_security_ids"),
        F.expr("split_part(text, '\n', 1)").alias("title"),
        F.expr(
            "CASE WHEN doc_id % 46 <> 0 THEN timestampadd(MINUTE, (doc_id * 7919) % 525600, TIMESTAMP '2024-01-01 00:00:00') END"
        ).alias("published_at"),
        F.expr("concat('https://', source, '.example.com/', lang, '/', doc_id)").alias("source_url"),
        "text",
        F.col("source").alias("publisher"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('type', doc_id % 3) END").alias("document_type"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN 'annual' ELSE '' END").alias("report_type"),
        F.expr("concat('level', doc_id % 2)").alias("content_level"),
        F.expr("doc_id % 6 <> 2").alias("external_allowed"),
    )


DOCUMENTS_SQL = """
docs AS (
  SELECT doc_id, 'doc:' || doc_id AS document_id,
    CASE doc_id % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'disclosure' WHEN 2 THEN 'research_report' ELSE 'glossary' END AS source_type,
    CASE WHEN doc_id % 10 < 7 THEN [lang] WHEN doc_id % 10 < 9
      THEN [lang, CASE WHEN lang = 'en' THEN 'de' ELSE 'en' END] ELSE CAST([] AS VARCHAR[]) END AS primary_security_ids,
    CASE WHEN doc_id % 10 = 9 THEN [lang] ELSE CAST([] AS VARCHAR[]) END AS mentioned_security_ids,
    split_part(text, chr(10), 1) AS title,
    CASE WHEN doc_id % 46 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST((doc_id * 7919) % 525600 AS INTEGER)) END AS published_at,
    'https://' || source || '.example.com/' || lang || '/' || doc_id AS source_url,
    text, source AS publisher,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'type' || (doc_id % 3) END AS document_type,
    CASE WHEN doc_id % 3 = 0 THEN 'annual' ELSE '' END AS report_type,
    'level' || (doc_id % 2) AS content_level, doc_id % 6 <> 2 AS external_allowed, lang
  FROM documents)
"""

BLANK_SQL = r"[\t-\r\x1c-\x20]+"


def snippet_sql(column: str = "text") -> str:
    return f"substr(trim(regexp_replace({column}, '{BLANK_SQL}', ' ', 'g')), 1, 500)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrievable snippets of the documents, through the library's own normalization."""
    from lodestone.operators.evidence import to_evidence

    docs = documents(spark, sf_dir)
    accepted, _ = to_evidence(docs)
    # Every 23rd snippet has no time of its own and falls back to its document.
    own_time = F.when(F.col("doc_id") % 23 != 0, F.col("published_at"))
    return accepted.withColumn("published_at", own_time)


EVIDENCE_SQL = DOCUMENTS_SQL + f""",
ev AS (
  SELECT doc_id, 'evidence:' || document_id AS evidence_id, document_id, source_type, title, source_url,
    CASE WHEN doc_id % 23 <> 0 THEN published_at END AS published_at,
    primary_security_ids AS subject_security_ids, mentioned_security_ids,
    CASE WHEN len(primary_security_ids) = 1 THEN 'company_specific' WHEN len(primary_security_ids) >= 2 THEN 'multi_company'
      ELSE 'industry_common' END AS scope,
    {snippet_sql()} AS snippet
  FROM docs WHERE trim(regexp_replace(text, '{BLANK_SQL}', ' ', 'g')) <> '')
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retrieval request per benchmark item."""
    df = table(spark, sf_dir, "benchmark")
    return df.select(
        F.expr("concat('req:', item_id)").alias("request_id"),
        "item_id",
        F.col("text").alias("query"),
        F.expr("CASE WHEN item_id % 5 = 4 THEN 'fr' ELSE 'en' END").alias("security_id"),
        F.expr(
            "CASE item_id % 3 WHEN 0 THEN array('news', 'disclosure', 'research_report')"
            " WHEN 1 THEN array('news') ELSE array('news', 'disclosure', 'research_report', 'glossary') END"
        ).alias("source_types"),
        F.expr("CASE WHEN item_id % 4 = 1 THEN DATE '2024-02-01' END").alias("start_day"),
        F.expr("CASE WHEN item_id % 4 = 1 THEN DATE '2024-11-30' END").alias("end_day"),
        F.expr(
            "CASE WHEN item_id % 2 = 0 THEN timestampadd(MINUTE, (item_id * 6007) % 400000, TIMESTAMP '2024-03-01 00:00:00') END"
        ).alias("as_of"),
        F.expr(
            "CASE WHEN item_id % 7 = 3 THEN array('type1', 'annual') WHEN item_id % 7 = 5 THEN cast(array() AS array<string>) END"
        ).alias("document_types"),
        F.expr("cast(4 + item_id % 9 AS int)").alias("top_k"),
        F.expr("timestampadd(DAY, 30 * (item_id % 3), TIMESTAMP '2024-10-01 00:00:00')").alias("basis_at"),
    )


REQUESTS_SQL = """
req AS (
  SELECT 'req:' || item_id AS request_id, item_id, text AS query,
    CASE WHEN item_id % 5 = 4 THEN 'fr' ELSE 'en' END AS security_id,
    CASE item_id % 3 WHEN 0 THEN ['news', 'disclosure', 'research_report'] WHEN 1 THEN ['news']
      ELSE ['news', 'disclosure', 'research_report', 'glossary'] END AS source_types,
    CASE WHEN item_id % 4 = 1 THEN DATE '2024-02-01' END AS start_day,
    CASE WHEN item_id % 4 = 1 THEN DATE '2024-11-30' END AS end_day,
    CASE WHEN item_id % 2 = 0 THEN TIMESTAMP '2024-03-01' + to_minutes(CAST((item_id * 6007) % 400000 AS INTEGER)) END AS as_of,
    CASE WHEN item_id % 7 = 3 THEN ['type1', 'annual'] WHEN item_id % 7 = 5 THEN CAST([] AS VARCHAR[]) END AS document_types,
    CAST(4 + item_id % 9 AS INTEGER) AS top_k,
    TIMESTAMP '2024-10-01' + to_days(CAST(30 * (item_id % 3) AS INTEGER)) AS basis_at
  FROM benchmark)
"""

# The filter of one (request, evidence) pair, written for SQL.
FILTER_SQL = """
cand AS (
  SELECT r.request_id, e.*, coalesce(e.published_at, d.published_at) AS effective_at
  FROM req r JOIN ev e ON list_contains(r.source_types, e.source_type)
  JOIN docs d ON d.document_id = e.document_id
  WHERE (list_contains(d.primary_security_ids, r.security_id) OR list_contains(d.mentioned_security_ids, r.security_id))
    AND CASE e.scope WHEN 'company_specific' THEN e.subject_security_ids = [r.security_id]
      WHEN 'multi_company' THEN list_contains(e.subject_security_ids, r.security_id)
      ELSE list_contains(e.mentioned_security_ids, r.security_id) END
    AND (r.document_types IS NULL OR list_has_any(r.document_types,
      list_filter([d.document_type, d.report_type, d.content_level], lambda x: x IS NOT NULL AND trim(x) <> '')))
    AND (r.as_of IS NULL OR coalesce(coalesce(e.published_at, d.published_at) <= r.as_of, false))
    AND ((r.start_day IS NULL AND r.end_day IS NULL) OR coalesce(
      CAST(coalesce(e.published_at, d.published_at) + INTERVAL 9 HOUR AS DATE) BETWEEN r.start_day AND r.end_day, false)))
"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts)


FOLD_SQL = "replace(lower({0}), 'ß', 'ss')"


def tokens_sql(column: str) -> str:
    return f"regexp_extract_all({FOLD_SQL.format(column)}, '[a-z0-9]+')"
