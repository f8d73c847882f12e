"""Events, citations and evaluation bound to the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import fold, title_terms
from lodestone.operators import citations, claims as claim_ops, evaluation, events, evidence as ev, policy, topics, validation
from lodestone.operators.skew import top_rows
from lodestone.plans import bindings as b
from lodestone.plans.registry import query
from lodestone.plans.text_queries import COLLAPSED, DEMO_PHRASES, DEMO_STOP, title_terms_sql
from lodestone.session import cut_lineage

LEXICON = {"phrases": DEMO_PHRASES, "stop_words": DEMO_STOP, "distinctive": ["of-the", "tion", "is", "of"]}
TITLE_SQL = "split_part(text, chr(10), 1)"
TITLES_SQL = f"titles AS (SELECT doc_id, lang AS security_id, TIMESTAMP '2024-01-01' + to_minutes(CAST((doc_id * 37) % 20160 AS INTEGER)) AS published_at, source AS publisher_host, {TITLE_SQL} AS title, {title_terms_sql(TITLE_SQL)} AS terms FROM documents)"
SAME_SQL = """abs(epoch(l.published_at) - epoch(r.published_at)) <= 129600 AND (len(list_intersect(list_intersect(l.terms, r.terms), ['of-the', 'tion', 'is', 'of'])) >= 2
  OR (len(list_intersect(list_intersect(l.terms, r.terms), ['of-the', 'tion', 'is', 'of'])) = 1 AND len(list_intersect(l.terms, r.terms)) >= 3
  AND len(list_intersect(list_intersect(l.terms, r.terms), ['of-the', 'tion', 'er', 'ouon'])) >= 2))"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of all documents as headlines, spread over two weeks."""
    return b.documents(spark, sf_dir).select(
        "doc_id", F.regexp_extract("source_url", "com/([a-z]+)/", 1).alias("security_id"), F.format_string("n%012d", "doc_id").alias("news_id"), "title",
        F.expr("timestampadd(MINUTE, (doc_id * 37) % 20160, TIMESTAMP '2024-01-01 00:00:00')").alias("published_at"), F.col("publisher").alias("publisher_host"),
    )


@query("cmp_14_same_event_pairs", f"WITH {TITLES_SQL} SELECT l.doc_id, {SAME_SQL} AS same_event FROM titles l JOIN titles r ON r.doc_id = l.doc_id + 1")
def same_event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = titles(spark, sf_dir).select("doc_id", "published_at", title_terms("title", DEMO_PHRASES, DEMO_STOP).alias("terms"))
    right = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("published_at").alias("right_at"), F.col("terms").alias("right_terms"))
    gap = F.unix_timestamp("published_at") - F.unix_timestamp("right_at")
    same = events.same_event("terms", "right_terms", gap, DEMO_PHRASES, LEXICON["distinctive"])
    return rows.join(right, "doc_id").select("doc_id", same.alias("same_event"))


@query("agg_19_confusion", f"WITH {TITLES_SQL}, p AS (SELECT {SAME_SQL} AS p, l.doc_id % 4 = 0 AS e FROM titles l JOIN titles r ON r.doc_id = l.doc_id + 1) SELECT count(*) FILTER (p AND e) AS true_positive, count(*) FILTER (p AND NOT e) AS false_positive, count(*) FILTER (NOT p AND e) AS false_negative, count(*) FILTER (NOT p AND NOT e) AS true_negative, round(coalesce(count(*) FILTER (p AND e) / nullif(count(*) FILTER (p), 0), 1.0), 4) AS precision, round(coalesce(count(*) FILTER (p AND e) / nullif(count(*) FILTER (e), 0), 1.0), 4) AS recall FROM p")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = same_event_pairs(spark, sf_dir).select(F.col("same_event").alias("predicted"), (F.col("doc_id") % 4 == 0).alias("expected"))
    rows = evaluation.confusion(pairs)
    return rows.withColumn("precision", F.round("precision", 4)).withColumn("recall", F.round("recall", 4))


@query("cmp_15_event_clusters", None)
def event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, _ = events.cluster_events(titles(spark, sf_dir), **LEXICON)
    return clusters.select("event_id", "security_id", "articles", "publishers", "event_label", F.array_join("event_terms", "|").alias("terms"))


GROUPED_SQL = f"{TITLES_SQL}, grouped AS (SELECT *, 'g' || (doc_id // 5) AS group_id FROM titles)"


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines grouped five by five: groups whose summary SQL can state as well."""
    return titles(spark, sf_dir).withColumn("terms", title_terms("title", DEMO_PHRASES, DEMO_STOP)).withColumn("group_id", F.expr("concat('g', doc_id div 5)"))


@query("agg_15_group_terms", f"WITH {GROUPED_SQL} SELECT security_id, group_id, term, CAST(row_number() OVER (PARTITION BY security_id, group_id ORDER BY term IN ('of-the', 'tion', 'is', 'of') DESC, n DESC, length(term) DESC, term DESC) AS INTEGER) AS term_rank FROM (SELECT security_id, group_id, term, count(*) AS n FROM (SELECT security_id, group_id, unnest(terms) AS term FROM grouped) GROUP BY ALL) WHERE n >= 2 QUALIFY term_rank <= 30")
def group_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.group_terms(_grouped(spark, sf_dir), LEXICON["distinctive"]).select("security_id", "group_id", "term", "term_rank")


@query("agg_16_group_summary", f"WITH {GROUPED_SQL} SELECT security_id, group_id, count(*) AS articles, count(DISTINCT publisher_host) AS publishers, strftime(min(published_at), '%Y-%m-%d %H:%M') AS first_at, strftime(max(published_at), '%Y-%m-%d %H:%M') AS last_at, arg_min(title, (length(title), published_at, doc_id)) AS event_label FROM grouped GROUP BY 1, 2")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.title_label(_grouped(spark, sf_dir))
    show = lambda name, alias: F.date_format(name, "yyyy-MM-dd HH:mm").alias(alias)
    return rows.select("security_id", "group_id", "articles", "publishers", show("first_published_at", "first_at"), show("last_published_at", "last_at"), "event_label")


@query("agg_26_lineage_summary", f"WITH {GROUPED_SQL} SELECT group_id, CAST(0 AS BIGINT) AS confirmed_independent_count, CAST(0 AS BIGINT) AS confirmed_republication_count, count(*) AS unknown_count FROM grouped GROUP BY 1")
def lineage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.coverage import lineage_summary as summarize

    return summarize(_grouped(spark, sf_dir), "group_id")


EVENT_CTES = GROUPED_SQL + """, ct AS (SELECT security_id, group_id, list(term) AS event_terms FROM (SELECT security_id, group_id, term, count(*) AS n FROM (SELECT security_id, group_id, unnest(terms) AS term FROM grouped) GROUP BY ALL) WHERE n >= 2 GROUP BY 1, 2),
cl AS (SELECT security_id || '/' || group_id AS event_id, security_id, event_terms FROM ct), mem AS (SELECT security_id || '/' || group_id AS event_id, security_id, doc_id, published_at FROM grouped JOIN ct USING (security_id, group_id)),
rq AS (SELECT item_id AS request_id, 'en' AS security_id, TIMESTAMP '2024-01-03' + to_days(CAST(item_id % 12 AS INTEGER)) AS as_of, list_distinct(string_split(lower(text), ' ')) AS query_terms, item_id % 3 = 0 AS has_marker FROM benchmark),
flags AS (SELECT request_id, EXISTS (SELECT 1 FROM cl WHERE list_has_any(cl.event_terms, rq.query_terms)) AS known, EXISTS (SELECT 1 FROM cl WHERE cl.security_id = rq.security_id AND list_has_any(cl.event_terms, rq.query_terms)) AS own FROM rq),
act AS (SELECT rq.*, own FROM rq JOIN flags USING (request_id) WHERE (own OR NOT known) AND (own OR has_marker)),
sc AS (SELECT a.request_id, a.security_id, a.as_of, c.event_id, a.own, len(list_intersect(c.event_terms, a.query_terms)) AS overlap, count(*) AS eligible, max(m.published_at) AS latest FROM act a JOIN cl c ON c.security_id = a.security_id JOIN mem m ON m.event_id = c.event_id AND m.published_at <= a.as_of GROUP BY ALL HAVING count(*) >= 2),
sel AS (SELECT * FROM sc WHERE NOT own OR overlap > 0 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY overlap DESC, latest DESC, event_id) = 1)
"""


def _event_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # One pass over the titles for terms and members alike.
    grouped = cut_lineage(_grouped(spark, sf_dir).withColumn("event_id", F.concat_ws("/", "security_id", "group_id")).select(
        "event_id", "security_id", "news_id", "published_at", F.array_distinct("terms").alias("terms")
    ))
    counts = grouped.select("event_id", "security_id", F.explode("terms").alias("term")).groupBy("event_id", "security_id", "term").agg(F.count(F.lit(1)).alias("n"))
    clusters = counts.where("n >= 2").groupBy("event_id", "security_id").agg(F.collect_list("term").alias("event_terms"))
    members = grouped.join(clusters.select("event_id"), "event_id", "left_semi")
    asked = b.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("request_id"), F.lit("en").alias("security_id"), F.expr("timestampadd(DAY, item_id % 12, TIMESTAMP '2024-01-03 00:00:00')").alias("as_of"),
        F.expr("array_distinct(split(lower(text), ' '))").alias("query_terms"), F.expr("item_id % 3 = 0").alias("has_marker"),
    )
    return asked, clusters, members


@query("joi_16_event_selection", f"WITH {EVENT_CTES} SELECT request_id, event_id, eligible, CAST(overlap AS BIGINT) AS overlap FROM sel")
def event_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.select_events(*_event_inputs(spark, sf_dir)).select("request_id", "event_id", "eligible", "overlap")


BACK_SQL = "back AS (SELECT doc_id, 'doc:' || doc_id AS source_id, lang AS security_id, list_distinct(string_split(lower(text), ' ')) AS topics, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 300 AS INTEGER)) AS published_at, source AS publisher, CASE WHEN doc_id % 2 = 0 THEN 'official_list_metadata' ELSE 'verified_body_fact' END AS link_basis FROM documents)"
FOCUS_SQL = "focus AS (SELECT item_id AS request_id, 'en' AS security_id, TIMESTAMP '2024-01-10' AS as_of, unnest(list_distinct(string_split(lower(text), ' '))) AS term FROM benchmark)"


def link_sql(kind: str, limit: int, extra: str = "") -> str:
    score = "s * 100 + n" if kind == "report" else "s * 100 + n * 10 + CAST(link_basis = 'official_list_metadata' AS INTEGER)"
    order = "score DESC, published_at DESC, publisher DESC, source_id" if kind == "report" else "score DESC, published_at DESC, source_id"
    return (
        f"hit AS (SELECT f.request_id, k.source_id, k.published_at, k.publisher, k.link_basis, count(*) AS n, count(*) FILTER (term NOT IN ('the', 'of', 'and')) AS s FROM focus f JOIN (SELECT * REPLACE (unnest(topics) AS topics) FROM back) k "
        f"ON k.security_id = f.security_id AND k.topics = f.term AND k.published_at <= f.as_of {extra} GROUP BY ALL), links AS (SELECT request_id, source_id, CAST({score} AS BIGINT) AS score, "
        f"row_number() OVER (PARTITION BY request_id ORDER BY {score} DESC, {order.split('score DESC, ')[1]}) AS link_rank FROM hit WHERE s > 0 QUALIFY link_rank <= {limit})"
    )


def _backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select(
        F.expr("concat('doc:', doc_id)").alias("source_id"), F.col("lang").alias("security_id"), F.expr("array_distinct(split(lower(text), ' '))").alias("topics"),
        F.expr("timestampadd(HOUR, doc_id % 300, TIMESTAMP '2024-01-01 00:00:00')").alias("published_at"), F.col("source").alias("publisher"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 'official_list_metadata' ELSE 'verified_body_fact' END").alias("link_basis"), "doc_id",
    )


def _focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("request_id"), F.lit("en").alias("security_id"), F.lit("2024-01-10 00:00:00").cast("timestamp").alias("as_of"), F.explode(F.expr("array_distinct(split(lower(text), ' '))")).alias("term")
    )


GENERIC = ["the", "of", "and"]


@query("joi_15_topic_links", f"WITH {BACK_SQL}, {FOCUS_SQL}, {link_sql('report', 3)} SELECT request_id, source_id, CAST(s * 100 + n AS BIGINT) AS score FROM hit WHERE s > 0")
def topic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.topic_links(_focus(spark, sf_dir), _backgrounds(spark, sf_dir), "report", None, GENERIC)


@query("top_03_report_perspectives", f"WITH {BACK_SQL}, {FOCUS_SQL}, {link_sql('report', 3)} SELECT request_id, source_id, score, CAST(link_rank AS INTEGER) AS link_rank FROM links")
def report_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.topic_links(_focus(spark, sf_dir), _backgrounds(spark, sf_dir), "report", 3, GENERIC)


@query("top_04_disclosure_links", f"WITH {BACK_SQL}, {FOCUS_SQL}, {link_sql('disclosure', 2)} SELECT request_id, source_id, 'official_background' AS role FROM links UNION ALL SELECT item_id, NULL, 'no_link' FROM benchmark WHERE item_id NOT IN (SELECT request_id FROM links)")
def disclosure_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = events.topic_links(_focus(spark, sf_dir), _backgrounds(spark, sf_dir), "disclosure", 2, GENERIC)
    asked = b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"))
    return events.with_no_link(asked, links).select("request_id", "source_id", "role")


@query("top_05_shown_articles", f"WITH {GROUPED_SQL} SELECT security_id AS request_id, count(*) AS article_total, least(count(*), 20) AS article_displayed, min(doc_id) FILTER (rn = 20) AS last_shown FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY published_at, doc_id) AS rn FROM grouped) GROUP BY 1")
def shown_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown, totals = events.shown_articles(_grouped(spark, sf_dir).withColumn("request_id", F.col("security_id")))
    last = shown.where("article_rank = 20").select("request_id", F.col("doc_id").alias("last_shown"))
    return totals.join(last, "request_id", "left")


COMPARE_SQL = (
    f"WITH {EVENT_CTES}, {BACK_SQL}, focus AS (SELECT DISTINCT request_id, security_id, as_of, unnest(list_distinct(list_concat(event_terms, query_terms))) AS term FROM sel JOIN cl USING (event_id, security_id) JOIN (SELECT request_id, query_terms FROM rq) USING (request_id)), "
    + link_sql("report", 3) + ", " + link_sql("disclosure", 2).replace("hit AS", "hit2 AS").replace("FROM hit ", "FROM hit2 ").replace("links AS", "links2 AS")
)


@query("cmp_16_evidence_comparison", COMPARE_SQL + " SELECT s.request_id, s.event_id, s.eligible AS article_total, coalesce(p.n, 0) AS perspectives, coalesce(d.n, 0) AS disclosure_links, CASE WHEN coalesce(p.n, 0) + coalesce(d.n, 0) > 0 THEN 'background_linked' ELSE 'coverage_only' END AS comparison_status FROM sel s LEFT JOIN (SELECT request_id, count(*) AS n FROM links GROUP BY 1) p USING (request_id) LEFT JOIN (SELECT request_id, count(*) AS n FROM links2 GROUP BY 1) d USING (request_id)")
def evidence_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _backgrounds(spark, sf_dir)
    rows = events.compare_evidence(*_event_inputs(spark, sf_dir), back, back, generic=GENERIC)
    return rows.select("request_id", "event_id", "article_total", "perspectives", "disclosure_links", "comparison_status")


CLAIM_ROWS_SQL = "claims AS (SELECT DISTINCT event_id, event_id || ':c' AS claim_id, CASE WHEN length(event_id) % 2 = 0 THEN 'common' ELSE 'difference' END AS claim_kind, 1 AS claim_index, 'text of ' || event_id AS text FROM g WHERE doc_id // 5 % 2 = 0)"


def _event_claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Articles by group, and one claim for every even group over its first and a foreign source."""
    articles = _grouped(spark, sf_dir).withColumn("event_id", F.concat_ws("/", "security_id", "group_id")).withColumn(
        "source_url", F.when(F.expr("doc_id % 9 <> 4"), F.concat(F.lit("https://n.example.com/"), "doc_id"))
    )
    claims = articles.where("doc_id div 5 % 2 = 0").groupBy("event_id").agg(F.min("news_id").alias("a"), F.max("news_id").alias("z")).select(
        "event_id", F.concat("event_id", F.lit(":c")).alias("claim_id"), F.when(F.length("event_id") % 2 == 0, F.lit("common")).otherwise(F.lit("difference")).alias("claim_kind"),
        F.lit(1).alias("claim_index"), F.concat(F.lit("text of "), "event_id").alias("text"), F.array_distinct(F.array("a", "z")).alias("source_ids"),
    )
    return articles, claims


@query(
    "prj_06_comparison_rows",
    f"""WITH {GROUPED_SQL}, g AS (SELECT *, security_id || '/' || group_id AS event_id, printf('n%012d', doc_id) AS news_id, doc_id % 9 <> 4 AS has_url FROM grouped),
c AS (SELECT event_id, CASE WHEN length(event_id) % 2 = 0 THEN 'common' ELSE 'difference' END AS claim_kind, unnest(list_distinct([min(news_id), max(news_id)])) AS news_id FROM g WHERE doc_id // 5 % 2 = 0 GROUP BY 1),
byc AS (SELECT event_id, news_id, claim_kind, 'comparison:' || substr(sha256(event_id || ':' || claim_kind || ':1:' || news_id), 1, 24) AS evidence_id FROM c JOIN g USING (event_id, news_id) WHERE has_url)
SELECT * FROM byc UNION ALL SELECT event_id, news_id, 'coverage', 'comparison:' || substr(sha256(event_id || ':' || news_id), 1, 24) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY published_at, news_id) AS rn FROM g) WHERE rn <= 4 AND has_url AND event_id NOT IN (SELECT event_id FROM byc)""",
)
def comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, claims = _event_claims(spark, sf_dir)
    return events.comparison_rows(claims, articles.select("event_id", "news_id", "title", "source_url", "published_at")).select("event_id", "news_id", "claim_kind", "evidence_id")


@query(
    "val_09_cluster_integrity",
    f"""WITH {GROUPED_SQL}, g AS (SELECT *, security_id || '/' || group_id AS event_id, printf('n%012d', doc_id) AS news_id FROM grouped),
s AS (SELECT event_id, count(DISTINCT publisher_host) AS p FROM g GROUP BY 1), c AS (SELECT event_id, list_distinct([min(news_id), max(news_id)]) AS ids FROM g WHERE doc_id // 5 % 2 = 0 GROUP BY 1)
SELECT event_id, NULL AS claim_id, 'one_publisher' AS problem FROM s WHERE p < 2 UNION ALL SELECT event_id, event_id || ':c', 'too_few_sources' FROM c WHERE len(ids) < 2 AND length(event_id) % 2 = 0""",
)
def cluster_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, claims = _event_claims(spark, sf_dir)
    clusters = events.title_label(articles).withColumn("event_id", F.concat_ws("/", "security_id", "group_id"))
    return events.cluster_problems(clusters, claims, articles)


@query("flt_13_event_window", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND o_custkey % 4 <> 1 AND o_orderkey % 6 <> 5")
def event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.reports import event_window_disclosures
    from lodestone.plans.text_queries import TITLE_TOPIC_NAMES

    names = F.array(*[F.lit(name) for name in TITLE_TOPIC_NAMES])
    rows = b.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.element_at(names, F.expr("cast(1 + o_orderkey % 6 as int)")).alias("report_name"), F.to_date("o_orderdate").alias("submitted_date"),
        F.expr("CASE WHEN o_custkey % 4 = 1 THEN 'superseded' ELSE 'original' END").alias("correction_status"),
    )
    return event_window_disclosures(rows, "1996-01-01", "1997-12-31").select("o_orderkey")


@query("joi_23_title_assignment", "SELECT p_partkey AS report_id, w AS needle, CASE WHEN w IS NULL THEN 'uncovered_report' WHEN count(*) OVER (PARTITION BY w) > 1 THEN 'ambiguous_needle' END AS problem FROM part LEFT JOIN (SELECT unnest(['red', 'hot', 'BLUE bolt']) AS w) ON contains(lower(p_name), lower(w))")
def title_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("report_id"), F.col("p_name").alias("title"))
    needles = spark.createDataFrame([("red",), ("hot",), ("BLUE bolt",)], "needle string")
    return events.assign_by_title(needles, reports)


FACT_SQL = "facts AS (SELECT l_orderkey AS document_id, l_linenumber::BIGINT * 10000000000 + l_partkey * 10000 + l_suppkey AS fact_index, (['consolidated_revenue', 'capex', 'risk_or_uncertainty', 'unknown'])[1 + l_partkey % 4] AS category, l_suppkey % 5 <> 0 AS verified, CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS INTEGER) END AS page FROM lineitem)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as disclosure facts."""
    categories = F.array(*[F.lit(c) for c in ("consolidated_revenue", "capex", "risk_or_uncertainty", "unknown")])
    return b.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.expr("l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey").alias("fact_index"), F.element_at(categories, F.expr("cast(1 + l_partkey % 4 as int)")).alias("category"),
        F.concat(F.lit("claim "), F.col("l_returnflag")).alias("claim"), F.expr("CASE WHEN l_suppkey % 5 <> 0 THEN 'verified_against_source' ELSE 'pending' END").alias("verification_status"),
        F.expr("CASE WHEN l_quantity > 10 THEN cast(l_quantity as int) END").alias("page"), F.array(F.lit("II"), F.col("l_linestatus")).alias("section_path"), "l_partkey", "l_suppkey",
    )


@query("win_14_first_facts", f"WITH {FACT_SQL} SELECT document_id, category, fact_index FROM (SELECT *, row_number() OVER (PARTITION BY document_id, category ORDER BY fact_index) AS rn FROM facts WHERE verified AND category <> 'unknown') WHERE rn = 1 AND page IS NOT NULL")
def first_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.first_facts(facts(spark, sf_dir), topics.fact_topics("category", "claim")).select("document_id", "category", "fact_index")


@query("set_05_missing_categories", f"WITH {FACT_SQL} SELECT document_id, array_to_string(list_sort(list_filter(['capex', 'consolidated_revenue', 'production_or_sales'], lambda c: NOT list_contains(l, c))), '|') AS missing FROM (SELECT document_id, list(category) AS l FROM facts GROUP BY 1)")
def missing_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validation.missing_categories(facts(spark, sf_dir), "document_id", ["capex", "consolidated_revenue", "production_or_sales"])
    return rows.select("document_id", F.array_join("missing", "|").alias("missing"))


# --- claims and citations -------------------------------------------------------------------

CLAIMS_SQL = f"""claims AS (SELECT doc_id, 'c' || doc_id AS claim_id, 'ans' || (doc_id // 4) AS answer_id, (['summary', 'facts', 'positive_factors', 'risk_factors'])[1 + doc_id % 4] AS section,
  CASE doc_id % 3 WHEN 0 THEN {b.snippet_sql()} WHEN 1 THEN {b.snippet_sql()} || ' zzz qqq www' ELSE 'nothing alike xyzzy' END AS text,
  CASE WHEN doc_id % 13 = 5 THEN ['evidence:none'] WHEN doc_id % 5 = 2 THEN ['evidence:doc:' || doc_id, 'evidence:doc:' || (doc_id - 1)] ELSE ['evidence:doc:' || doc_id] END AS evidence_ids FROM documents)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim per document: a quote, a quote with added words, or something unrelated."""
    # A whole snippet, as retrieval gives it.
    flat = F.substring(F.trim(F.regexp_replace("text", r"[\t-\r\x1c-\x20]+", " ")), 1, 500)
    body = F.when(F.expr("doc_id % 3 = 0"), flat).when(F.expr("doc_id % 3 = 1"), F.concat(flat, F.lit(" zzz qqq www"))).otherwise(F.lit("nothing alike xyzzy"))
    own, before = F.expr("concat('evidence:doc:', doc_id)"), F.expr("concat('evidence:doc:', doc_id - 1)")
    ids = F.when(F.expr("doc_id % 13 = 5"), F.array(F.lit("evidence:none"))).when(F.expr("doc_id % 5 = 2"), F.array(own, before)).otherwise(F.array(own))
    return b.table(spark, sf_dir, "documents").select(
        "doc_id", F.expr("concat('c', doc_id)").alias("claim_id"), F.expr("concat('ans', doc_id div 4)").alias("answer_id"), F.expr("concat('ans', doc_id div 4)").alias("request_id"),
        F.expr("element_at(array('summary', 'facts', 'positive_factors', 'risk_factors'), cast(1 + doc_id % 4 as int))").alias("section"), body.alias("text"), ids.alias("evidence_ids"),
    )


def cited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with locator fields; every seventh locator URL differs, every eleventh lacks a provider or section."""
    rows = b.evidence(spark, sf_dir)
    gap = F.expr("doc_id % 11 = 6")
    return rows.select(
        "*", F.when(~gap, F.lit("feed")).alias("provider"), F.when(F.expr("doc_id % 7 = 3"), F.lit("https://other.example.com/")).otherwise(F.col("source_url")).alias("locator_url"),
        F.col("published_at").alias("locator_time"), F.lit(0).alias("raw_index"), F.lit("00000000000000").alias("receipt_no"), F.when(~gap, F.lit("m1")).alias("manifest_id"), F.lit("e1").alias("entry_id"),
        F.lit(1).alias("version"), F.lit("s1").alias("section"), F.lit("pdf_1_based").alias("page_basis"), F.lit(3).alias("page"), F.col("document_id").alias("locator_document_id"), F.lit(None).cast("string").alias("source_asset_id"),
    )


LOCATOR_SQL = "CASE source_type WHEN 'disclosure' THEN CASE WHEN doc_id % 11 = 6 THEN 'invalid_locator' ELSE 'unsafe_source_url' END ELSE CASE WHEN doc_id % 11 = 6 THEN 'invalid_locator' WHEN doc_id % 7 = 3 THEN 'unsafe_source_url' END END"


@query("cmp_07_locator_check", b.ctes(b.EVIDENCE_SQL) + f"SELECT evidence_id, {LOCATOR_SQL} AS issue FROM ev")
def locator_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited_evidence(spark, sf_dir).select("evidence_id", citations.locator_reason().alias("issue"))


@query("joi_17_claim_links", b.ctes(b.EVIDENCE_SQL, CLAIMS_SQL) + "SELECT claim_id, k.evidence_id, ev.evidence_id IS NOT NULL AS known FROM (SELECT claim_id, unnest(evidence_ids) AS evidence_id FROM claims) k LEFT JOIN ev ON ev.evidence_id = k.evidence_id")
def claim_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = citations.claim_links(claims(spark, sf_dir), b.evidence(spark, sf_dir))
    return rows.select("claim_id", "evidence_id", F.col("document_id").isNotNull().alias("known"))


GROUND_SQL = """lk AS (SELECT c.claim_id, c.text, e.evidence_id, e.snippet FROM (SELECT claim_id, text, unnest(evidence_ids) AS evidence_id FROM claims) c JOIN ev e USING (evidence_id)),
ct AS (SELECT claim_id, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9][a-z0-9]+')) AS toks FROM claims),
gr AS (SELECT claim_id, (count(*) = 1 AND bool_or(contains(replace(lower(snippet), 'ß', 'ss'), replace(lower(trim(text)), 'ß', 'ss')))) OR
  (len(list_distinct(flatten(list(sh)))) >= 2 AND len(list_distinct(flatten(list(sh)))) / any_value(len(toks)) >= 0.3 AND min(len(sh)) > 0) AS grounded
  FROM (SELECT lk.*, toks, list_intersect(toks, regexp_extract_all(replace(lower(snippet), 'ß', 'ss'), '[a-z0-9][a-z0-9]+')) AS sh FROM lk JOIN ct USING (claim_id)) GROUP BY 1)"""


@query("cmp_06_claim_grounding", b.ctes(b.EVIDENCE_SQL, CLAIMS_SQL, GROUND_SQL) + "SELECT claim_id, grounded FROM gr")
def claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.claim_grounding(claims(spark, sf_dir), b.evidence(spark, sf_dir))


@query(
    "cmp_05_citation_rejections",
    b.ctes(b.EVIDENCE_SQL, CLAIMS_SQL, GROUND_SQL) + f""", rw AS (SELECT c.claim_id, CASE WHEN e.evidence_id IS NULL THEN 1 WHEN NOT CASE e.scope WHEN 'company_specific' THEN e.subject_security_ids = ['en'] WHEN 'multi_company' THEN list_contains(e.subject_security_ids, 'en') ELSE list_contains(e.mentioned_security_ids, 'en') END THEN 2
  WHEN {LOCATOR_SQL} = 'invalid_locator' THEN 3 WHEN {LOCATOR_SQL} = 'unsafe_source_url' THEN 4 END AS place FROM (SELECT claim_id, unnest(evidence_ids) AS evidence_id FROM claims) c LEFT JOIN ev e USING (evidence_id)),
w AS (SELECT claim_id, min(place) AS place FROM rw GROUP BY 1)
SELECT claim_id, (['unknown_evidence', 'wrong_company', 'invalid_locator', 'unsafe_source_url', 'unsupported_claim'])[coalesce(place, 5)] AS code FROM w LEFT JOIN gr USING (claim_id) WHERE place IS NOT NULL OR NOT coalesce(grounded, false)""",
)
def citation_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims(spark, sf_dir)
    asked = rows.select("request_id").distinct().withColumn("security_id", F.lit("en"))
    _, rejections = citations.validate_citations(rows, asked, cited_evidence(spark, sf_dir))
    return rejections


@query("cmp_08_numeric_grounding", "SELECT o_orderkey AS claim_id, NOT (o_orderkey % 3 = 1) AS numbers_supported FROM orders")
def numeric_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order claims its total and date; every third claims a figure its evidence lacks."""
    orders = b.table(spark, sf_dir, "orders")
    total, day = F.format_string("%.2f", "o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd")
    evidence_id = F.col("o_orderkey").cast("string")
    rows = orders.select(
        F.col("o_orderkey").alias("claim_id"), F.array(evidence_id).alias("evidence_ids"),
        F.concat(F.lit("total "), total, F.when(F.expr("o_orderkey % 3 = 1"), F.lit(" or 123456789 won")).otherwise(F.lit(" as said"))).alias("text"),
    )
    sources = orders.select(evidence_id.alias("evidence_id"), F.concat(F.lit("On "), day, F.lit(" came "), total, F.lit(" in all")).alias("snippet"))
    return claim_ops.numeric_support(rows, sources)


@query(
    "cmp_09_answer_gate",
    """SELECT answer_id, CASE WHEN bool_or(unsafe) THEN 'safety_blocked' WHEN count(*) FILTER (ok) = 0 THEN 'nothing_accepted' WHEN bool_or(ok AND section = 2) AND bool_or(ok AND section = 3) THEN 'missing_uncertainty' ELSE 'accepted' END AS verdict, count(*) FILTER (ok) AS accepted
FROM (SELECT 'ans' || (doc_id // 4) AS answer_id, doc_id % 4 AS section, doc_id % 10 = 7 AS unsafe, doc_id % 3 <> 2 AS ok FROM documents) GROUP BY 1""",
)
def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "documents").select(
        F.expr("concat('ans', doc_id div 4)").alias("answer_id"), F.expr("element_at(array('summary', 'facts', 'positive_factors', 'risk_factors'), cast(1 + doc_id % 4 as int))").alias("section"),
        F.expr("concat('claim number ', doc_id, CASE WHEN doc_id % 10 = 7 THEN ' gives a guaranteed return' ELSE '' END)").alias("text"), F.expr("doc_id % 3 <> 2").alias("supported"),
    )
    return claim_ops.gate_answers(rows).select("answer_id", "verdict", "accepted")


@query(
    "cmp_10_claim_structure",
    """SELECT answer_id, count(DISTINCT t) = count(*) AS unique_claims, bool_and(ordered) AND count(*) FILTER (section = 0) = 1 AS sections_in_order FROM (SELECT *, coalesce(section >= lag(section) OVER (PARTITION BY answer_id ORDER BY doc_id), true) AS ordered
FROM (SELECT doc_id, 'ans' || (doc_id // 4) AS answer_id, CASE WHEN doc_id % 24 IN (5, 6) THEN 9 - doc_id % 24 ELSE doc_id % 4 END AS section, CASE WHEN doc_id % 20 = 3 THEN 't' || (doc_id - 1) ELSE 't' || doc_id END AS t FROM documents)) GROUP BY 1""",
)
def claim_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "documents").select(
        F.expr("concat('ans', doc_id div 4)").alias("answer_id"), F.col("doc_id").alias("position"),
        F.expr("element_at(array('summary', 'facts', 'interpretation', 'inference', 'positive_factors'), cast(1 + CASE WHEN doc_id % 24 IN (5, 6) THEN 9 - doc_id % 24 ELSE doc_id % 4 END as int))").alias("section"),
        F.expr("CASE WHEN doc_id % 20 = 3 THEN concat('t', doc_id - 1) ELSE concat('t', doc_id) END").alias("text"), F.array(F.lit("e")).alias("evidence_ids"),
    )
    return claim_ops.structure_problems(rows)


# --- evaluation -----------------------------------------------------------------------------

SCORES_SQL = "scores AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'b' ELSE 'a' END AS metric, quality = 1 AS label, round(n_chars % 1000 / 1000.0, 3)::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("doc_id", F.expr("round(n_chars % 1000 / 1000, 3)").alias("score"))
    return b.table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", F.expr("CASE WHEN toxic = 1 THEN 'b' ELSE 'a' END").alias("metric"), F.expr("quality = 1").alias("label"), "score"
    )


@query(
    "agg_21_calibration",
    f"""WITH {SCORES_SQL}, v AS (SELECT DISTINCT metric, score FROM scores), cand AS (SELECT metric, score AS t FROM v UNION SELECT metric, (score + lag(score) OVER (PARTITION BY metric ORDER BY score)) / 2 FROM v UNION SELECT DISTINCT metric, 0.0 FROM v UNION SELECT DISTINCT metric, 1.000001 FROM v),
r AS (SELECT c.metric, t, count(*) FILTER ((score >= t) = label) AS agreement, count(*) FILTER (score >= t AND NOT label) AS false_pass, count(*) FILTER (score < t AND label) AS false_fail FROM cand c JOIN scores s USING (metric) WHERE t IS NOT NULL GROUP BY 1, 2)
SELECT metric, round(t, 5) AS threshold, agreement, false_pass, false_fail, CASE WHEN agreement >= 5 AND false_pass = 0 THEN 'REQUIRED' ELSE 'REPORT_ONLY' END AS status FROM r QUALIFY row_number() OVER (PARTITION BY metric ORDER BY agreement DESC, false_pass, false_fail, t DESC) = 1""",
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibrate(scores(spark, sf_dir), "metric").withColumn("threshold", F.round("threshold", 5))


@query("agg_22_fixed_threshold", f"WITH {SCORES_SQL} SELECT metric, count(*) FILTER ((score >= 0.5) = label) AS agreement, count(*) FILTER (score >= 0.5 AND NOT label) AS false_pass, count(*) FILTER (score < 0.5 AND label) AS false_fail FROM scores GROUP BY 1")
def fixed_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.fixed_threshold(scores(spark, sf_dir), "metric", F.lit(0.5))


@query("agg_20_metric_summary", f"WITH {SCORES_SQL} SELECT metric, count(*) AS total, round(avg(score), 5) AS mean, round(median(score), 5) AS median, min(score) AS minimum, count(*) FILTER (score >= 0.4) AS pass_count, round(count(*) FILTER (score >= 0.4) / count(*), 5) AS pass_rate, CASE WHEN count(*) FILTER (score >= 0.4) / count(*) >= 0.8 AND avg(score) >= 0.4 THEN 'PASS' ELSE 'FAIL' END AS status FROM scores GROUP BY 1")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    thresholds = scores(spark, sf_dir).select("metric").distinct().withColumn("threshold", F.lit(0.4)).withColumn("status", F.lit("REQUIRED"))
    rows = evaluation.metric_summary(scores(spark, sf_dir), thresholds, "metric")
    return rows.select("metric", "total", F.round("mean", 5).alias("mean"), F.round("median", 5).alias("median"), "minimum", "pass_count", F.round("pass_rate", 5).alias("pass_rate"), "status")


@query("agg_23_gate_by_label", "SELECT label, count(*) AS total, count(*) FILTER (ok) AS passed, round(100.0 * count(*) FILTER (ok) / count(*), 1) AS percentage FROM (SELECT quality = 1 AS ok, unnest([lang, source]) AS label FROM labels JOIN documents USING (doc_id)) GROUP BY 1")
def gate_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_label, _, _ = evaluation.gate_report(_cases(spark, sf_dir))
    # Rounded once, from the counts: the report's own two digits would be rounded again.
    return per_label.withColumn("percentage", F.round(F.col("passed") * 100 / F.col("total") * 10) / 10)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("taxonomy"))
    return b.table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("case_id"), F.expr("quality = 1").alias("passed"), F.expr("toxic = 1").alias("critical"), "taxonomy")


@query("agg_23_failed_cases", "SELECT doc_id AS case_id, toxic = 1 AS critical, unnest([lang, source]) AS label FROM labels JOIN documents USING (doc_id) WHERE quality <> 1")
def failed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, failed = evaluation.gate_report(_cases(spark, sf_dir))
    return failed


@query("agg_24_acceptance_summary", "SELECT count(*) AS cases, count(*) FILTER (doc_id % 2 = 0) AS eligible, count(*) FILTER (doc_id % 4 = 0) AS attempted, count(*) FILTER (doc_id % 8 = 0) AS succeeded, count(*) FILTER (toxic = 1) AS critical, count(*) FILTER (toxic = 1 AND doc_id % 4 = 0) AS critical_attempts, count(*) FILTER (toxic = 1 AND quality <> 1) AS critical_failures, bool_and(quality = 1) AS all_valid FROM labels")
def acceptance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "labels").select(
        F.expr("doc_id % 2 = 0").alias("eligible"), F.expr("doc_id % 4 = 0").alias("attempted"), F.expr("doc_id % 8 = 0").alias("succeeded"), F.expr("toxic = 1").alias("critical"), F.expr("quality = 1").alias("valid")
    )
    return evaluation.acceptance_summary(rows)


@query("agg_25_source_health", "SELECT user_id, CASE WHEN bool_and(g) THEN 'ok' WHEN bool_or(g) THEN 'degraded' ELSE 'error' END AS health FROM (SELECT user_id, event_type <> 'error' AND user_id % 3 <> 1 AS g FROM events) GROUP BY 1")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "events").select("user_id", F.expr("CASE WHEN event_type = 'error' THEN 'timeout' ELSE 'ok' END").alias("status"), F.lit(1).alias("document_count"), F.expr("CASE WHEN user_id % 3 = 1 THEN 2 ELSE 1 END").alias("expected_count"))
    return policy.health(rows, "user_id")


@query("cmp_21_leakage_audit", b.ctes(b.EVIDENCE_SQL) + "SELECT d.publisher AS answer_id, count(*) FILTER (ev.published_at > TIMESTAMP '2024-09-01') AS future_rows, count(*) FILTER (len(ev.subject_security_ids) > 0 AND NOT list_contains(ev.subject_security_ids, 'en')) AS wrong_company_rows FROM ev JOIN docs d USING (document_id) GROUP BY 1")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    publishers = b.documents(spark, sf_dir).select("document_id", F.col("publisher").alias("answer_id"))
    rows = b.evidence(spark, sf_dir).join(publishers, "document_id")
    answers = publishers.select("answer_id").distinct().withColumn("basis_at", F.lit("2024-09-01 00:00:00").cast("timestamp")).withColumn("expected_security_id", F.lit("en"))
    return evaluation.leakage_audit(answers, rows.select("answer_id", "published_at", "subject_security_ids"))


@query("cmp_22_golden_mismatches", "SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'lang' END, CASE WHEN doc_id % 7 = 0 THEN 'source' END, CASE WHEN lang = 'fr' THEN 'banned' END], lambda x: x IS NOT NULL), '|') AS failures FROM documents")
def golden_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    expected = docs.select("doc_id", "lang", "source", F.array(F.lit("fr")).alias("banned"))
    actual = docs.select(
        "doc_id", F.expr("CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END").alias("lang"), F.expr("CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END").alias("source"), F.array("lang").alias("seen")
    )
    rows = evaluation.golden_mismatches(expected, actual, "doc_id", ["lang", "source"], {"banned": "seen"})
    return rows.select("doc_id", F.array_join("failures", "|").alias("failures"))


@query("val_12_acceptance_check", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'status' WHEN lang <> 'en' THEN 'security' WHEN doc_id % 7 = 0 THEN 'intent' WHEN doc_id % 11 = 0 THEN 'sources' WHEN contains(text, 'ation') THEN 'forbidden_phrase' END AS reason FROM documents")
def acceptance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.array(F.lit("complete"), F.lit("partial")).alias("allowed_statuses"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'blocked' ELSE 'partial' END").alias("status"), F.col("lang").alias("security_id"),
        F.lit("en").alias("expected_security_id"), F.expr("CASE WHEN doc_id % 7 = 0 THEN 'price' ELSE 'recent_issue' END").alias("intent"), F.lit("recent_issue").alias("expected_intent"),
        F.expr("CASE WHEN doc_id % 11 = 0 THEN array('x') ELSE array('news') END").alias("returned_sources"), F.array(F.lit("news")).alias("required_evidence_sources"),
    )
    return rows.select("doc_id", evaluation.acceptance_reason("text", ["ation"]).alias("reason"))


@query(
    "cmp_03_evidence_decision",
    """WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'price_move' WHEN 1 THEN 'recent_issue' WHEN 2 THEN 'prohibited_advice' WHEN 3 THEN 'out_of_scope' ELSE 'multi_source_summary' END AS intent, o_orderkey % 5 IN (2, 3) AS clar, o_custkey % 3 <> 0 AS news, o_custkey % 5 = 0 AS disc, o_orderkey % 11 = 4 AS failed, o_orderkey % 13 = 1 AS warned FROM orders),
d AS (SELECT *, CASE intent WHEN 'multi_source_summary' THEN ['news', 'disclosure', 'research_report'] WHEN 'price_move' THEN ['news'] WHEN 'recent_issue' THEN ['news'] ELSE [] END AS cov, list_filter([CASE WHEN news THEN 'news' END, CASE WHEN disc THEN 'disclosure' END, 'research_report'], lambda x: x IS NOT NULL) AS ret FROM r)
SELECT k AS request_id, CASE WHEN clar THEN CASE WHEN intent = 'prohibited_advice' THEN 'blocked' ELSE 'no_evidence' END WHEN NOT news THEN CASE WHEN failed THEN 'provider_failed' ELSE 'no_evidence' END
  WHEN len(list_filter(cov, lambda c: NOT list_contains(ret, c))) > 0 OR failed OR warned THEN 'partial' ELSE 'complete' END AS status, array_to_string(list_filter(cov, lambda c: NOT list_contains(ret, c)), ',') AS missing FROM d""",
)
def evidence_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-03 with SET-03: a decision for every order standing for a request."""
    orders = b.table(spark, sf_dir, "orders")
    intents = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'price_move' WHEN 1 THEN 'recent_issue' WHEN 2 THEN 'prohibited_advice' WHEN 3 THEN 'out_of_scope' ELSE 'multi_source_summary' END")
    base = orders.select(F.col("o_orderkey").alias("request_id"), intents.alias("intent"), F.expr("o_orderkey % 5 IN (2, 3)").alias("requires_clarification"), "o_custkey")
    empty = F.array().cast("array<string>")
    asked = base.withColumn("required_sources", F.coalesce(policy.required_sources("intent"), empty))
    returned = base.select("request_id", F.explode(F.array_compact(F.expr("array(CASE WHEN o_custkey % 3 <> 0 THEN 'news' END, CASE WHEN o_custkey % 5 = 0 THEN 'disclosure' END, 'research_report')"))).alias("source_type"))
    statuses = base.select("request_id", F.lit("news").alias("source_type"), F.expr("CASE WHEN request_id % 11 = 4 THEN 'timeout' ELSE 'ok' END").alias("status"))
    warnings = base.where("request_id % 13 = 1").select("request_id", F.lit("news").alias("source_type"), F.lit("stale_news").alias("code"))
    diagnostics = base.select("request_id", F.expr("CASE WHEN o_custkey % 3 <> 0 THEN 'ok' ELSE 'empty' END").alias("status"))
    rows = policy.decide(asked, statuses, warnings, returned, diagnostics)
    return rows.select("request_id", "status", F.array_join("missing_sources", ",").alias("missing"))


@query("set_03_source_coverage", "SELECT o_orderkey, array_to_string(list_filter(['news', 'disclosure', 'research_report'], lambda s: list_contains(ret, s)), ',') AS satisfied, array_to_string(list_filter(['news', 'disclosure', 'research_report'], lambda s: NOT list_contains(ret, s)), ',') AS missing FROM (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN ['glossary', 'news'] WHEN 1 THEN ['research_report', 'disclosure'] ELSE ['news'] END AS ret FROM orders)")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = F.array(F.lit("news"), F.lit("disclosure"), F.lit("research_report"))
    rows = b.table(spark, sf_dir, "orders").withColumn("returned", F.expr("CASE o_custkey % 3 WHEN 0 THEN array('glossary', 'news') WHEN 1 THEN array('research_report', 'disclosure') ELSE array('news') END"))
    satisfied, missing = policy.coverage(required, "returned")
    return rows.select("o_orderkey", F.array_join(satisfied, ",").alias("satisfied"), F.array_join(missing, ",").alias("missing"))


@query("set_04_matrix_equality", """WITH e AS (SELECT DISTINCT c_nationkey AS nation, c_custkey % 7 AS part FROM customer), o AS (SELECT DISTINCT s_nationkey AS nation, s_suppkey % 7 AS part FROM supplier)
SELECT *, 'missing' AS problem FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM o) UNION ALL SELECT *, 'surplus' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM e)""")
def matrix_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected matrix is the customers' (nation, part) pairs, the observed one the suppliers'."""
    expected = b.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.expr("c_custkey % 7").alias("part")).distinct()
    observed = b.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.expr("s_suppkey % 7").alias("part")).distinct()
    return validation.matrix_difference(observed, expected)
