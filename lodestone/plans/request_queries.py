"""Questions, glossaries, sessions, reports, sources and streams bound to the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import coverage, dialogue, evidence as ev, inventory, planning, reports, resolve, selection, validation
from lodestone.plans import bindings as b
from lodestone.plans.event_queries import facts
from lodestone.plans.registry import query
from lodestone.plans.text_queries import DEMO_LEXICON, NAME_SQL, REMARK_SQL, disclosure_names, focus_sql, intent_sql
from lodestone.sources import readers, sinks
from lodestone.streaming import flows, state

# --- resolution -----------------------------------------------------------------------------


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as securities: id, ticker, name and one alias each."""
    return b.table(spark, sf_dir, "customer").select(
        F.expr("concat('KRX:', lpad(cast(c_custkey as string), 6, '0'))").alias("security_id"), F.expr("lpad(cast(c_custkey as string), 6, '0')").alias("ticker"),
        F.col("c_name").alias("security_name"), F.array(F.expr("concat('Acct  ', c_custkey)")).alias("aliases"), F.expr("concat(c_name, ' Corp')").alias("corp_name"),
    )


@query(
    "joi_03_resolve",
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 4 THEN 'ambiguous' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'not_found' ELSE 'resolved' END AS status, CASE WHEN o_orderkey % 7 < 4 THEN 'KRX:' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS security_id,
  (['security_id', 'ticker', 'name', 'alias', 'none', 'unsupported_rule', 'none'])[1 + o_orderkey % 7] AS matched_by FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(
        "CASE o_orderkey % 7 WHEN 0 THEN concat(' krx:', lpad(cast(o_custkey as string), 6, '0')) WHEN 1 THEN lpad(cast(o_custkey as string), 6, '0') WHEN 2 THEN upper(c_name)"
        " WHEN 3 THEN concat('ACCT ', o_custkey) WHEN 4 THEN 'Samsung' WHEN 5 THEN 'AAPL' ELSE 'no such company' END"
    )
    orders = b.table(spark, sf_dir, "orders").join(b.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = resolve.resolve(orders.select("o_orderkey", text.alias("query")), resolve.lookup_table(securities(spark, sf_dir)), ambiguous=["samsung"], unsupported=["nasdaq"])
    return rows.select("o_orderkey", F.col("resolution_status").alias("status"), "security_id", "matched_by")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per order: about one customer, two customers, an ambiguous name or nobody."""
    first = F.expr("CASE o_orderkey % 2 WHEN 0 THEN concat('Acct ', o_custkey) ELSE lpad(cast(o_custkey as string), 6, '0') END")
    text = (
        F.when(F.expr("o_orderkey % 5 = 3"), F.concat(F.lit("compare "), first, F.lit(" with "), F.expr("lpad(cast((o_custkey + 1) % 10 as string), 6, '0')"), F.lit(" please")))
        .when(F.expr("o_orderkey % 5 = 4"), F.lit("what does 9999999 mean")).when(F.expr("o_orderkey % 5 = 2"), F.concat(F.lit("AAPL or "), first))
        .otherwise(F.concat(F.lit("tell me about ("), first, F.lit(") now")))
    )
    return b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), text.alias("question"), "o_custkey")


@query(
    "joi_04_question_securities",
    """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 5 IN (0, 1) OR (o_orderkey % 5 = 3 AND o_custkey = (o_custkey + 1) % 10) THEN 'KRX:' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS security_id,
  o_orderkey % 5 = 3 AS multi_security, o_orderkey % 5 IN (2, 3) AS unclear_security FROM orders""",
)
def question_securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = resolve.lookup_table(securities(spark, sf_dir))
    return resolve.extract_securities(questions(spark, sf_dir), lookup, hints=["acct"])


PLAN_SQL = f"""WITH q AS (SELECT doc_id, trim(regexp_replace(text, '{b.BLANK_SQL}', ' ', 'g')) AS t FROM documents),
f AS (SELECT doc_id, replace(lower(t), 'ß', 'ss') AS q, {intent_sql("replace(lower(t), 'ß', 'ss')")} AS rule FROM q),
p AS (SELECT *, doc_id % 3 <> 0 AS has_security, contains(q, 'erthand') AS prohibited FROM f),
i AS (SELECT *, CASE WHEN prohibited THEN 'prohibited_advice' WHEN rule = 'out_of_scope' AND NOT contains(q, 'ingthe') AND has_security AND regexp_matches(q, '[a-z]') THEN 'multi_source_summary' ELSE rule END AS intent FROM p),
c AS (SELECT *, prohibited OR intent = 'out_of_scope' OR (intent <> 'financial_term' AND NOT has_security) AS clarify FROM i)
"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a question about a language, for two documents in three."""
    docs = b.table(spark, sf_dir, "documents")
    asked = docs.select(F.col("doc_id").alias("request_id"), F.col("text").alias("question"), F.lit("2024-02-15").cast("date").alias("basis_day"))
    named = docs.select(
        F.col("doc_id").alias("request_id"), F.when(F.expr("doc_id % 3 <> 0"), F.concat(F.lit("L:"), "lang")).alias("security_id"),
        F.lit(False).alias("multi_security"), F.lit(False).alias("unclear_security"),
    )
    langs = docs.select(F.concat(F.lit("L:"), "lang").alias("security_id"), F.lit("99").alias("ticker"), F.lit("zzname").alias("security_name"), F.lit("zzcorp").alias("corp_name")).distinct()
    return planning.question_features(asked, named, langs, DEMO_LEXICON, content="[a-z]", bounded=[], today=["today"], recent=["recent"])


@query(
    "cmp_23_request_plans",
    PLAN_SQL + f"SELECT doc_id AS request_id, intent, clarify AS requires_clarification, CASE WHEN NOT clarify THEN {focus_sql('q', 'intent')} END AS answer_focus, CASE WHEN clarify THEN '' ELSE CASE intent WHEN 'financial_term' THEN 'glossary' WHEN 'disclosure_summary' THEN 'disclosure' WHEN 'research_report_summary' THEN 'research_report' WHEN 'recent_issue' THEN 'news' WHEN 'price' THEN '' ELSE 'news,disclosure,research_report' END END AS sources, CASE WHEN NOT clarify AND intent = 'price_move' THEN '2024-02-15' END AS start_day FROM c",
)
def request_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planning.plan_requests(_features(spark, sf_dir), DEMO_LEXICON)
    return rows.select("request_id", "intent", "requires_clarification", "answer_focus", F.array_join("required_sources", ",").alias("sources"), F.col("start_day").cast("string").alias("start_day"))


@query("cmp_24_follow_ups", None)
def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of all conversations; every third names a security, every fifth only follows up."""
    turns = b.table(spark, sf_dir, "conversations").where("role = 'user'")
    question = F.when(F.expr("turn % 5 = 4"), F.lit("xfollow 12")).otherwise(F.col("text"))
    key = F.expr("conv_id * 100000 + turn")
    asked = turns.select(key.alias("request_id"), question.alias("question"), F.lit("2024-02-15").cast("date").alias("basis_day"))
    named = turns.select(
        key.alias("request_id"), F.when(F.expr("(conv_id + turn) % 3 = 0"), F.lit("L:1")).alias("security_id"), F.lit(False).alias("multi_security"), F.lit(False).alias("unclear_security")
    )
    listed = turns.select(F.lit("L:1").alias("security_id"), F.lit("99").alias("ticker"), F.lit("zzname").alias("security_name"), F.lit("zzcorp").alias("corp_name")).distinct()
    features = planning.question_features(asked, named, listed, DEMO_LEXICON, content="[a-z]", bounded=[])
    rows = features.withColumn("session_id", F.expr("request_id div 100000")).withColumn("turn", F.expr("request_id % 100000"))
    return dialogue.follow_up_plans(rows).select("session_id", "turn", "plan_intent", "plan_security", "plan_clarify")


# --- glossary -------------------------------------------------------------------------------


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as glossary entries, one per brand and type."""
    parts = b.table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("k"), F.min("p_size").alias("size"))
    return parts.select(
        F.concat_ws("/", "p_brand", "p_type").alias("entry_id"), F.lit(1).alias("version"), F.concat("p_brand", F.lit(" "), "p_type").alias("canonical_term"),
        F.array(F.concat(F.lit("term"), "k"), F.concat("p_type", F.lit("-"), "p_brand")).alias("aliases"), F.concat(F.lit("defines "), "p_brand").alias("definition"),
        F.concat(F.lit("matters for "), "p_type").alias("why_it_matters"), F.lit("take care").alias("caution"), F.expr("CASE WHEN size % 2 = 0 THEN concat('f=', size) END").alias("formula"),
        F.expr("CASE WHEN size % 3 = 0 THEN 'e.g.' END").alias("example"), F.expr("element_at(array('approved', 'pending', 'rejected', 'synthetic'), 1 + size % 4)").alias("usage_review_status"),
        F.expr("size % 3 <> 1").alias("corpus_ingest_allowed"), F.expr("size % 5 = 0").alias("external_llm_processing_allowed"), F.expr("CASE WHEN size % 7 = 0 THEN 'synthetic' ELSE 'internal' END").alias("content_origin"),
        F.expr("CASE WHEN size % 4 = 0 THEN array(concat_ws('/', p_brand, p_type)) WHEN size % 4 = 1 THEN array('x', 'x') ELSE array('Brand#1/ECONOMY') END").alias("related_entry_ids"),
    )


GLOSSARY_SQL = """gl AS (SELECT p_brand || '/' || p_type AS entry_id, p_brand || ' ' || p_type AS canonical_term, min(p_partkey) AS k, min(p_size) AS size, p_brand, p_type FROM part GROUP BY p_brand, p_type)"""


@query("joi_24_glossary_lookup", f"WITH {GLOSSARY_SQL} SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 'not_found' ELSE 'found' END AS status, CASE WHEN p_partkey % 3 < 2 THEN p_brand || '/' || p_type END AS entry_id, (['canonical', 'alias', NULL])[1 + p_partkey % 3] AS matched_by FROM part")
def glossary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(' ', lower(p_brand), '  ', p_type) WHEN 1 THEN upper(concat(p_type, '-', p_brand)) ELSE 'unheard of' END")
    asked = b.table(spark, sf_dir, "part").select("p_partkey", text.alias("query"))
    return resolve.glossary_lookup(asked, glossary(spark, sf_dir)).select("p_partkey", "status", "entry_id", "matched_by")


@query("joi_20_glossary_phrases", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'found' ELSE 'not_found' END AS status, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '/' || p_type END AS entry_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' ' || p_type END AS matched_term FROM part")
def glossary_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = b.table(spark, sf_dir, "part").select("p_partkey", F.expr("concat('What is ', lower(p_brand), ' ', p_type, CASE WHEN p_partkey % 2 = 0 THEN '은?' ELSE 'x?' END)").alias("question"))
    entries = glossary(spark, sf_dir).select("entry_id", "canonical_term", F.array().cast("array<string>").alias("aliases"))
    return resolve.glossary_phrases(asked, entries).select("p_partkey", "status", "entry_id", "matched_term")


@query("joi_19_related_entries", f"WITH {GLOSSARY_SQL} SELECT entry_id, CASE size % 4 WHEN 0 THEN entry_id WHEN 1 THEN 'x' ELSE 'Brand#1/ECONOMY' END AS related_id, CASE WHEN size % 4 = 0 THEN 'self' WHEN size % 4 = 1 THEN 'repeated' WHEN entry_id = 'Brand#1/ECONOMY' THEN 'self' ELSE 'dangling' END AS reason FROM gl WHERE size % 4 < 2 OR entry_id = 'Brand#1/ECONOMY' OR NOT EXISTS (SELECT 1 FROM gl g WHERE g.entry_id = 'Brand#1/ECONOMY')")
def related_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.dangling_references(glossary(spark, sf_dir), "entry_id", "related_entry_ids")


@query(
    "prj_05_glossary_sections",
    f"""WITH {GLOSSARY_SQL}, s AS (SELECT entry_id, canonical_term, unnest([{{n: 'definition', t: 'defines ' || p_brand}}, {{n: 'why_it_matters', t: 'matters for ' || p_type}}, {{n: 'caution', t: 'take care'}}, {{n: 'formula', t: CASE WHEN size % 2 = 0 THEN 'f=' || size END}}, {{n: 'example', t: CASE WHEN size % 3 = 0 THEN 'e.g.' END}}]) AS x FROM gl)
SELECT 'glossary:evidence:' || sha256('["parts","' || entry_id || '",1,"' || x.n || '"]') AS evidence_id, entry_id, x.n AS section, canonical_term AS title, x.t AS snippet FROM s WHERE x.t IS NOT NULL""",
)
def glossary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.glossary_sections(glossary(spark, sf_dir), "parts")


@query("agg_13_glossary_coverage", f"WITH {GLOSSARY_SQL} SELECT count(*) AS total, count(*) FILTER (size % 4 = 0 AND size % 3 <> 1 AND size % 7 <> 0) AS approved_usable, count(*) FILTER (size % 4 = 3) AS synthetic, count(*) FILTER (size % 4 = 1) AS pending, count(*) FILTER (size % 4 = 2) AS rejected FROM gl")
def glossary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.entry_coverage(glossary(spark, sf_dir))


@query("val_03_glossary_integrity", "SELECT p_name AS lookup_key, CAST(min(p_partkey) AS BIGINT) AS first_owner, CAST(max(p_partkey) AS BIGINT) AS last_owner FROM part GROUP BY 1 HAVING min(p_partkey) <> max(p_partkey)")
def glossary_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = b.table(spark, sf_dir, "part").select(F.col("p_name").alias("lookup_key"), F.col("p_partkey").alias("owner"))
    return validation.colliding_keys(keys).select("lookup_key", "first_owner", "last_owner")


@query("val_02_alias_integrity", "SELECT k AS lookup_key, min(o) AS first_owner, max(o) AS last_owner FROM (SELECT lower(c_name) AS k, 'KRX:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS o FROM customer UNION ALL SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0'), 'KRX:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer UNION ALL SELECT 'krx:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0'), 'KRX:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer UNION ALL SELECT 'acct ' || (c_custkey % 50), 'KRX:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer) GROUP BY 1 HAVING min(o) <> max(o)")
def alias_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = securities(spark, sf_dir).withColumn("aliases", F.array(F.expr("concat('Acct ', cast(ticker as int) % 50)")))
    keys = resolve.lookup_table(rows).withColumnRenamed("security_id", "owner")
    return validation.colliding_keys(keys).select("lookup_key", "first_owner", "last_owner")


@query("val_04_permission_gate", f"WITH {GLOSSARY_SQL}, s AS (SELECT entry_id, (['approved', 'pending', 'rejected', 'synthetic'])[1 + size % 4] AS st, size % 3 <> 1 AS ing, size % 5 = 0 AS ext FROM gl) SELECT entry_id, CASE WHEN st <> 'approved' AND (ing OR ext) THEN 'unapproved_open' WHEN ext AND NOT ing THEN 'external_without_approval' END AS reason FROM s")
def permission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary(spark, sf_dir).select("entry_id", validation.permission_reason("usage_review_status", "corpus_ingest_allowed", "external_llm_processing_allowed").alias("reason"))


@query("val_08_overclaims", "SELECT doc_id, contains(replace(lower(text), 'ß', 'ss'), 'ation') OR contains(replace(lower(text), 'ß', 'ss'), 'gung') AS overclaims FROM documents")
def overclaims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", validation.overclaims("text", ["ation", "gung"]).alias("overclaims"))


# --- sessions -------------------------------------------------------------------------------

EXCHANGE_SQL = "ex AS (SELECT conv_id AS session_id, turn AS exchange_id, text AS user_text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS assistant_text FROM conversations WHERE role <> 'system' QUALIFY role = 'user' AND lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant')"


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows; system turns are skipped."""
    from pyspark.sql import Window

    spec = Window.partitionBy("conv_id").orderBy("turn")
    rows = b.table(spark, sf_dir, "conversations").where("role <> 'system'").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("exchange_id"), "role", F.col("text").alias("user_text"),
        F.lead("text").over(spec).alias("assistant_text"), F.lead("role").over(spec).alias("next_role"),
    )
    return rows.where("role = 'user' AND next_role = 'assistant'").drop("role", "next_role").withColumn("ts", F.col("exchange_id"))


@query("win_09_conversation_context", f"WITH {EXCHANGE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY exchange_id DESC) AS rn, 'User: ' || user_text || chr(10) || 'Assistant: ' || assistant_text AS block FROM ex), k AS (SELECT *, sum(length(block)) OVER (PARTITION BY session_id ORDER BY rn) AS used FROM r WHERE rn <= 2) SELECT session_id, md5(string_agg(substr(block, 1, 4000), chr(10) || chr(10) ORDER BY rn DESC)) AS context FROM k WHERE rn = 1 OR used <= 4000 GROUP BY 1")
def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.conversation_context(exchanges(spark, sf_dir)).select("session_id", F.md5("context").alias("context"))


@query("win_10_recent_exchanges", f"WITH {EXCHANGE_SQL} SELECT session_id, exchange_id, row_number() OVER (PARTITION BY session_id ORDER BY exchange_id) AS revision FROM ex QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY exchange_id DESC) <= 4")
def recent_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.recent_exchanges(exchanges(spark, sf_dir)).select("session_id", "exchange_id", "revision")


@query("win_15_memory_text", "WITH r AS (SELECT conv_id, turn, text, row_number() OVER w AS rn, sum(length(text) + 1) OVER w - 1 AS used FROM conversations WHERE length(text) > 0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, md5(string_agg(substr(text, 1, CAST(least(length(text), 2000 - used + length(text)) AS BIGINT)), chr(10) ORDER BY rn)) AS memory FROM r WHERE 2000 - used + length(text) > 0 GROUP BY 1")
def memory_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = b.table(spark, sf_dir, "conversations")
    return selection.prefix_text(turns, "conv_id", [F.col("turn")], "text").select("conv_id", F.md5("memory_text").alias("memory"))


@query("top_06_answer_limit", "SELECT doc_id, CAST(CASE WHEN doc_id % 6 = 0 AND contains(text, 'er') THEN CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END WHEN doc_id % 6 = 0 THEN 2 WHEN doc_id % 6 = 1 THEN 3 WHEN doc_id % 6 IN (2, 3) THEN 4 WHEN doc_id % 6 = 4 THEN 5 ELSE 6 END AS INTEGER) AS answer_limit FROM documents")
def answer_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "documents").select(
        "doc_id", F.expr("concat(text, CASE WHEN doc_id % 6 IN (0, 1) THEN ' 핵심만' ELSE '' END)").alias("question"), F.lit("recent_issue").alias("intent"),
        F.expr("element_at(array('disclosure', 'risk', 'recent_events', 'performance', 'outlook', 'general'), cast(1 + doc_id % 6 as int))").alias("focus"),
    )
    return rows.select("doc_id", selection.answer_limit("question", "intent", "focus").alias("answer_limit"))


@query("top_06_priority_order", "SELECT l_orderkey, l_partkey, l_suppkey, CAST(rn AS INTEGER) AS answer_rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 9 ELSE 7 END), l_linenumber::BIGINT * 10000000000 + l_partkey * 10000 + l_suppkey) AS rn FROM lineitem) WHERE rn <= 4")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).select(
        F.col("document_id").alias("request_id"), "category", F.col("fact_index").alias("position"), F.col("claim").alias("snippet"), F.lit("disclosure").alias("answer_focus"), F.lit("disclosure_summary").alias("intent"), F.lit(4).alias("answer_limit"), "l_partkey", "l_suppkey"
    )
    return selection.prioritize(rows).select(F.col("request_id").alias("l_orderkey"), "l_partkey", "l_suppkey", "answer_rank")


@query("top_07_inventory_order", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) AS BIGINT) AS place FROM orders")
def inventory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each row in the total order: range partitions, their sizes, then the place inside."""
    from lodestone.operators.order import total_order

    return total_order(b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate", "o_orderkey"]).select("o_orderkey", "place")


# --- reports and facts ------------------------------------------------------------------------


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports: each line is a page."""
    return b.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("security_id"), F.col("source").alias("publisher"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.expr("date_add(DATE '2024-01-01', cast(doc_id % 365 as int))").alias("published_date"), F.expr("concat('https://r.example.com/', doc_id)").alias("source_url"),
        F.sha2("text", 256).alias("content_hash"), F.expr("CASE WHEN doc_id % 9 = 4 THEN array('', ' ') WHEN doc_id % 9 = 5 THEN array_append(split(text, '\n'), '') ELSE split(text, '\n') END").alias("page_texts"), "doc_id",
    )


REPORT_SQL = "rep AS (SELECT doc_id, lang AS security_id, source AS publisher, CASE WHEN doc_id % 9 = 4 THEN ['', ' '] WHEN doc_id % 9 = 5 THEN list_append(string_split(text, chr(10)), '') ELSE string_split(text, chr(10)) END AS pages, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS published_date, split_part(text, chr(10), 1) AS title, sha256(text) AS content_hash FROM documents)"
REPORT_ITEMS_SQL = REPORT_SQL + ", ri AS (SELECT *, len(list_filter(pages, lambda p: trim(p) <> '')) AS filled, CASE WHEN len(list_filter(pages, lambda p: trim(p) <> '')) = 0 THEN 'image_only_visual_review_required' WHEN len(list_filter(pages, lambda p: trim(p) <> '')) = len(pages) THEN 'text_extracted' ELSE 'partial_text_extracted' END AS extraction_status, CASE WHEN published_date <= DATE '2024-09-30' THEN 'selected' ELSE 'excluded_after_cutoff' END AS selection_status FROM rep)"


@query("cmp_17_report_inventory", f"WITH {REPORT_ITEMS_SQL} SELECT 'report:' || sha256(concat_ws('|', security_id, publisher, published_date, title, content_hash)) AS report_id, CAST(len(pages) AS INTEGER) AS page_count, CAST(filled AS INTEGER) AS nonempty_pages, CAST(list_sum(list_transform(pages, lambda p: length(trim(p)))) AS INTEGER) AS characters, extraction_status, selection_status FROM ri")
def report_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inventory.report_inventory(report_rows(spark, sf_dir), "2024-09-30")
    return rows.select("report_id", "page_count", "nonempty_pages", "characters", "extraction_status", "selection_status")


@query("cmp_17_page_checksums", f"WITH {REPORT_SQL} SELECT doc_id, CAST(i AS INTEGER) AS page_number, sha256(trim(pages[i])) AS text_sha256 FROM (SELECT doc_id, pages, unnest(range(1, len(pages) + 1)) AS i FROM rep) WHERE trim(pages[i]) <> ''")
def page_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.page_checksums(report_rows(spark, sf_dir), "doc_id").select("doc_id", "page_number", "text_sha256")


@query("agg_11_report_coverage", f"WITH {REPORT_ITEMS_SQL} SELECT security_id, 'total' AS dimension, NULL AS value, count(*) AS n FROM ri GROUP BY 1 UNION ALL SELECT security_id, 'publisher', publisher, count(*) FROM ri GROUP BY 1, 3 UNION ALL SELECT security_id, 'extraction_status', extraction_status, count(*) FROM ri GROUP BY 1, 3 UNION ALL SELECT security_id, 'selection_status', selection_status, count(*) FROM ri GROUP BY 1, 3")
def report_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = inventory.report_inventory(report_rows(spark, sf_dir), "2024-09-30")
    return coverage.coverage(items, "security_id", ["publisher", "extraction_status", "selection_status"])


@query("val_10_report_recomputation", "SELECT CAST(count(*) AS BIGINT) AS changed FROM documents WHERE doc_id % 10 = 3")
def report_recomputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports_ = report_rows(spark, sf_dir)
    columns = ["report_id", "page_count", "extraction_status", "doc_id"]
    again = inventory.report_inventory(reports_, "2024-09-30").select("report_id", "page_count", "extraction_status")
    stored = inventory.report_inventory(reports_.withColumn("page_texts", F.expr("CASE WHEN doc_id % 10 = 3 THEN array_append(page_texts, 'more') ELSE page_texts END")), "2024-09-30").select(*columns[:3])
    return validation.recomputation_differences(stored, again).agg(F.count_if(F.col("side") == "stored_only").alias("changed"))


MANIFEST_SQL = """man AS (SELECT o_orderkey AS manifest_id, 'S' || (o_custkey % 20) AS security_id, CAST(o_orderdate AS DATE) AS published_day, o_orderkey % 4 <> 3 AS approved FROM orders),
sec AS (SELECT l_orderkey AS manifest_id, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS document_id, l_partkey, CAST(l_quantity AS INTEGER) AS page, l_linenumber FROM lineitem)"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as report manifests that list their lines; every sixth lists one more, every eighth leaves one out."""
    lines = sections(spark, sf_dir).groupBy("manifest_id").agg(F.array_sort(F.collect_list(F.struct("place", "document_id"))).alias("l"))
    listed = F.transform("l", lambda item: item["document_id"])
    documents = F.expr("CASE WHEN manifest_id % 6 = 1 THEN array_append(listed, 'ghost') WHEN manifest_id % 8 = 2 THEN slice(listed, 2, size(listed)) ELSE listed END")
    orders = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("manifest_id"), F.expr("concat('S', o_custkey % 20)").alias("security_id"), F.to_date("o_orderdate").alias("published_day"),
        F.expr("concat('Report ', o_orderkey % 9)").alias("report_title"), F.expr("CASE WHEN o_orderkey % 4 = 3 THEN 'pending' ELSE 'approved' END").alias("usage_review_status"),
        F.lit(True).alias("corpus_ingest_allowed"), F.lit(False).alias("external_allowed"),
    )
    return orders.join(lines.select("manifest_id", listed.alias("listed")), "manifest_id").withColumn("documents", documents).drop("listed")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    items = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct()
    spec = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    owners = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("concat('S', o_custkey % 20)").alias("security_id"))
    placed = items.dropDuplicates(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).withColumn("place", F.row_number().over(spec) - 1)
    return placed.join(owners, "l_orderkey").select(
        F.col("l_orderkey").alias("manifest_id"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("document_id"), "security_id", "place",
        F.expr("concat('Report ', l_linenumber)").alias("section"), F.col("l_quantity").cast("int").alias("page"),
    )


SECTION_SQL = "sec AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)))"


@query("joi_18_bundle_reconciliation", f"WITH {SECTION_SQL}, c AS (SELECT l_orderkey, count(*) AS n FROM sec GROUP BY 1) SELECT l_orderkey AS manifest_id, 'ghost' AS document_id, 'missing' AS problem FROM c WHERE l_orderkey % 6 = 1 UNION ALL SELECT l_orderkey, concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey), CASE WHEN place = 0 THEN 'unlisted' ELSE 'out_of_order' END FROM sec WHERE l_orderkey % 8 = 2 AND l_orderkey % 6 <> 1")
def bundle_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bundle_problems(manifests(spark, sf_dir), sections(spark, sf_dir))


@query("agg_12_valid_reports", f"WITH {SECTION_SQL}, s AS (SELECT DISTINCT 'S' || (o_custkey % 20) AS security_id FROM orders) SELECT s.security_id, count(DISTINCT o_orderkey) AS valid_reports FROM s LEFT JOIN (SELECT o_orderkey, 'S' || (o_custkey % 20) AS security_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM sec) AND o_orderkey % 6 <> 1 AND NOT (o_orderkey % 8 = 2) AND o_orderkey % 4 <> 3 AND o_orderdate <= TIMESTAMP '1998-01-01') m USING (security_id) GROUP BY 1")
def valid_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = manifests(spark, sf_dir)
    everyone = b.table(spark, sf_dir, "orders").select(F.expr("concat('S', o_custkey % 20)").alias("security_id")).distinct()
    return reports.bundle_coverage(listed, sections(spark, sf_dir), everyone, F.lit("1998-01-01").cast("date"))


@query("prj_04_section_documents", f"WITH {SECTION_SQL} SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS document_id, CASE WHEN o_orderkey % 9 = l_linenumber THEN 'Report ' || l_linenumber ELSE 'Report ' || (o_orderkey % 9) || ' - Report ' || l_linenumber END AS title, CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') AS INTEGER) AS age_days, datediff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') > 180 AS is_stale_candidate FROM sec JOIN orders ON o_orderkey = l_orderkey")
def section_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = manifests(spark, sf_dir).drop("security_id")
    rows = reports.section_documents(listed, sections(spark, sf_dir), F.lit("1998-06-01").cast("date"))
    return rows.select("document_id", "title", "age_days", "is_stale_candidate")


@query("prj_10_section_coverage", "SELECT l_orderkey AS manifest_id, count(*) AS sections, count(DISTINCT CAST(l_quantity AS INTEGER)) AS pages, count(*) >= 8 AS ready FROM lineitem GROUP BY 1")
def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("manifest_id"), F.expr("cast(l_quantity as int)").alias("page"))
    return reports.section_coverage(rows)


@query("prj_03_fact_evidence", """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n, (['consolidated_revenue', 'capex', 'risk_or_uncertainty', 'unknown'])[1 + l_partkey % 4] AS category, l_returnflag, l_linestatus FROM lineitem)
SELECT 'evidence:disclosure:' || l_orderkey || ':f' || l_linenumber AS evidence_id, 'Filing ' || l_orderkey || CASE category WHEN 'consolidated_revenue' THEN ' · 매출 실적' WHEN 'capex' THEN ' · 시설투자' WHEN 'risk_or_uncertainty' THEN ' · 위험 불확실성' ELSE '' END AS title, 'claim ' || l_returnflag AS snippet, 'II > ' || l_linestatus AS section FROM f WHERE n = 1""")
def fact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "lineitem").select(
        F.expr("concat('disclosure:', l_orderkey)").alias("document_id"), F.expr("concat('Filing ', l_orderkey)").alias("title"),
        F.struct(
            F.expr("concat('f', l_linenumber)").alias("fact_id"), F.expr("element_at(array('consolidated_revenue', 'capex', 'risk_or_uncertainty', 'unknown'), cast(1 + l_partkey % 4 as int))").alias("category"),
            F.expr("concat('claim ', l_returnflag)").alias("claim"), F.array(F.lit("II"), F.col("l_linestatus")).alias("section_path"),
        ).alias("fact"),
    )
    docs = rows.groupBy("document_id", "title").agg(F.collect_list("fact").alias("facts")).select(
        "*", F.lit("disclosure").alias("source_type"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("timestamp").alias("published_at"),
        F.array(F.lit("KRX:1")).alias("primary_security_ids"), F.array().cast("array<string>").alias("mentioned_security_ids"),
    )
    accepted, _ = ev.flatten_facts(docs)
    return accepted.select("evidence_id", "title", "snippet", "section")


@query("prj_09_facts_document", f"SELECT 'disclosure:' || l_orderkey AS document_id, md5(string_agg('claim ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS body, CAST(count(*) AS INTEGER) AS fact_count, regexp_extract(any_value(n), '\\[([^\\]]+)\\]', 1) IN ('기재정정', '첨부정정') AS is_correction, contains(any_value(r), '철') AS is_withdrawn FROM lineitem JOIN (SELECT o_orderkey, {NAME_SQL} AS n, {REMARK_SQL} AS r FROM orders) ON o_orderkey = l_orderkey GROUP BY l_orderkey")
def facts_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = disclosure_names(b.table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("l_orderkey"), "report_name", "remark")
    rows = b.table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select(
        F.col("l_orderkey").cast("string").alias("receipt_no"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("fact_id"), F.concat(F.lit("claim "), "l_returnflag").alias("claim"), "report_name", "remark"
    )
    return reports.facts_document(rows).select("document_id", F.md5("text").alias("body"), "fact_count", "is_correction", "is_withdrawn")


@query("prj_08_curated_news", "SELECT 'news:en:' || sha256('en|' || doc_id) AS document_id, CASE WHEN hour(at_ + INTERVAL 9 HOUR) < 9 THEN 'pre_market' ELSE 'intraday' END AS time_band, 'Acme: ' || trim(replace(text, chr(10), ' ')) AS text FROM (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(CAST((doc_id * 37) % 525600 AS INTEGER)) AS at_ FROM documents)")
def curated_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "documents").select(
        F.lit("en").alias("security_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit("t").alias("title"), F.expr("timestampadd(MINUTE, (doc_id * 37) % 525600, TIMESTAMP '2024-01-01 00:00:00')").alias("published_at"),
        F.lit(None).cast("string").alias("source_url"), F.lit("Acme").alias("security_name"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("summary"), F.lit(1).alias("sequence"),
    )
    return reports.curated_news(rows).select("document_id", "time_band", "text")


@query("cmp_18_fact_matrix", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 4 = 3 THEN 'category' WHEN l_suppkey % 5 = 0 THEN 'verification' WHEN CAST(l_quantity AS INTEGER) > 40 THEN 'page' END AS reason FROM lineitem")
def fact_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("concat('f', l_linenumber)").alias("fact_id"), F.lit("c").alias("claim"),
        F.expr("element_at(array('consolidated_revenue', 'capex', 'risk_or_uncertainty', 'unknown'), cast(1 + l_partkey % 4 as int))").alias("category"), F.lit("high").alias("confidence"),
        F.expr("CASE WHEN l_suppkey % 5 <> 0 THEN 'verified_against_source' ELSE 'pending' END").alias("verification_status"), F.expr("cast(l_quantity as int)").alias("page"), F.lit(40).alias("page_count"), F.array().cast("array<string>").alias("notes"),
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reports.fact_reason().alias("reason"))


RULES = [{"event_id": "e1", "time_band": "intraday", "terms": ["ation"]}, {"event_id": "e2", "time_band": "pre_market", "terms": ["er"]}, {"event_id": "e3", "time_band": "intraday", "terms": ["er", "ou"]}]


@query("win_13_rule_curation", None)
def rule_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.documents(spark, sf_dir).where("published_at IS NOT NULL").select(
        F.regexp_extract("source_url", "com/([a-z]+)/", 1).alias("security_id"), "document_id", "title", "text", "published_at", "source_url"
    )
    return reports.curate_by_rules(docs, RULES).select("security_id", "event_id", "document_id", "rule")


# --- contracts --------------------------------------------------------------------------------


@query("val_01_document_contract", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'missing_document_id' WHEN 1 THEN 'no_security' WHEN 2 THEN 'repeated_security' WHEN 3 THEN 'overlapping_security' WHEN 4 THEN 'invalid_source_url' END AS reason FROM documents WHERE trim(text) <> ''")
def document_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    docs = b.documents(spark, sf_dir).where("trim(text) <> ''").withColumn("document_id", F.expr("CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE document_id END")).withColumn(
        "primary_security_ids", F.when(F.expr("doc_id % 7 = 1"), empty).when(F.expr("doc_id % 7 = 2"), F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    ).withColumn("mentioned_security_ids", F.when(F.expr("doc_id % 7 = 3"), F.array(F.lit("a"))).otherwise(empty)).withColumn("source_url", F.expr("CASE WHEN doc_id % 7 = 4 THEN 'ftp://x' ELSE source_url END"))
    return docs.select("doc_id", ev.document_reason().alias("reason"))


@query("val_06_observation_contract", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'provider_status' WHEN 1 THEN 'evidence_decision' WHEN 2 THEN 'llm_call_count' WHEN 3 THEN 'intent_classifier_status' END AS reason FROM events")
def observation_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).withColumn("provider_statuses", F.expr("map('news', CASE WHEN event_id % 6 = 0 THEN 'odd' ELSE 'ok' END)")).withColumn(
        "evidence_decision", F.expr("CASE WHEN event_id % 6 = 1 THEN 'odd' ELSE 'partial' END")
    ).withColumn("llm_call_count", F.expr("CASE WHEN event_id % 6 = 2 THEN 3 ELSE 1 END")).withColumn("intent_routing", F.lit("hybrid_llm")).withColumn(
        "intent_classifier_status", F.expr("CASE WHEN event_id % 6 = 3 THEN 'not_called' ELSE 'accepted' END")
    ).select("event_id", validation.observation_reason().alias("reason"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request observations."""
    return b.table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr("concat('r', event_id)").alias("request_id"), F.lit("recent_issue").alias("intent"), F.lit(None).cast("string").alias("security_id"),
        F.lit(1).alias("evidence_count"), F.expr("CASE event_type WHEN 'error' THEN 'no_evidence' WHEN 'view' THEN 'partial' ELSE 'complete' END").alias("evidence_decision"), F.col("value").alias("total_latency_ms"), F.expr("event_type = 'error'").alias("fallback_used"),
    )


@query("val_07_snapshot_rows", b.ctes(b.DOCUMENTS_SQL) + "SELECT doc_id, CASE WHEN len(primary_security_ids) <> 1 OR len(mentioned_security_ids) <> 0 THEN 'attribution' WHEN source_type = 'glossary' THEN 'source_type' WHEN published_at IS NULL THEN 'missing_time' WHEN published_at > TIMESTAMP '2024-09-01' THEN 'after_basis' WHEN trim(title) = '' OR length(title) > 300 THEN 'title' WHEN source_type = 'news' AND document_type IS NULL THEN 'news_type' WHEN source_type = 'research_report' AND external_allowed THEN 'report_permission' END AS reason FROM docs")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = F.lit("2024-09-01 00:00:00").cast("timestamp")
    return b.documents(spark, sf_dir).select("doc_id", validation.snapshot_reason(basis).alias("reason"))


@query("val_11_provenance", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'missing_reference' WHEN 1 THEN 'reference_url' WHEN 2 THEN 'reference_date' WHEN 3 THEN 'receipt' WHEN 4 THEN 'viewer_url' END AS reason FROM documents")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipt = F.lpad(F.col("doc_id").cast("string"), 14, "0")
    viewer = F.concat(F.lit("https://dart.fss.or.kr/dsaf001/main.do?rcpNo="), receipt)
    url = F.when(F.expr("doc_id % 6 = 4"), F.lit("https://x.example.com/")).otherwise(viewer)
    docs = b.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.expr("doc_id % 6 = 0"), F.lit("")).otherwise(F.lit("t")).alias("reference_title"), F.lit("p").alias("reference_publisher"), url.alias("source_url"),
        F.when(F.expr("doc_id % 6 = 1"), F.lit("https://y.example.com/")).otherwise(url).alias("reference_url"), F.when(F.expr("doc_id % 6 = 2"), F.lit("2024-13-01")).otherwise(F.lit("2024-01-31")).alias("reference_published_at"),
        F.lit("disclosure").alias("source_type"), F.when(F.expr("doc_id % 6 = 3"), F.lit("12")).otherwise(receipt).alias("receipt_no"), F.concat(F.lit("disclosure:"), receipt).alias("document_id"),
    )
    return docs.select("doc_id", validation.provenance_reason().alias("reason"))


@query("joi_22_review_list", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'no_document' WHEN c_custkey % 3 = 0 THEN 'no_time' END AS problem FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 1) ON c_custkey = o_custkey")
def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.review import review_rows

    docs = b.table(spark, sf_dir, "customer").where("c_custkey % 4 <> 1").select(
        F.col("c_custkey").alias("document_id"), F.expr("CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' END").alias("published_at"), F.lit("https://x.example.com/").alias("source_url")
    )
    chosen = b.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("document_id"))
    return review_rows(chosen, docs).select("o_orderkey", "problem")


# --- recorded files -----------------------------------------------------------------------------


def _written(spark: SparkSession, df: DataFrame) -> str:
    path = f"{flows.work_dir(spark)}/files"
    df.write.json(path)
    return path


@query("src_01_feed_pages", "SELECT page_id, CAST(0 AS INTEGER) AS raw_index, url AS originallink FROM pages")
def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("page_id").cast("string").alias("title"), F.col("url").alias("originallink"), F.lit("").alias("link"), F.lit("").alias("description"), F.lit("").alias("pubDate"))
    pages = b.table(spark, sf_dir, "pages").select(F.struct(F.array(item).alias("items")).alias("body"))
    rows = readers.feed_items(readers.read_json(spark, _written(spark, pages), readers.FEED_PAGE, multi_line=False))
    return rows.select(F.col("title").cast("bigint").alias("page_id"), "raw_index", "originallink")


@query("src_02_disclosure_lists", "SELECT lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS rcept_no, CASE WHEN o_orderkey % 2 = 0 THEN 'old' || o_orderkey END AS corrects FROM orders WHERE o_orderkey % 5 <> 0")
def disclosure_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipt = F.lpad(F.col("o_orderkey").cast("string"), 14, "0")
    item = F.struct(F.lit("Y").alias("corp_cls"), receipt.alias("rcept_no"))
    links = F.when(F.expr("o_orderkey % 2 = 0"), F.create_map(receipt, F.concat(F.lit("old"), "o_orderkey")))
    files = b.table(spark, sf_dir, "orders").select(
        F.struct(F.expr("CASE WHEN o_orderkey % 5 = 0 THEN '013' ELSE '000' END").alias("status"), F.array(item).alias("list")).alias("response"), F.struct(links.alias("correction_links")).alias("extensions")
    )
    rows = readers.disclosure_items(readers.read_json(spark, _written(spark, files), readers.DISCLOSURE_LIST, multi_line=False))
    return rows.select("rcept_no", "corrects")


@query("src_05_market_snapshots", "SELECT CAST(c_custkey AS BIGINT) AS k, CASE WHEN c_custkey % 5 = 0 THEN 'identity' WHEN c_custkey % 5 = 1 THEN 'currency' WHEN c_custkey % 5 = 2 THEN 'trading_date' END AS reason FROM customer")
def market_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = securities(spark, sf_dir)
    snapshot = F.struct(
        "security_id", F.lit("KRX").alias("market"), "ticker", F.when(F.expr("cast(ticker as int) % 5 = 0"), F.lit("wrong")).otherwise(F.col("security_name")).alias("security_name"),
        F.expr("CASE WHEN cast(ticker as int) % 5 = 2 THEN '2024-01-02' ELSE '2024-01-03' END").alias("trading_date"), F.lit("2024-01-03T10:00:00+09:00").alias("observed_at"), F.lit(110).alias("price"), F.lit(100).alias("previous_close"),
        F.lit(10).alias("change"), F.lit(10).alias("change_percent"), F.lit("regular").alias("market_session"), F.expr("CASE WHEN cast(ticker as int) % 5 = 1 THEN 'USD' ELSE 'KRW' END").alias("currency"),
    )
    files = known.select(F.lit(1).alias("schema_version"), F.array(snapshot).alias("snapshots"))
    rows = readers.market_snapshots(readers.read_json(spark, _written(spark, files), readers.SNAPSHOT_FILE, multi_line=False), known)
    return rows.select(F.col("ticker").cast("bigint").alias("k"), "reason")


@query("src_06_raw_pages", "SELECT page_id, 'q' || (page_id % 3) || '|start=' || (page_id % 50) AS tag FROM pages")
def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("page_id").cast("string").alias("title"))
    page = F.struct(F.expr("cast(page_id % 50 as int)").alias("start"), F.array(item).alias("items"))
    files = b.table(spark, sf_dir, "pages").select(F.expr("concat('q', page_id % 3)").alias("query"), F.array(page).alias("pages"))
    rows = readers.raw_pages(readers.read_json(spark, _written(spark, files), readers.RAW_PAGES, multi_line=False))
    return rows.select(F.col("title").cast("bigint").alias("page_id"), F.regexp_replace("provenance", r"\|[^|]+\|", "|").alias("tag"))


@query("src_07_corpus_reconciliation", "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'missing' WHEN doc_id % 10 = 4 THEN 'unlisted' WHEN doc_id % 10 = 5 THEN 'out_of_order' END AS problem FROM documents WHERE doc_id % 10 IN (3, 4, 5)")
def corpus_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("doc_id")
    listed = docs.where("doc_id % 10 <> 4").withColumn("place", F.expr("CASE WHEN doc_id % 10 = 5 THEN -1 ELSE doc_id END"))
    return validation.reconcile(listed, docs.where("doc_id % 10 <> 3").withColumn("place", F.col("doc_id")), "doc_id", "place")


@query("src_08_glossary_corpus", f"WITH {GLOSSARY_SQL} SELECT 'parts' AS corpus_id, entry_id, canonical_term FROM gl")
def glossary_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = glossary(spark, sf_dir)
    files = entries.select(F.lit("parts").alias("corpus_id"), F.array(F.struct(*entries.columns)).alias("entries"))
    rows = readers.glossary_entries(readers.read_json(spark, _written(spark, files), readers.GLOSSARY, multi_line=False))
    return rows.select("corpus_id", "entry_id", "canonical_term")


@query("src_09_report_bundles", f"WITH {SECTION_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS manifest_id, count(*) AS sections, CAST(max(place) AS INTEGER) AS last_place FROM sec GROUP BY 1")
def report_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections(spark, sf_dir)
    listed = manifests(spark, sf_dir).select(F.col("manifest_id").cast("string").alias("manifest_id"), "security_id", F.col("report_title").alias("title"), "documents")
    bundles = rows.groupBy(F.col("manifest_id").cast("string").alias("manifest_id")).agg(F.array_sort(F.collect_list(F.struct("place", "document_id", "security_id", "section", "page"))).alias("documents"))
    _, read = readers.report_bundle(
        readers.read_json(spark, _written(spark, listed), readers.MANIFEST, False), readers.read_json(spark, _written(spark, bundles), readers.SECTIONS, False)
    )
    return read.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("sections"), F.max("place").alias("last_place"))


@query("src_13_report_files", "SELECT CAST(n_nationkey AS INTEGER) AS k, n_name AS publisher, '2024-01-05' AS published_date, sha256('report ' || n_name || chr(10)) AS content_hash FROM nation")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file per nation, named like a report."""
    folder = f"{flows.work_dir(spark)}/reports"
    names = b.table(spark, sf_dir, "nation").select(
        F.format_string("%06d", "n_nationkey").alias("ticker"), F.concat(F.replace("n_name", F.lit("_"), F.lit(" ")), F.lit("_Kim_Outlook_240105")).alias("stem"), F.concat(F.lit("report "), "n_name").alias("value")
    )
    names.write.partitionBy("ticker", "stem").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    part = F.regexp_extract(F.url_decode("path"), r"ticker=(\d+)/stem=([^/]+)/", 2)
    named = readers.report_names(files.withColumn("path", F.concat(F.regexp_extract("path", r"ticker=(\d+)/", 1), F.lit("/"), part, F.lit(".pdf"))))
    return named.select(F.col("ticker").cast("int").alias("k"), F.replace("publisher", F.lit(" "), F.lit("_")).alias("publisher"), F.col("published_date").cast("string").alias("published_date"), "content_hash")


INVENTORY_ROWS = 5_000
INVENTORY_SQL = f"""WITH lines AS (SELECT o_orderstatus, o_orderdate, o_orderkey, '{{"order_date":"' || strftime(o_orderdate, '%Y-%m-%d') || '","order_id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}}' AS line FROM orders),
  placed AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM lines)
SELECT o_orderstatus AS status, CAST(place // {INVENTORY_ROWS} AS INTEGER) AS part, sha256(string_agg(line || chr(10), '' ORDER BY place)) AS sha256 FROM placed GROUP BY 1, 2"""


@query("snk_01_inventory_files", INVENTORY_SQL)
def inventory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the orders by status as sorted JSON lines and hashes the bytes of each file."""
    path = f"{flows.work_dir(spark)}/inventory"
    items = b.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), F.col("o_orderkey").alias("order_id"))
    sinks.write_inventory(items, path, "status", ["order_date", "order_id"], INVENTORY_ROWS)
    return sinks.inventory_hashes(spark, path, "status")


@query("snk_02_snapshot_bundle", "SELECT 'nations' AS table_name, (SELECT count(*) FROM nation) AS row_count UNION ALL SELECT 'orders', (SELECT count(*) FROM orders)")
def snapshot_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"nations": b.table(spark, sf_dir, "nation"), "orders": b.table(spark, sf_dir, "orders")}
    return sinks.write_snapshot(tables, f"{flows.work_dir(spark)}/snapshot", parts=32).where("level = 'table'").select("table_name", "row_count")


BUNDLE_SQL = """WITH d AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'disclosure' ELSE 'research_report' END AS source_type, lang AS security_id, doc_id FROM documents),
  c AS (SELECT count(*) AS n FROM (SELECT 1 FROM d GROUP BY ROLLUP (source_type, security_id))), e AS (SELECT 'documents' AS table_name, count(*) AS row_count FROM d UNION ALL SELECT 'coverage', n FROM c UNION ALL SELECT 'permissions', 3)
SELECT table_name, row_count, CAST(0 AS BIGINT) AS altered FROM e"""


@query("snk_02_service_bundle", BUNDLE_SQL)
def service_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the bundle of all documents and reads it back: rows by table, and parts whose rows do not give the manifest's hash."""
    docs = b.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), "doc_id").alias("document_id"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'disclosure' ELSE 'research_report' END").alias("source_type"),
        F.col("lang").alias("security_id"), F.expr("if(doc_id % 2 = 0, 'pre_market', 'intraday')").alias("band"), F.expr("doc_id % 5").alias("fact_count"), F.col("source").alias("report_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 86400).alias("published_at"), "text",
    )
    register = spark.createDataFrame(
        [("news", "approved", True, True), ("disclosure", "approved", True, True), ("research_report", "approved", True, False)],
        "source_type string, usage_review_status string, corpus_ingest_allowed boolean, external_llm_processing_allowed boolean",
    )
    path = f"{flows.work_dir(spark)}/bundle"
    manifest = sinks.write_bundle(docs, register, path, "2024-01-02 00:00:00", parts=32)
    altered = sinks.altered_parts(spark, path, {"documents": docs.schema, "coverage": coverage.snapshot_coverage(docs).schema, "permissions": register.schema})
    counts = altered.groupBy("table_name").agg(F.count(F.lit(1)).alias("altered"))
    return manifest.where("level = 'table'").join(counts, "table_name", "left").select("table_name", "row_count", F.coalesce("altered", F.lit(0)).alias("altered"))


@query("snk_03_observation_records", "SELECT '{\"event_type\":\"' || event_type || '\",\"request_id\":' || event_id || '}' AS value FROM events")
def observation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.observation_lines(b.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "event_type"))


# --- request streams ----------------------------------------------------------------------------


def request_rows(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"
    )


def event_stream(spark: SparkSession, sf_dir: str, files: int = 64) -> DataFrame:
    """The events as a stream, whether the table is one file or a folder of part files; ``files`` of them a micro-batch."""
    path = f"{sf_dir}/events.parquet"
    schema = b.table(spark, sf_dir, "events").schema
    inside = spark.read.format("binaryFile").load(path).select("path").limit(1).first()
    whole = inside is not None and inside["path"].rstrip("/").endswith("/events.parquet")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if whole else reader.parquet(path)


def squeezed(df: DataFrame) -> DataFrame:
    """Requests a hundred times denser in time, so that the limits bite."""
    since = F.unix_micros("ts") - F.lit(1704067200000000)
    dense = F.timestamp_micros((since / 100).cast("bigint") + F.lit(1704067200000000))
    return df.withColumn("ts", dense)


DENSE_SQL = "1704067200000000 + (epoch_us(ts) - 1704067200000000) // 100"
LOCAL_DAY_SQL = "CAST(make_timestamp({0}) + INTERVAL 9 HOUR AS DATE)"


def steps_sql(key: str, at: str, first: str, following: str) -> str:
    """A walk over the events of each ``key`` in time; ``first`` and ``following`` make the state, the latter from w (before) and e (now)."""
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY key_ ORDER BY at_, request_id) AS n, {LOCAL_DAY_SQL.format('at_')} AS day_
  FROM (SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS client, {key} AS key_, {at} AS at_ FROM events)),
w AS (SELECT e.*, {first} FROM e WHERE n = 1 UNION ALL SELECT e.*, {following} FROM w JOIN e ON e.key_ = w.key_ AND e.n = w.n + 1)
"""


RECENT_SQL = "list_filter(w.recent, lambda t: t > e.at_ - 300000000)"
COUNT_SQL = "CASE WHEN w.day_ = e.day_ THEN w.admitted ELSE 0 END"
GOOD_SQL = f"(len({RECENT_SQL}) < 10 AND {COUNT_SQL} < 50)"
ADMISSION_SQL = steps_sql(
    "user_id", DENSE_SQL, "[at_] AS recent, 1 AS admitted, true AS good",
    f"CASE WHEN {GOOD_SQL} THEN list_append({RECENT_SQL}, e.at_) ELSE {RECENT_SQL} END, {COUNT_SQL} + CAST({GOOD_SQL} AS INTEGER), {GOOD_SQL}",
) + "SELECT client, request_id, CASE WHEN good THEN 'admitted' ELSE 'refused' END AS decision FROM w"
FRESH_SQL = "(e.at_ - w.since >= 90000000)"
REPEATS_SQL = steps_sql(
    "user_id || '/' || event_type", DENSE_SQL, "at_ AS since, true AS fresh", f"CASE WHEN {FRESH_SQL} THEN e.at_ ELSE w.since END, {FRESH_SQL}"
) + "SELECT request_id, CASE WHEN fresh THEN 'computed' ELSE 'repeated' END AS served FROM w"
IDLE_SQL = "(e.at_ - w.at_ >= 1800000000)"
EXCHANGES_SQL = steps_sql(
    "user_id", "epoch_us(ts)", "1 AS revision, [request_id] AS held",
    f"CASE WHEN {IDLE_SQL} THEN 1 ELSE w.revision + 1 END, CASE WHEN {IDLE_SQL} THEN [e.request_id] ELSE list_append(w.held, e.request_id)[-4:] END",
) + "SELECT client AS session_id, request_id, CAST(revision AS INTEGER) AS revision, array_to_string(held, ',') AS kept FROM w"
# All clients in one walk: recent and today's admissions as (client, time) pairs.
OWN_SQL = "len(list_filter({0}, lambda x: x.client = e.client))"
LATE_SQL = "list_filter(w.recent, lambda x: x.at_ > e.at_ - 300000000)"
TODAY_SQL = "(CASE WHEN w.day_ = e.day_ THEN w.today ELSE [] END)"
WITHIN_SQL = f"({OWN_SQL.format(LATE_SQL)} < 10 AND {OWN_SQL.format(TODAY_SQL)} < 50 AND len({TODAY_SQL}) < 100)"
NOW_SQL = "{'client': e.client, 'at_': e.at_}"
GLOBAL_SQL = steps_sql(
    "0", "epoch_us(ts)", "[{'client': client, 'at_': at_}] AS recent, [{'client': client, 'at_': at_}] AS today, true AS good",
    f"CASE WHEN {WITHIN_SQL} THEN list_append({LATE_SQL}, {NOW_SQL}) ELSE {LATE_SQL} END, CASE WHEN {WITHIN_SQL} THEN list_append({TODAY_SQL}, {NOW_SQL}) ELSE {TODAY_SQL} END, {WITHIN_SQL}",
) + "SELECT CAST(day_ AS VARCHAR) AS day, request_id FROM w WHERE good"


@query("str_01_admission_batch", ADMISSION_SQL)
def admission_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.admission(squeezed(request_rows(b.table(spark, sf_dir, "events"))).select("client", "request_id", "ts")).select("client", "request_id", "decision")


@query("str_01_admission_stream", ADMISSION_SQL)
def admission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = squeezed(request_rows(event_stream(spark, sf_dir))).select("client", "request_id", "ts")
    return flows.run_in_order(rows, "client", state.admission_stream, state.admission_again)


@query("str_01_global_limit", GLOBAL_SQL)
def global_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = dialogue.admission_within_global_limit(request_rows(b.table(spark, sf_dir, "events")).select("client", "request_id", "ts"))
    return decided.where("decision = 'admitted'").select("day", "request_id")


@query("str_02_repeats_batch", REPEATS_SQL)
def repeats_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = squeezed(request_rows(b.table(spark, sf_dir, "events")))
    return dialogue.suppress_repeats(rows.select("client", "event_type", "request_id", "ts"), ["client", "event_type"]).select("request_id", "served")


@query("str_02_repeats_stream", REPEATS_SQL)
def repeats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = squeezed(request_rows(event_stream(spark, sf_dir))).withColumn("repeat_key", F.concat_ws("/", "client", "event_type"))
    rows = rows.select("repeat_key", "request_id", "ts")
    return flows.run_in_order(rows, "repeat_key", state.repeat_stream, state.repeat_again).select("request_id", "served")


@query("str_03_session_gaps", "SELECT event_id AS request_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_number FROM (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 1800000000, true) THEN 1 ELSE 0 END AS b FROM events)")
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.session_gaps(request_rows(b.table(spark, sf_dir, "events")), "client").select("request_id", "session_number")


@query("str_03_session_stream", "WITH s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 1800000000, true) THEN 1 ELSE 0 END AS b FROM events)) SELECT CAST(user_id AS VARCHAR) AS client, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, count(*) AS requests FROM s GROUP BY user_id, n")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions by ``session_window``, drained from the stream with its open sessions."""
    rows = flows.run_upsert(flows.session_windows(request_rows(event_stream(spark, sf_dir)), "client"), ["client", "first_at"], "complete")
    return rows.select("client", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"), "requests")


@query("str_04_session_exchanges", EXCHANGES_SQL)
def session_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_rows(event_stream(spark, sf_dir)).withColumnRenamed("client", "session_id")
    return flows.run_in_order(rows.select("session_id", "request_id", "ts"), "session_id", state.exchange_stream, state.exchange_again)


@query("str_05_feed_ingest", "SELECT CAST(user_id AS VARCHAR) AS security_id, 'u' || CAST(event_id % 20 AS VARCHAR) AS canonical_url, min(event_id) AS ord, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS provenance FROM events GROUP BY 1, 2")
def feed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_rows(event_stream(spark, sf_dir)).select(
        F.col("client").alias("security_id"), F.concat(F.lit("u"), (F.col("request_id") % 20).cast("string")).alias("canonical_url"), F.col("request_id").alias("ord"),
        F.array("event_type").alias("provenance"), F.lit("title_alias").alias("match_basis"),
    )
    return flows.feed_batches(rows).select("security_id", "canonical_url", "ord", F.array_join("provenance", ",").alias("provenance"))


@query("str_06_late_and_future_rows", "SELECT event_id AS request_id, CASE WHEN event_id % 13 = 0 THEN 'missing_published_at' WHEN ts > TIMESTAMP '2024-01-20' THEN 'future_published_at' END AS time_flag, CASE WHEN event_id % 13 = 0 OR ts > TIMESTAMP '2024-01-20' THEN 'quarantined' ELSE 'accepted' END AS went FROM events")
def late_and_future_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_rows(event_stream(spark, sf_dir)).select(
        "request_id", F.when(F.expr("request_id % 13 <> 0"), F.col("ts")).alias("published_at"), F.lit("2024-01-20 00:00:00").cast("timestamp").alias("basis_at")
    )
    accepted, quarantined = flows.run_split(flows.flag_times(rows), "time_flag")
    went = lambda df, name: df.select("request_id", "time_flag", F.lit(name).alias("went"))
    return went(accepted, "accepted").unionByName(went(quarantined, "quarantined"))


@query("str_07_observation_rates", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, CASE event_type WHEN 'error' THEN 'no_evidence' WHEN 'view' THEN 'partial' ELSE 'complete' END AS evidence_decision, count(*) AS requests, count(*) FILTER (event_type = 'error') AS fallbacks, round(max(value), 2) AS max_latency_ms FROM events GROUP BY 1, 2")
def observation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"), F.expr("CASE event_type WHEN 'error' THEN 'no_evidence' WHEN 'view' THEN 'partial' ELSE 'complete' END").alias("evidence_decision"),
        F.col("value").alias("total_latency_ms"), F.expr("event_type = 'error'").alias("fallback_used"),
    )
    rates = flows.observation_rates(rows, "1 hour")
    return rates.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "evidence_decision", "requests", "fallbacks", F.round("max_latency_ms", 2).alias("max_latency_ms"))
