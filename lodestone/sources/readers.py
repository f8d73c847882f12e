"""Readers of recorded responses and corpora; schemas are declared, bad records become rows to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEED_PAGE = "body STRUCT<items: ARRAY<STRUCT<title: STRING, originallink: STRING, link: STRING, description: STRING, pubDate: STRING>>>"
DISCLOSURE_LIST = (
    "response STRUCT<status: STRING, message: STRING, page_no: INT, total_page: INT, list: ARRAY<STRUCT<corp_cls: STRING, corp_name: STRING, "
    "corp_code: STRING, stock_code: STRING, report_nm: STRING, rcept_no: STRING, flr_nm: STRING, rcept_dt: STRING, rm: STRING>>>, "
    "extensions STRUCT<correction_links: MAP<STRING, STRING>>"
)
SNAPSHOT_FILE = (
    "schema_version INT, snapshots ARRAY<STRUCT<security_id: STRING, market: STRING, ticker: STRING, security_name: STRING, security_type: STRING, "
    "trading_date: STRING, observed_at: STRING, price: DECIMAL(18,6), previous_close: DECIMAL(18,6), change: DECIMAL(18,6), "
    "change_percent: DECIMAL(18,6), volume: BIGINT, market_session: STRING, currency: STRING>>"
)
RAW_PAGES = "query STRING, pages ARRAY<STRUCT<start: INT, items: ARRAY<STRUCT<title: STRING, originallink: STRING, link: STRING, description: STRING, pubDate: STRING>>>>"
GLOSSARY = (
    "corpus_id STRING, entries ARRAY<STRUCT<entry_id: STRING, version: INT, canonical_term: STRING, aliases: ARRAY<STRING>, definition: STRING, "
    "why_it_matters: STRING, caution: STRING, formula: STRING, example: STRING, usage_review_status: STRING, corpus_ingest_allowed: BOOLEAN, "
    "external_llm_processing_allowed: BOOLEAN, content_origin: STRING, related_entry_ids: ARRAY<STRING>>>"
)
MANIFEST = (
    "manifest_id STRING, security_id STRING, title STRING, publisher STRING, published_at STRING, usage_review_status STRING, "
    "corpus_ingest_allowed BOOLEAN, external_llm_processing_allowed BOOLEAN, documents ARRAY<STRING>"
)
SECTIONS = "manifest_id STRING, documents ARRAY<STRUCT<document_id: STRING, security_id: STRING, section: STRING, page: INT, page_basis: STRING, text: STRING>>"
REPORT_FILE = r"([^/]+)/([^/_]+)_([^_/]+)_(.+)_(\d{6}|\d{8})\.[A-Za-z]+$"
CORRUPT = "_corrupt_record"


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON files with a fixed schema; unreadable records keep their text in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, {CORRUPT} STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option(
        "multiLine", multi_line
    ).json(path)


def feed_items(pages: DataFrame) -> DataFrame:
    """SRC-01: one row per feed item with its index in the page."""
    return pages.select(F.posexplode_outer("body.items").alias("raw_index", "item")).where(F.col("item").isNotNull()).select("raw_index", "item.*")


def disclosure_items(pages: DataFrame) -> DataFrame:
    """SRC-02: rows of successful lists, with the receipt each one corrects."""
    rows = pages.where(F.col("response.status") == "000").select(
        F.col("extensions.correction_links").alias("links"), F.posexplode("response.list").alias("raw_index", "item")
    )
    return rows.select("raw_index", "item.*", F.try_element_at("links", F.col("item.rcept_no")).alias("corrects"))


def market_snapshots(files: DataFrame, securities: DataFrame) -> DataFrame:
    """SRC-05: snapshot rows with the first broken rule: identity, invariants or a repeated key."""
    from lodestone.operators.validation import market_reason

    rows = files.select(F.explode("snapshots").alias("s")).select("s.*").withColumn("trading_date", F.to_date("trading_date")).withColumn(
        "observed_at", F.try_to_timestamp("observed_at")
    )
    known = securities.select("security_id", F.col("security_name").alias("expected_name"))
    copies = rows.groupBy("security_id", "trading_date", "observed_at").agg(F.count(F.lit(1)).alias("copies"))
    joined = rows.join(known, "security_id", "left").join(copies, ["security_id", "trading_date", "observed_at"], "left")
    identity = (F.col("security_id") != F.concat_ws(":", "market", "ticker")) | F.coalesce(F.col("expected_name") != F.col("security_name"), F.lit(True))
    reason = F.when(identity, F.lit("identity")).otherwise(F.coalesce(market_reason(), F.when(F.col("copies") > 1, F.lit("duplicate"))))
    return joined.withColumn("reason", reason).drop("copies", "expected_name")


def raw_pages(files: DataFrame) -> DataFrame:
    """SRC-06: items of many raw page files, tagged ``query|file|start=n``."""
    name = F.regexp_extract(F.col("file"), r"([^/]+)$", 1)
    pages = files.withColumn("file", F.col("_metadata.file_path")).select("query", "file", F.explode("pages").alias("page"))
    tag = F.concat_ws("|", "query", name, F.concat(F.lit("start="), F.col("page.start").cast("string")))
    return pages.select(tag.alias("provenance"), F.posexplode("page.items").alias("raw_index", "item")).select("provenance", "raw_index", "item.*")


def glossary_entries(files: DataFrame) -> DataFrame:
    """SRC-08."""
    return files.select("corpus_id", F.explode("entries").alias("entry")).select("corpus_id", "entry.*")


def report_bundle(manifests: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-09: manifest rows, and section rows in file order."""
    rows = sections.select("manifest_id", F.posexplode("documents").alias("place", "d")).select("manifest_id", "place", "d.*")
    return manifests.drop(CORRUPT), rows


def report_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: report files by name (``ticker/publisher_analyst_title_yymmdd``) with their content hash."""
    return report_names(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def report_names(files: DataFrame) -> DataFrame:
    """Entity, publisher, analyst, title and day read from the path of each file."""
    part = lambda group: F.regexp_extract(F.url_decode("path"), REPORT_FILE, group)
    day = F.when(F.length(part(5)) == 6, F.concat(F.lit("20"), part(5))).otherwise(part(5))
    return files.select(
        part(1).alias("ticker"), part(2).alias("publisher"), F.trim(part(3)).alias("analyst"), F.trim(part(4)).alias("title"),
        F.to_date(F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("yyyyMMdd"))).alias("published_date"), F.sha2("content", 256).alias("content_hash"),
        F.regexp_extract(F.url_decode("path"), r"([^/]+)\.[A-Za-z]+$", 1).alias("stem"),
    )


def source_map_problems(files: DataFrame, source_map: DataFrame) -> DataFrame:
    """SRC-13: files without a source URL, and URLs without a file."""
    both = files.select("ticker", "stem", F.lit(1).alias("has_file")).join(source_map.select("ticker", "stem", "source_url"), ["ticker", "stem"], "full_outer")
    problem = F.when(F.col("has_file").isNull(), F.lit("no_file")).when(F.col("source_url").isNull(), F.lit("no_source"))
    return both.select("ticker", "stem", problem.alias("problem")).where(F.col("problem").isNotNull())
