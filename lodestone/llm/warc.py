"""Web archives with revisit records.

Headers (page, digest, size), not payloads, are shuffled to find the first record of each payload;
archives are written by Spark's own text writer, whose commit protocol survives lost tasks on any
file system, with the blank line that ends a WARC record as line separator.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.skew import spread_join
from lodestone.session import cut_lineage, ensure_checkpoint_dir

LEAST_BYTES = 100
ARCHIVE_BYTES = 64_000_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def archive_folder(spark: SparkSession) -> str:
    """A new folder inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def record_id(page: Column, digest: Column) -> Column:
    """The same URN for the same page and payload, so that retries write equal records."""
    name = F.sha2(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("none")), digest), 256)
    parts = [F.substring(name, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def find_originals(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """For each digest that several records with ``least`` payload bytes share: first_page and first_url of the smallest page_id."""
    return headers.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min("page_id").alias("first_page"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("__n")
    ).where("__n > 1").drop("__n")


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url and html of ``pages`` with payload_bytes and payload_digest; a null html is an empty payload."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html.cast("binary"), 256).alias("payload_digest"),
    )


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html): a response, or a revisit of an equal earlier payload.

    Of records whose equal payloads have ``least`` bytes or more, the one with the smallest page_id
    is the response; rows that repeat its page_id are responses too, and so is a row without a
    page_id. Headers are built anew; a url is written with control characters and spaces escaped,
    and a page without one is named by its id. Revisits carry the response's headers, not its payload.
    """
    records = payloads(pages)
    # Sizes, digests and ids only: payloads are read again by the scan below, not shuffled.
    originals = cut_lineage(find_originals(records.drop("html"), least))
    volume = records.agg(F.avg("payload_bytes")).first()[0] or 0
    # Few originals are broadcast behind a check of their number; else hot digests are salted.
    rows = spread_join(records, originals, ["payload_digest"], "left", max_rows=50_000)
    revisit = (F.col("payload_bytes") >= least) & F.col("first_page").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first_page"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def uri(url: Column, page: Column) -> Column:
        named = F.coalesce(url, F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none"))))
        return F.regexp_replace(named, r"[\x00-\x20\x7f]", "%20")

    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    refers = F.when(revisit, F.concat(
        line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("first_page"), F.col("payload_digest"))),
        line("WARC-Refers-To-Target-URI", uri(F.col("first_url"), F.col("first_page"))), line("WARC-Refers-To-Date", F.lit(date)),
    )).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri(F.col("url"), F.col("page_id"))),
        F.when(F.col("page_id").isNotNull(), line("Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")), refers,
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    writer = rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / (volume + 1_000)))).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all records under ``path``, one row each; payloads are measured and hashed, not kept.

    page_id, record_id, record_type, target_uri, refers_to_id, payload_bytes and payload_digest: of
    a revisit as its headers state them, of a response as its payload is. A record that is cut short raises.
    """
    names = ["page_id", "record_id", "record_type", "target_uri", "refers_to_id", "payload_bytes", "payload_digest"]

    def fields(head: bytes) -> dict[str, str]:
        pairs = (row.partition(":") for row in head.decode("utf-8").split("\r\n") if ":" in row)
        return {name.strip().lower(): value.strip() for name, _, value in pairs}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()]
        for batch in batches:
            for content in batch.column("content"):
                data = zlib.decompress(content.as_py(), wbits=31) if content.as_py() else b""
                rows, at = [], 0
                while at < len(data):
                    start = data.index(b"\r\n\r\n", at) + 4
                    head = fields(data[at:start])
                    end = start + int(head["content-length"])
                    if data[end : end + 4] != b"\r\n\r\n":
                        raise ValueError(f"a record in {path} is cut short")
                    body = data.index(b"\r\n\r\n", start) + 4
                    page = int(head["page-id"]) if "page-id" in head else None
                    if head["warc-type"] == "revisit":
                        size, digest = int(fields(data[start:body])["content-length"]), head["warc-payload-digest"].partition(":")[2]
                    else:
                        size, digest = end - body, hashlib.sha256(memoryview(data)[body:end]).hexdigest()
                    rows.append((page, head["warc-record-id"], head["warc-type"], head["warc-target-uri"], head.get("warc-refers-to"), size, digest))
                    at = end + 4
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(values), kind) for values, kind in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = "page_id long, record_id string, record_type string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string"
    return files.mapInArrow(parse, kinds)


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """``headers`` with ``refers_to``: the page of the response that a revisit names, null for responses and broken references.

    Headers meet by payload digest and record; the responses that revisits name are one row each before the join.
    """
    keys = ["payload_digest", "refers_to_id"]
    wanted = headers.where("record_type = 'revisit'").select(*keys).distinct()
    named = headers.where("record_type = 'response'").select("payload_digest", F.col("record_id").alias("refers_to_id"), "page_id")
    found = cut_lineage(named.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.min("page_id").alias("__page")))
    joined = spread_join(headers, found, keys, "left", max_rows=50_000)
    return joined.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("__page"))).drop("__page")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives of ``pages``, read them back and resolve the revisits; an empty table gives an empty result."""
    spark = pages.sparkSession
    path = path or archive_folder(spark)
    write_archives(pages, path)
    headers = cut_lineage(read_archives(spark, path))
    return resolve_revisits(headers).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
