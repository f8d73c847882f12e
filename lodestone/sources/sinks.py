"""Sinks: inventories, snapshot bundles and observation records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.functions.hashing import canonical_json, digest_of_sums, fingerprint, hash_sums
from lodestone.operators.coverage import snapshot_coverage
from lodestone.operators.skew import spread_join
from lodestone.operators.validation import permission_reason
from lodestone.session import cut_lineage

BUNDLE_PARTS = 256
BUNDLE_TABLES = ("documents", "coverage", "permissions")


def write_inventory(items: DataFrame, path: str, partition: str, order: Sequence[str], rows_per_file: int = 1_000_000) -> None:
    """SNK-01: canonical JSON lines sorted by ``order`` inside each value of ``partition``; equal rows give equal bytes.

    The place of a row in its partition decides its file (``partition=…/part=n``), so neither the
    sampling of the sort's ranges nor the number of tasks moves a row to another file, and a hot
    partition is spread over as many tasks as it fills files. Rows of equal order stand by their JSON.
    Repeated rows are kept; a null partition has a folder of its own; an empty table leaves no files.
    """
    lines = items.select(F.col(partition).alias("__key"), *[F.col(name).alias(f"__o{i}") for i, name in enumerate(order)], canonical_json(items.columns).alias("value"))
    keys = ["__key", *[f"__o{i}" for i in range(len(order))], "value"]
    sorted_ranges = cut_lineage(
        lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
            "__key", "value", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__at")
        )
    )
    sizes = sorted_ranges.groupBy("__key", "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).select(
        "__range", F.xxhash64(F.col("__key").isNull(), "__key").alias("__id"), "__shift"
    )
    placed = spread_join(sorted_ranges.withColumn("__id", F.xxhash64(F.col("__key").isNull(), "__key")), shift, ["__range", "__id"])
    placed = placed.select(F.col("__key").alias(partition), "value", (F.col("__at") + F.col("__shift")).alias("__place"))
    filed = placed.withColumn("part", F.expr(f"__place div {rows_per_file}")).repartition(partition, "part").sortWithinPartitions(partition, "part", "__place")
    filed.drop("__place").write.mode("overwrite").partitionBy(partition, "part").text(path)


def inventory_hashes(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """SHA-256 of the bytes of each inventory file; a file is bounded by the rows it was given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    value = F.url_decode(F.replace(F.regexp_extract("path", rf"/{partition}=([^/]*)/part=\d+/[^/]+$", 1), F.lit("+"), F.lit("%2B")))
    part = F.regexp_extract("path", r"/part=(\d+)/[^/]+$", 1).cast("int")
    return files.select(value.alias(partition), part.alias("part"), F.sha2("content", 256).alias("sha256"))


def write_snapshot(tables: Mapping[str, DataFrame], path: str, volatile: Sequence[str] = (), parts: int = BUNDLE_PARTS) -> DataFrame:
    """SNK-02: each table as parquet in hash parts, and a manifest with a tree of content hashes.

    A row's fingerprint (without the ``volatile`` columns) decides its part; large parts are written by
    several tasks. The manifest holds one
    row per filled part, per table (the hash of its parts in order) and for the bundle (the hash of its
    tables in order): ``level, table_name, part, row_count, checksum``. Hashes are order-free inside
    a part, so equal contents give equal manifests. An empty table has its table row only.
    """
    spark = next(iter(tables.values())).sparkSession
    parted = None
    for name, df in tables.items():
        kept = [column for column in df.columns if column not in set(volatile)]
        rows = df.withColumn("__row", fingerprint(kept))
        home = F.pmod(F.conv(F.substring("__row", 1, 8), 16, 10).cast("bigint"), F.lit(parts)).cast("int")
        rows.withColumn("__part", home).drop("__row").hint("rebalance", "__part").write.mode("overwrite").partitionBy("__part").parquet(f"{path}/{name}")
        stored = spark.read.schema(_with_part(df.schema)).parquet(f"{path}/{name}")
        one = _part_hashes(stored, name, kept)
        parted = one if parted is None else parted.unionByName(one)
    leaves = cut_lineage(parted)
    names = spark.createDataFrame([(name,) for name in tables], "table_name string")
    tops = _node(leaves.groupBy("table_name"), F.struct(F.col("part").alias("name"), "checksum"))
    tops = names.join(tops, "table_name", "left").select(
        F.lit("table").alias("level"), "table_name", F.lit(None).cast("int").alias("part"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("checksum", F.sha2(F.lit(""), 256)).alias("checksum"),
    )
    tops = cut_lineage(tops)
    whole = _node(tops.groupBy(), F.struct(F.col("table_name").alias("name"), "checksum")).select(
        F.lit("bundle").alias("level"), F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("int").alias("part"), "row_count", "checksum"
    )
    leaves.unionByName(tops).unionByName(whole).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _with_part(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("__part", IntegerType())])


def _part_hashes(stored: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    sums = hash_sums(stored.select("__part", fingerprint(columns).alias("row_hash")).groupBy(F.col("__part").alias("part")))
    return sums.select(F.lit("part").alias("level"), F.lit(name).alias("table_name"), "part", "row_count", digest_of_sums().alias("checksum"))


def _node(grouped: GroupedData, children: Column) -> DataFrame:
    """Hash of the children's names and hashes in order; at most ``parts`` children, or as many as there are tables."""
    lines = F.transform(F.array_sort(F.collect_list(children)), lambda c: F.concat(c["name"].cast("string"), F.lit("\t"), c["checksum"], F.lit("\n")))
    return grouped.agg(F.sum("row_count").alias("row_count"), F.sha2(F.concat_ws("", lines), 256).alias("checksum"))


def changed_parts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Parts in which two manifests differ (``changed``, ``added`` or ``removed``); no table is read."""
    side = lambda df, name: df.where("level = 'part'").select("table_name", "part", F.col("checksum").alias(name))
    both = side(before, "old").join(side(after, "new"), ["table_name", "part"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), F.lit("added")).when(F.col("new").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    return both.select("table_name", "part", change.alias("change"))


def altered_parts(spark: SparkSession, path: str, schemas: Mapping[str, StructType], volatile: Sequence[str] = (), parts: Sequence[int] | None = None) -> DataFrame:
    """SNK-02: read-back. Names the parts whose stored rows no longer give the manifest's hash, of all parts or of ``parts`` only.

    The part is a folder, so with ``parts`` the scan is pruned to these folders.
    """
    wanted = F.lit(True) if parts is None else F.col("part").isin(list(parts))
    found = None
    for name, schema in schemas.items():
        stored = spark.read.schema(_with_part(schema)).parquet(f"{path}/{name}")
        stored = stored if parts is None else stored.where(F.col("__part").isin(list(parts)))
        columns = [column for column in stored.columns if column != "__part" and column not in set(volatile)]
        one = _part_hashes(stored, name, columns)
        found = one if found is None else found.unionByName(one)
    listed = spark.read.parquet(f"{path}/manifest").where((F.col("level") == "part") & wanted & F.col("table_name").isin(list(schemas)))
    return changed_parts(listed, found)


def write_bundle(documents: DataFrame, permissions: DataFrame, path: str, basis_at: str, parts: int = BUNDLE_PARTS) -> DataFrame:
    """SNK-02: the service bundle. Documents, their coverage, the permission register and the manifest of their hashes.

    ``documents`` has the columns of ``coverage.snapshot_coverage`` and ``document_id``, ``published_at``;
    ``permissions`` one row per source with its review status and what is allowed. The bundle is refused
    (``ValueError``) before anything is written when a document is newer than the basis, repeats an id,
    or is of a source that the register does not name or does not open, or when the register breaks its own rule.
    """
    problems = bundle_problems(documents, permissions, basis_at)
    first = problems.limit(5).collect()
    if first:
        raise ValueError(f"bundle refused: {[(row['reason'], row['name']) for row in first]}")
    tables = dict(zip(BUNDLE_TABLES, (documents, snapshot_coverage(documents), permissions), strict=True))
    return write_snapshot(tables, path, parts=parts)


def bundle_problems(documents: DataFrame, permissions: DataFrame, basis_at: str) -> DataFrame:
    """Why a bundle may not be written: one row per document or source and reason."""
    register = permissions.select("source_type", F.col("corpus_ingest_allowed").alias("__open"))
    joined = spread_join(documents.select("document_id", "source_type", "published_at"), register, ["source_type"], "left")
    reason = (
        F.when(F.col("__open").isNull(), F.lit("source_not_registered")).when(~F.col("__open"), F.lit("source_closed"))
        .when(F.col("published_at") > F.lit(basis_at).cast("timestamp"), F.lit("after_basis"))
    )
    rows = joined.select(F.col("document_id").alias("name"), reason.alias("reason"))
    copies = documents.groupBy(F.col("document_id").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit("repeated_id").alias("reason"))
    broken = permissions.select(
        F.col("source_type").alias("name"), permission_reason(F.col("usage_review_status"), F.col("corpus_ingest_allowed"), F.col("external_llm_processing_allowed")).alias("reason")
    )
    return rows.unionByName(copies).unionByName(broken).where(F.col("reason").isNotNull())


def observation_lines(observations: DataFrame) -> DataFrame:
    """SNK-03: one JSON record per request, nulls kept, as text lines for a batch or streaming file sink."""
    return observations.select(F.to_json(F.struct(*sorted(observations.columns)), {"ignoreNullFields": "false"}).alias("value"))
