"""Built-in streaming flows: sessions, feed ingest, late rows, observation rates, and their sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone import fixed_values as fixed
from lodestone.operators.skew import keep_first
from lodestone.session import cut_lineage, ensure_checkpoint_dir


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def run_append(stream: DataFrame) -> DataFrame:
    """Drain an append-mode stream into files and return what was written."""
    spark, folder = stream.sparkSession, work_dir(stream.sparkSession)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/log").option(
        "path", f"{folder}/out"
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_split(stream: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """STR-06: drain a stream into two tables: rows without a ``reason`` are accepted, the others quarantined.

    Both are written from one pass over a micro-batch, in folders by ``reason``; an epoch that runs again
    overwrites its own folder, so a row is in exactly one table and counts once.
    """
    spark, folder = stream.sparkSession, work_dir(stream.sparkSession)
    side = F.when(F.col(reason).isNull(), F.lit("accepted")).otherwise(F.lit("quarantined"))

    written = set()

    def write(batch: DataFrame, epoch: int) -> None:
        written.add(epoch)
        batch.withColumn("__side", side).write.mode("overwrite").partitionBy("__side").parquet(f"{folder}/out/epoch={epoch}")

    query = stream.writeStream.option("checkpointLocation", f"{folder}/log").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType(stream.schema.fields).add("epoch", "long").add("__side", "string")
    rows = spark.read.schema(schema).parquet(f"{folder}/out") if written else spark.createDataFrame([], schema)
    table = lambda name: rows.where(F.col("__side") == name).drop("epoch", "__side")
    return table("accepted"), table("quarantined")


def run_in_order(stream: DataFrame, key: str, flow: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Drain a stateful flow over the rows of ``stream``; keys with late rows are computed ``again`` from a side table of all rows.

    The flow marks rows out of order as ``late``; rows behind the watermark are missing from its result.
    """
    side, done = run_append(stream), run_append(flow(stream))
    came = side.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__rows"))
    made = done.groupBy(F.col(key).alias("__made")).agg(F.count(F.lit(1)).alias("__results"), F.max("late").alias("__late"))
    joined = came.join(made, F.col("__key").eqNullSafe(F.col("__made")), "left")
    broken = cut_lineage(joined.where(F.coalesce(F.col("__late") | (F.col("__rows") != F.col("__results")), F.lit(True))).select("__key"))
    if broken.isEmpty():
        return done.drop("late")
    same = F.col(key).eqNullSafe(F.col("__key"))
    return done.join(broken, same, "left_anti").drop("late").unionByName(again(side.join(broken, same, "left_semi")))


def run_upsert(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Drain a stream of changing rows; every micro-batch overwrites its own folder, the newest row per key counts.

    In complete mode a micro-batch holds all rows, so only the last one counts.
    """
    spark, folder = stream.sparkSession, work_dir(stream.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/log").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    if mode == "complete":
        last = rows.agg(F.max("epoch")).first()[0]
        return rows.where(F.col("epoch") == F.lit(last)).drop("epoch")
    return keep_first(rows, keys, [F.col("epoch").desc()]).drop("epoch")


def session_windows(requests: DataFrame, key: str, gap: int = fixed.SESSION_GAP_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """STR-03: sessions per key. A pause of exactly ``gap`` ends one, so the window gap is a microsecond shorter."""
    just_under = f"{gap - 1}.999999 seconds"
    return requests.withWatermark("ts", lateness).groupBy(key, F.session_window("ts", just_under).alias("session")).agg(
        F.count(F.lit(1)).alias("requests"), F.max("ts").alias("last_at")
    ).select(key, F.col("session.start").alias("first_at"), "last_at", "requests")


def feed_batches(stream: DataFrame) -> DataFrame:
    """STR-05: feed rows written per micro-batch and merged on read by (security, URL): first row, united provenance."""
    from lodestone.operators.inventory import merge_duplicates

    spark, folder = stream.sparkSession, work_dir(stream.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        merge_duplicates(batch, ["security_id", "canonical_url"], "ord").drop("copies").write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    query = stream.writeStream.option("checkpointLocation", f"{folder}/log").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return merge_duplicates(spark.read.parquet(f"{folder}/out").drop("epoch"), ["security_id", "canonical_url"], "ord").drop("copies")


def flag_times(rows: DataFrame, basis: str = "basis_at", time: str = "published_at") -> DataFrame:
    """STR-06: rows after the basis are future, rows without time missing; the rest is kept."""
    flag = F.when(F.col(time).isNull(), F.lit("missing_published_at")).when(F.col(time) > F.col(basis), F.lit("future_published_at"))
    return rows.withColumn("time_flag", flag)


def observation_rates(observations: DataFrame, width: str = "1 minute") -> DataFrame:
    """STR-07: requests, fallbacks and latency per tumbling window and decision.

    Each micro-batch writes its sums, which are added up on read, so a row counts however late it comes.
    """
    spark, folder = observations.sparkSession, work_dir(observations.sparkSession)
    keys = ["window_start", "evidence_decision"]

    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(F.window("ts", width).alias("w"), "evidence_decision").agg(
            F.count(F.lit(1)).alias("requests"), F.count_if("fallback_used").alias("fallbacks"), F.sum("total_latency_ms").alias("latency"),
            F.count("total_latency_ms").alias("timed"), F.max("total_latency_ms").alias("max_latency_ms"),
        ).withColumn("window_start", F.col("w.start")).drop("w").write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    query = observations.writeStream.option("checkpointLocation", f"{folder}/log").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy(*keys).agg(
        F.sum("requests").alias("requests"), F.sum("fallbacks").alias("fallbacks"),
        F.try_divide(F.sum("latency"), F.sum("timed")).alias("mean_latency_ms"), F.max("max_latency_ms").alias("max_latency_ms"),
    )
