"""Streams over a shuffled table with more files than a trigger takes, against the batch results."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.plans import request_queries as plans
from lodestone.streaming import state

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="shared tables are absent")


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shuffled"))
    spark.read.parquet(f"{SF_DIR}/events.parquet").repartition(70, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    assert sum(name.endswith(".parquet") for name in os.listdir(f"{folder}/events.parquet")) > 64
    return folder


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_admission(spark, shuffled):
    assert rows(plans.admission_stream(spark, shuffled)) == rows(plans.admission_batch(spark, SF_DIR))


def test_repeats(spark, shuffled):
    assert rows(plans.repeats_stream(spark, shuffled)) == rows(plans.repeats_batch(spark, SF_DIR))


def test_exchanges(spark, shuffled):
    events = plans.request_rows(spark.read.parquet(f"{SF_DIR}/events.parquet")).select("client", "request_id", F.unix_micros("ts").alias("at"))
    sessions, want = defaultdict(list), Counter()
    for row in events.collect():
        sessions[row["client"]].append((row["at"], row["request_id"]))
    for client, held in sessions.items():
        last, kept, revision = None, [], 0
        for at, request in sorted(held):
            if last is not None and at - last >= 1_800_000_000:
                kept, revision = [], 0
            last, kept, revision = at, [*kept, request][-4:], revision + 1
            want[(client, request, revision, ",".join(map(str, kept)))] += 1
    assert rows(plans.session_exchanges(spark, shuffled)) == want


def test_rates(spark, shuffled):
    decision = F.expr("CASE event_type WHEN 'error' THEN 'no_evidence' WHEN 'view' THEN 'partial' ELSE 'complete' END")
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at"), decision.alias("d")).agg(
        F.count(F.lit(1)), F.count_if(F.col("event_type") == "error"), F.round(F.max("value"), 2)
    )
    assert rows(plans.observation_rates(spark, shuffled)) == rows(events.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm")))


def test_keys_share_state_rows(spark, tmp_path, monkeypatch):
    # A call into Python, and a state row, for each bucket and not for each key.
    monkeypatch.setattr(state, "BUCKETS", 4)
    rows_of = [(f"k{i % 300}", i, f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}") for i in range(1500)]
    table = spark.createDataFrame(rows_of, "repeat_key string, request_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/rows")
    query = state.repeat_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    assert all(sum(op["numRowsTotal"] for op in progress["stateOperators"]) <= 4 for progress in query.recentProgress)
    streamed = spark.read.parquet(f"{tmp_path}/out").select("repeat_key", "request_id", "served")
    assert rows(streamed) == rows(state.repeat_again(table))
