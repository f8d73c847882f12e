"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``$BENCH_QUERIES=all`` times every query of the library instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "cmp_01_retrieve_evidence",
    "cmp_02_freshness_retained",
    "cmp_04_select_context",
    "cmp_05_citation_rejections",
    "cmp_11_news_inventory",
    "cmp_13_disclosure_inventory",
    "cmp_15_event_clusters",
    "cmp_16_evidence_comparison",
    "cmp_19_market_checkpoints",
    "cmp_23_request_plans",
    "agg_03_news_coverage",
    "agg_21_calibration",
    "chk_01_table_checksum",
    "joi_03_resolve",
    "joi_07_asof_join",
    "joi_11_interval_neighbours",
    "joi_14_correction_roots",
    "win_02_two_key_dedup",
    "str_01_admission_batch",
    "str_03_session_gaps",
    "txt_03_tokenize",
    "url_01_canonical_url",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    from pyspark.sql import SparkSession

    from lodestone.plans import all_queries

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("lodestone-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bound, seconds = all_queries(), {}
    # The first text query pays for starting workers and compiling; it is not timed.
    bound["txt_03_tokenize"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in sorted(bound) if os.environ.get("BENCH_QUERIES") == "all" else HEADLINE:
        start = time.time()
        bound[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
