"""Evaluation tables: confusion, score summaries, threshold calibration, gates and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions.text import contains_any
from lodestone.operators.skew import spread_join


def confusion(predictions: DataFrame, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    """AGG-19: confusion counts with precision and recall, both 1 when undefined."""
    p, e = F.col(predicted), F.col(expected)
    counts = predictions.agg(
        F.count_if(p & e).alias("true_positive"), F.count_if(p & ~e).alias("false_positive"),
        F.count_if(~p & e).alias("false_negative"), F.count_if(~p & ~e).alias("true_negative"),
    )
    tp = F.col("true_positive")
    ratio = lambda other: F.coalesce(F.try_divide(tp, tp + F.col(other)), F.lit(1.0))
    return counts.withColumn("precision", ratio("false_positive")).withColumn("recall", ratio("false_negative"))


def fixed_threshold(scores: DataFrame, by: str, threshold: Column) -> DataFrame:
    """AGG-22: agreement, false passes and false fails of a given threshold."""
    passed, label = F.col("score") >= threshold, F.col("label")
    return scores.groupBy(by).agg(
        F.count_if(passed == label).alias("agreement"), F.count_if(passed & ~label).alias("false_pass"),
        F.count_if(~passed & label).alias("false_fail"),
    )


def counts_below(scores: DataFrame, by: str, buckets: int = 512) -> tuple[DataFrame, DataFrame]:
    """Per distinct score: good and bad labels at it and below it, the next lower score; and the totals.

    Scores shrink to a histogram first. Running sums go over value ranges: totals per range, then
    inside it, so a metric with very many distinct scores still spreads over its ranges.
    """
    histogram = scores.where(F.col("score").isNotNull()).groupBy(by, "score").agg(
        F.count_if("label").alias("good"), F.count_if(~F.col("label")).alias("bad")
    )
    # Each metric has ranges of its own, so one with small values does not fall into a single range.
    bounds = histogram.groupBy(by).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / F.lit(buckets)).otherwise(F.lit(1.0))
    ranged = F.floor((F.col("score") - F.col("low")) / width).cast("int")
    placed = spread_join(histogram, bounds, [by]).withColumn("range", ranged).drop("low", "high")
    sums = placed.groupBy(by, "range").agg(
        F.sum("good").alias("range_good"), F.sum("bad").alias("range_bad"), F.max("score").alias("range_top")
    )
    before = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(by)
    starts = sums.select(
        by, "range", F.coalesce(F.sum("range_good").over(before), F.lit(0)).alias("good_before"),
        F.coalesce(F.sum("range_bad").over(before), F.lit(0)).alias("bad_before"), F.max("range_top").over(before).alias("previous_top"),
        F.sum("range_good").over(everything).alias("all_good"), F.sum("range_bad").over(everything).alias("all_bad"),
    )
    inside = Window.partitionBy(by, "range").orderBy("score")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(starts, [by, "range"]).select(
        by, "score", "good", "bad", "all_good", "all_bad",
        (F.col("good_before") + F.coalesce(F.sum("good").over(upto), F.lit(0))).alias("good_below"),
        (F.col("bad_before") + F.coalesce(F.sum("bad").over(upto), F.lit(0))).alias("bad_below"),
        F.coalesce(F.lag("score").over(inside), F.col("previous_top")).alias("lower"),
    )
    return rows, starts.select(by, "all_good", "all_bad").distinct()


def calibrate(scores: DataFrame, by: str, buckets: int = 512) -> DataFrame:
    """AGG-21: threshold with the most agreement, then fewest false passes and fails, then the highest.

    Candidates are 0, 1.000001, every score and every midpoint between neighbouring scores.
    """
    rows, _ = counts_below(scores, by, buckets)
    # At a score and at the midpoint below it the same rows stay below.
    at_scores = rows.select(by, "all_good", "all_bad", "good_below", "bad_below", F.explode(F.array_compact(F.array(
        F.col("score"), F.when(F.col("lower").isNotNull(), (F.col("lower") + F.col("score")) / 2)
    ))).alias("threshold"))
    ends = [rows.groupBy(by, "all_good", "all_bad").agg(
        *[F.coalesce(F.sum(F.when(F.col("score") < F.lit(value), F.col(name))), F.lit(0)).alias(f"{name}_below") for name in ("good", "bad")]
    ).withColumn("threshold", F.lit(value)) for value in (0.0, fixed.NO_PASS_THRESHOLD)]
    candidates = at_scores.unionByName(ends[0]).unionByName(ends[1]).withColumn("false_fail", F.col("good_below")).withColumn(
        "false_pass", F.col("all_bad") - F.col("bad_below")
    ).withColumn("agreement", F.col("all_good") - F.col("good_below") + F.col("bad_below"))
    best = candidates.groupBy(by).agg(F.max(F.struct(
        "agreement", (-F.col("false_pass")).alias("a"), (-F.col("false_fail")).alias("b"), "threshold", "false_pass", "false_fail"
    )).alias("best"))
    return best.select(
        by, F.bround("best.threshold", 6).alias("threshold"), "best.agreement", "best.false_pass", "best.false_fail",
        F.when((F.col("best.agreement") >= fixed.AGREEMENT_MINIMUM) & (F.col("best.false_pass") == 0), F.lit("REQUIRED")).otherwise(F.lit("REPORT_ONLY")).alias("status"),
    )


def exact_median(scores: DataFrame, by: str) -> DataFrame:
    """Median per metric: the mean of the two middle scores, found by their ranks in the histogram."""
    rows, _ = counts_below(scores.withColumn("label", F.lit(True)), by)
    n, below, upto = F.col("all_good"), F.col("good_below"), F.col("good_below") + F.col("good")
    middle = F.array(F.floor((n + 1) / 2), F.floor((n + 2) / 2))
    hits = F.size(F.filter(middle, lambda rank: (rank > below) & (rank <= upto)))
    return rows.select(by, "score", hits.alias("hits")).where("hits > 0").groupBy(by).agg(
        (F.sum(F.col("score") * F.col("hits")) / F.sum("hits")).alias("median")
    )


def metric_summary(scores: DataFrame, thresholds: DataFrame, by: str, pass_rate: float = fixed.HELD_OUT_PASS_RATE) -> DataFrame:
    """AGG-20: mean, median, minimum and pass rate per metric, and its verdict."""
    # One threshold row per metric.
    joined = spread_join(scores, thresholds.select(by, "threshold", F.col("status").alias("calibration")), [by])
    score = F.col("score")
    rows = joined.groupBy(by, "threshold", "calibration").agg(
        F.count(F.lit(1)).alias("total"), F.count("score").alias("scored"), F.avg("score").alias("mean"),
        F.min("score").alias("minimum"), F.count_if(score >= F.col("threshold")).alias("pass_count"),
    ).join(exact_median(scores, by), by, "left")
    rate = F.coalesce(F.try_divide(F.col("pass_count"), F.col("total")), F.lit(0.0))
    good = (F.col("scored") == F.col("total")) & (rate >= pass_rate) & (F.col("mean") >= F.col("threshold"))
    verdict = F.when(F.col("calibration") != "REQUIRED", F.col("calibration")).when(F.coalesce(good, F.lit(False)), F.lit("PASS")).otherwise(F.lit("FAIL"))
    return rows.withColumn("pass_rate", rate).withColumn("status", verdict)


def percentage(passed: Column, total: Column) -> Column:
    return F.coalesce(F.bround(F.try_divide(passed * 100, total), 2), F.lit(0.0))


def gate_report(results: DataFrame, labels: str = "taxonomy") -> tuple[DataFrame, DataFrame, DataFrame]:
    """AGG-23: per label, overall and critical pass counts, and the failed cases as rows.

    ``results``: case_id, passed, critical and an array of labels.
    """
    n, ok = F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed")
    per_label = results.select("passed", F.explode(labels).alias("label")).groupBy("label").agg(n, ok).withColumn(
        "percentage", percentage(F.col("passed"), F.col("total"))
    )
    overall = results.agg(
        n, ok, F.count_if("critical").alias("critical_total"), F.count_if(F.col("critical") & F.col("passed")).alias("critical_passed")
    )
    overall = overall.withColumn("percentage", percentage(F.col("passed"), F.col("total"))).withColumn(
        "critical_percentage", percentage(F.col("critical_passed"), F.col("critical_total"))
    ).withColumn("gate_passed", (F.col("percentage") >= 80.0) & (F.col("critical_percentage") == 100.0))
    failed = results.where(~F.col("passed")).select("case_id", "critical", F.explode_outer(labels).alias("label"))
    return per_label, overall, failed


def acceptance_summary(results: DataFrame) -> DataFrame:
    """AGG-24: eligible, attempted and succeeded cases, and the critical ones among them."""
    return results.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("eligible").alias("eligible"), F.count_if("attempted").alias("attempted"),
        F.count_if("succeeded").alias("succeeded"), F.count_if("critical").alias("critical"),
        F.count_if(F.col("critical") & F.col("attempted")).alias("critical_attempts"),
        F.count_if(F.col("critical") & ~F.col("valid")).alias("critical_failures"), F.bool_and("valid").alias("all_valid"),
    )


def leakage_audit(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """CMP-21: per answer, evidence newer than its basis and evidence about other securities only."""
    rows = answers.select("answer_id", "basis_at", "expected_security_id").join(evidence, "answer_id", "left")
    future = F.col("published_at") > F.col("basis_at")
    foreign = F.col("expected_security_id").isNotNull() & (F.size("subject_security_ids") > 0) & ~F.array_contains(
        "subject_security_ids", F.col("expected_security_id")
    )
    return rows.groupBy("answer_id").agg(
        F.count_if(F.coalesce(future, F.lit(False))).alias("future_rows"), F.count_if(F.coalesce(foreign, F.lit(False))).alias("wrong_company_rows")
    )


def golden_mismatches(expected: DataFrame, actual: DataFrame, key: str, fields: Sequence[str], forbidden: Mapping[str, str] | None = None) -> DataFrame:
    """CMP-22: names of differing fields per case; ``forbidden`` maps an array column of the expectation to an actual array."""
    joined = expected.alias("e").join(actual.alias("a"), key, "left")
    checks = [F.when(~F.col(f"e.{name}").eqNullSafe(F.col(f"a.{name}")), F.lit(name)) for name in fields]
    for banned, seen in (forbidden or {}).items():
        checks.append(F.when(F.coalesce(F.arrays_overlap(f"e.{banned}", f"a.{seen}"), F.lit(False)), F.lit(banned)))
    return joined.select(key, F.array_compact(F.array(*checks)).alias("failures"))


def acceptance_reason(rendered: str, forbidden: Sequence[str]) -> Column:
    """VAL-12: first way in which an answer row departs from its acceptance case."""
    return (
        F.when(~F.array_contains("allowed_statuses", F.col("status")), F.lit("status"))
        .when(~F.col("security_id").eqNullSafe(F.col("expected_security_id")), F.lit("security"))
        .when(F.col("intent") != F.col("expected_intent"), F.lit("intent"))
        .when(F.col("returned_sources") != F.col("required_evidence_sources"), F.lit("sources"))
        .when(contains_any(rendered, forbidden), F.lit("forbidden_phrase"))
    )
