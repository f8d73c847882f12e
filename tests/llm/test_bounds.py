"""Large numbers in the top-k proof; rare domains and targets out of reach in the mixing."""

from __future__ import annotations

import numpy as np
import pytest

from lodestone.llm.common import ready
from lodestone.llm.mixing import fit_rates, mixed_documents, with_posteriors
from lodestone.llm.topk import ImpactIndex


@pytest.mark.parametrize("scale", [256, 1e8, 2.7e8])
def test_no_member_of_the_best_is_lost(scale):
    for seed in range(30):
        chooser = np.random.default_rng(seed)
        vectors = np.floor(scale * (1 + 1e-8 * chooser.normal(size=(300, 24)))).astype(np.int64)
        query = np.floor(scale * (1 + 1e-8 * chooser.normal(size=24))).astype(np.int64)
        rows, scores = ImpactIndex(vectors).search(query, 6)
        assert np.array_equal(vectors[rows] @ query, scores)
        assert sorted(scores.tolist(), reverse=True)[:6] == sorted((vectors @ query).tolist(), reverse=True)[:6]


def soft(spark, rows):
    return spark.createDataFrame(rows, "__tokens long, __p_a double, __p_b double")


def test_a_rare_domain_reaches_its_target(spark):
    # 0.09 % of the tokens are of domain b.
    fit = fit_rates(soft(spark, [(100, 1.0, 0.0)] * 9991 + [(100, 0.0, 1.0)] * 9), {"a": 0.99, "b": 0.01})
    assert not fit.missed and fit.reached["b"] == pytest.approx(fit.goal["b"], rel=0.02) and fit.goal["b"] > 10_000


def test_a_target_out_of_reach_is_named(spark):
    fit = fit_rates(soft(spark, [(100, 0.9, 0.1)] * 500), {"a": 0.5, "b": 0.5})
    assert fit.missed and fit.reached["b"] < fit.goal["b"]
    # The nearest point on the ray of the only posterior there is.
    assert fit.reached["a"] == pytest.approx(9 * fit.reached["b"], rel=1e-6)


def test_a_domain_without_tokens_is_left_out(spark):
    fit = fit_rates(soft(spark, [(100, 1.0, 0.0)] * 50), {"a": 0.5, "b": 0.5})
    assert fit.goal == {"a": 5000.0, "b": 0.0} and not fit.missed
    assert fit_rates(soft(spark, []), {"a": 0.5, "b": 0.5}).steps == []


def test_the_plan_stays_small(spark, make_documents):
    ready(spark)
    documents = make_documents({i: f"word{i % 7} text{i % 3}" for i in range(60)})
    labelled = spark.createDataFrame([(i, ("clean", "poor", "toxic")[i % 3]) for i in range(60)], "doc_id long, domain string")
    model = {domain: (-1.0, [0.0] * 8192) for domain in ("clean", "poor", "toxic")}
    scored = with_posteriors(documents, model, list(model))
    assert len(scored._jdf.queryExecution().toString()) < 100_000
    assert len(mixed_documents(documents, labelled)._jdf.queryExecution().toString()) < 100_000
