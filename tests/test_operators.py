"""Small fixtures for edges the shared tables do not reach."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random

from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import text, times, urls
from lodestone.operators import citations, claims, coverage, evaluation, evidence, filters, freshness, graph, market, mentions, planning, resolve, retrieval, selection
from lodestone.operators.skew import keep_first, salted_join
from lodestone.plans import all_queries
from lodestone.session import cut_lineage


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()["r"]


def test_fold_and_clean(spark):
    assert one(spark, text.fold("v"), " ＨＢＭ４　Straße  ﬁn ") == "hbm4 strasse fin"
    assert one(spark, text.clean_tags_first("v"), "<b>A</b>&amp;lt;b&gt; &hearts;x") == "A&lt;b> ♥x"
    assert one(spark, text.clean_entities_first("v"), "&lt;b&gt;A&lt;/b&gt;B") == "A B"


def test_korean_tokens(spark):
    got = one(spark, text.retrieval_tokens("v"), "삼성전자에서 HBM4E를 알려줘 은 실적은")
    assert got == ["삼성전자", "hbm4e", "hbm", "를", "알려", "은", "실적"]
    assert one(spark, text.query_tokens("v"), "최근 실적은 실적") == ["실적", "실적"]
    assert set(one(spark, text.grounding_tokens("v"), "매출은 증가했고 매출 전망은 12조원")) == {"매출", "증가했고", "12", "조원"}
    assert set(one(spark, text.numeric_tokens("v"), "2026년 7월 24일 1,234.5 억원 3.2% v2")) == {"2026년7월24일", "1,234.5억원", "3.2%"}
    assert one(spark, text.humanize_amounts("v"), "매출 12,345,678백만원, 원문 9,000,000백만원, 10억원") == (
        "매출 약 12.3조원(공시 원문 12,345,678백만원), 원문 9,000,000백만원, 10억원"
    )


def test_urls_and_times(spark):
    assert one(spark, urls.canonical_url("v"), "HTTPS://WWW.Ex.com?a&utm_x=1&ref=2&b=3#f") == "https://www.ex.com/?a=&b=3"
    assert one(spark, urls.canonical_url("v"), "https://u@ex.com/") is None
    assert one(spark, urls.feed_url("v"), "http://EX.com:80/a?b#c") == "http://ex.com/a?b"
    assert one(spark, urls.is_safe_url("v"), "https://ex.com/?api-key=1") is False
    assert one(spark, times.parse_feed_time("v"), "Fri, 24 Jul 2026 09:00:00 +0900") == dt.datetime(2026, 7, 24)
    assert one(spark, times.parse_feed_time("v"), "Fri, 24 Jul 2026 09:00:00") is None
    day = one(spark, times.day_available_at(times.parse_compact_day("v")), "20260724")
    assert day == dt.datetime(2026, 7, 24, 14, 59, 59)
    period = one(spark, times.parse_period("v", F.lit("2026-07-24").cast("date")), "2026년 2월 실적")
    assert (period["start"], period["end"]) == (dt.date(2026, 2, 1), dt.date(2026, 2, 28))
    assert one(spark, times.parse_period("v", F.lit("2026-07-24").cast("date")), "오늘 2026-07-01")["start"] is None


def test_intents(spark):
    asked = {"삼성전자 왜 올랐어": "price_move", "per 뜻이 뭐야": "financial_term", "위험 요인": "risk_factors", "현재 주가": "price", "최근 뉴스": "recent_issue", "주가 차트": "out_of_scope"}
    for question, intent in asked.items():
        assert one(spark, planning.classify_intent(text.fold("v")), question) == intent
    assert one(spark, planning.is_prohibited(text.fold("v")), "지금 사야 해") is True
    assert one(spark, planning.is_prohibited(text.fold("v")), "회사야") is False


def brute_bm25(docs, query):
    total = len(docs)
    mean = sum(map(len, docs)) / total
    scores = []
    for doc in docs:
        score = 0.0
        for token in dict.fromkeys(query):
            tf, df = doc.count(token), sum(token in d for d in docs)
            if tf:
                score += math.log(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean)) * query.count(token)
        scores.append(round(score, 6))
    return scores


def corpus(spark, rows):
    docs = spark.createDataFrame(
        [(f"d{n}", source, ["S"], [], title, dt.datetime(2024, 1, 1), f"https://e.com/{n}", body, "t", "", "l", True) for n, (source, title, body) in enumerate(rows)],
        "document_id string, source_type string, primary_security_ids array<string>, mentioned_security_ids array<string>, title string, published_at timestamp,"
        "source_url string, text string, document_type string, report_type string, content_level string, external_allowed boolean",
    )
    return docs, evidence.to_evidence(docs)[0]


def ask(spark, query, sources, top_k=6, request="r"):
    return spark.createDataFrame(
        [(request, query, "S", sources, None, None, None, None, top_k)],
        "request_id string, query string, security_id string, source_types array<string>, start_day date, end_day date, as_of timestamp, document_types array<string>, top_k int",
    )


def test_retrieval_scores_and_order(spark):
    rows = [("news", "alpha beta", "gamma"), ("news", "alpha", "beta alpha"), ("disclosure", "beta", "zeta"), ("news", "eta", "theta"), ("news", "iota", "kappa")]
    docs, ev = corpus(spark, rows)
    hits, diagnostics = retrieval.bm25_retrieve(ev, ask(spark, "alpha beta beta", ["disclosure", "news"]), docs)
    tokens = [2 * title.split() + body.split() for _, title, body in rows]
    want = {f"evidence:d{n}": s for n, s in enumerate(brute_bm25(tokens, ["alpha", "beta", "beta"])) if s >= 0.5}
    got = hits.orderBy("position").collect()
    assert {r["evidence_id"]: r["score"] for r in got} == want
    assert got[0]["source_type"] == "disclosure"
    row = diagnostics.first()
    assert (row["status"], row["filtered_count"], row["query_token_count"]) == ("ok", 5, 3)


def test_retrieval_statuses(spark):
    docs, ev = corpus(spark, [("news", "alpha", "beta"), ("news", "alpha", "gamma")])
    assert retrieval.bm25_retrieve(ev, ask(spark, "최근 설명", ["news"]), docs)[1].first()["status"] == "low_relevance"
    empty = retrieval.bm25_retrieve(ev, ask(spark, "alpha", ["glossary"]), docs)[1].first()
    assert (empty["status"], empty["filtered_count"], empty["query_token_count"]) == ("empty", 0, 0)


def test_document_types_null_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", []), ("a", ["a"])], "t string, wanted array<string>")
    assert [r[0] for r in df.select(filters.type_match(["t"], "wanted")).collect()] == [True, False, True]


def test_context_budget_edge(spark):
    rows = spark.createDataFrame([("r", n, f"e{n}", "x" * 98) for n in range(3)], "request_id string, position int, evidence_id string, j string")
    order = [F.col("position")]
    # Two elements of 98 characters, one comma and two brackets make 199.
    assert selection.fitting_prefix(rows, order, F.col("j"), 199, 6000).count() == 2
    assert selection.fitting_prefix(rows, order, F.col("j"), 198, 6000).count() == 1
    assert selection.fitting_prefix(rows, order, F.col("j"), 9999, 67).count() == 2
    assert selection.fitting_prefix(rows, order, F.col("j"), 9999, 66).count() == 1


def test_freshness_edges(spark):
    basis = dt.datetime(2024, 7, 1)
    scopes = spark.createDataFrame([("k", ["news", "disclosure"], None, None, basis)], "scope string, source_types array<string>, start_day date, end_day date, basis_at timestamp")
    rows = [("news", 30), ("news", 31), *[("disclosure", d) for d in (10, 180, 181, 365, 366)]]
    data = [("k", f"e{n}", f"d{n}", s, basis - dt.timedelta(days=age), False, False, False, None) for n, (s, age) in enumerate(rows)]
    data.append(("k", "e9", "d9", "disclosure", basis - dt.timedelta(days=1), True, False, False, "d2"))
    df = spark.createDataFrame(data, "scope string, evidence_id string, document_id string, source_type string, effective_at timestamp, is_correction boolean, has_subsequent_correction boolean, is_withdrawn boolean, correction_of string")
    retained, summary, warnings = freshness.apply_freshness(df, scopes)
    # Four recent disclosures are too few, so the window grows to 365 days; d2 is replaced by d9.
    assert {r["document_id"] for r in retained.collect()} == {"d0", "d3", "d4", "d5", "d9"}
    assert {(r["source_type"], r["code"]) for r in warnings.collect()} == {
        ("news", "stale_news"), ("disclosure", "disclosure_window_extended"), ("disclosure", "insufficient_disclosure_coverage")
    }
    assert summary.first()["latest_disclosure_at"] == basis - dt.timedelta(days=1)


def test_asof_join_over_buckets(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    bars = [(rng.choice(["hot", "hot", "cold"]), start + dt.timedelta(seconds=rng.randrange(400_000)), n) for n in range(200)]
    asks = [(rng.choice(["hot", "cold", "none"]), start + dt.timedelta(seconds=rng.randrange(400_000)), n) for n in range(150)]
    asks.append(("hot", next(b[1] for b in bars if b[0] == "hot"), 999))
    left = spark.createDataFrame(asks, "k string, at timestamp, ask int")
    right = spark.createDataFrame(bars, "k string, bar_at timestamp, price int")
    got = {r["ask"]: r["matched_ts"] for r in market.asof_join(left, right, ["k"], "at", "bar_at", ["price"], 3600).collect()}
    assert got == {n: max((b[1] for b in bars if b[0] == k and b[1] <= at), default=None) for k, at, n in asks}


def test_mentions_by_join_equal_mentions_by_literal(spark):
    rng = random.Random(9)
    words = ["abc", "ab", "a", "xyz", "삼성", "삼성전자", "q"]
    texts = spark.createDataFrame([(n, "".join(rng.choice("abcxyz 삼성전자") for _ in range(rng.randrange(12)))) for n in range(200)], "id int, t string")
    aliases = spark.createDataFrame([(f"s{n % 3}", w) for n, w in enumerate(words)], "security_id string, term string")
    literal = {f"s{k}": [w for n, w in enumerate(words) if n % 3 == k] for k in range(3)}
    small = mentions.find_mentions(texts, "id", "t", literal)
    large = mentions.find_mentions(texts, "id", "t", aliases)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_glossary_phrase_boundaries(spark):
    entries = spark.createDataFrame([("e1", "PER", ["주가수익비율"]), ("e2", "PBR", [])], "entry_id string, canonical_term string, aliases array<string>")
    asked = ["PER은 뭐야", "superPER", "PER와 PBR", "주가수익비율 (PER)"]
    df = spark.createDataFrame([(q,) for q in asked], "question string")
    got = {r["question"]: (r["entry_id"], r["matched_term"]) for r in resolve.glossary_phrases(df, entries).collect()}
    assert got == {asked[0]: ("e1", "PER"), asked[1]: (None, None), asked[2]: (None, None), asked[3]: ("e1", "주가수익비율")}


def test_calibration_matches_the_sweep(spark):
    rng = random.Random(6)
    rows = [("m", round(rng.random(), 3), rng.random() < 0.6) for _ in range(300)]
    values = sorted({s for _, s, _ in rows})
    tried = {0.0, 1.000001, *values, *[(a + c) / 2 for a, c in zip(values, values[1:])]}
    best = max((sum((s >= t) is y for _, s, y in rows), -sum(s >= t and not y for _, s, y in rows), -sum(s < t and y for _, s, y in rows), t) for t in tried)
    df = spark.createDataFrame(rows, "metric string, score double, label boolean")
    got = evaluation.calibrate(df, "metric", buckets=7).first()
    assert (got["agreement"], got["false_pass"], got["false_fail"], got["threshold"]) == (best[0], -best[1], -best[2], round(best[3], 6))


def test_grounding_rules(spark):
    ev = spark.createDataFrame([("e1", "alpha beta gamma delta"), ("e2", "omega")], "evidence_id string, snippet string")
    rows = [("c1", "beta gamma", ["e1"]), ("c2", "alpha zz beta yy", ["e1"]), ("c3", "alpha beta", ["e1", "e2"]), ("c4", "alpha b1 b2 b3 b4 b5 b6 beta", ["e1"])]
    df = spark.createDataFrame(rows, "claim_id string, text string, evidence_ids array<string>")
    got = {r["claim_id"]: r["grounded"] for r in citations.claim_grounding(df, ev).collect()}
    assert got == {"c1": True, "c2": True, "c3": False, "c4": False}


def test_unsafe_wording(spark):
    for value, bad in {"지금 매수하세요": True, "상승 확률은 70%": True, "실적이 개선되었다": False, "목표가 90,000원": True}.items():
        assert one(spark, claims.is_unsafe(text.fold("v")), value) is bad


def test_resolution_priorities(spark):
    securities = spark.createDataFrame([("KRX:005930", "005930", "삼성전자", ["삼전"]), ("KRX:005380", "005380", "현대자동차", ["현대차"])], "security_id string, ticker string, security_name string, aliases array<string>")
    lookup = resolve.lookup_table(securities)
    asked = spark.createDataFrame([("a", "삼성전자와 현대차 비교"), ("b", "삼전의 실적"), ("c", "AAPL 어때"), ("d", "삼성 주가")], "request_id string, question string")
    got = {r["request_id"]: (r["security_id"], r["multi_security"], r["unclear_security"]) for r in resolve.extract_securities(asked, lookup, ambiguous=["삼성"]).collect()}
    assert got == {"a": (None, True, True), "b": ("KRX:005930", False, False), "c": (None, False, True), "d": (None, False, True)}


def test_salted_join_and_keep_first(spark):
    left = spark.createDataFrame([("hot", n) for n in range(100)] + [("x", 1)], "k string, n int")
    right = spark.createDataFrame([("hot", "h")], "k string, v string")
    assert salted_join(left, right, ["k"], "left").where("v IS NULL").count() == 1
    assert salted_join(left, right, ["k"], "left_anti").count() == 1
    assert keep_first(left, ["k"], [F.col("n").desc()]).where("k = 'hot'").first()["n"] == 99


def test_copies_and_hops_are_not_broadcast(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("'s' AS scope", "id + 1 AS node", "id AS parent").write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "Broadcast" not in plan(salted_join(edges, edges.select("node", F.lit(1).alias("v")), ["node"]))
    plans = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: plans.append(plan(df)) or cut_lineage(df))
    roots, stuck = graph.chain_roots(edges, "scope")
    assert roots.where("root = 0").count() == 1000 and stuck.isEmpty()
    assert len(plans) > 5 and not any("Broadcast" in one for one in plans)


def test_fixed_tables_are_consistent():
    assert set(fixed.FOCUS_LIMITS) <= set(fixed.FOCUS_QUERY_TERMS)
    assert set(fixed.LIMITING_WARNINGS) <= set(fixed.WARNING_ORDER)
    assert set(fixed.EVENT_DISTINCTIVE) <= set(fixed.EVENT_PHRASES.values())


def test_price_change_from_zero(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, day), 7, "view", value, None) for day, value in ((1, 0.0), (2, 5.0), (3, 5.0), (4, 0.0), (5, 0.0))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["day"]: (r["direction"], r["percent"]) for r in all_queries()["win_12_price_change"].build(spark, str(tmp_path)).collect()}
    assert got["2024-01-02"] == ("up", math.inf) and got["2024-01-03"] == ("flat", 0.0) and got["2024-01-04"] == ("down", -100.0)
    assert got["2024-01-05"][0] == "flat" and math.isnan(got["2024-01-05"][1])


def test_shared_titles_differ_by_blanks(spark, tmp_path):
    rows = [("en", "A  b\nx", "s1"), ("en", "a b\ny", "s2"), ("en", "Straße\n", "s1"), ("en", "strasse\n", "s2"), ("en", "SAME\n", "s1"), ("en", "same\n", "s2"), ("de", None, "s1")]
    spark.createDataFrame(rows, "lang string, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in all_queries()["agg_04_shared_titles"].build(spark, str(tmp_path)).collect()} == {("en", 1), ("de", 0)}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).selectExpr("lang AS security_id", "split_part(text, '\n', 1) AS title", "source AS publisher_host")
    assert {tuple(r) for r in coverage.shared_titles(docs).collect()} == {("en", 3), ("de", 0)}


def test_gate_percentage_is_rounded_once(spark, tmp_path):
    spark.range(377).selectExpr("id AS doc_id", "'es' AS lang", "'src' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(377).selectExpr("id AS doc_id", "cast(id < 321 as int) AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    rows = all_queries()["agg_23_gate_by_label"].build(spark, str(tmp_path)).collect()
    assert {(r["label"], r["passed"], r["total"], r["percentage"]) for r in rows} == {("es", 321, 377, 85.1), ("src", 321, 377, 85.1)}


def test_risk_focus_keeps_the_blank_a_cut_leaves(spark, tmp_path):
    rows = [(0, "x" * 491 + " tion ti and more"), (2, "tion"), (4, "plain"), (1, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert rows[0][1][:500].endswith("tion ti ")
    got = {r["evidence_id"] for r in all_queries()["flt_14_risk_focus"].build(spark, str(tmp_path)).collect()}
    assert got == {"evidence:doc:1", "evidence:doc:2"}


def test_priority_order_keeps_large_keys(spark, tmp_path):
    rows = [(1, 1_199_999, 59_999, 1), (1, 1_200_000, 10_000, 2)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    lines.selectExpr("*", "20.0D AS l_quantity", "'R' AS l_returnflag", "'O' AS l_linestatus").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = all_queries()["top_06_priority_order"].build(spark, str(tmp_path)).collect()
    assert {(r["l_partkey"], r["l_suppkey"], r["answer_rank"]) for r in got} == {(1_200_000, 10_000, 1), (1_199_999, 59_999, 2)}


def test_pages_are_cleaned_with_the_stated_entities(spark, tmp_path):
    html = "<title>the&&amp; &ampx &hearts;</title>&lt;b&gt;"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = all_queries()["txt_02_html_clean"].build(spark, str(tmp_path)).first()
    md5 = lambda value: hashlib.md5(value.encode()).hexdigest()
    assert (got["tags_first"], got["entities_first"]) == (md5("the&& &ampx &hearts;<b>"), md5("the&& &ampx &hearts;"))


def test_feed_titles_keep_half_entities(spark, tmp_path):
    rows = [(n, f"https://www.ex.com/en/{n}", f"<html><title>the {mark}</title></html>") for n, mark in ((20, "&amp"), (22, "&amp;"), (23, "&hearts;"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    items = all_queries()["cmp_11_news_inventory"].build(spark, str(tmp_path))
    assert {r["title"] for r in items.collect()} == {"the &amp", "the &", "the &hearts;"}
    # Rejection counts need no description and no Python.
    assert "Python" not in all_queries()["agg_07_rejection_counts"].build(spark, str(tmp_path))._jdf.queryExecution().toString()


def test_event_relevance_reads_the_whole_body(spark, tmp_path):
    rows = [(0, "Alpha beta\nnothing here"), (1, "Alpha beta\n" + "filler " * 200 + "alpha"), (2, "Alpha beta"), (3, " \n ")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["evidence_id"]: r["relevant"] for r in all_queries()["flt_15_query_event_relevance"].build(spark, str(tmp_path)).collect()}
    assert got == {"evidence:doc:0": False, "evidence:doc:1": True, "evidence:doc:2": False}


def test_spans_of_a_question_are_worked_out_once(spark):
    lookup = spark.createDataFrame([("S1", "000123", "name", 2)], "security_id string, lookup_key string, kind string, priority int")
    asked = spark.createDataFrame([(1, "tell me about (000123) now"), (2, None), (3, ""), (4, " two  blanks "), (5, " ".join(["000123"] * 40))], "request_id long, question string")
    found = resolve.extract_securities(asked, lookup, hints=["acct"])
    # The words of a question and the parts of a span are split; the plan does not repeat them for filters, ends or places.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 4
    assert {r["request_id"]: r["security_id"] for r in found.collect()} == {1: "S1", 2: None, 3: None, 4: None, 5: "S1"}
