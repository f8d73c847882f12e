"""Steps whose cost must not grow faster than their input, or with the number of times a text is named."""

from __future__ import annotations

import random
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import text, times
from lodestone.operators import claims, events, planning, scan

ODD = [
    "plain words", " lead  and tail ", "tab\tand\nline\r\nbreak", "one two", "　wide　 ", "Straße ÄÖÜ é", "ﬁne ① ｆｕｌｌ", "한국어 회사", " a   b", "a b c", "x\u0085y",
    "\U0001d400 bold", "İ İ", "café é", "", " ", "\n", "~! !~  ~", None,
]


def test_folding_passes_plain_text_over_and_changes_all_other(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "n int, s string")
    got = {r["n"]: (r["folded"], r["whole"]) for r in df.select("n", text.fold("s").alias("folded"), text.collapse("s").alias("whole")).collect()}
    for n, value in enumerate(ODD):
        if value is None:
            assert got[n] == (None, None)
            continue
        squeezed = lambda s: re.sub(text.BLANKS, " ", s).strip(" ")
        assert got[n] == (squeezed(unicodedata.normalize("NFKC", value).casefold()), squeezed(value)), value
    # Classes of many ranges are reached by characters outside printed ASCII only.
    assert text.UNEVEN_BLANKS.startswith("[^!-~]") and text.UNSTABLE_CHARACTER.startswith(r"[^\x00-\x7F](?<!")


def test_phrases_are_plain_searches(spark):
    phrases = ["a.b", "", "(c", "zz"]
    df = spark.createDataFrame([("xa.by",), ("xaxby",), ("(c",), (None,)], "s string")
    some = text.contains_any("s", phrases[:1] + phrases[2:])
    rows = df.select("s", some.alias("some"), text.contains_any("s", phrases).alias("all"))
    assert [tuple(r) for r in rows.collect()] == [("xa.by", True, True), ("xaxby", False, True), ("(c", True, True), (None, None, None)]
    assert "RLIKE" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_groups_are_found_without_looking_at_all_members():
    rng = random.Random(3)
    marks, names = frozenset(["m1", "m2", "m3"]), frozenset(["m1", "n1", "n2"])
    words = [*sorted(marks | names), *(f"w{i}" for i in range(30))]
    same = lambda a, b: len(a & b & marks) >= 2 or (len(a & b & marks) == 1 and len(a & b) >= 3 and len(a & b & names) >= 2)
    held, want, plain = events.OpenGroups(marks, names, None), [], []
    for n in range(3000):
        terms = frozenset(rng.sample(words[:5], rng.randint(2, 3)) + rng.sample(words[5:], rng.randint(0, 5)))
        if not same(terms, terms):
            continue
        plain = [g for g in plain if n - g[1] <= 400]
        home = next((g for g in plain if all(same(terms, m) for m in g[2])), None)
        if home is None:
            home = (f"t{n}", n, [])
            plain.append(home)
        home[2].append(terms)
        held.close_before(n - 400)
        want.append((held.put(f"t{n}", n, terms), home[0]))
        if n % 500 == 0:
            held = events.OpenGroups(marks, names, held.state())
    assert all(a == b for a, b in want) and len({a for a, _ in want}) > 20
    many = events.OpenGroups(marks, names, None)
    assert {many.put(f"t{n}", n, frozenset(["m1", "m2", f"w{n}"])) for n in range(20_000)} == {"t0"}
    assert len(many.related) == 1 and len(many.state()[0]["members"]) == 1


def test_a_walk_reads_its_own_columns_only(spark):
    def step(run: pd.DataFrame, state):
        assert set(run.columns) == {"chunk", "__place", "k", "at"}, list(run.columns)
        return [{"n": str(i + (state or 0))} for i in range(len(run))], (state or 0) + len(run)

    df = spark.range(50).select((F.col("id") % 2).cast("string").alias("k"), F.col("id").alias("at"), F.repeat(F.lit("x"), 100).alias("wide"))
    rows = scan.ordered_scan(df, "k", ["at"], step, scan.text_result("n"), 10, []).collect()
    assert {(r["k"], r["at"]): r["n"] for r in rows} == {(str(i % 2), i): str(i // 2) for i in range(50)}
    assert all(r["wide"] == "x" * 100 for r in rows)


def test_many_small_keys_pass_a_walk_as_rows(spark):
    import time

    def step(run, state):
        assert isinstance(run, list), type(run)
        return [{"n": f"{(state or 0) + i} {row.v}"} for i, row in enumerate(run)], (state or 0) + len(run)

    df = spark.range(40).selectExpr("CASE WHEN id % 3 > 0 THEN id % 3 END AS k", "id AS at", "CASE WHEN id % 2 = 0 THEN cast(id AS string) END AS v")
    rows = scan.ordered_scan(df, "k", ["at"], step, scan.text_result("n"), 7, tuples=True).collect()
    assert {r["at"]: r["n"] for r in rows} == {i: f"{i // 3 if i % 3 == 0 else (i - i % 3) // 3} {i if i % 2 == 0 else None}" for i in range(40)}
    frame = pd.DataFrame({"k": [str(n // 2) for n in range(60_000)], "at": range(60_000), "v": [None, "x"] * 30_000})
    begun = time.process_time()
    found, first, last, state = scan._play(frame, "k", ["at"], step, None, tuples=True)
    # 30,000 keys; a frame for each takes more than ten seconds.
    assert time.process_time() - begun < 5 and len(found) == 60_000 and (first, state) == ("0", 2)


def test_memory_names_are_marked_from_their_letters_on(spark):
    texts = ["hbm3e", "xhbm4 hbm4", "(hbm4) hbm hbm33hbm4", "회사hbm4e1 hbmx hbm", "9hbm2 -hbm2", "hbmhbm3"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", text.retrieval_tokens_of(F.col("s")).alias("got"))
    plain = spark.createDataFrame([(re.sub("(?<![a-z0-9])(hbm[0-9][a-z0-9]*)", r"\1 hbm", t), t) for t in texts], "m string, s string")
    want = {r["s"]: r["want"] for r in plain.select("s", F.regexp_extract_all("m", F.lit(text.fixed.RETRIEVAL_TOKEN), F.lit(0)).alias("want")).collect()}
    assert {r["s"]: r["got"] for r in rows.collect()} == want
    # No lookbehind at every character.
    assert "(?<![a-z0-9])(hbm" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_periods_are_looked_for_in_dated_texts_only(spark):
    texts = [
        "2026-07-01", "x 2026-07-01 ~ 2026-07-09 y", "2026-07-09~2026-07-01", "2026년 2월 실적", "2026  년 2월 3일", "2026-07-011", "12026-07-01", "2026년", "2026년 2월 3", "오늘", "오늘 2026-07-01",
        "최근 오늘", "최근", "2026-7-1", "1년 2월", "", "no day", "2026-02-31", "2026년 13월", "2026-07-01 2026년 2월", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "v string").withColumn("day", F.lit("2026-07-24").cast("date")).withColumn("d", times.dated_text("v"))
    rows = df.select("v", "d", times.parse_period("v", "day").alias("plain"), times.parse_period("v", "day", dated="d").alias("quick")).collect()
    assert [r["quick"] for r in rows] == [r["plain"] for r in rows]
    assert {r["v"] for r in rows if r["d"] == ""} == {"오늘", "최근 오늘", "최근", "2026-7-1", "1년 2월", "", "no day"}
    ends = ["은", " 는?", "쪽 은요!\n", "~도~", "도 요", "은은", "은 x", "", "?", "쪽", None]
    found = spark.createDataFrame([(t,) for t in ends], "v string").select(
        planning.consists_of("v", fixed.SWITCH_REMAINDERS, r"[\s?!.,~]").alias("a"), F.regexp_replace("v", r"[\s?!.,~]+", "").isin(fixed.SWITCH_REMAINDERS).alias("b")
    ).collect()
    assert [r["a"] for r in found] == [r["b"] for r in found] == [True] * 5 + [False] * 5 + [None]


def test_unsafe_words_are_searched_before_their_patterns(spark):
    texts = [
        "you should hold it now", "buy", "stop-loss at 12", "take profit 5", "목표 가격 제시", "target  price of 9", "a guaranteed return", "확정 수익", "매수를 권장", "사세요", "plain", "반드시 상승", "손절 시점", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    rows = df.select(claims.unsafe_flags("v").alias("quick"), claims.unsafe_flags("v", fixed.UNSAFE_ANSWER_PATTERNS).alias("plain"))
    assert all(r["quick"] == r["plain"] for r in rows.collect())
    assert "Contains(v" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_suffixes_are_looked_for_from_hangul_letters_on(spark):
    texts = ["매출은 abc", "x매출은", "매출은증가", "가매출은 9", "은", "매출에게서", "plain", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    suffixes = fixed.GROUNDING_PARTICLES
    plain = F.regexp_replace("v", f"(?<![가-힣])([가-힣]{{2,}}?)(?:{text.alternation(suffixes)})(?![가-힣])", "$1")
    rows = df.select(text.strip_suffix_once(F.col("v"), suffixes).alias("got"), plain.alias("want"))
    assert all(r["got"] == r["want"] for r in rows.collect())
    assert "(?=[가-힣])(?<!" in rows._jdf.queryExecution().optimizedPlan().toString()
