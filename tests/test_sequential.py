"""Order-dependent operators against plain re-statements, with chunks small enough to split every key."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.operators import dialogue, events
from lodestone.operators.dedup import two_key_dedup
from lodestone.operators.graph import chain_roots

START = dt.datetime(2024, 1, 1)


def test_two_key_dedup_matches_the_walk(spark):
    rng = random.Random(7)
    rows = [("s", rng.choice("abcdefgh"), rng.choice("uvwxyz"), n) for n in range(120)]
    rows += [("hot", "same", f"t{n % 40}", n) for n in range(200)]
    kept, seen = [], {}
    for scope, first, second, at in sorted(rows, key=lambda r: (r[0], r[3])):
        firsts, seconds = seen.setdefault(scope, (set(), set()))
        if first not in firsts and second not in seconds:
            firsts.add(first)
            seconds.add(second)
            kept.append((scope, at))
    df = spark.createDataFrame(rows, "scope string, a string, b string, at long")
    got = [tuple(r) for r in two_key_dedup(df, "scope", "a", "b", "at").select("scope", "at").collect()]
    assert sorted(got) == sorted(kept)


def test_two_key_dedup_with_missing_keys_and_ties(spark):
    rows = [("s", None, "u", 1), ("s", None, "u", 2), ("s", "a", None, 3), ("s", "a", None, 3), ("s", None, None, 4), ("s", None, None, 4), (None, "a", "v", 5), (None, "a", "w", 5)]
    rows += [("t", "a", "x", 7), ("t", "b", "x", 7), ("t", "b", "y", 7), ("t", "a", "y", 7)]
    df = spark.createDataFrame(rows, "scope string, a string, b string, at long")
    got = sorted((str(r["scope"]), str(r["a"]), str(r["b"]), r["at"]) for r in two_key_dedup(df, "scope", "a", "b", "at").collect())
    assert got[:1] == [("None", "a", "v", 5)]
    assert [r for r in got if r[0] == "s"] == [("s", "None", "None", 4), ("s", "None", "None", 4), ("s", "None", "u", 1), ("s", "a", "None", 3)]
    assert [r for r in got if r[0] == "t"] == [("t", "a", "x", 7), ("t", "b", "y", 7)]


def test_global_limit_is_decided_in_the_walk(spark):
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(12)}", n, START + dt.timedelta(hours=12, seconds=40 * n)) for n in range(1200)]
    df = spark.createDataFrame(rows, "client string, request_id long, ts timestamp")
    got = {r["request_id"] for r in dialogue.admission_within_global_limit(df, limit=70, rows_per_chunk=200).where("decision = 'admitted'").collect()}
    want, recent, days = set(), {}, {}
    for client, request, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        day = (ts + dt.timedelta(hours=9)).date()
        held = [t for t in recent.get(client, []) if t > ts - dt.timedelta(seconds=300)]
        today = days.setdefault(day, [])
        if len(held) < 10 and today.count(client) < 50 and len(today) < 70:
            held.append(ts)
            today.append(client)
            want.add(request)
        recent[client] = held
    assert got == want


def brute_admission(rows):
    out, state = {}, {}
    for client, request, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        times, days = state.setdefault(client, ([], {}))
        day = (ts + dt.timedelta(hours=9)).date()
        times[:] = [t for t in times if t > ts - dt.timedelta(seconds=300)]
        good = len(times) < 10 and days.get(day, 0) < 50
        if good:
            times.append(ts)
            days[day] = days.get(day, 0) + 1
        out[request] = "admitted" if good else "refused"
    return out


def test_admission_matches_the_walk(spark):
    rng = random.Random(3)
    rows, at = [], START
    for n in range(900):
        at += dt.timedelta(seconds=rng.choice([1, 5, 20, 60, 3000]))
        rows.append(("hot" if n % 3 else f"c{n % 5}", n, at))
    # One exactly five minutes after the first of a burst has left the window again.
    rows += [("edge", 2000 + n, START + dt.timedelta(seconds=n)) for n in range(11)] + [("edge", 2100, START + dt.timedelta(seconds=300))]
    df = spark.createDataFrame(rows, "client string, request_id long, ts timestamp")
    got = {r["request_id"]: r["decision"] for r in dialogue.admission(df, rows_per_chunk=60).collect()}
    want = brute_admission(rows)
    assert got == want
    assert got[2010] == "refused" and got[2100] == "admitted"


def test_repeats_match_the_walk(spark):
    rng = random.Random(5)
    rows, at = [], START
    for n in range(400):
        at += dt.timedelta(milliseconds=rng.choice([100, 30_000, 59_900, 90_000]))
        rows.append((rng.choice("ab"), n, at))
    want, first = {}, {}
    for key, request, ts in rows:
        fresh = key not in first or ts - first[key] >= dt.timedelta(seconds=90)
        first[key] = ts if fresh else first[key]
        want[request] = "computed" if fresh else "repeated"
    df = spark.createDataFrame(rows, "session string, request_id long, ts timestamp")
    got = {r["request_id"]: r["served"] for r in dialogue.suppress_repeats(df, ["session"], rows_per_chunk=50).collect()}
    assert got == want


PHRASES = {"alpha": "alpha", "beta": "beta", "gamma": "gamma", "delta": "delta"}
DISTINCTIVE = ["alpha", "beta", "gamma"]


def brute_groups(rows):
    def same(a, c):
        if abs((a["at"] - c["at"]).total_seconds()) > 36 * 3600:
            return False
        shared = a["terms"] & c["terms"]
        strong = shared & set(DISTINCTIVE)
        return len(strong) >= 2 or (len(strong) == 1 and len(shared) >= 3 and len(shared & set(PHRASES.values())) >= 2)

    found = {}
    for security in {r["security"] for r in rows}:
        groups = []
        for row in sorted((r for r in rows if r["security"] == security), key=lambda r: (r["at"], r["id"])):
            home = next((g for g in groups if all(same(row, member) for member in g)), None)
            if home is None:
                home = []
                groups.append(home)
            home.append(row)
        for group in groups:
            for row in group:
                found[row["id"]] = (group[0]["id"], len(group))
    return found


def test_greedy_groups_match_the_walk(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "one", "two", "three"]
    rows, at = [], START
    for n in range(260):
        at += dt.timedelta(minutes=rng.choice([0, 30, 240, 900]))
        terms = rng.sample(words, rng.randint(1, 4))
        rows.append({"security": "hot" if n % 4 else "cold", "id": f"n{n:04d}", "at": at, "title": " ".join(terms), "terms": set(terms)})
    df = spark.createDataFrame(
        [(r["security"], r["id"], r["title"], r["at"], "h") for r in rows], "security_id string, news_id string, title string, published_at timestamp, publisher_host string"
    )
    got = {r["news_id"]: r["group_id"] for r in events.greedy_groups(df, PHRASES, [], DISTINCTIVE, rows_per_chunk=40).collect()}
    want = brute_groups(rows)
    # Titles left out beforehand would have been groups of one.
    assert {i: g for i, (g, size) in want.items() if size > 1} == {i: g for i, g in got.items() if want[i][1] > 1}
    assert all(want[i][0] == g for i, g in got.items())


def test_chain_roots_and_cycles(spark):
    chain = [("s", f"d{n}", f"d{n - 1}") for n in range(1, 40)]
    cycle = [("s", "x", "y"), ("s", "y", "z"), ("s", "z", "x"), ("s", "w", "x")]
    df = spark.createDataFrame(chain + cycle, "scope string, node string, parent string")
    roots, stuck = chain_roots(df, "scope")
    assert {(r["node"], r["root"]) for r in roots.collect()} == {(f"d{n}", "d0") for n in range(1, 40)}
    assert {r["node"] for r in stuck.collect()} == {"x", "y", "z", "w"}


def test_follow_up_inherits_until_a_new_subject(spark):
    base = {"multi_security": False, "unclear_security": False, "period_start": None, "period_end": None, "period_explicit": False, "prohibited": False,
            "unsupported": False, "has_content": False, "follow_up": False, "switch": False, "basis_day": "2024-02-15"}
    turns = [
        {"security_id": "KRX:1", "rule_intent": "recent_issue", "period_start": "2024-01-01", "period_end": "2024-01-31", "period_explicit": True},
        {"security_id": None, "rule_intent": "financial_term"},
        {"security_id": None, "rule_intent": "disclosure_summary"},
        {"security_id": None, "rule_intent": "out_of_scope", "follow_up": True},
        {"security_id": "KRX:2", "rule_intent": "out_of_scope", "switch": True},
        {"security_id": None, "rule_intent": "out_of_scope"},
        {"security_id": None, "rule_intent": "recent_issue", "prohibited": True},
    ]
    rows = [{**base, **turn, "session_id": "s", "turn": n, "request_id": n, "folded": "q"} for n, turn in enumerate(turns)]
    schema = (
        "session_id string, turn long, request_id long, folded string, security_id string, multi_security boolean, unclear_security boolean, rule_intent string, period_start string,"
        "period_end string, period_explicit boolean, prohibited boolean, unsupported boolean, has_content boolean, follow_up boolean, switch boolean, basis_day string"
    )
    df = spark.createDataFrame([tuple(row[name.strip().split()[0]] for name in schema.split(",")) for row in rows], schema)
    got = {r["turn"]: r for r in dialogue.follow_up_plans(df, rows_per_chunk=2).collect()}
    assert [got[n]["plan_intent"] for n in range(7)] == [
        "recent_issue", "financial_term", "disclosure_summary", "disclosure_summary", "disclosure_summary", "out_of_scope", "prohibited_advice",
    ]
    # The glossary turn keeps the period, which the next turn inherits and stores again.
    assert got[2]["plan_security"] == "KRX:1" and got[2]["plan_start"] == "2024-01-01"
    assert got[4]["plan_security"] == "KRX:2" and got[4]["plan_start"] == "2024-01-01"
    assert got[5]["plan_clarify"] == "true"


def test_session_gap_edges(spark):
    seconds = [0, 1799, 1799 + 1800, 1799 + 1800 + 1799]
    df = spark.createDataFrame([("c", n, START + dt.timedelta(seconds=s)) for n, s in enumerate(seconds)], "client string, request_id long, ts timestamp")
    got = {r["request_id"]: r["session_number"] for r in dialogue.session_gaps(df, "client", bucket_seconds=1000).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2}


def test_streams_agree_with_batches(spark, tmp_path):
    from lodestone.streaming import flows, state

    rng = random.Random(2)
    rows, at = [], START
    for n in range(300):
        at += dt.timedelta(seconds=rng.choice([1, 10, 45, 400]))
        rows.append((rng.choice(["a", "b"]), n, at))
    df = spark.createDataFrame(rows, "client string, request_id long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r["request_id"]: r["decision"] for r in flows.run_append(state.admission_stream(stream)).collect()}
    assert got == brute_admission(rows)
    repeats = flows.run_append(state.repeat_stream(stream.withColumnRenamed("client", "repeat_key")))
    batch = dialogue.suppress_repeats(df, ["client"])
    assert {(r["request_id"], r["served"]) for r in repeats.collect()} == {(r["request_id"], r["served"]) for r in batch.collect()}
    kept = flows.run_append(state.exchange_stream(stream.select(F.col("client").alias("session_id"), "request_id", "ts")))
    assert kept.where("size(split(kept, ',')) > 4").isEmpty()
