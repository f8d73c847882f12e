"""Topic links against a count over all pairs."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest

from lodestone.operators import events

GENERIC = ["the", "of"]
BASIS = ["official_list_metadata", "verified_body_fact"]


def tables(seed):
    chooser = random.Random(seed)
    # Term w0 is in nearly all backgrounds, later ones in fewer and fewer.
    words = [f"w{i}" for i in range(40)]
    pick = lambda most: [w for i, w in enumerate(words) if chooser.random() < most / (1 + i)] + [g for g in GENERIC if chooser.random() < 0.7]
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=chooser.randint(0, 40))
    back = [(f"s{i}", chooser.choice("AB"), pick(1.4), day(), chooser.choice(["p", "q"]), chooser.choice(BASIS)) for i in range(150)]
    focus = []
    for i in range(30):
        security, at = chooser.choice("AB"), day()
        focus += [(i, security, at, term) for term in pick(4)]
    return back, focus + focus[:5]


def expected(back, focus, kind, limit):
    asked = {}
    for key, security, at, term in focus:
        asked.setdefault((key, security, at), set()).add(term)
    out = set()
    for (key, security, at), terms in asked.items():
        hits = []
        for source, own, topics, published, publisher, basis in back:
            specific, shared = len((terms & set(topics)) - set(GENERIC)), len(terms & set(topics))
            if own == security and published <= at and specific:
                score = specific * 100 + (shared if kind == "report" else shared * 10 + (basis == BASIS[0]))
                hits.append((score, published, publisher if kind == "report" else "", source))
        hits.sort(key=lambda row: row[3])
        for part in (2, 1, 0):
            hits.sort(key=lambda row: row[part], reverse=True)
        out |= {(key, row[3], row[0], rank) for rank, row in enumerate(hits[:limit], 1)}
    return out


@pytest.mark.parametrize("kind,limit", [("report", 3), ("disclosure", 2)])
@pytest.mark.parametrize("probed", [0, 20, 10_000])
def test_best_links(spark, monkeypatch, kind, limit, probed):
    monkeypatch.setattr(events, "PROBED_POSTINGS", probed)
    back, focus = tables(probed)
    backgrounds = spark.createDataFrame(back, "source_id string, security_id string, topics array<string>, published_at timestamp, publisher string, link_basis string")
    asked = spark.createDataFrame(focus, "request_id int, security_id string, as_of timestamp, term string")
    got = {tuple(row) for row in events.topic_links(asked, backgrounds, kind, limit, GENERIC).collect()}
    assert got == expected(back, focus, kind, limit)
    every = {(row["request_id"], row["source_id"], row["score"]) for row in events.topic_links(asked, backgrounds, kind, None, GENERIC).collect()}
    assert every == {row[:3] for row in expected(back, focus, kind, 10**6)}


def test_no_focus_or_backgrounds(spark):
    back, focus = tables(1)
    backgrounds = spark.createDataFrame(back, "source_id string, security_id string, topics array<string>, published_at timestamp, publisher string, link_basis string")
    asked = spark.createDataFrame(focus, "request_id int, security_id string, as_of timestamp, term string")
    assert events.topic_links(asked.limit(0), backgrounds, "report", 3, GENERIC).count() == 0
    assert events.topic_links(asked, backgrounds.limit(0), "report", 3, GENERIC).count() == 0
    assert events.topic_links(asked.where("term IN ('the', 'of')"), backgrounds, "report", 3, GENERIC).count() == 0


def test_all_links_are_counted_where_their_backgrounds_lie(spark):
    back, focus = tables(2)
    # The same row twice, and another row of the same source.
    back += [back[0], (back[1][0], *back[1][1:3], back[1][3] - dt.timedelta(hours=1), *back[1][4:])]
    backgrounds = spark.createDataFrame(back, "source_id string, security_id string, topics array<string>, published_at timestamp, publisher string, link_basis string")
    asked = spark.createDataFrame(focus, "request_id int, security_id string, as_of timestamp, term string")
    links = events.topic_links(asked, backgrounds, "report", None, GENERIC, True)
    wanted = sorted(row[:3] for row in expected([row for n, row in enumerate(back) if n != len(back) - 2], focus, "report", 10**6))
    assert sorted({tuple(row) for row in links.collect()}) == sorted(set(wanted))
    plan = links._jdf.queryExecution().executedPlan().toString()
    # Backgrounds cross the network once, links never, and no link carries topics.
    assert len([keys for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan.split("== Initial Plan ==")[-1]) if "source_id" in keys]) == 1, plan
    assert "array_intersect" not in plan
    spread = events.topic_links(asked, backgrounds, "report", None, GENERIC, False)
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, links.collect()))


def test_backgrounds_keep_asked_topics_only(spark):
    back, focus = tables(3)
    back.append(back[0])
    backgrounds = spark.createDataFrame(back, "source_id string, security_id string, topics array<string>, published_at timestamp, publisher string, link_basis string")
    asked = spark.createDataFrame([row for row in focus if row[1] == "A" and row[0] % 5 == 0], "request_id int, security_id string, as_of timestamp, term string")
    named, latest = {row[3] for row in asked.collect()}, max(row[2] for row in asked.collect())
    want = {(row[0], tuple(sorted(named & set(row[2])))) for row in back if row[1] == "A" and row[3] <= latest and named & set(row[2])}
    got = events.shared_topics(asked, backgrounds, True)
    assert sorted((row["source_id"], tuple(sorted(row["topics"]))) for row in got.collect()) == sorted(want)
    assert sorted(map(tuple, events.shared_topics(asked, backgrounds, False).select("source_id", "__row").collect())) == sorted(map(tuple, got.select("source_id", "__row").collect()))
    for kind in ("report", "disclosure"):
        links = events.topic_links(asked, backgrounds, kind, 3, GENERIC, True, got)
        assert {tuple(row) for row in links.collect()} == expected(back[:-1], [tuple(row) for row in asked.collect()], kind, 3)
