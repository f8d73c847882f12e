"""News events: pair rule, greedy grouping, event summaries and links."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import hashing
from lodestone.functions.text import ColumnLike, as_column, title_terms, word_array
from lodestone.operators.market import asof_join
from lodestone.operators.mentions import containing
from lodestone.operators.scan import ordered_scan, text_result
from lodestone.operators.skew import hinted_join, is_small, keep_first, top_rows
from lodestone.session import cut_lineage


def same_event(
    left_terms: ColumnLike, right_terms: ColumnLike, seconds_apart: ColumnLike, phrases: Mapping[str, str] | None = None,
    distinctive: Sequence[str] | None = None, max_gap: int = fixed.EVENT_GAP_SECONDS,
) -> Column:
    """CMP-14: close in time and sharing two distinctive terms, or one with three terms and two phrases in all."""
    marks = word_array(fixed.EVENT_DISTINCTIVE if distinctive is None else distinctive)
    names = word_array(sorted(set((fixed.EVENT_PHRASES if phrases is None else phrases).values())))
    shared = F.array_intersect(as_column(left_terms), as_column(right_terms))
    strong, named = F.size(F.array_intersect(shared, marks)), F.size(F.array_intersect(shared, names))
    return (F.abs(as_column(seconds_apart)) <= max_gap) & ((strong >= 2) | ((strong == 1) & (F.size(shared) >= 3) & (named >= 2)))


def greedy_groups(
    titles: DataFrame, phrases: Mapping[str, str] | None = None, stop_words: Sequence[str] | None = None,
    distinctive: Sequence[str] | None = None, max_gap: int = fixed.EVENT_GAP_SECONDS, rows_per_chunk: int = 100_000,
) -> DataFrame:
    """CMP-15: put each title into the first open group whose every member is the same event.

    ``titles``: security_id, news_id, title, published_at, publisher_host. A group closes 36 hours
    after its first member, and members with equal terms count once, so the carried state is small.
    A title that is not the same event as a copy of itself can never share a group and is left out
    before the walk; it would end as a group of one.
    """
    phrases = dict(fixed.EVENT_PHRASES if phrases is None else phrases)
    distinctive = list(fixed.EVENT_DISTINCTIVE if distinctive is None else distinctive)
    marks, names = frozenset(distinctive), frozenset(phrases.values())
    # Kept, so that the condition below does not work the terms out again for each time it names them.
    termed = cut_lineage(titles.withColumn("terms", title_terms("title", phrases, stop_words)))
    able = termed.where(same_event("terms", "terms", F.lit(0), phrases, distinctive, max_gap)).withColumn(
        "at", F.unix_micros("published_at")
    )
    gap = max_gap * 1_000_000

    def step(run: pd.DataFrame, state: Any) -> tuple[list[dict[str, Any]], Any]:
        groups = OpenGroups(marks, names, state)
        found = []
        for news_id, at, terms in zip(run["news_id"], run["at"], run["terms"], strict=True):
            groups.close_before(int(at) - gap)
            found.append({"group_id": groups.put(news_id, int(at), frozenset(terms))})
        return found, groups.state()

    return ordered_scan(able, "security_id", ["at", "news_id"], step, text_result("group_id"), rows_per_chunk, ["terms"]).drop("at")


class OpenGroups:
    """The open groups of one security: finds the first whose every member matches a title without looking at all members.

    Whether two titles match depends on their marks and names (their kind), except where they share one
    mark and one other name, both names: then some third term must be shared. So a group holds the kinds
    of its members, and the other terms only of kinds that can come to need them. Groups of the same kinds
    stand in one list, whose first is the one to take where no terms are needed; where they are, the
    groups are found by the terms of the title.
    """

    def __init__(self, marks: frozenset[str], names: frozenset[str], state: list[dict[str, Any]] | None) -> None:
        self.marks, self.names, self.keys = marks, names, marks | names
        self.related: dict[tuple[frozenset[str], frozenset[str]], int] = {}
        self.verdicts: dict[tuple[frozenset[str], frozenset[frozenset[str]]], int] = {}
        self.groups: dict[int, tuple[str, int, dict[frozenset[str], tuple[set[frozenset[str]], dict[str, int]]]]] = {}
        self.alike: dict[frozenset[frozenset[str]], list[int]] = {}
        self.holding: dict[str, set[int]] = {}
        self.opened = 0
        for group in state or []:
            number = self._open(group["id"], group["at"])
            for kind, others in group["members"]:
                for other in others:
                    self._add(number, frozenset(kind), frozenset(other))

    def relation(self, left: frozenset[str], right: frozenset[str]) -> int:
        """0: titles of these kinds never match, 1: if they share another term, 2: always."""
        if (left, right) not in self.related:
            shared = left & right
            strong, named = len(shared & self.marks), len(shared & self.names)
            loose = strong == 1 and named >= 2
            self.related[left, right] = 2 if strong >= 2 or (loose and len(shared) >= 3) else int(loose)
        return self.related[left, right]

    def _open(self, name: str, at: int) -> int:
        number, self.opened = self.opened, self.opened + 1
        self.groups[number] = (name, at, {})
        self.alike.setdefault(frozenset(), []).append(number)
        return number

    def _move(self, number: int, old: frozenset[frozenset[str]], new: frozenset[frozenset[str]] | None) -> None:
        numbers = self.alike[old]
        del numbers[bisect_left(numbers, number)]
        if not numbers:
            del self.alike[old]
        if new is not None:
            insort(self.alike.setdefault(new, []), number)

    def _add(self, number: int, kind: frozenset[str], others: frozenset[str]) -> None:
        members = self.groups[number][2]
        if kind not in members:
            old = frozenset(members)
            members[kind] = (set(), {})
            self._move(number, old, old | {kind})
        # The terms of a kind without a mark that is a name and a name that is no mark are never asked for.
        if not (kind & self.marks & self.names and kind & (self.names - self.marks)):
            others = frozenset()
        sets, counts = members[kind]
        if others not in sets:
            sets.add(others)
            for term in others:
                counts[term] = counts.get(term, 0) + 1
                self.holding.setdefault(term, set()).add(number)

    def close_before(self, earliest: int) -> None:
        while self.groups and self.groups[number := next(iter(self.groups))][1] < earliest:
            members = self.groups.pop(number)[2]
            self._move(number, frozenset(members), None)
            for _, counts in members.values():
                for term in counts:
                    if number in self.holding.get(term, ()):
                        self.holding[term].discard(number)
                        if not self.holding[term]:
                            del self.holding[term]

    def _shares(self, number: int, kind: frozenset[str], others: frozenset[str]) -> bool:
        for member, (sets, counts) in self.groups[number][2].items():
            if self.relation(kind, member) == 1:
                found = [n for term in others if (n := counts.get(term))]
                if sum(found) < len(sets) or (max(found) < len(sets) and any(others.isdisjoint(held) for held in sets)):
                    return False
        return True

    def put(self, news_id: str, at: int, terms: frozenset[str]) -> str:
        """The group that the title joins, or opens."""
        kind, others = terms & self.keys, terms - self.keys
        home, asks = None, set()
        for kinds, numbers in self.alike.items():
            if (verdict := self.verdicts.get((kind, kinds))) is None:
                verdict = self.verdicts[kind, kinds] = min((self.relation(kind, member) for member in kinds), default=0)
            if verdict == 2 and (home is None or numbers[0] < home):
                home = numbers[0]
            elif verdict == 1:
                asks.add(kinds)
        if asks:
            near = {number for term in others for number in self.holding.get(term, ()) if home is None or number < home}
            home = next((n for n in sorted(near) if frozenset(self.groups[n][2]) in asks and self._shares(n, kind, others)), home)
        if home is None:
            home = self._open(news_id, at)
        self._add(home, kind, others)
        return self.groups[home][0]

    def state(self) -> list[dict[str, Any]]:
        return [
            {"id": name, "at": at, "members": sorted([sorted(kind), sorted(sorted(one) for one in sets)] for kind, (sets, _) in members.items())}
            for name, at, members in self.groups.values()
        ]


def title_label(members: DataFrame) -> DataFrame:
    """AGG-16: first and last time, size, publishers and shortest title per group."""
    return members.groupBy("security_id", "group_id").agg(
        F.min("published_at").alias("first_published_at"), F.max("published_at").alias("last_published_at"),
        F.count(F.lit(1)).alias("articles"), F.countDistinct("publisher_host").alias("publishers"),
        F.min_by("title", F.struct(F.length("title"), "published_at", "news_id")).alias("event_label"),
    )


def group_terms(members: DataFrame, distinctive: Sequence[str] | None = None, limit: int = fixed.CLUSTER_TERM_LIMIT) -> DataFrame:
    """AGG-15: terms of at least two titles of a group: distinctive, frequent and long ones first."""
    marks = fixed.EVENT_DISTINCTIVE if distinctive is None else distinctive
    counts = members.select("security_id", "group_id", F.explode("terms").alias("term")).groupBy(
        "security_id", "group_id", "term"
    ).agg(F.count(F.lit(1)).alias("titles")).where(F.col("titles") >= 2)
    strong = F.col("term").isin(list(marks))
    order = [strong.desc(), F.col("titles").desc(), F.length("term").desc(), F.col("term").desc()]
    return top_rows(counts, ["security_id", "group_id"], order, limit, "term_rank")


def cluster_events(titles: DataFrame, min_articles: int = 2, min_hosts: int = 2, **lexicon: Any) -> tuple[DataFrame, DataFrame]:
    """CMP-15 with its summaries: event clusters and their members."""
    members = greedy_groups(titles, **lexicon)
    groups = title_label(members).where((F.col("articles") >= min_articles) & (F.col("publishers") >= min_hosts))
    terms = group_terms(members, lexicon.get("distinctive"))
    listed = terms.groupBy("security_id", "group_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("term_rank", "term"))), lambda t: t["term"]).alias("event_terms")
    )
    clusters = groups.join(listed, ["security_id", "group_id"]).withColumn("event_id", hashing.stable_id("event", "security_id", "group_id"))
    return clusters, members.join(clusters.select("security_id", "group_id", "event_id"), ["security_id", "group_id"])


def select_events(requests: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """JOI-16: the event each request is about: most shared terms, then the latest article at its cutoff.

    ``requests``: request_id, security_id, as_of, query_terms (array), has_marker. Requests that name
    terms of other securities' events only, or neither a term nor an event marker, get none.

    A request meets only events it shares a term with; one that names no term takes the event of the
    latest article before its cutoff by an as-of join. Requests are never paired with all articles.
    """
    asked = requests.select("request_id", "security_id", "as_of", "has_marker", F.explode_outer(F.array_distinct("query_terms")).alias("term"))
    vocabulary = clusters.select("security_id", "event_id", F.explode("event_terms").alias("term"))
    anywhere = vocabulary.select("term").distinct().withColumn("__known", F.lit(True))
    own = vocabulary.select("security_id", "term").distinct().withColumn("__own", F.lit(True))
    judged = asked.join(anywhere, "term", "left").join(own, ["security_id", "term"], "left").groupBy(
        "request_id", "security_id", "as_of", "has_marker"
    ).agg(F.coalesce(F.bool_or("__known"), F.lit(False)).alias("known"), F.coalesce(F.bool_or("__own"), F.lit(False)).alias("own"))
    active = judged.where((F.col("own") | ~F.col("known")) & (F.col("own") | F.col("has_marker")))
    keys = ["request_id", "security_id", "as_of"]

    overlap = asked.join(vocabulary, ["security_id", "term"]).groupBy(*keys, "event_id").agg(F.countDistinct("term").alias("overlap"))
    by_term = overlap.join(active.where("own").select("request_id"), "request_id", "left_semi")
    # The second and later articles of an event are those that make it eligible.
    order = F.struct("published_at", "news_id")
    first = members.groupBy("event_id").agg(F.min(order).alias("first")).select("event_id", "first.*")
    later = members.select("security_id", "event_id", "published_at", "news_id").join(first, ["event_id", "published_at", "news_id"], "left_anti")
    arrivals = later.groupBy("security_id", "published_at").agg(F.min("event_id").alias("event_id"))
    latest = asof_join(active.where("NOT own").select(*keys), arrivals, ["security_id"], "as_of", "published_at", ["event_id"], 86_400)
    by_time = latest.where(F.col("event_id").isNotNull()).select(*keys, "event_id").withColumn("overlap", F.lit(0).cast("bigint"))

    pairs = by_term.unionByName(by_time)
    # Articles up to each time of an event, looked up at the cutoffs: as many rows out as pairs in.
    counted = members.groupBy("event_id", "published_at").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("event_id").orderBy("published_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counted.select("event_id", "published_at", F.sum("n").over(upto).alias("eligible"), F.col("published_at").alias("latest"))
    at_cutoff = asof_join(pairs, running, ["event_id"], "as_of", "published_at", ["eligible", "latest"], 86_400)
    scored = at_cutoff.where(F.col("eligible") >= 2)
    best = keep_first(scored, ["request_id"], [F.col("overlap").desc(), F.col("latest").desc(), F.col("event_id")])
    return best.select("request_id", "security_id", "as_of", "event_id", "eligible", "overlap", "latest")


PROBED_POSTINGS = 64


def _link_weights(kind: str) -> tuple[int, Column]:
    """What a shared term of any sort scores beside the 100 of a specific one, and what the background itself adds."""
    return (1, F.lit(0)) if kind == "report" else (10, (F.col("link_basis") == "official_list_metadata").cast("int"))


def _all_links(focus: DataFrame, backgrounds: DataFrame, kind: str, generic: Sequence[str], small: bool) -> DataFrame:
    """JOI-15: every background that shares a specific term with a request, and the score.

    Backgrounds of asked securities cross the network once; their shared terms are found, counted and
    summed up in the task that holds them, so neither pairs nor topics are shuffled for each link.
    """
    weight, basis = _link_weights(kind)
    terms = focus.select("request_id", "security_id", "as_of", "term", (~F.col("term").isin(generic)).cast("int").alias("__specific")).distinct()
    latest = terms.groupBy("security_id").agg(F.max("as_of").alias("__latest"))
    held = hinted_join(backgrounds, latest, ["security_id"], small).where(F.col("published_at") <= F.col("__latest")).select(
        "security_id", "source_id", "published_at", basis.alias("__basis"), F.xxhash64("published_at", "publisher", "link_basis").alias("__key"), F.array_distinct("topics").alias("topics")
    )
    if small:
        held = held.repartition("source_id")
    # Rows of one source are told apart by number; equal links of them become one below.
    held = held.withColumn("__copy", F.monotonically_increasing_id())
    shared = hinted_join(held.withColumn("term", F.explode("topics")).drop("topics"), terms, ["security_id", "term"], small).where(F.col("published_at") <= F.col("as_of"))
    counted = shared.groupBy("source_id", "__copy", "__key", "request_id", "as_of").agg(
        F.sum("__specific").alias("__specific"), F.count(F.lit(1)).alias("__all"), F.max("__basis").alias("__basis")
    )
    score = F.col("__specific") * 100 + F.col("__all") * weight + F.col("__basis")
    return counted.where(F.col("__specific") > 0).select("request_id", "source_id", "__key", score.alias("score")).distinct().drop("__key")


LINK_ROW = ["source_id", "published_at", "publisher", "link_basis"]


def shared_topics(focus: DataFrame, backgrounds: DataFrame, small: bool) -> DataFrame:
    """Backgrounds of asked securities with those topics alone that a request of their security names; the texts are read once."""
    latest = focus.groupBy("security_id").agg(F.max("as_of").alias("__latest"))
    asked = hinted_join(backgrounds, latest, ["security_id"], small).where(F.col("published_at") <= F.col("__latest"))
    held = asked.select("security_id", *LINK_ROW, F.xxhash64("security_id", *LINK_ROW, "topics").alias("__row"), F.explode("topics").alias("term"))
    met = hinted_join(held, focus.select("security_id", "term").distinct(), ["security_id", "term"], small, "left_semi")
    return cut_lineage(met.groupBy("security_id", *LINK_ROW, "__row").agg(F.collect_set("term").alias("topics")))


def topic_links(
    focus: DataFrame, backgrounds: DataFrame, kind: str, limit: int | None, generic: Sequence[str] | None = None, small: bool | None = None,
    held: DataFrame | None = None,
) -> DataFrame:
    """JOI-15 / TOP-03 / TOP-04: best backgrounds per request by shared topics.

    ``focus``: request_id, security_id, as_of, term (one row each). ``backgrounds``: source_id, security_id,
    topics, published_at, publisher, link_basis. ``kind`` is ``report`` or ``disclosure``. Without a ``limit`` every link comes, unranked.

    Only specific terms are joined on, rarest first. With a ``limit``, the backgrounds of each request's
    rarest terms are scored first, which gives a score that its last place has at least. A background
    that reaches it shares so many specific terms that one of them is among all but the most frequent
    few; the lists of those few are never read. Scores are counted on the asked topics of what is left
    (``held``: the ``shared_topics`` of both tables, where they are known).
    Without one, every shared term is a row that is counted where its background lies (``_all_links``).
    """
    generic = list(fixed.GENERIC_LINK_TOPICS if generic is None else generic)
    small = is_small(focus) if small is None else small
    if limit is None:
        return _all_links(focus, backgrounds, kind, generic, small)
    asked = focus.distinct().groupBy("request_id", "security_id", "as_of").agg(F.collect_set("term").alias("terms"))
    asked = cut_lineage(asked.withColumn("specific", F.filter("terms", lambda term: ~term.isin(generic))))
    held = shared_topics(focus, backgrounds, small) if held is None else held
    wanted = asked.select("request_id", "security_id", "as_of", F.explode("specific").alias("term"))
    postings = held.select("security_id", "published_at", "__row", "source_id", F.explode("topics").alias("term"))

    weight, basis = _link_weights(kind)
    order = [F.col("score").desc(), F.col("published_at").desc(), *([F.col("publisher").desc()] if kind == "report" else []), F.col("source_id")]

    def scored(terms: DataFrame) -> DataFrame:
        """Backgrounds that share one of ``terms`` (request_id, security_id, as_of, term), with their scores over all topics."""
        met = hinted_join(postings, terms, ["security_id", "term"], small).where(F.col("published_at") <= F.col("as_of"))
        pairs = met.select("request_id", "source_id", "__row").distinct()
        # A background of many requests makes its pairs the hot side, one row of topics the other: skewed parts are split.
        full = pairs.join(held, ["source_id", "__row"])
        judged = hinted_join(full, asked.select("request_id", "terms", "specific"), ["request_id"], small)
        count = lambda name: F.size(F.array_intersect("topics", name)).cast("bigint")
        score = count("specific") * 100 + count("terms") * weight + basis
        return judged.select("request_id", *LINK_ROW, score.alias("score")).distinct()

    lists = postings.groupBy("security_id", "term").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("request_id").orderBy("df", "term")  # the terms of one question
    ordered = hinted_join(wanted, lists, ["security_id", "term"], small).withColumns({
        "place": F.row_number().over(rarest), "before": F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    ordered = cut_lineage(ordered)
    columns = ["request_id", "security_id", "as_of", "term"]
    probed = scored(ordered.where(F.col("before") < PROBED_POSTINGS).select(*columns))
    last = top_rows(probed, ["request_id"], order, limit, "__place").where(F.col("__place") == limit).select("request_id", F.col("score").alias("__least"))
    sizes = ordered.groupBy("request_id").agg(F.count(F.lit(1)).alias("__specific"))
    spare = asked.select("request_id", (F.size("terms") - F.size("specific")).alias("__generic"))
    # The most that m shared specific terms can score: m x 100 + (m + generic terms) x weight + 1.
    needed = F.greatest(F.lit(1), F.ceil((F.col("__least") - 1 - F.col("__generic") * weight) / (100 + weight)))
    reach = sizes.join(spare, "request_id").join(last, "request_id", "left").select("request_id", (F.col("__specific") - F.coalesce(needed, F.lit(1)) + 1).alias("__reach"))
    left = hinted_join(ordered, reach, ["request_id"], small).where(F.col("place") <= F.col("__reach"))
    return top_rows(scored(left.select(*columns)), ["request_id"], order, limit, "link_rank").select("request_id", "source_id", "score", "link_rank")


def with_no_link(requests: DataFrame, links: DataFrame) -> DataFrame:
    """TOP-04: links, plus one ``no_link`` row for each request without any."""
    linked = links.withColumn("role", F.lit("official_background"))
    bare = requests.select("request_id").join(links.select("request_id").distinct(), "request_id", "left_anti")
    return linked.unionByName(bare.withColumn("role", F.lit("no_link")), allowMissingColumns=True)


def shown_articles(articles: DataFrame, limit: int = fixed.COMPARISON_ARTICLES_SHOWN) -> tuple[DataFrame, DataFrame]:
    """TOP-05: the articles displayed per request, and the total."""
    shown = top_rows(articles, ["request_id"], [F.col("published_at"), F.col("news_id")], limit, "article_rank")
    totals = articles.groupBy("request_id").agg(F.count(F.lit(1)).alias("article_total"))
    return shown, totals.withColumn("article_displayed", F.least("article_total", F.lit(limit).cast("bigint")))


def eligible_claims(selected: DataFrame, claims: DataFrame, members: DataFrame) -> DataFrame:
    """CMP-16: claims of the selected event whose sources are all visible at the cutoff."""
    rows = selected.join(claims, "event_id").select(
        "request_id", "as_of", "event_id", "claim_id", F.size(F.array_distinct("source_ids")).alias("wanted"), F.explode(F.array_distinct("source_ids")).alias("news_id")
    )
    times_ = members.select("event_id", "news_id", "published_at")
    visible = rows.join(times_, ["event_id", "news_id"]).where(F.col("published_at") <= F.col("as_of"))
    return visible.groupBy("request_id", "event_id", "claim_id", "wanted").agg(F.countDistinct("news_id").alias("visible")).where(
        F.col("visible") == F.col("wanted")
    ).select("request_id", "event_id", "claim_id")


def compare_evidence(
    requests: DataFrame, clusters: DataFrame, members: DataFrame, perspectives: DataFrame, backgrounds: DataFrame,
    claims: DataFrame | None = None, generic: Sequence[str] | None = None,
) -> DataFrame:
    """CMP-16: one comparison per request with an event: article counts, links, claims and status."""
    # Titles and terms are worked out once, whatever reads them below.
    clusters = cut_lineage(clusters.select("event_id", "security_id", "event_terms"))
    members = cut_lineage(members.select("event_id", "security_id", "news_id", "published_at"))
    # One row per request: kept, because every part below starts from it.
    selected = cut_lineage(select_events(requests, clusters, members))
    event_terms = selected.join(clusters.select("event_id", "event_terms"), "event_id").select(
        "request_id", "security_id", "as_of", F.explode("event_terms").alias("term")
    )
    asked = selected.select("request_id").join(requests, "request_id").select(
        "request_id", "security_id", "as_of", F.explode("query_terms").alias("term")
    )
    # The focus is worked out once; one table of both kinds is read once.
    focus = cut_lineage(event_terms.unionByName(asked).distinct())
    small = is_small(focus)
    held = shared_topics(focus, perspectives, small)
    reports = topic_links(focus, perspectives, "report", fixed.PERSPECTIVE_LIMIT, generic, small, held)
    filings = topic_links(focus, backgrounds, "disclosure", fixed.DISCLOSURE_LINK_LIMIT, generic, small, held if backgrounds is perspectives else None)
    counts = [
        reports.groupBy("request_id").agg(F.count(F.lit(1)).alias("perspectives")),
        filings.groupBy("request_id").agg(F.count(F.lit(1)).alias("disclosure_links")),
    ]
    if claims is not None:
        counts.append(eligible_claims(selected, claims, members).groupBy("request_id").agg(F.count(F.lit(1)).alias("claims")))
    result = selected
    for part in counts:
        result = result.join(part, "request_id", "left")
    zero = F.lit(0).cast("bigint")
    names = ["perspectives", "disclosure_links"] + (["claims"] if claims is not None else [])
    linked = (F.coalesce("perspectives", zero) + F.coalesce("disclosure_links", zero)) > 0
    return result.select(
        "request_id", "event_id", F.col("eligible").alias("article_total"),
        F.least("eligible", F.lit(fixed.COMPARISON_ARTICLES_SHOWN).cast("bigint")).alias("article_displayed"),
        *[F.coalesce(name, zero).alias(name) for name in names],
        F.when(linked, F.lit("background_linked")).otherwise(F.lit("coverage_only")).alias("comparison_status"),
    )


def comparison_rows(claims: DataFrame, articles: DataFrame, limit: int = fixed.COVERAGE_ARTICLE_LIMIT) -> DataFrame:
    """PRJ-06: one evidence row per (claim, source); the first articles of events without any claim row.

    ``claims``: event_id, claim_kind, claim_index, text, source_ids. ``articles``: event_id, news_id, title, source_url, published_at.
    """
    sources = articles.where(F.col("source_url").isNotNull())
    pairs = claims.select("event_id", "claim_kind", "claim_index", "text", F.explode("source_ids").alias("news_id"))
    by_claim = pairs.join(sources, ["event_id", "news_id"]).select(
        "event_id", "news_id", "claim_kind",
        F.substring(F.sha2(F.concat_ws(":", "event_id", "claim_kind", F.col("claim_index").cast("string"), "news_id"), 256), 1, 24).alias("digest"),
        F.col("text").alias("snippet"),
    )
    # The first articles are chosen before those without a URL drop out.
    head = top_rows(articles, ["event_id"], [F.col("published_at"), F.col("news_id")], limit).where(F.col("source_url").isNotNull())
    plain = head.join(by_claim.select("event_id").distinct(), "event_id", "left_anti").select(
        "event_id", "news_id", F.lit("coverage").alias("claim_kind"),
        F.substring(F.sha2(F.concat_ws(":", "event_id", "news_id"), 256), 1, 24).alias("digest"), F.col("title").alias("snippet"),
    )
    return by_claim.unionByName(plain).withColumn("evidence_id", F.concat(F.lit("comparison:"), "digest")).drop("digest")


def first_facts(facts: DataFrame, topics: Column) -> DataFrame:
    """WIN-14: first verified fact with topics per (document, category), then only those with page and section."""
    usable = facts.withColumn("topics", topics).where((F.size("topics") > 0) & (F.col("verification_status") == fixed.FACT_VERIFIED))
    first = keep_first(usable, ["document_id", "category"], [F.col("fact_index")])
    return first.where(F.col("page").isNotNull() & F.col("section_path").isNotNull())


def assign_by_title(perspectives: DataFrame, reports: DataFrame) -> DataFrame:
    """JOI-23: each needle must occur in one report title, each report be hit once; returns every row with its problem.

    Titles and needles meet by the join on character triples of ``mentions.containing``.
    """
    needles = perspectives.select("needle").distinct().withColumn("term", F.lower("needle"))
    hits = containing(reports.select("report_id", F.lower("title").alias("__title")), "__title", needles).select("report_id", "needle")
    per_report = reports.select("report_id").join(hits, "report_id", "left")
    per_needle = per_report.groupBy("needle").agg(F.count(F.lit(1)).alias("reports"))
    hit_counts = per_report.groupBy("report_id").agg(F.count("needle").alias("needles"))
    judged = per_report.join(hit_counts, "report_id").join(per_needle, "needle", "left")
    problem = (
        F.when(F.col("needle").isNull(), F.lit("uncovered_report")).when(F.col("reports") > 1, F.lit("ambiguous_needle"))
        .when(F.col("needles") > 1, F.lit("repeated_report"))
    )
    return judged.select("report_id", "needle", problem.alias("problem"))


def cluster_problems(clusters: DataFrame, claims: DataFrame, members: DataFrame) -> DataFrame:
    """VAL-09: events out of time order or with one publisher, and claims with foreign or too few sources."""
    bad_events = clusters.select("event_id", F.lit(None).cast("string").alias("claim_id"), (
        F.when(F.col("first_published_at") > F.col("last_published_at"), F.lit("time_order"))
        .when(F.col("publishers") < 2, F.lit("one_publisher"))
    ).alias("problem")).where(F.col("problem").isNotNull())
    known = members.select("event_id", "news_id", F.lit(1).alias("known"))
    rows = claims.select("event_id", "claim_id", "claim_kind", F.size("source_ids").alias("n"), F.explode("source_ids").alias("news_id"))
    judged = rows.join(known, ["event_id", "news_id"], "left").groupBy("event_id", "claim_id", "claim_kind", "n").agg(
        F.count("known").alias("found"), F.count(F.lit(1)).alias("asked")
    )
    bad_claims = judged.select("event_id", "claim_id", (
        F.when(F.col("found") < F.col("asked"), F.lit("foreign_source"))
        .when((F.col("claim_kind") == "common") & (F.col("n") < 2), F.lit("too_few_sources"))
    ).alias("problem")).where(F.col("problem").isNotNull())
    return bad_events.unionByName(bad_claims)
