"""Names to securities: exact lookup, spans of a question, glossary terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions.text import ColumnLike, alternation, as_column, compose, fold, let, quote, word_array
from lodestone.operators.mentions import containing
from lodestone.operators.skew import hinted_join, is_small, spread_join

KINDS = ["security_id", "ticker", "name", "alias"]


def lookup_table(securities: DataFrame) -> DataFrame:
    """Folded lookup keys of each security with their kind; lower ``priority`` wins.

    ``securities``: security_id, ticker, security_name, aliases.
    """
    entries = F.concat(
        F.array(*[
            F.struct(F.col(column).alias("word"), F.lit(kind).alias("kind"), F.lit(place).alias("priority"))
            for place, (column, kind) in enumerate([("security_id", "security_id"), ("ticker", "ticker"), ("security_name", "name")])
        ]),
        F.transform("aliases", lambda word: F.struct(word.alias("word"), F.lit("alias").alias("kind"), F.lit(3).alias("priority"))),
    )
    rows = securities.select("security_id", F.explode(entries).alias("entry")).select("security_id", "entry.*")
    return rows.select(fold("word").alias("lookup_key"), "security_id", "kind", "priority").where(F.col("lookup_key") != "")


def best_match(lookup: DataFrame) -> DataFrame:
    """One row per key: the best security entry."""
    return lookup.groupBy("lookup_key").agg(F.min_by(F.struct("security_id", "kind"), F.struct("priority", "security_id")).alias("match"))


def resolve(queries: DataFrame, lookup: DataFrame, ambiguous: Sequence[str] = (), unsupported: Sequence[str] = (), text: str = "query") -> DataFrame:
    """JOI-03: status, security and kind of match for each query text.

    Priority is id, ticker, name, alias; then ambiguous terms, unsupported terms and foreign tickers.
    """
    folded_ambiguous, folded_unsupported = ([word.casefold() for word in words] for words in (ambiguous, unsupported))
    keyed = queries.withColumn("lookup_key", fold(text))
    # One row a key: nothing to repeat by salts. Adaptive execution splits a key that many texts ask for.
    best = best_match(lookup)
    found = keyed.join(F.broadcast(best) if is_small(lookup) else best.hint("merge"), "lookup_key", "left")
    key = F.col("lookup_key")
    status = (
        F.when(F.col("match").isNotNull(), F.lit("resolved"))
        .when(key.isin(folded_ambiguous) if folded_ambiguous else F.lit(False), F.lit("ambiguous"))
        .when((key.isin(folded_unsupported) if folded_unsupported else F.lit(False)) | key.rlike(fixed.FOREIGN_TICKER_FOLDED), F.lit("unsupported"))
        .otherwise(F.lit("not_found"))
    )
    return found.select(
        *queries.columns, status.alias("resolution_status"), F.col("match.security_id").alias("security_id"),
        F.coalesce("match.kind", F.when(status == "unsupported", F.lit("unsupported_rule")).otherwise(F.lit("none"))).alias("matched_by"),
    )


def strip_punctuation(text: Column) -> Column:
    marks = "".join(quote(ch) for ch in fixed.CANDIDATE_PUNCTUATION)
    return F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$", "")


def candidate_spans(question: ColumnLike, max_width: int = 4, hints: Sequence[str] | None = None) -> Column:
    """Spans of one to four words worth resolving: struct of text, start and end (0-based offsets)."""
    hints = word_array(fixed.CANDIDATE_ENGLISH_HINTS if hints is None else hints)
    particle = f"^(.+?)(?:{'|'.join(fixed.CANDIDATE_PARTICLES)})$"

    def clean(raw: Column) -> Column:
        bare = strip_punctuation(F.trim(raw))
        return strip_punctuation(F.trim(F.regexp_replace(bare, particle, "$1")))

    def every(words: Column, ends: Column) -> Column:
        def spans(width: Column) -> Column:
            starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda at: F.struct(
                clean(F.array_join(F.slice(words, at, width), " ")).alias("text"),
                (F.get(ends, at - 1) - F.length(F.get(words, at - 1))).alias("start"), width.alias("width"),
            ))

        return F.flatten(F.transform(F.array(*[F.lit(width) for width in range(max_width, 0, -1)]), spans))

    def ends_of(words: Column) -> Column:
        # Each word ends its own length after the blank behind the one before; the first entry is dropped.
        grown = F.aggregate(words, F.array(F.lit(-1)), lambda held, word: F.concat(held, F.array(F.element_at(held, F.lit(-1)) + F.length(word) + 1)))
        return F.slice(grown, F.lit(2), F.size(words))

    def worthwhile(span: Column) -> Column:
        text, parts = span["text"], F.split(span["text"], " ")
        hinted = F.exists(parts, lambda part: F.array_contains(hints, strip_punctuation(F.lower(part))))
        return (text != "") & (
            text.rlike(r"[0-9:]") | text.rlike("[가-힣]")
            | F.when(F.size(parts) > 1, hinted).otherwise(
                ~text.isin(fixed.CANDIDATE_TERM_MARKERS + fixed.CANDIDATE_DOMAIN_TOKENS)
                & (text.rlike(fixed.FOREIGN_TICKER_UPPER) | ((span["width"] > 1) & hinted))
            )
        )

    # Words and their ends are worked out once a question: an expression inside a lambda is evaluated anew for every span.
    found = let(F.split(as_column(question), " "), lambda words: let(ends_of(words), lambda ends: F.filter(every(words, ends), worthwhile)))
    return F.array_distinct(F.transform(found, lambda s: F.struct(
        s["text"].alias("text"), s["start"].alias("start"), (s["start"] + F.length(s["text"])).alias("end")
    )))


def extract_securities(
    questions: DataFrame, lookup: DataFrame, ambiguous: Sequence[str] = (), unsupported: Sequence[str] = (), hints: Sequence[str] | None = None,
) -> DataFrame:
    """JOI-04: the security a question names, or that it names several or something unclear.

    Spans are looked up by an equi-join; a span inside a resolved longer span does not count.
    """
    composed = questions.select("request_id", compose("question").alias("composed"))
    spans = composed.select("request_id", F.explode(candidate_spans("composed", hints=hints)).alias("span")).select("request_id", "span.*")
    found = resolve(spans, lookup, ambiguous, unsupported, text="text").where(F.col("resolution_status") != "not_found")
    span = F.struct("start", "end", "resolution_status", "security_id")
    # At most a few spans per question word.
    grouped = found.groupBy("request_id").agg(F.collect_set(span).alias("spans"))
    solved = F.filter("spans", lambda s: s["resolution_status"] == "resolved")
    outer = F.filter(F.col("spans"), lambda s: ~F.exists(solved, lambda r: (
        (r["start"] <= s["start"]) & (r["end"] >= s["end"]) & ((r["end"] - r["start"]) > (s["end"] - s["start"]))
    ) | ((s["resolution_status"] != "resolved") & (r["start"] <= s["start"]) & (r["end"] >= s["end"]))))
    kept = grouped.withColumn("kept", outer)
    ids = F.array_distinct(F.transform(F.filter("kept", lambda s: s["resolution_status"] == "resolved"), lambda s: s["security_id"]))
    issues = F.exists("kept", lambda s: s["resolution_status"] != "resolved")
    judged = kept.select("request_id", ids.alias("ids"), issues.alias("issues"))
    joined = questions.select("request_id").join(judged, "request_id", "left")
    several = F.coalesce(F.size("ids") > 1, F.lit(False))
    unclear = F.coalesce("issues", F.lit(False))
    return joined.select(
        "request_id", F.when(~several & ~unclear, F.try_element_at("ids", F.lit(1))).alias("security_id"),
        several.alias("multi_security"), (several | unclear).alias("unclear_security"),
    )


def glossary_lookup(queries: DataFrame, entries: DataFrame, text: str = "query") -> DataFrame:
    """JOI-24: exact lookup by folded canonical term or alias; the canonical term wins.

    ``entries``: entry_id, canonical_term, aliases.
    """
    keys = entries.select("entry_id", F.explode(F.concat(
        F.array(F.struct(F.col("canonical_term").alias("term"), F.lit("canonical").alias("kind"), F.lit(0).alias("priority"))),
        F.transform("aliases", lambda alias: F.struct(alias.alias("term"), F.lit("alias").alias("kind"), F.lit(1).alias("priority"))),
    )).alias("key")).select("entry_id", "key.*")
    table = keys.withColumn("lookup_key", fold("term")).groupBy("lookup_key").agg(
        F.min_by(F.struct("entry_id", "kind", "term"), F.struct("priority", "entry_id")).alias("hit")
    )
    joined = hinted_join(queries.withColumn("lookup_key", fold(text)), table, ["lookup_key"], is_small(entries), "left")
    return joined.select(
        *queries.columns, F.when(F.col("hit").isNull(), F.lit("not_found")).otherwise(F.lit("found")).alias("status"),
        F.col("hit.entry_id").alias("entry_id"), F.col("hit.kind").alias("matched_by"), F.col("hit.term").alias("matched_term"),
    )


def glossary_phrases(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """JOI-20: the one glossary entry a question speaks of, with the longest and then earliest of its terms.

    A term must not touch other letters or digits, except for one grammatical particle. Terms and
    distinct question texts meet by a join on character triples; borders are checked on the pairs
    that contain each other. A text that names two entries finds neither.
    """
    rows = entries.select("entry_id", F.explode(F.concat(F.array("canonical_term"), "aliases")).alias("written")).withColumn("term", fold("written"))
    letter, particles = r"[\p{L}\p{N}]", alternation(fixed.GLOSSARY_PARTICLES)
    literal = F.concat(F.lit(r"\Q"), F.replace("term", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(f"(?<!{letter})"), literal, F.lit(f"(?:(?:{particles})(?!{letter})|(?!{letter}))"))
    asked = questions.withColumn("__folded", fold("question"))
    found = containing(asked.select("__folded").distinct(), "__folded", rows.select("entry_id", "written", "term").distinct())
    placed = found.withColumn("position", F.regexp_instr(F.col("__folded"), pattern)).where("position > 0")
    hit = F.struct((-F.length("term")).alias("size"), F.col("position").alias("position"), F.col("written").alias("written"), F.col("entry_id").alias("entry_id"))
    best = placed.groupBy("__folded").agg(F.min("entry_id").alias("one"), F.max("entry_id").alias("other"), F.min(hit).alias("hit")).where("one = other")
    joined = spread_join(asked, best.select("__folded", "hit"), ["__folded"], "left")
    return joined.select(
        *questions.columns, F.col("hit.entry_id").alias("entry_id"), F.col("hit.written").alias("matched_term"),
        F.when(F.col("hit").isNotNull(), F.lit("found")).otherwise(F.lit("not_found")).alias("status"),
    )


def glossary_sections(entries: DataFrame, corpus_id: str) -> DataFrame:
    """PRJ-05: up to five section evidences per entry, with stable ids; empty sections are skipped."""
    sections = fixed.GLOSSARY_SECTIONS
    parts = F.array(*[
        F.struct(F.lit(place).alias("place"), F.lit(name).alias("section"), F.col(name).alias("snippet")) for place, name in enumerate(sections)
    ])
    rows = entries.select("entry_id", "version", "canonical_term", F.explode(parts).alias("part")).where(F.col("part.snippet").isNotNull())
    # The JSON list of mixed types is spelled out; its strings go through the JSON encoder.
    text = lambda value: F.to_json(F.array(value))
    inner = lambda value: F.substr(text(value), F.lit(2), F.length(text(value)) - 2)
    identity = F.concat(
        F.lit("["), inner(F.lit(corpus_id)), F.lit(","), inner(F.col("entry_id")), F.lit(","), F.col("version").cast("string"), F.lit(","), inner(F.col("part.section")), F.lit("]")
    )
    return rows.select(
        F.concat(F.lit("glossary:evidence:"), F.sha2(identity, 256)).alias("evidence_id"), "entry_id", F.col("part.section").alias("section"),
        F.col("canonical_term").alias("title"), F.col("part.snippet").alias("snippet"),
    )
