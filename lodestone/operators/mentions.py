"""Which securities a text mentions, by substring aliases.

A dictionary within a checked number of terms becomes one automaton, built once a task, that reads
each text once where it lies: no text is shuffled and none is read again for another alias. A larger
dictionary is joined on the first characters of its terms, with ids and character triples only.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, IntegerType

from lodestone.functions.text import ColumnLike, as_column, clean_entities_first, fold
from lodestone.operators.skew import salted_join, spread_join, within_rows

GRAM = 3
# Terms of one automaton; more are joined.
DICTIONARY_TERMS = 200_000

Aliases = DataFrame | Mapping[str, Sequence[str]]


def match_text(text: ColumnLike) -> Column:
    """Text as aliases are compared with it: cleaned and folded."""
    return fold(clean_entities_first(text))


def automaton_of(terms: Sequence[str]):
    """One automaton over ``terms``; a match gives the places of all equal terms."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for place, term in enumerate(terms):
        automaton.add_word(term, (*automaton.get(term, ()), place))
    automaton.make_automaton()
    return automaton


def term_places(folded: ColumnLike, terms: Sequence[str]) -> Column:
    """Places in ``terms`` of all terms that the text contains, in ascending order; null and empty texts contain none."""

    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = automaton_of(terms)
        for batch in batches:
            yield pd.Series([sorted({place for _, found in automaton.iter(text) for place in found}) if text else [] for text in batch], index=batch.index, dtype=object)

    return F.pandas_udf(places, "array<int>")(as_column(folded)) if terms else F.array().cast("array<int>")


def containing(texts: DataFrame, folded: str, terms: DataFrame, keep_text: bool = True) -> DataFrame:
    """Rows of ``texts`` beside each row of ``terms`` whose ``term`` their column ``folded`` contains; empty terms are in none.

    Without ``keep_text`` the result has no column ``folded``.
    """
    sound = terms.where(F.length("term") > 0)
    kept = [name for name in texts.columns if keep_text or name != folded]
    if not within_rows(sound, DICTIONARY_TERMS):
        return containing_by_triples(texts, folded, sound).select(*kept, *terms.columns)
    rows = sound.collect()  # at most ``DICTIONARY_TERMS``
    fields = StructType([*terms.schema.fields, StructField("__place", IntegerType())])
    numbered = texts.sparkSession.createDataFrame([(*row, place) for place, row in enumerate(rows)], fields)
    found = texts.select(*kept, F.explode(term_places(folded, [row["term"] for row in rows])).alias("__place"))
    return found.join(F.broadcast(numbered), "__place").drop("__place")


def containing_by_triples(texts: DataFrame, folded: str, terms: DataFrame) -> DataFrame:
    """``containing`` for a dictionary of any size, as a join.

    Texts and terms meet on the first three characters of a term, which a text offers as its distinct
    character triples. Texts are named by a hash on the way: no text is in a row with a triple. Each
    text then meets its likely terms once and is checked in full, so equal hashes do no harm.
    """
    keyed = terms.withColumn("__gram", F.substring("term", 1, GRAM))
    sizes = F.array(*[F.lit(size) for size in range(1, GRAM + 1)])
    grams = F.array_distinct(F.flatten(F.transform(sizes, lambda size: F.transform(
        F.sequence(F.lit(1), F.length(folded)), lambda at: F.substr(F.col(folded), at, size)
    ))))
    named = texts.where(F.length(folded) > 0).withColumn("__text", F.xxhash64(folded))
    offered = named.select("__text", F.explode(grams).alias("__gram")).distinct()
    begun = spread_join(offered, keyed.select("__gram").distinct(), ["__gram"], "left_semi")
    likely = salted_join(begun, keyed, ["__gram"]).drop("__gram")
    # Many rows of one text are the hot side; its likely terms are few.
    return salted_join(named, likely, ["__text"]).where(F.contains(F.col(folded), F.col("term"))).drop("__text")


def alias_table(aliases: Aliases) -> list[tuple[str, str]] | None:
    """(security, term) pairs on the driver, if they are at most ``DICTIONARY_TERMS``; else None."""
    if isinstance(aliases, DataFrame):
        terms = aliases.where(F.length("term") > 0).select("security_id", "term").distinct()
        return sorted(tuple(row) for row in terms.collect()) if within_rows(terms, DICTIONARY_TERMS) else None
    return sorted({(security, term) for security, terms in aliases.items() for term in terms if term})


def mentioned(folded: ColumnLike, pairs: Sequence[tuple[str, str]]) -> Column:
    """Distinct securities, in ascending order, of which the text contains a term. The dictionary travels with the function, not in the plan."""

    def securities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = automaton_of([term for _, term in pairs])
        for batch in batches:
            yield pd.Series([sorted({pairs[place][0] for _, found in automaton.iter(text) for place in found}) if text else [] for text in batch], index=batch.index, dtype=object)

    return F.pandas_udf(securities, "array<string>")(as_column(folded)) if pairs else F.array().cast("array<string>")


def find_mentions(texts: DataFrame, row_id: str, folded: str, aliases: Aliases) -> DataFrame:
    """JOI-05: distinct (row, security) pairs. ``aliases`` is a table of ``security_id`` and folded ``term``, or a mapping of securities to terms."""
    pairs = alias_table(aliases)
    if pairs is None:
        terms = aliases.select("security_id", "term").distinct()
        return containing(texts.select(row_id, folded), folded, terms, keep_text=False).select(row_id, "security_id").distinct()
    return texts.select(row_id, F.explode(mentioned(folded, pairs)).alias("security_id")).distinct()


def attribute(items: DataFrame, row_id: str, aliases: Aliases) -> DataFrame:
    """JOI-06: primary and mentioned securities of a feed item asked for ``security_id``.

    The asked security must occur; when only other securities stand in the title the item is dropped.
    """
    pairs = alias_table(aliases)
    if pairs is not None:
        # Both texts are read in one pass.
        joined = items.withColumns({
            "title_ids": mentioned(match_text("title"), pairs), "description_ids": mentioned(match_text("description"), pairs),
        })
    else:
        texts = items.select(row_id, match_text("title").alias("t"), match_text("description").alias("d"))
        joined, empty = items, F.array().cast("array<string>")
        for column, name in (("t", "title_ids"), ("d", "description_ids")):
            found = find_mentions(texts, row_id, column, aliases).groupBy(row_id).agg(F.array_sort(F.collect_set("security_id")).alias(name))
            joined = joined.join(found, row_id, "left").withColumn(name, F.coalesce(name, empty))
    in_title = F.array_contains("title_ids", F.col("security_id"))
    in_description = F.array_contains("description_ids", F.col("security_id"))
    primary = F.when(in_title, F.col("title_ids")).otherwise(F.array("security_id"))
    return joined.where(in_title | (in_description & (F.size("title_ids") == 0))).withColumn("primary_security_ids", primary).withColumn(
        "mentioned_security_ids", F.array_except("description_ids", "primary_security_ids")
    ).drop("title_ids", "description_ids")
