"""Text columns: folding, tokens, phrases, HTML cleaning.

Everything runs in the JVM except Unicode compatibility folding and rare HTML entities, which
go through an Arrow UDF. The UDF only receives the rows that need it (others pass a null).
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone import fixed_values as fixed

ColumnLike = Column | str

# Characters outside these ranges may change under compatibility folding; inside them case folding
# is plain lower case, the sharp s apart (ASCII, Latin-1 letters, usual punctuation, kana,
# ideographs, Hangul syllables).
# One plain range is tested first: a class of many ranges costs several times as much a character.
UNSTABLE_CHARACTER = r"[^\x00-\x7F](?<![¡-§©«¬®°±¶·»¿-ÿ–—‘’“”•ぁ-ゖァ-ヺ一-鿿가-힣])"
# Every character Unicode calls white space, listed because the class is much faster than (?U)\s.
_ODD_BLANKS = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = f"[ {_ODD_BLANKS}]+"
# Runs that are not already one plain space, so that ordinary text has nothing to replace; printed ASCII is passed over first.
UNEVEN_BLANKS = f"[^!-~](?:(?<! )|(?=[^!-~]))(?<=[ {_ODD_BLANKS}])(?:(?<! )|(?=[ {_ODD_BLANKS}]))[ {_ODD_BLANKS}]*+"
TAGS = "<[^>]+>"


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def quote(literal: str) -> str:
    """Escape regex metacharacters the same way Java and RE2 read them."""
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/-" else ch for ch in literal)


def alternation(words: Iterable[str]) -> str:
    return "|".join(quote(word) for word in sorted(words, key=len, reverse=True))


def word_array(words: Iterable[str]) -> Column:
    items = list(words)
    return F.array(*[F.lit(word) for word in items]) if items else F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def collapse(text: ColumnLike) -> Column:
    """Runs of whitespace become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(as_column(text), UNEVEN_BLANKS, " "))


@F.pandas_udf(StringType())
def _fold_unstable(values: pd.Series) -> pd.Series:
    return values.map(lambda value: None if value is None else unicodedata.normalize("NFKC", value).casefold())


@F.pandas_udf(StringType())
def _compose_unstable(values: pd.Series) -> pd.Series:
    return values.map(lambda value: None if value is None else unicodedata.normalize("NFKC", value))


@F.pandas_udf(StringType())
def _unescape_rare(values: pd.Series) -> pd.Series:
    return values.map(lambda value: None if value is None else html.unescape(value))


def fold_case(text: ColumnLike) -> Column:
    """Case folding alone."""
    return F.replace(F.lower(as_column(text)), F.lit("ß"), F.lit("ss"))


def has_unstable(value: Column) -> Column:
    """Text that compatibility folding may change; plain ASCII is told by its length."""
    return (F.octet_length(value) != F.length(value)) & value.rlike(UNSTABLE_CHARACTER)


def fold(text: ColumnLike) -> Column:
    """TXT-01: compatibility normalization, whitespace collapse, case folding."""
    value = as_column(text)
    unstable = F.when(has_unstable(value), value)
    return collapse(F.coalesce(_fold_unstable(unstable), fold_case(value)))


def compose(text: ColumnLike) -> Column:
    """Compatibility normalization and whitespace collapse, case kept."""
    value = as_column(text)
    unstable = F.when(has_unstable(value), value)
    return collapse(F.coalesce(_compose_unstable(unstable), value))


def unescape_html(text: ColumnLike, entities: Mapping[str, str] | None = None) -> Column:
    """HTML 5 entities as characters; with ``entities`` these alone, in their order and without Python."""
    value = as_column(text)
    if entities is not None:
        for entity, char in entities.items():
            value = F.replace(value, F.lit(entity), F.lit(char))
        return value
    # The ampersand comes last, so decoded text is never decoded again.
    rare = F.when(value.rlike("&(?!(?:amp|lt|gt|quot|#39|nbsp|middot|copy|hellip|ndash|mdash);)"), value)
    common = value
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"),
        ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"),
    ):
        common = F.replace(common, F.lit(entity), F.lit(char))
    return F.coalesce(_unescape_rare(rare), F.when(value.contains("&"), common).otherwise(value))


def clean_tags_first(text: ColumnLike, entities: Mapping[str, str] | None = None) -> Column:
    """TXT-02 (a): drop tags, then decode entities; encoded markup survives as text."""
    return collapse(unescape_html(F.regexp_replace(as_column(text), TAGS, ""), entities))


def clean_entities_first(text: ColumnLike, entities: Mapping[str, str] | None = None) -> Column:
    """TXT-02 (b): decode entities, then replace tags by a space."""
    return collapse(F.regexp_replace(unescape_html(text, entities), TAGS, " "))


def contains_any(text: ColumnLike, phrases: Sequence[str]) -> Column:
    """Plain searches, one a phrase, stopped by the first found; the text expression is evaluated once."""
    if not phrases:
        return F.lit(False)
    value = as_column(text)
    if len(phrases) == 1:
        return value.contains(phrases[0])
    return let(value, lambda whole: reduce(or_, [F.contains(whole, F.lit(phrase)) for phrase in phrases]))


def count_contained(text: ColumnLike, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur."""
    return let(as_column(text), lambda value: F.size(F.filter(word_array(phrases), lambda phrase: F.contains(value, phrase))))


def bounded_contains(text: ColumnLike, phrase: str) -> Column:
    """Phrase not touching digits, Latin or Hangul letters on either side."""
    edge = "[0-9a-z가-힣]"
    return as_column(text).rlike(f"(?<!{edge}){quote(phrase)}(?!{edge})")


def first_offset(text: ColumnLike, phrases: Sequence[str]) -> Column:
    """Smallest 0-based offset of any phrase, null when none occurs."""
    return F.nullif(F.regexp_instr(as_column(text), F.lit(alternation(phrases))), F.lit(0)) - F.lit(1)


def strip_suffix_once(folded: Column, suffixes: Sequence[str]) -> Column:
    """Remove one listed suffix (the longest that fits) from every Hangul word, keeping a stem of two."""
    # A Hangul letter is asked for first, so that what stands before is looked at there only.
    return F.regexp_replace(folded, f"(?=[가-힣])(?<![가-힣])([가-힣]{{2,}}?)(?:{alternation(suffixes)})(?![가-힣])", "$1")


def retrieval_tokens_of(folded: Column) -> Column:
    """TXT-03/04 on already folded text: words and numbers, endings and particles removed."""
    # The letters come first, so that what stands before them is looked at where they occur only.
    marked = F.regexp_replace(folded, "hbm(?<![a-z0-9]hbm)([0-9][a-z0-9]*)", "hbm$1 hbm")
    stems = strip_suffix_once(strip_suffix_once(marked, fixed.REQUEST_ENDINGS), fixed.RETRIEVAL_PARTICLES)
    return F.regexp_extract_all(stems, F.lit(fixed.RETRIEVAL_TOKEN), F.lit(0))


def retrieval_tokens(text: ColumnLike) -> Column:
    return retrieval_tokens_of(fold(text))


def query_tokens(text: ColumnLike, generic: Sequence[str] | None = None) -> Column:
    """TXT-05: query tokens without the generic ones; repeats stay (they weigh the score)."""
    stop = word_array(fixed.GENERIC_QUERY_TOKENS if generic is None else generic)
    return F.filter(retrieval_tokens(text), lambda token: ~F.array_contains(stop, token))


def grounding_tokens(text: ColumnLike, generic: Sequence[str] | None = None) -> Column:
    """TXT-08: the set of content tokens used to ground a claim."""
    stems = strip_suffix_once(fold(text), fixed.GROUNDING_PARTICLES)
    tokens = F.regexp_extract_all(stems, F.lit(fixed.GROUNDING_TOKEN), F.lit(0))
    return F.array_except(tokens, word_array(fixed.GENERIC_GROUNDING_TOKENS if generic is None else generic))


def numeric_tokens(text: ColumnLike) -> Column:
    """TXT-09: set of numbers, dates, quarters and amounts with blanks removed."""
    found = F.regexp_extract_all(fold(text), F.lit(fixed.NUMERIC_TOKEN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda token: F.regexp_replace(token, BLANKS, "")))


def humanize_amounts(text: ColumnLike) -> Column:
    """TXT-10: large Korean amounts in trillions, the printed figure kept in brackets.

    The text is cut at its amounts; each amount is spelled anew from its own figure and unit, unless
    it is small or the eight characters before it call it the original. Figures are rounded as the
    binary doubles they are.
    """
    value = as_column(text)
    figure_of = lambda amount: F.regexp_extract(amount, r"^[\d,]+", 0)
    units = F.create_map(*[F.lit(part) for pair in fixed.AMOUNT_UNITS.items() for part in pair])

    def spelled(amount: Column, before: Column) -> Column:
        figure = figure_of(amount)
        unit = F.substring(amount, F.length(figure) + 1, F.length(amount))
        trillions = F.replace(figure, F.lit(","), F.lit("")).cast("double") / units[unit]
        long = F.concat(F.lit("약 "), F.format_number(trillions, 1), F.lit("조원(공시 원문 "), amount, F.lit(")"))
        return F.when(F.contains(before, F.lit(fixed.AMOUNT_ORIGINAL_MARK)) | (trillions < 1), amount).otherwise(long)

    def rebuilt(whole: Column, amounts: Column, pieces: Column) -> Column:
        # Pieces stand before, between and after the amounts: one more than these.
        start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

        def step(held: Column, pair: Column) -> Column:
            at = held["at"] + F.length(pair["piece"])
            before = F.substr(whole, F.greatest(at - 7, F.lit(1)), F.least(at, F.lit(8)))
            shown = F.when(pair["amount"].isNull(), F.lit("")).otherwise(spelled(pair["amount"], before))
            return F.struct(
                F.concat(held["done"], pair["piece"], shown).alias("done"),
                (at + F.coalesce(F.length(pair["amount"]), F.lit(0))).alias("at"),
            )

        return F.aggregate(F.arrays_zip(pieces.alias("piece"), amounts.alias("amount")), start, step)["done"]

    pattern = F.lit(fixed.AMOUNT_PATTERN)
    parts = F.struct(F.regexp_extract_all(value, pattern, F.lit(0)).alias("amounts"), F.split(value, fixed.AMOUNT_PATTERN, -1).alias("pieces"))
    return F.when(value.rlike(fixed.AMOUNT_PATTERN), let(parts, lambda p: rebuilt(value, p["amounts"], p["pieces"]))).otherwise(value)


def title_terms(
    title: ColumnLike,
    phrases: Mapping[str, str] | None = None,
    stop_words: Sequence[str] | None = None,
    token_pattern: str = fixed.EVENT_TOKEN,
) -> Column:
    """TXT-07: set of title words plus canonical phrases found anywhere in the title."""
    phrases = fixed.EVENT_PHRASES if phrases is None else phrases
    stop_words = fixed.EVENT_STOP_WORDS if stop_words is None else stop_words

    def terms(folded: Column) -> Column:
        words = F.filter(
            F.regexp_extract_all(folded, F.lit(token_pattern), F.lit(0)), lambda word: F.length(word) >= 2
        )
        return F.array_sort(F.array_union(F.array_except(words, word_array(stop_words)), phrase_topics(folded, phrases)))

    return let(fold_case(clean_tags_first(title)), terms)


def phrase_topics(folded: Column, phrases: Mapping[str, str]) -> Column:
    """Canonical values of the phrases contained in the text."""
    if not phrases:
        return F.array().cast("array<string>")
    pairs = F.array(*[F.struct(F.lit(phrase).alias("phrase"), F.lit(name).alias("name")) for phrase, name in phrases.items()])
    return let(
        folded,
        lambda value: F.array_distinct(
            F.transform(F.filter(pairs, lambda pair: F.contains(value, pair["phrase"])), lambda pair: pair["name"])
        ),
    )


def sentences(text: ColumnLike) -> Column:
    parts = F.split(as_column(text), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda part: F.trim(part)), lambda part: F.length(part) > 0)


def last_hedged_sentence(text: ColumnLike, markers: Sequence[str] | None = None) -> Column:
    """TXT-22: the last sentence that carries a hedge marker, null when none does."""
    marks = fixed.HEDGE_MARKERS if markers is None else markers
    return F.try_element_at(F.filter(sentences(text), lambda s: contains_any(s, marks)), F.lit(-1))
