"""Time columns. Instants are UTC timestamps; days and clock times are local to the market zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions.text import ColumnLike, as_column


def local_time(instant: ColumnLike, zone: str = fixed.LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(as_column(instant), zone)


def local_day(instant: ColumnLike, zone: str = fixed.LOCAL_ZONE) -> Column:
    return F.to_date(local_time(instant, zone))


def parse_feed_time(text: ColumnLike) -> Column:
    """DAT-01: RFC 2822 or ISO text with a zone, as UTC; null without a zone or when malformed."""
    value = F.trim(as_column(text))
    bare = F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]{3,9},\s*", ""), r"\s+", " ")
    bare = F.regexp_replace(bare, r"(?i) (?:GMT|UTC|UT|Z)$", " +0000")
    seconds = F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2} "), F.regexp_replace(bare, r"(:\d{2}) ", "$1:00 "))
    mail = F.when(
        bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(?::\d{2})? [+-]\d{4}$"),
        F.try_to_timestamp(F.initcap(F.coalesce(seconds, bare)), F.lit("d MMM yyyy HH:mm:ss Z")),
    )
    iso = F.when(
        value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})$"),
        F.try_to_timestamp(F.regexp_replace(value, r"([+-]\d{2})(\d{2})$", "$1:$2")),
    )
    return F.coalesce(mail, iso)


def parse_compact_day(text: ColumnLike) -> Column:
    """DAT-02: ``yyyyMMdd`` as a date."""
    value = as_column(text)
    return F.to_date(F.when(value.rlike(r"^\d{8}$"), F.try_to_timestamp(value, F.lit("yyyyMMdd"))))


def day_available_at(day: ColumnLike, policy: str = "end_of_day", zone: str = fixed.LOCAL_ZONE) -> Column:
    """DAT-02: instant at which a row known by date only counts as available."""
    start = as_column(day).cast("timestamp")
    if policy == "end_of_day":
        start = start + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 SECOND")
    elif policy != "start_of_day":
        raise ValueError(f"unknown availability policy: {policy}")
    return F.to_utc_timestamp(start, zone)


def age_days(instant: ColumnLike, basis: ColumnLike, zone: str = fixed.LOCAL_ZONE) -> Column:
    """DAT-03: age in local days."""
    return F.datediff(local_day(basis, zone), local_day(instant, zone))


def checkpoint_id(instant: ColumnLike, zone: str = fixed.LOCAL_ZONE) -> Column:
    """DAT-05."""
    return F.date_format(local_time(instant, zone), "yyyyMMdd'T'HHmm'KST'")


def time_band(instant: ColumnLike, zone: str = fixed.LOCAL_ZONE) -> Column:
    """DAT-07."""
    return F.when(F.hour(local_time(instant, zone)) < 9, F.lit("pre_market")).otherwise(F.lit("intraday"))


def market_session(instant: ColumnLike, is_trading_day: Column, zone: str = fixed.LOCAL_ZONE) -> Column:
    """DAT-06: session name by local clock; closed off the trading calendar. Edges belong to the earlier session."""
    clock = F.date_format(local_time(instant, zone), "HH:mm:ss.SSSSSS")
    session = F.when(~is_trading_day, F.lit("closed"))
    for edge, name in fixed.SESSION_EDGES:
        session = session.when(clock <= F.lit(edge + ".000000"), F.lit(name))
    return session.otherwise(F.lit("after_close"))


def market_status(instant: ColumnLike, is_trading_day: Column, zone: str = fixed.LOCAL_ZONE) -> Column:
    clock = F.date_format(local_time(instant, zone), "HH:mm:ss")
    return F.when(~is_trading_day | (clock >= F.lit(fixed.MARKET_CLOSE)), F.lit("closed")).otherwise(F.lit("open"))


def publication_time(text: ColumnLike, zone: str = fixed.LOCAL_ZONE) -> Column:
    """DAT-08: struct of instant, precision, zone basis and local day; all null when malformed."""
    value = F.trim(as_column(text))
    is_day = value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    offset = F.regexp_extract(
        value, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(Z|[+-]\d{2}:\d{2})$", 1
    )
    day_start = F.to_utc_timestamp(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), zone)
    instant = F.when(is_day, day_start).when(offset != "", F.try_to_timestamp(value))
    return F.struct(
        instant.alias("published_at"),
        F.when(instant.isNotNull(), F.when(is_day, F.lit("date")).otherwise(F.lit("datetime"))).alias("precision"),
        F.when(
            instant.isNotNull(),
            F.when(is_day, F.lit(zone)).when(offset == "Z", F.lit("UTC")).otherwise(offset),
        ).alias("zone_basis"),
        local_day(instant, zone).alias("local_day"),
    )


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def dated_text(text: ColumnLike) -> Column:
    """The text where it can hold a day or month that ``parse_period`` reads, else an empty one."""
    value = as_column(text)
    return F.when(~value.rlike(r"\d{4}(?:-\d{2}-\d{2}|\s*년)"), F.lit("")).otherwise(value)


def parse_period(
    text: ColumnLike, basis_day: ColumnLike, today: Sequence[str] | None = None, recent: Sequence[str] | None = None, dated: ColumnLike | None = None,
) -> Column:
    """DAT-04: struct of start, end and ``explicit`` (the text speaks about time, so inherit nothing).

    One ISO range, ISO day, Korean day, Korean month or "today" is read; two of them, or a
    malformed one, give no period but still count as explicit. ``dated`` may name a column that holds
    ``dated_text``, which spares long texts without a day all patterns.
    """
    whole, basis = as_column(text), as_column(basis_day)
    value = whole if dated is None else as_column(dated)
    today = fixed.PHRASES["today"] if today is None else today
    recent = fixed.PHRASES["recent"] if recent is None else recent
    iso = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
    iso_range = r"(?<!\d)(\d{4}-\d{2}-\d{2})\s*~\s*(\d{4}-\d{2}-\d{2})(?!\d)"
    kr_day = r"(?<!\d)(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일(?!\d)"
    kr_day_cue = r"(?<!\d)\d{4}\s*년\s*\d+\s*월\s*\d+\s*일"
    kr_month = r"(?<!\d)(\d{4})\s*년\s*(\d{1,2})\s*월"
    kr_cue = r"(?<!\d)\d{4}\s*년\s*\d+\s*월"

    def any_of(words: Sequence[str]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | whole.contains(word)
        return found

    ranges = _count(value, iso_range)
    days = _count(F.regexp_replace(value, iso_range, " "), iso)
    kr_days = _count(value, kr_day)
    months = _count(F.regexp_replace(value, kr_day_cue, " "), kr_month)
    explicit = ranges + days + kr_days + months
    has_today, has_recent = any_of(today), any_of(recent)
    conflict = (
        value.rlike(r"(?<!\d)\d{4}-\d{2}-\d{2}\d+(?!\d)")
        | (_count(value, kr_day_cue) != kr_days)
        | (has_today & has_recent)
        | ((has_today | has_recent) & (explicit > 0))
        | (explicit > 1)
        | (value.rlike(kr_cue) & (kr_days + months == 0))
    )

    def to_day(year: Column, month: Column, day: Column) -> Column:
        return F.to_date(F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")))

    def iso_day(text_day: Column) -> Column:
        return F.to_date(F.try_to_timestamp(F.nullif(text_day, F.lit("")), F.lit("yyyy-MM-dd")))

    outside = F.regexp_replace(value, iso_range, " ")
    month_text = F.regexp_replace(value, kr_day_cue, " ")
    month_start = to_day(
        F.regexp_extract(month_text, kr_month, 1), F.regexp_extract(month_text, kr_month, 2), F.lit("1")
    )
    one_day = F.when(days > 0, iso_day(F.regexp_extract(outside, iso, 0))).when(
        kr_days > 0,
        to_day(F.regexp_extract(value, kr_day, 1), F.regexp_extract(value, kr_day, 2), F.regexp_extract(value, kr_day, 3)),
    )
    range_start, range_end = iso_day(F.regexp_extract(value, iso_range, 1)), iso_day(F.regexp_extract(value, iso_range, 2))
    start = (
        F.when(conflict, F.lit(None).cast("date"))
        .when(ranges > 0, F.when(range_end >= range_start, range_start))
        .when(days + kr_days > 0, one_day)
        .when(months > 0, month_start)
        .when(has_today, basis)
    )
    end = (
        F.when(start.isNull(), F.lit(None).cast("date"))
        .when(ranges > 0, range_end)
        .when(months > 0, F.last_day(month_start))
        .otherwise(start)
    )
    return F.struct(
        start.alias("start"), end.alias("end"),
        (conflict | (explicit > 0) | has_today | has_recent).alias("explicit"),
    )
