"""URL columns, split with the generic URI pattern (java.net.URI refuses many real feed URLs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions.text import ColumnLike, alternation, as_column, word_array

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
AUTHORITY = r"^(?:([^@]*)@)?(\[[^\]]*\]|[^:@]*)(?::(\d*))?$"
CONTROLS = r"[\x00-\x1f\x7f]"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def scheme(url: ColumnLike) -> Column:
    return F.lower(part(as_column(url), 1))


def authority(url: ColumnLike) -> Column:
    return part(as_column(url), 2)


def host(url: ColumnLike) -> Column:
    return F.lower(F.regexp_extract(authority(url), AUTHORITY, 2))


def port(url: ColumnLike) -> Column:
    return F.regexp_extract(authority(url), AUTHORITY, 3).try_cast("int")


def is_web_url(url: ColumnLike) -> Column:
    value = as_column(url)
    return (
        scheme(value).isin("http", "https")
        & authority(value).rlike(AUTHORITY)
        & (host(value) != "")
        & ~authority(value).contains("@")
    )


def canonical_one(url: ColumnLike, tracking_keys: Sequence[str] | None = None) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters; null when not a web URL.

    Query values keep the percent-encoding they came with.
    """
    keys = word_array(fixed.TRACKING_KEYS if tracking_keys is None else tracking_keys)
    value = F.trim(as_column(url))
    pairs = F.filter(F.split(part(value, 4), "&"), lambda pair: pair != "")
    kept = F.filter(
        pairs,
        lambda pair: ~(
            F.lower(F.substring_index(pair, "=", 1)).startswith(fixed.TRACKING_PREFIX)
            | F.array_contains(keys, F.lower(F.substring_index(pair, "=", 1)))
        ),
    )
    query = F.concat_ws("&", F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))))
    path = F.when(part(value, 3) == "", F.lit("/")).otherwise(part(value, 3))
    whole = F.concat(
        scheme(value), F.lit("://"), F.lower(authority(value)), path,
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(is_web_url(value), whole)


def canonical_url(*urls: ColumnLike) -> Column:
    """URL-01: canonical form of the first valid URL."""
    return F.coalesce(*[canonical_one(url) for url in urls])


def feed_url(url: ColumnLike) -> Column:
    """URL-02: lower scheme and host, default port and fragment dropped, query kept."""
    value = F.trim(as_column(url))
    number = port(value)
    default = ((scheme(value) == "http") & (number == 80)) | ((scheme(value) == "https") & (number == 443))
    shown_port = F.when(number.isNull() | default, F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string")))
    query = part(value, 4)
    whole = F.concat(
        scheme(value), F.lit("://"), host(value), shown_port, part(value, 3),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(is_web_url(value) & F.coalesce(number.between(0, 65535), F.lit(True)), whole)


def publisher_host(url: ColumnLike) -> Column:
    """URL-03: host without a leading ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def has_credential_key(url: ColumnLike) -> Column:
    keys = alternation(fixed.CREDENTIAL_KEYS)
    names = F.transform(
        F.split(part(as_column(url), 4), "&"),
        lambda pair: F.regexp_replace(
            F.lower(F.coalesce(F.try_url_decode(F.substring_index(pair, "=", 1)), F.substring_index(pair, "=", 1))),
            "[^a-z0-9]", "",
        ),
    )
    return F.exists(names, lambda name: name.rlike(f"^(?:{keys})$"))


LOCAL_PATH = "|".join(fixed.LOCAL_PATH_PATTERNS)


def has_local_path(text: ColumnLike) -> Column:
    value = as_column(text)
    web = F.lower(value).startswith("http://") | F.lower(value).startswith("https://")
    return ~web & value.rlike(LOCAL_PATH)


def leaks_local_path(text: ColumnLike) -> Column:
    """Local paths anywhere, also inside text that starts like a URL."""
    return as_column(text).rlike(LOCAL_PATH)


def is_safe_url(url: ColumnLike) -> Column:
    """URL-04: web URL without user info, fragment, bad port, blanks, controls or credential keys."""
    value = as_column(url)
    values = F.transform(F.split(part(value, 4), "&"), lambda pair: F.regexp_replace(pair, "^[^=]*=?", ""))
    decoded = F.transform(values, lambda v: F.coalesce(F.try_url_decode(v), v))
    return (
        is_web_url(value)
        & ~value.rlike(CONTROLS)
        & ~value.rlike(r"(?U)\s")
        & (part(value, 5) == "")
        & F.coalesce(port(value).between(1, 65535), F.lit(True))
        & ~has_credential_key(value)
        & ~F.exists(decoded, lambda v: v.rlike(CONTROLS) | has_local_path(v))
    )
