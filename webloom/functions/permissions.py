"""Robots directives of a page: X-Robots-Tag header and robots meta tags.

A permission is a struct<index, follow>; sources only ever switch a permission off. Tests are
case-sensitive and look for the directive anywhere in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import text as tx

# Content types of documents that are kept.
PAGE_CONTENT_TYPES = ["text/html", "text/plain"]

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
# Groups of a time: hour, minute, second and half of the day.
_TIME = r"(?:[T ,]\s*(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,]\d+)?)?)?(?:\s*([AaPp])\.?[Mm]\.?)?)?"
_ZONE = r"\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2})?(?:\s*[A-Z]{3,4})?"

_ISO = rf"^\s*(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}{_ZONE}\s*$"
_COMPACT = rf"^\s*(\d{{4}})(\d{{2}})(\d{{2}}){_TIME}{_ZONE}\s*$"
_SLASHES = rf"^\s*(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}){_TIME}{_ZONE}\s*$"
_DAY_FIRST = rf"(?i)^\s*(?:[a-z]+\.?,?\s+)?(\d{{1,2}})[ -]([a-z]{{3}})[a-z]*\.?[ -](\d{{4}}|\d{{2}}){_TIME}{_ZONE}\s*$"
_MONTH_FIRST = rf"(?i)^\s*(?:[a-z]+\.?,\s+)?([a-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}}){_TIME}{_ZONE}\s*$"


def is_page_content(content_type: Column) -> Column:
    """Does a content type announce a page? A missing one does not."""
    kinds = [content_type.contains(kind) for kind in PAGE_CONTENT_TYPES]
    return F.coalesce(kinds[0] | kinds[1], F.lit(False))


def x_robots_tag(headers: Column) -> Column:
    """Directives of the response headers, by exact header name; NULL if there are none."""
    return F.try_element_at(headers, F.lit("X-Robots-Tag"))


def meta_directives(meta_robots: Column) -> Column:
    """Directives of all robots meta tags of a page, joined by commas."""
    return F.array_join(meta_robots, ",")


def parse_date(text: Column, as_of: Column) -> Column:
    """Timestamp of a date in ISO, RFC 1123, RFC 850, ``Month D, YYYY``, ``MM/DD/YYYY`` or ``YYYYMMDD`` form, else NULL.

    A date without a zone, or with a zone that is only a name, is UTC. A two-digit year is the
    one nearest to ``as_of``.
    """
    parts = F.coalesce(
        _date_parts(text, _ISO, "$1|$2|$3"),
        _date_parts(text, _COMPACT, "$1|$2|$3"),
        _date_parts(text, _SLASHES, "$3|$1|$2"),
        _date_parts(text, _DAY_FIRST, "$3|$2|$1"),
        _date_parts(text, _MONTH_FIRST, "$3|$1|$2"),
    )
    return tx.let(parts, lambda found: _timestamp(found, as_of))


def _date_parts(text: Column, pattern: str, year_month_day: str) -> Column:
    """array(year, month, day, hour, minute, second, half of the day, zone) of a date in one form, else NULL."""
    joined = F.regexp_replace(text, pattern, year_month_day + "|$4|$5|$6|$7|$8")
    return F.when(text.rlike(pattern), F.split(joined, r"\|"))


def _timestamp(parts: Column, as_of: Column) -> Column:
    def number(at: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(at)).try_cast("int"), F.lit(0))

    names = F.array(*[F.lit(m) for m in _MONTHS])
    by_name = F.array_position(names, F.lower(F.get(parts, F.lit(1)))).cast("int")
    month = F.greatest(number(1), by_name)
    this_year = F.year(as_of)
    short = this_year - this_year % 100 + number(0)
    nearest = short - F.when(short >= this_year + 50, 100).when(short < this_year - 50, -100).otherwise(0)
    year = F.when(F.length(F.get(parts, F.lit(0))) == 2, nearest).otherwise(number(0))
    half, zone = F.lower(F.get(parts, F.lit(6))), F.get(parts, F.lit(7))
    hour = F.when(half == "p", number(3) % 12 + 12).when(half == "a", number(3) % 12).otherwise(number(3))
    digits = F.coalesce(F.regexp_replace(zone, "[^0-9]", "").try_cast("int"), F.lit(0))
    minutes = F.floor(digits / 100) * 60 + digits % 100
    offset = F.when(zone.startswith("-"), -minutes).otherwise(minutes).cast("int")
    seconds = number(5).cast("decimal(8,6)")
    local = F.try_make_timestamp(year, month, number(2), hour, number(4), seconds, F.lit("UTC"))
    return local - F.make_dt_interval(mins=offset)


def expired(directives: Column, as_of: Column) -> Column:
    """Has an ``unavailable_after`` date passed?

    The directives are split at commas that a letter follows at once (the comma rule is a fixed value). An empty date ends the
    search; one that cannot be read has no effect.
    """
    parts = F.filter(
        F.split(directives, r",(?=[a-zA-Z-]+:?)"), lambda part: part.startswith("unavailable_after")
    )
    dates = F.transform(
        parts, lambda part: F.when(part.contains(":"), F.regexp_replace(part, r"(?s)^[^:]*:", "")).otherwise(part)
    )
    first_empty = F.array_position(dates, "")
    read = F.when(first_empty > 0, F.slice(dates, 1, (first_empty - 1).cast("int"))).otherwise(dates)
    past = F.exists(read, lambda date: F.coalesce(parse_date(date, as_of) < as_of, F.lit(False)))
    return F.coalesce(F.when(directives.contains("unavailable_after"), past), F.lit(False))


def directive_permissions(directives: Column, as_of: Column) -> Column:
    """struct<index, follow> allowed by one directive text; NULL text allows both."""
    given = F.coalesce(directives, F.lit(""))
    return tx.let(
        given.contains("none") | expired(given, as_of),
        lambda neither: F.struct(
            (~(given.contains("noindex") | neither)).alias("index"),
            (~(given.contains("nofollow") | neither)).alias("follow"),
        ),
    )


def page_permissions(headers: Column, meta_robots: Column, as_of: Column) -> Column:
    """struct<index, follow> allowed by both the headers and the meta tags of a page."""
    of_header = directive_permissions(x_robots_tag(headers), as_of)
    of_meta = directive_permissions(meta_directives(meta_robots), as_of)
    return F.aggregate(
        F.array(of_header, of_meta),
        F.struct(F.lit(True).alias("index"), F.lit(True).alias("follow")),
        lambda both, one: F.struct(
            (both["index"] & one["index"]).alias("index"), (both["follow"] & one["follow"]).alias("follow")
        ),
    )
