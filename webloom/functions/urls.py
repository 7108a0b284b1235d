"""URL columns: parts, link resolution, canonical form and registered domain.

``parse_url`` is not used: it refuses URLs with a space or ``|``, which are links all the same.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import let

# Extensions of documents that are followed.
PAGE_EXTENSIONS = ["htm", "html", "php", "asp", "aspx", "xhtml"]

# Schemes whose last path segment may carry ``;params``.
_SCHEMES_WITH_PARAMS = ["", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "sip", "sips", "mms", "sftp", "tel"]

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_parts(url: Column) -> Column:
    """struct<scheme, netloc, path, params, query, fragment>; absent parts are empty.

    The scheme is lower-cased, the host keeps its case. Leading control characters and spaces are
    cut, tabs and line ends removed.
    """
    clean = F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    # no line end is left in a URL, so it can part what one match finds
    found = F.split(F.regexp_replace(clean, _PARTS, "$1\n$2\n$3\n$4\n$5"), "\n")

    def parts(of: Column) -> Column:
        scheme, path = F.lower(F.get(of, F.lit(0))), F.get(of, F.lit(2))
        has_params = scheme.isin(_SCHEMES_WITH_PARAMS) & path.contains(";")
        without_params = F.when(has_params, F.regexp_replace(path, r"(?s);[^/]*\z", "")).otherwise(path)
        params = F.when(has_params, F.regexp_extract(path, r"(?s);([^/]*)\z", 1)).otherwise("")
        fields = {
            "scheme": scheme,
            "netloc": F.get(of, F.lit(1)),
            "path": without_params,
            "params": params,
            "query": F.get(of, F.lit(3)),
            "fragment": F.get(of, F.lit(4)),
        }
        # named outright: names given by alias are lost beside a generator
        return F.named_struct(*[x for name, part in fields.items() for x in (F.lit(name), part)])

    return let(found, parts)


def netloc(url: Column) -> Column:
    """Host and port of a URL, by one match."""
    clean = F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    return F.regexp_extract(clean, _PARTS, 2)


def resolve(page: Column, href: Column) -> Column:
    """Absolute URL of a link on a page with these URL parts; NULL for links not followed.

    Followed are ``/path``, ``//host/path`` and anything that starts with ``http``.
    """
    return (
        F.when(href.startswith("//"), F.concat(page["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(page["scheme"], F.lit("://"), page["netloc"], href))
        .when(href.startswith("http"), href)
    )


def has_page_extension(path: Column) -> Column:
    """A path without any dot passes, else the suffix of its last segment must be a page's."""
    allowed = r"(?is)[^/]\.(?:" + "|".join(PAGE_EXTENSIONS) + r")(?:/\.?)*\z"
    return ~path.contains(".") | path.rlike(allowed)


def canonical(url: Column) -> Column:
    """Scheme, host and path only, without trailing slashes."""
    parts = url_parts(url)
    return canonical_of(parts)


def canonical_of(parts: Column) -> Column:
    whole = F.concat(parts["scheme"], F.lit("://"), parts["netloc"], parts["path"])
    return F.rtrim(whole, F.lit("/"))


def url_title(url: Column) -> Column:
    """Title taken from the URL: its last segment without the last extension."""
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"(?s)\.[^.]*\z", "")


def registered_domain(url: Column, suffixes: Iterable[str]) -> Column:
    """``domain.suffix`` of a URL by a public-suffix list with ``*.`` and ``!`` rules.

    Pass the complete list: hosts under a suffix that it lacks fall together under their last label.
    The list becomes a hash set inside the expression: a lookup per host tail, no join. A host
    without a known suffix gives its last label and a dot.
    """
    rules = [rule.lower() for rule in suffixes]
    wild = [r[2:] for r in rules if r.startswith("*.")]
    exceptions = [r[1:] for r in rules if r.startswith("!")]
    # the suffix of an exception is what follows its first label
    plain = [r for r in rules if r[0] not in "*!"] + [r.split(".", 1)[1] for r in exceptions]

    host = F.regexp_replace(netloc(url), r"(?s)^.*@|:[^:\]]*\z", "")
    host = F.rtrim(F.translate(F.trim(host), "。．｡", "..."), F.lit("."))

    def split_at_suffix(labels: Column) -> Column:
        def tail(start: Column) -> Column:
            return F.array_join(F.slice(labels, start, F.size(labels)), ".")

        def is_suffix(start: Column) -> Column:
            this, parent = F.lower(tail(start)), F.lower(tail(start + 1))
            match = this.isin(plain)
            if wild:
                match = match | (parent.isin(wild) & ~this.isin(exceptions))
            return match

        starts = F.filter(F.sequence(F.lit(1), F.size(labels)), is_suffix)

        def joined(start: Column) -> Column:
            domain = F.when(start > 1, F.element_at(labels, start - 1)).otherwise("")
            return F.concat(domain, F.lit("."), tail(start))

        return let(F.coalesce(F.get(starts, F.lit(0)), F.size(labels) + 1), joined)

    is_address = host.rlike(r"^(\d{1,3}\.){3}\d{1,3}\z|^\[.*\]\z")
    return F.when(is_address, F.concat(host, F.lit("."))).otherwise(
        let(F.split(host, r"\."), split_at_suffix)
    )
