"""Titles, text, links and URL functions over the raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import common as c
from webloom.functions import urls
from webloom.functions.keys import page_key, page_key_blake2b
from webloom.operators import firsts
from webloom.operators import links as ln
from webloom.operators import pages as pg
from webloom.plans.lineage import scratch_path, spread
from webloom.sources import layout, tables


def _scan_pages(spark, sf_dir):
    pages = tables.scan_pages(spark, f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").alias("n_chars"))


def _page_layout(spark, sf_dir):
    pages = tables.scan_pages(spark, f"{sf_dir}/pages.parquet")
    return layout.write_pages(pages, scratch_path(spark, "pages"))


def _page_lookup(spark, sf_dir):
    """Every fiftieth page, by its key."""
    pages = tables.scan_pages(spark, f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "pages")
    layout.write_pages(pages, path)
    keys = pages.filter("page_id % 50 = 0").select(page_key(F.col("url")).alias("page_key"))
    return layout.lookup_pages(keys, path).select("page_id", "url", F.md5("html").alias("html_md5"), "page_key")


def _page_key(spark, sf_dir):
    return c.pages(spark, sf_dir).select("page_id", page_key(F.col("url")).alias("page_key"))


def _page_key_blake2b(spark, sf_dir):
    return c.pages(spark, sf_dir).select("page_id", page_key_blake2b(F.col("url")).alias("page_key"))


def _url_parts(spark, sf_dir):
    return c.pages(spark, sf_dir).select("page_id", urls.url_parts(F.col("url")).alias("parts")).select(
        "page_id", "parts.*"
    )


def _canonical_url(spark, sf_dir):
    return c.pages(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


def _registered_domain(spark, sf_dir):
    return c.pages(spark, sf_dir).select("page_id", urls.registered_domain(F.col("url"), c.SUFFIXES).alias("domain"))


# Hosts by page number, with a plain, a two-label, a wildcard and an exception suffix, and their domains.
_HOSTS = ["a.shop.com", "a.shop.co.uk", "a.shop.any.ck", "a.www.ck"]
_DOMAINS = ["shop.com", "shop.co.uk", "shop.any.ck", "www.ck"]


def _registered_domain_suffixes(spark, sf_dir):
    host = F.get(F.array(*[F.lit(h) for h in _HOSTS]), F.pmod("page_id", F.lit(4)).cast("int"))
    url = F.concat(F.lit("https://user@"), host, F.lit(":8080/x?"), F.col("url"))
    return c.pages(spark, sf_dir).select("page_id", urls.registered_domain(url, c.SUFFIXES).alias("domain"))


def _url_title(spark, sf_dir):
    return c.pages(spark, sf_dir).select("page_id", urls.url_title(F.col("url")).alias("title"))


def _page_title(spark, sf_dir):
    return pg.titled_pages(spread(c.pages(spark, sf_dir))).select("page_id", "title")


def _retitled(spark, sf_dir):
    """Pages whose titles are elsewhere, by number: og tag, twitter tag, heading, empty tag, title element."""
    pages = c.pages(spark, sf_dir)
    kind, number = F.pmod("page_id", F.lit(5)), F.col("page_id").cast("string")
    bare = F.regexp_replace("html", "(?s)<title>.*?</title>", "")

    def with_meta(attribute, name, content):
        tag = F.concat(F.lit(f'<head><meta {attribute}="{name}" content="'), content, F.lit('">'))
        return F.replace(bare, F.lit("<head>"), tag)

    html = (
        F.when(kind == 0, with_meta("property", "og:title", F.concat(F.lit("Og "), number)))
        .when(kind == 1, with_meta("name", "twitter:title", F.concat(F.lit("Twitter "), number)))
        .when(kind == 2, F.replace(bare, F.lit("<body>"), F.concat(F.lit("<body><h1>Heading <b>"), number, F.lit("</b></h1>"))))
        .when(kind == 3, with_meta("property", "og:title", F.lit("")))
        .otherwise(F.col("html"))
    )
    return pages.select("page_id", "url", html.alias("html"))


def _page_title_fallbacks(spark, sf_dir):
    return pg.titled_pages(spread(_retitled(spark, sf_dir))).select("page_id", "title")


def _page_text_untitled(spark, sf_dir):
    """The literal scope takes the body of a page without a title."""
    bare = c.pages(spark, sf_dir).withColumn("html", F.regexp_replace("html", "(?s)<title>.*?</title>", ""))
    texts = pg.page_texts(spread(bare), "title_else_body")
    return texts.select("page_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def _append_links(spark, sf_dir):
    """The stored link graph after two batches of pages."""
    path = scratch_path(spark, "links")
    edges = ln.link_edges(c.pages(spark, sf_dir), c.SUFFIXES)
    for batch in (edges.filter(F.col("source_url").contains("/de/")), edges.filter(~F.col("source_url").contains("/de/"))):
        tables.append_links(batch, path)
    return tables.read_table(spark, path, tables.PAGE_LINKS)


def _page_text(scope):
    def query(spark, sf_dir):
        texts = pg.page_texts(spread(c.pages(spark, sf_dir)), scope)
        return texts.select("page_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))

    return query


def _crawled_again(spark, sf_dir):
    """Each page twice under two ids, as after a second crawl, and the pages known before."""
    pages = c.pages(spark, sf_dir).withColumn("indexation", ~F.col("url").contains("/de/"))
    again = pages.withColumn("page_id", F.col("page_id") + 1_000_000)
    return pages.unionByName(again), pages.filter(F.col("url").contains("/es/"))


def _parse_pages(spark, sf_dir):
    return pg.parse_pages(*_crawled_again(spark, sf_dir))


def _parse_first_pages(spark, sf_dir):
    return firsts.parse_first_pages(*_crawled_again(spark, sf_dir))


def _parse_dedupe(spark, sf_dir):
    """Pages of one canonical URL, the lowest id first."""
    pages = c.pages(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("url"))
    return pg.first_per_url(pages)


def _page_hrefs(spark, sf_dir):
    return ln.page_hrefs(c.pages(spark, sf_dir)).select("page_id", "pos", "href")


def _resolved_links(spark, sf_dir):
    return ln.resolved_links(ln.page_hrefs(c.pages(spark, sf_dir))).select("page_id", "pos", "link")


def _link_ext_filter(spark, sf_dir):
    links = ln.page_links(ln.resolved_links(ln.page_hrefs(c.pages(spark, sf_dir))))
    return links.select("page_id", "pos", "target_url")


def link_edges(spark, sf_dir):
    pages = c.pages(spark, sf_dir).withColumn("follow", ~F.col("url").contains("/de/"))
    return ln.link_edges(pages, c.SUFFIXES)


def _out_degree(spark, sf_dir):
    return ln.out_degree(ln.link_edges(c.pages(spark, sf_dir), c.SUFFIXES))


def _in_links(spark, sf_dir):
    return ln.in_links(ln.link_edges(c.pages(spark, sf_dir), c.SUFFIXES))


_PARTS = """
parts AS (
  SELECT page_id, url, html, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) AS scheme,
         regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS netloc,
         regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment
  FROM pages)
"""

_HREFS = f"""WITH {_PARTS},
found AS (SELECT *, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM parts),
hrefs AS (SELECT page_id, url, scheme, netloc, unnest(hrefs) AS href,
                 (generate_subscripts(hrefs, 1) - 1)::INTEGER AS pos FROM found),
links AS (SELECT *, scheme || '://' || netloc || href AS link FROM hrefs WHERE href LIKE '/%'),
kept AS (
  SELECT *, rtrim(link, '/') AS target_url FROM links
  WHERE NOT contains(href, '.')
     OR regexp_extract(lower(href), '[^/](\\.[^./]+)/*$', 1) IN ('.htm', '.html', '.php', '.asp', '.aspx', '.xhtml'))
"""

_EDGES = f"""{_HREFS},
edges AS (SELECT url AS source_url, target_url, regexp_extract(netloc, '[^.]+\\.[^.]+$', 0) AS domain FROM kept)
"""

SQL_HREFS = _HREFS

# The four entities in use; HTML reads them without the final semicolon as well.
_UNESCAPED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&quot;?', '\"', 'g'), "
    "'&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g')"
)
SQL_TITLE = _TITLE = _UNESCAPED.format("trim(regexp_extract(html, '<title>(.*?)</title>', 1))")
_BODY = "regexp_extract(html, '(?s)<body>(.*?)(</body>|$)', 1)"
_TEXT = _UNESCAPED.format(f"regexp_replace({_BODY}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')")


def _text_sql(text: str) -> str:
    return f"SELECT page_id, trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS text FROM pages"


_PARSED = f"""SELECT page_id, url, {_TITLE} AS title FROM pages
WHERE NOT contains(url, '/de/') AND NOT contains(url, '/es/')"""

QUERIES = {
    "scan_pages": (_scan_pages, "SELECT page_id, url, length(html)::INTEGER AS n_chars FROM pages"),
    "page_layout": (
        _page_layout,
        "SELECT page_id, url, md5(url) AS page_key, substr(md5(url), 1, 2) AS prefix FROM pages",
    ),
    "page_lookup": (
        _page_lookup,
        """SELECT page_id, url, md5(html) AS html_md5, md5(url) AS page_key FROM pages
        WHERE url IN (SELECT url FROM pages WHERE page_id % 50 = 0)""",
    ),
    "page_key": (_page_key, "SELECT page_id, md5(url) AS page_key FROM pages"),
    "page_key_blake2b": (_page_key_blake2b, None),
    "url_parts": (
        _url_parts,
        f"WITH {_PARTS} SELECT page_id, scheme, netloc, path, '' AS params, query, fragment FROM parts",
    ),
    "canonical_url": (
        _canonical_url,
        f"WITH {_PARTS} SELECT page_id, rtrim(scheme || '://' || netloc || path, '/') AS canonical FROM parts",
    ),
    "registered_domain": (
        _registered_domain,
        f"WITH {_PARTS} SELECT page_id, regexp_extract(netloc, '[^.]+\\.[^.]+$', 0) AS domain FROM parts",
    ),
    "registered_domain_suffixes": (
        _registered_domain_suffixes,
        f"SELECT page_id, {_DOMAINS}[page_id % 4 + 1] AS domain FROM pages",
    ),
    "page_title_fallbacks": (
        _page_title_fallbacks,
        f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Og ' || page_id WHEN 1 THEN 'Twitter ' || page_id
        WHEN 2 THEN 'Heading ' || page_id WHEN 3 THEN regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', '')
        ELSE {_TITLE} END AS title FROM pages""",
    ),
    "page_text_untitled": (_page_text_untitled, _text_sql(_TEXT)),
    "append_links": (_append_links, f"{_EDGES} SELECT source_url, target_url FROM edges"),
    "url_title": (
        _url_title,
        "SELECT page_id, regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', '') AS title FROM pages",
    ),
    "page_title": (_page_title, f"SELECT page_id, {_TITLE} AS title FROM pages"),
    "page_text_literal": (_page_text("title_else_body"), _text_sql(_TITLE)),
    "page_text_full": (_page_text("title_and_body"), _text_sql(f"{_TITLE} || ' ' || {_TEXT}")),
    "parse_pages": (_parse_pages, _PARSED),
    "parse_first_pages": (_parse_first_pages, _PARSED),
    "parse_dedupe": (
        _parse_dedupe,
        f"""WITH {_PARTS} SELECT min(page_id) AS page_id, rtrim(scheme || '://' || netloc || path, '/') AS url
        FROM parts GROUP BY 2""",
    ),
    "page_hrefs": (_page_hrefs, f"{_HREFS} SELECT page_id, pos, href FROM hrefs"),
    "resolved_links": (_resolved_links, f"{_HREFS} SELECT page_id, pos, link FROM links"),
    "link_ext_filter": (_link_ext_filter, f"{_HREFS} SELECT page_id, pos, target_url FROM kept"),
    "link_edges": (
        link_edges,
        f"{_EDGES} SELECT source_url, target_url, domain FROM edges WHERE NOT contains(source_url, '/de/')",
    ),
    "out_degree": (_out_degree, f"{_EDGES} SELECT source_url, count(*) AS out_degree FROM edges GROUP BY source_url"),
    "in_links": (
        _in_links,
        f"""{_EDGES} SELECT target_url, source_url, count(*) AS n_links FROM edges
        GROUP BY target_url, source_url""",
    ),
}
