"""Links of pages and the link graph."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators.pages import with_fields


def page_hrefs(pages: DataFrame, with_parts: bool = False) -> DataFrame:
    """Anchors with a href, in document order, repeats kept: (page_id, url, pos, href).

    With ``with_parts`` also the URL parts of the page, worked out once per page: page.
    """
    parsed = with_fields(pages, "hrefs")
    parts = [urls.url_parts(F.col("url")).alias("page")] if with_parts else []
    return parsed.select("page_id", "url", *parts, F.posexplode("fields.hrefs").alias("pos", "href"))


def resolved_links(hrefs: DataFrame) -> DataFrame:
    """Links that are followed, as absolute URLs: (..., link). Takes the page's parts if they are there."""
    followed = hrefs.filter(F.col("href").startswith("/") | F.col("href").startswith("http"))
    parsed = followed if "page" in hrefs.columns else followed.withColumn("page", urls.url_parts(F.col("url")))
    return parsed.withColumn("link", urls.resolve(F.col("page"), F.col("href"))).drop("page")


def page_links(links: DataFrame) -> DataFrame:
    """Links to documents that may be pages, with their canonical target: (..., target_url)."""
    parts = links.withColumn("parts", urls.url_parts(F.col("link")))
    kept = parts.filter(urls.has_page_extension(F.col("parts.path")))
    return kept.withColumn("target_url", urls.canonical_of(F.col("parts"))).drop("parts")


def link_edges(
    pages: DataFrame,
    suffixes: Iterable[str],
    canonicalize_sources: bool = False,
) -> DataFrame:
    """Edges of the link graph, parallel edges kept: (source_url, target_url, domain).

    Pages with a boolean ``follow`` column contribute only where it is true. No step leaves the
    row of a page, so nothing is shuffled.
    """
    if "follow" in pages.columns:
        pages = pages.filter("follow").drop("follow")
    links = page_links(resolved_links(page_hrefs(pages.filter("html IS NOT NULL"), with_parts=True)))
    source = urls.canonical(F.col("url")) if canonicalize_sources else F.col("url")
    return links.select(
        source.alias("source_url"),
        "target_url",
        urls.registered_domain(F.col("target_url"), suffixes).alias("domain"),
    )


def out_degree(edges: DataFrame) -> DataFrame:
    """Links per source, parallel ones counted: (source_url, out_degree)."""
    return edges.groupBy("source_url").agg(F.count("*").alias("out_degree"))


def in_links(edges: DataFrame) -> DataFrame:
    """Who links to a target, and how often: (target_url, source_url, n_links).

    One row per pair of neighbours rather than a list per target, which has no bound.
    """
    return edges.groupBy("target_url", "source_url").agg(F.count("*").alias("n_links"))
