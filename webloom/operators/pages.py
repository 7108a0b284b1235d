"""Pages: crawl outcome, titles, text and first-wins parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import permissions as pm
from webloom.functions import text as tx
from webloom.functions import urls
from webloom.functions.html import html_fields
from webloom.functions.keys import page_key


def with_fields(pages: DataFrame, *fields: str) -> DataFrame:
    """Pages with a struct column ``fields`` in place of their HTML."""
    others = [c for c in pages.columns if c != "html"]
    return pages.select(*others, html_fields(F.col("html"), *fields).alias("fields"))


def page_title(fields: Column, url: Column) -> Column:
    """Title of a page, with fallbacks.

    The title element, else the og:title or else the twitter:title tag, else the first existing
    heading. A meta tag that is there but empty goes on to the URL, headings are not tried.
    """
    titled = F.nullif(tx.strip(fields["title"]), F.lit(""))
    from_meta = F.coalesce(fields["og_title"], fields["twitter_title"])
    found = F.when(titled.isNotNull(), titled).when(from_meta.isNotNull(), from_meta).otherwise(fields["heading"])
    empty = F.coalesce(found, F.lit("")) == ""
    return tx.strip(F.when(empty, urls.url_title(url)).otherwise(found))


TITLE_FIELDS = ("title", "og_title", "twitter_title", "heading")


def titled_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) to (page_id, url, title)."""
    parsed = with_fields(pages.select("page_id", "url", "html"), *TITLE_FIELDS)
    return parsed.select("page_id", "url", page_title(F.col("fields"), F.col("url")).alias("title"))


def page_text(fields: Column, scope: str = "title_else_body") -> Column:
    """Text that is indexed: the title where there is one and else the body, or both."""
    title, body = fields["title"], F.coalesce(fields["body_text"], F.lit(""))
    if scope == "title_else_body":
        return F.coalesce(title, body)
    if scope == "title_and_body":
        return F.concat_ws(" ", title, F.nullif(body, F.lit("")))
    raise ValueError(f"unknown scope {scope!r}")


def page_texts(pages: DataFrame, scope: str = "title_else_body") -> DataFrame:
    """Pages (page_id, url, html) to (page_id, url, title, text)."""
    parsed = with_fields(pages.select("page_id", "url", "html"), *TITLE_FIELDS, "body_text")
    return parsed.select(
        "page_id",
        "url",
        page_title(F.col("fields"), F.col("url")).alias("title"),
        page_text(F.col("fields"), scope).alias("text"),
    )


def indexable(crawled: DataFrame) -> DataFrame:
    """Crawl results that may be indexed."""
    return crawled.filter("indexation")


def first_per_url(pages: DataFrame) -> DataFrame:
    """The row with the lowest page_id per URL.

    Ids, which are unique, are combined per URL by hash aggregation, before the shuffle; the other
    columns are joined back to the ids that remain. Rows without a URL are left out.
    """
    firsts = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return pages.join(firsts, ["url", "page_id"], "left_semi")


def new_pages(pages: DataFrame, known: DataFrame) -> DataFrame:
    """First row per URL among pages whose URL is not known yet."""
    return first_per_url(pages).join(known.select("url").distinct(), "url", "left_anti").select(pages.columns)


def parse_pages(crawled: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Crawl results (page_id, url, indexation, html) to new pages (page_id, url, title)."""
    allowed = indexable(crawled) if "indexation" in crawled.columns else crawled
    # known and repeated URLs go before any HTML is parsed
    fresh = first_per_url(allowed) if known is None else new_pages(allowed, known)
    return titled_pages(fresh)


def pending(pages: DataFrame, processed: DataFrame, flag: str) -> DataFrame:
    """Pages with a boolean column that tells which ids were processed."""
    done = processed.select("page_id").distinct().withColumn(flag, F.lit(True))
    return pages.join(done, "page_id", "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def batch(pages: DataFrame, flag: str, n: int = 10) -> DataFrame:
    """The next n unprocessed pages, by id."""
    return pages.filter(~F.col(flag)).orderBy("page_id").limit(n)


def crawl_outcome(fetched: DataFrame, as_of: Column) -> DataFrame:
    """What a crawl leaves behind per URL: (url, indexation, follow, page_key).

    Takes (url, can_visit, content_type, headers, meta_robots, fetched). A page that was refused,
    not fetched or not a page is not indexed and has no key; a noindex page may be followed. NULL in
    can_visit or fetched counts as false.
    """
    allowed = pm.page_permissions(F.col("headers"), F.col("meta_robots"), as_of)
    stored = F.coalesce(F.col("can_visit") & F.col("fetched") & pm.is_page_content(F.col("content_type")), F.lit(False))
    decided = fetched.select("url", stored.alias("stored"), allowed.alias("allowed"))
    return decided.select(
        "url",
        (F.col("stored") & F.col("allowed.index")).alias("indexation"),
        (F.col("stored") & F.col("allowed.follow")).alias("follow"),
        F.when(F.col("stored"), page_key(F.col("url"))).alias("page_key"),
    )
