"""First page of each URL, without moving any HTML.

Which pages are new is found out from ids and URLs alone. URLs that a Bloom filter of the known ones lets
through are checked exactly; the others need no check. To get at the HTML of the winners no join is made
with them: a second filter holds the pages that lost, and a scan drops what it holds. The few winners that
this filter holds by mistake are known exactly, and are let through by a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.pages import indexable, titled_pages
from webloom.plans import bloom
from webloom.plans.lineage import materialize

#: Winners that the filter of losers may hold by mistake and a broadcast list lets through. With more of them
#: (a filter too small for the losers) the HTML is joined to the winners after all.
LISTED = 200_000


def known_filter(known: DataFrame, bits: int = bloom.BITS) -> bytes:
    """Filter of known URLs (url); it can be kept beside them."""
    return bloom.build(known.select(F.xxhash64("url").alias("hash")), bits)


def first_new_ids(pages: DataFrame, known: DataFrame | None = None, known_bits: bytes | None = None, bits: int = bloom.BITS) -> DataFrame:
    """The lowest page_id (page_id, url) of each URL that is not known yet, from pages (page_id, url)."""
    firsts = pages.filter("url IS NOT NULL AND page_id IS NOT NULL").groupBy("url").agg(F.min("page_id").alias("page_id"))
    if known is None:
        return firsts.select("page_id", "url")
    firsts = materialize(firsts.select("page_id", "url"), "firsts")
    packed = known_filter(known, bits) if known_bits is None else known_bits
    marked = firsts.withColumn("maybe", bloom.may_hold(packed, F.xxhash64("url"), firsts, bits))
    doubtful = marked.filter("maybe").drop("maybe").join(known.select("url").distinct(), "url", "left_anti")
    return marked.filter("NOT maybe").drop("maybe").unionByName(doubtful.select("page_id", "url"))


def keep_first_new(
    pages: DataFrame, known: DataFrame | None = None, known_bits: bytes | None = None, bits: int = bloom.BITS, listed: int = LISTED
) -> DataFrame:
    """All columns of the first page of each new URL, as ``pages.new_pages`` gives them.

    Ids are unique. ``pages`` is read twice, the first time without its other columns. Pages without a URL
    are left out.
    """
    ids = pages.select("page_id", "url")
    winners = materialize(first_new_ids(ids, known, known_bits, bits), "first_ids")
    place = F.xxhash64("page_id", "url")
    losers = ids.filter("url IS NOT NULL AND page_id IS NOT NULL").join(winners, ["page_id", "url"], "left_anti")
    packed = bloom.build(losers.select(place.alias("hash")), bits)
    held = winners.filter(bloom.may_hold(packed, place, winners, bits))
    held = materialize(held, "held_by_mistake")
    complete = pages.filter("url IS NOT NULL AND page_id IS NOT NULL")
    if held.limit(listed + 1).count() > listed:
        return complete.join(winners, ["page_id", "url"], "left_semi").select(pages.columns)
    marked = complete.withColumn("__held", bloom.may_hold(packed, place, pages, bits))
    allowed = held.select("page_id", "url", F.lit(True).alias("__listed"))
    marked = marked.join(F.broadcast(allowed), ["page_id", "url"], "left")
    return marked.filter(~F.col("__held") | F.col("__listed")).select(pages.columns)


def parse_first_pages(crawled: DataFrame, known: DataFrame | None = None, known_bits: bytes | None = None, bits: int = bloom.BITS) -> DataFrame:
    """Crawl results (page_id, url, indexation, html) to new pages (page_id, url, title), as ``pages.parse_pages``."""
    allowed = indexable(crawled) if "indexation" in crawled.columns else crawled
    return titled_pages(keep_first_new(allowed.select("page_id", "url", "html"), known, known_bits, bits))
