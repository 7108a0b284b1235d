"""An inverted index in immutable segments, for pages that keep coming.

A segment holds the postings of some pages in word order, beside its own word counters:
``segments/<name>/postings`` and ``segments/<name>/term_documents``. A manifest names the segments that
make up a version of the index; a version is complete once its manifest is. Adding pages writes one small
segment. Segments of a size tier are merged into one as soon as there are ``FANOUT`` of them, so there are
never more than a few per power of ``FANOUT``, and a posting is written again once per tier.

Postings hold no scores. A refresh writes the statistics that scores are made of, document frequencies,
corpus size and page ranks, and ties them to a version of the index. ``scored`` joins them to postings when
a search reads these, and since that join is by word, a search reads the statistics of its words only. So a
refresh rewrites no posting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import index as ix
from webloom.operators.search import postings_of
from webloom.plans.lineage import discard_folders, exists, folders, shuffles_removed
from webloom.sources import tables
from webloom.sources.layout import write_index

#: So many segments of a size tier are merged; a tier is as many times larger than the one before.
FANOUT = 4

# Bytes of text that make a posting, at least: a word, what is after it, and its repeats.
_POSTING_BYTES = 8

POSTINGS = "word STRING, page_id BIGINT, url STRING, title STRING, tf DOUBLE"
PAGES = "page_id BIGINT, url STRING"
_MANIFEST = "segment STRING, n_pages BIGINT, n_postings BIGINT"
_STATISTICS = "n_pages BIGINT, index_version BIGINT, ranked BOOLEAN"
RANKS = "url STRING, page_rank DOUBLE"


@dataclass(frozen=True)
class Segment:
    name: str
    n_pages: int
    n_postings: int

    @property
    def tier(self) -> int:
        tier, size = 0, self.n_postings
        while size >= FANOUT:
            tier, size = tier + 1, size // FANOUT
        return tier


def _versions(spark: SparkSession, path: str, kind: str) -> list[int]:
    found = [int(name.removeprefix("version=")) for name in folders(spark, f"{path}/{kind}") if name.startswith("version=")]
    return sorted(v for v in found if exists(spark, f"{path}/{kind}/version={v}/_SUCCESS"))


def segments(spark: SparkSession, path: str, version: int | None = None) -> list[Segment]:
    """The segments of a version of the index, or of the newest; few, as they are merged by tiers."""
    complete = _versions(spark, path, "manifest")
    if version is None:
        version = complete[-1] if complete else None
    if version is None:
        return []
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={version}").collect()
    return sorted((Segment(*row) for row in rows), key=lambda s: s.name)


def newest(spark: SparkSession, path: str) -> int | None:
    """Number of the newest complete version."""
    complete = _versions(spark, path, "manifest")
    return complete[-1] if complete else None


def _read(spark: SparkSession, path: str, live: list[Segment], table: str, schema: str) -> DataFrame:
    paths = [f"{path}/segments/{s.name}/{table}" for s in live]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_postings(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Postings (word, page_id, url, title, tf) of all segments; a filter on words reaches each of them."""
    return _read(spark, path, segments(spark, path, version), "postings", POSTINGS)


def read_pages(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Pages indexed (page_id, url), those without any word included."""
    return _read(spark, path, segments(spark, path, version), "pages", PAGES)


def read_counters(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Document frequencies (word, documents_number), added up over the segments."""
    counted = _read(spark, path, segments(spark, path, version), "term_documents", tables.TERM_DOCUMENTS)
    return counted.groupBy("word").agg(F.sum("documents_number").alias("documents_number"))


def _publish(spark: SparkSession, path: str, version: int, live: list[Segment]) -> None:
    rows = spark.createDataFrame([(s.name, s.n_pages, s.n_postings) for s in live], _MANIFEST)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def _write_counters(counted: DataFrame, path: str) -> None:
    with shuffles_removed(counted.sparkSession):
        counted.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(path)


def _write_segment(
    spark: SparkSession, path: str, name: str, postings: DataFrame, pages: DataFrame, n_postings: int, at_once: bool = False
) -> Segment:
    """``n_postings``, if only about, is for the number of tasks: what each of them sorts shall fit in its memory."""
    where = f"{path}/segments/{name}"
    write_index(postings, f"{where}/postings", mode="overwrite", n_postings=n_postings, at_once=at_once)
    pages.select("page_id", "url").write.mode("overwrite").parquet(f"{where}/pages")
    stored = spark.read.schema(POSTINGS).parquet(f"{where}/postings")
    _write_counters(ix.term_documents(stored), f"{where}/term_documents")
    n_postings = stored.count()
    return Segment(name, spark.read.schema(PAGES).parquet(f"{where}/pages").count(), n_postings)


def add_pages(
    pages: DataFrame, path: str, version: int, text_column: str = "text", merge: bool = True, spread: int | None = None
) -> list[Segment]:
    """Publish a version of the index with more pages (page_id, url, title, text); returns its segments.

    ``spread`` shares the pages out over that many tasks, for batches of fewer files than cores.
    Versions are numbered by the caller, as by the id of a micro-batch. One that is complete is left as it
    is, so pages that come again with the same number are not indexed twice.
    """
    spark = pages.sparkSession
    complete = _versions(spark, path, "manifest")
    if version in complete:
        return segments(spark, path, version)
    earlier = [v for v in complete if v < version]
    live = segments(spark, path, earlier[-1]) if earlier else []
    postings = ix.build_postings(pages if spread is None else pages.repartition(spread), F.col(text_column))
    n_bytes = pages.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    live.append(_write_segment(spark, path, f"{version:09d}", postings, pages, n_bytes // _POSTING_BYTES, at_once=True))
    if merge:
        live = _merged(spark, path, version, live)
    _publish(spark, path, version, live)
    return live


def _merged(spark: SparkSession, path: str, version: int, live: list[Segment]) -> list[Segment]:
    """Merge every tier that is full, the smallest first; the result is of a higher one."""
    for n in range(len(live)):
        tiers = [s.tier for s in live]
        full = [t for t in sorted(set(tiers)) if tiers.count(t) >= FANOUT]
        if not full:
            break
        old = [s for s in live if s.tier == full[0]]
        name = f"{version:09d}-{n + 1}"
        postings, pages = _read(spark, path, old, "postings", POSTINGS), _read(spark, path, old, "pages", PAGES)
        merged = _write_segment(spark, path, name, postings, pages, sum(s.n_postings for s in old))
        live = [s for s in live if s.tier != full[0]] + [merged]
    return live


def refresh(spark: SparkSession, path: str, version: int, ranks: DataFrame | None = None) -> None:
    """Publish statistics for a version of the index: document frequencies, corpus size and ranks (url, page_rank)."""
    if version in _versions(spark, path, "statistics"):
        return
    live = segments(spark, path, version)
    where = f"{path}/scores/version={version}"
    _write_counters(read_counters(spark, path, version), f"{where}/term_documents")
    if ranks is not None:
        ranks.select("url", "page_rank").write.mode("overwrite").parquet(f"{where}/ranks")
    row = spark.createDataFrame([(sum(s.n_pages for s in live), version, ranks is not None)], _STATISTICS)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics/version={version}")


@dataclass(frozen=True)
class Statistics:
    """What the newest refresh published."""

    version: int
    n_pages: int
    documents: DataFrame
    ranks: DataFrame | None


def statistics(spark: SparkSession, path: str) -> Statistics | None:
    complete = _versions(spark, path, "statistics")
    if not complete:
        return None
    n_pages, version, ranked = spark.read.schema(_STATISTICS).parquet(f"{path}/statistics/version={complete[-1]}").first()
    where = f"{path}/scores/version={version}"
    documents = tables.read_table(spark, f"{where}/term_documents", tables.TERM_DOCUMENTS)
    return Statistics(version, n_pages, documents, tables.read_table(spark, f"{where}/ranks", RANKS) if ranked else None)


def scored(spark: SparkSession, path: str, all_words: bool = False, words: DataFrame | None = None) -> DataFrame:
    """The index as of the newest refresh: (word, page_id, url, title, tf, tf_idf), for the functions of ``operators.search``.

    Pass the ranks of ``statistics`` to a search as its pages. A search filters on words, and the filter
    reaches postings and statistics alike. The most frequent words are scored where their postings lie. With
    ``all_words`` others of many pages are joined in slices, for a job that reads the whole index. Pass the distinct
    ``words`` (word) of a table of queries, stored, and no other postings are scored.
    """
    known = statistics(spark, path)
    if known is None:
        return spark.createDataFrame([], tables.INVERTED_INDEX)
    corpus = spark.range(1).select(F.lit(known.n_pages).cast("long").alias("n_pages"))
    postings = read_postings(spark, path, known.version)
    postings = postings if words is None else postings_of(postings, words, documents=known.documents)
    rows = ix.score_postings(postings, corpus, known.documents, sliced=all_words)
    return rows.select("word", "page_id", "url", "title", "tf", "tf_idf")


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete what neither the newest ``keep`` versions of the index nor of the statistics name."""
    complete, refreshed = _versions(spark, path, "manifest"), _versions(spark, path, "statistics")
    kept = {*complete[-keep:], *refreshed[-keep:]}
    old = [v for v in complete if v not in kept]
    used = {s.name for v in kept & {*complete} for s in segments(spark, path, v)}
    gone = [name for name in folders(spark, f"{path}/segments") if name not in used and int(name.split("-")[0]) <= (complete or [-1])[-1]]
    discard_folders(
        spark,
        *[f"{path}/manifest/version={v}" for v in old],
        *[f"{path}/{kind}/version={v}" for v in refreshed[:-keep] for kind in ("statistics", "scores")],
        *[f"{path}/segments/{name}" for name in gone],
    )
