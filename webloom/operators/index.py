"""Inverted index: postings, document frequencies and TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import scoring
from webloom.functions import text as tx
from webloom.plans.skew import HotKeys, skew_join

#: Up to so many of the most frequent words are held in memory by every task, of so many bytes on average.
FREQUENT, _WORD_BYTES = 100_000, 40


def page_terms(pages: DataFrame, text: Column, *keep: str) -> DataFrame:
    """Distinct terms of each page with their counts: (*keep, word, cnt, n_terms).

    A page is one row, so its terms are counted inside that row: they are sorted, and a count is
    the distance between the starts of two runs. Nothing is shuffled, and the columns kept are
    not repeated through an exchange.
    """
    ordered = pages.select(*keep, F.sort_array(tx.terms(text)).alias("ws"))
    starts = ordered.select(*keep, "ws", tx.run_starts(F.col("ws")).alias("starts"))
    runs = starts.select(*keep, "ws", "starts", F.posexplode("starts").alias("run", "first"))
    following = F.coalesce(F.get("starts", F.col("run") + 1), F.size("ws"))
    return runs.select(
        *keep,
        F.get("ws", F.col("first")).alias("word"),
        (following - F.col("first")).cast("long").alias("cnt"),
        F.size("ws").cast("long").alias("n_terms"),
    )


def term_counts(pages: DataFrame, text: Column) -> DataFrame:
    """Occurrences of each term of each page: (page_id, word, cnt)."""
    return page_terms(pages, text, "page_id").select("page_id", "word", "cnt")


def build_postings(pages: DataFrame, text: Column, *keep: str) -> DataFrame:
    """One row per page and distinct term: (word, page_id, url, title, tf) and columns to keep, as page_rank."""
    return page_terms(pages, text, "page_id", "url", "title", *keep).select(
        "word", "page_id", "url", "title", (F.col("cnt") / F.col("n_terms")).alias("tf"), *keep
    )


def term_documents(postings: DataFrame) -> DataFrame:
    """Number of pages that hold each word: (word, documents_number)."""
    return postings.groupBy("word").agg(F.count("*").alias("documents_number"))


def merge_term_documents(known: DataFrame, added: DataFrame) -> DataFrame:
    """Counters after more pages were indexed; both frames are (word, documents_number)."""
    return known.unionByName(added).groupBy("word").agg(
        F.sum("documents_number").alias("documents_number")
    )


def corpus_size(pages: DataFrame) -> DataFrame:
    """Number of pages indexed, pages without any term included: one row (n_pages)."""
    return pages.agg(F.count("*").alias("n_pages"))


def idf(documents: DataFrame, corpus: DataFrame) -> DataFrame:
    """Inverse document frequency of each word: (word, documents_number, idf)."""
    return documents.withColumn("idf", scoring.idf(corpus.scalar(), F.col("documents_number")))


def score_postings(postings: DataFrame, corpus: DataFrame, documents: DataFrame | None = None, sliced: bool = True) -> DataFrame:
    """Postings with their tf_idf, other columns are kept.

    The postings are read several times, so pass stored tables. The most frequent words, by the stored
    counters, are held in memory by every task, so their postings do not move; the others are joined by
    word, and one that is in a large share of all pages in slices, unless ``sliced`` is false.
    """
    documents = term_documents(postings) if documents is None else documents
    weights = idf(documents, corpus)
    border = frequent_from(documents)
    if border is None:
        hot = HotKeys(documents, "word", "documents_number") if sliced else None
        scored = skew_join(postings, weights.select("word", "idf"), "word", ["page_id"], hot)
    else:
        often = F.col("documents_number") >= border
        frequent = F.broadcast(weights.filter(often).select("word", "idf"))
        hot = HotKeys(documents.filter(~often), "word", "documents_number") if sliced else None
        others = postings.join(frequent, "word", "left_anti")
        rare = skew_join(others, weights.filter(~often).select("word", "idf"), "word", ["page_id"], hot)
        scored = postings.join(frequent, "word").unionByName(rare)
    return scored.select(*postings.columns, (F.col("tf") * F.col("idf")).alias("tf_idf"))


def frequent_from(documents: DataFrame, most: int = FREQUENT) -> int | None:
    """The least number of pages from which on words are ``most`` at most, and no longer than ``_WORD_BYTES``
    on average; None if even the most frequent are more."""
    # a row per power of the eighth root of two
    level = F.floor(8 * F.log2("documents_number"))
    found = documents.filter("word IS NOT NULL AND documents_number > 0").groupBy(level.alias("level")).agg(
        F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("n_bytes"), F.min("documents_number").alias("least")
    )
    border, n, n_bytes = None, 0, 0
    for row in sorted(found.collect(), reverse=True):
        n, n_bytes = n + row.n, n_bytes + row.n_bytes
        if n > most or n_bytes > most * _WORD_BYTES:
            break
        border = row.least
    return border
