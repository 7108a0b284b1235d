"""Keyword search: every term must match, results ranked by TF-IDF and PageRank.

The index is a frame of scored postings (word, page_id, url, title, tf_idf) that carry the page_rank of
their page, so a search reads the postings of its words and nothing else. For an index without ranks
pass the pages (url, page_rank); they are joined to the matches only. Unscored words add nothing to a
sum; a page without any scored word, or without a rank, has a NULL score and ranks first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import scoring
from webloom.functions import text as tx
from webloom.plans.lineage import materialize
from webloom.plans.skew import HotKeys, skew_join

# Up to this many distinct query words, of this many bytes, are held in memory by every task;
# more are shuffled.
WORDS_IN_MEMORY = 100_000
_WORD_BYTES_IN_MEMORY = 16 << 20

#: Words of queries that are answered together, and postings that one task holds.
TERMS_TOGETHER, POSTINGS_OF_TASK = 1 << 20, 1 << 20
_ANSWERS_TOGETHER = 1 << 16

# Scores that agree to this many digits are equal: the order in which a sum is added up is not
# fixed, and ties are broken by page.
_SCORE_DIGITS = 12
_SLACK = 1e-11
# Stands for a sum of no scores, which no sum of logarithms comes to.
_NO_TEXT = -np.inf

# A partial top-k before the shuffle is planned by Spark up to this limit.
_PARTIAL_TOP_K = 1000


def parse_query(index: DataFrame, query: str, strip_punct: bool = False) -> list[str]:
    """Distinct terms of one query, in order, made by the same expression as index terms."""
    one_row = index.sparkSession.range(1)
    found = one_row.select(F.array_distinct(tx.query_terms(F.lit(query), strip_punct)).alias("terms"))
    return found.first()["terms"]


def and_pages(index: DataFrame, terms: list[str]) -> DataFrame:
    """Pages that hold every term: (page_id). One pass over the postings of the terms."""
    if not terms:
        return index.limit(0).select("page_id")
    matches = index.filter(F.col("word").isin(terms)).groupBy("page_id").agg(
        *[F.max(F.col("word") == term).alias(f"has_{i}") for i, term in enumerate(terms)]
    )
    return matches.filter(_all_true(len(terms))).select("page_id")


def and_pages_intersect(index: DataFrame, terms: list[str]) -> DataFrame:
    """The same pages as an INTERSECT of one page set per term."""
    sets = [index.filter(F.col("word") == term).select("page_id") for term in terms]
    return reduce(DataFrame.intersect, sets) if sets else index.limit(0).select("page_id")


def _best_first(score: str) -> list[Column]:
    return [F.desc_nulls_first(F.round(score, _SCORE_DIGITS)), F.asc("page_id")]


def _all_true(n: int) -> Column:
    return reduce(Column.__and__, [F.col(f"has_{i}") for i in range(n)], F.lit(n > 0))


def matching_postings(index: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of the terms on the pages that hold all of them, with one shuffle by page."""
    of_page = Window.partitionBy("page_id")
    hits = index.filter(F.col("word").isin(terms)).select(
        "*", *[F.max(F.col("word") == term).over(of_page).alias(f"has_{i}") for i, term in enumerate(terms)]
    )
    return hits.filter(_all_true(len(terms))).drop(*[f"has_{i}" for i in range(len(terms))])


def _limited(rows: DataFrame, order: list[Column], n_results: int) -> DataFrame:
    if n_results < -1:
        raise ValueError("n_results must be -1 (no limit) or more")
    ordered = rows.orderBy(*order)
    return ordered if n_results == -1 else ordered.limit(n_results)


def _with_rank(matches: DataFrame, pages: DataFrame | None) -> DataFrame:
    return matches if pages is None else matches.join(pages.select("url", "page_rank"), "url")


def search_rows(
    index: DataFrame, pages: DataFrame | None, query: str, n_results: int = 20, strip_punct: bool = False
) -> DataFrame:
    """Result rows in rank order: (page_id, title, url, score, order_key, n_words).

    Rows are grouped by tf_idf as well, so a page shows once per distinct tf_idf of its matched
    words. Words with an equal tf_idf share a row: its score counts one of them, its order key
    all of them. The groups use the shuffle by page that found the matches.
    """
    hits = _with_rank(matching_postings(index, parse_query(index, query, strip_punct)), pages)
    rows = hits.groupBy("page_id", "title", "url", "tf_idf", "page_rank").agg(
        (F.sum(scoring.text_score(F.col("tf_idf"))) + scoring.rank_score(F.max("page_rank"))).alias("order_key"),
        F.count("*").alias("n_words"),
    )
    scored = rows.select(
        "page_id",
        "title",
        "url",
        "tf_idf",
        (scoring.text_score(F.col("tf_idf")) + scoring.rank_score(F.col("page_rank"))).alias("score"),
        "order_key",
        "n_words",
    )
    return _limited(scored, [*_best_first("order_key"), F.asc("tf_idf")], n_results).drop("tf_idf")


def search_pages(
    index: DataFrame, pages: DataFrame | None, query: str, n_results: int = 20, strip_punct: bool = False
) -> DataFrame:
    """One row per page in rank order: (page_id, title, url, score).

    The score is the sum of the text scores of all matched words plus one PageRank score. One
    aggregation by page, combined before its shuffle, finds the matches and scores them.
    """
    terms = parse_query(index, query, strip_punct)
    found = [F.max(F.col("word") == term).alias(f"has_{i}") for i, term in enumerate(terms)]
    rank = [F.max("page_rank").alias("page_rank")] if pages is None else []
    by_page = index.filter(F.col("word").isin(terms)).groupBy("page_id", "title", "url")
    matches = by_page.agg(F.sum(scoring.text_score(F.col("tf_idf"))).alias("text"), *rank, *found)
    matches = _with_rank(matches.filter(_all_true(len(terms))), pages)
    score = F.col("text") + scoring.rank_score(F.col("page_rank"))
    return _limited(matches.select("page_id", "title", "url", score.alias("score")), _best_first("score"), n_results)


def search_count(rows: DataFrame) -> DataFrame:
    """Number of results with its message: one row (n_results, message)."""
    n = rows.agg(F.count("*").alias("n_results"))
    return n.withColumn(
        "message",
        F.when(F.col("n_results") == 0, "No results")
        .when(F.col("n_results") == 1, "1 result")
        .otherwise(F.concat(F.col("n_results").cast("string"), F.lit(" results"))),
    )


def search_batch(
    index: DataFrame,
    pages: DataFrame | None,
    queries: DataFrame,
    k: int = 20,
    strip_punct: bool = False,
    words_in_memory: int = WORDS_IN_MEMORY,
    documents: DataFrame | None = None,
    terms_together: int = TERMS_TOGETHER,
) -> DataFrame:
    """Answer a table of queries (query_id, query): (query_id, page_id, title, url, score, rank).

    Equal queries are answered once. Queries with a word that is on no page, by the stored counters (word,
    documents_number) if they are passed, fall out first. The postings of the others' words, without title
    and URL, are shuffled once, by page, so that a task has all asked words of its pages. There the pages of
    each query are met by intersecting those of its words, the shortest list first; pairs of queries and
    pages are not shuffled. Only the best k of each task reach the ranking of a query, and titles and URLs
    are fetched for the answers. Every task holds the numbers of the words of all queries; queries of over
    ``terms_together`` words in all are answered in several goes.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    as_terms = F.sort_array(F.array_distinct(tx.query_terms(F.col("query"), strip_punct)))
    named = queries.select("query_id", F.array_join(as_terms, "\n").alias("terms")).filter("terms <> ''")
    named = materialize(named, "queries")
    numbered = named.select("terms").distinct().withColumn("asked", F.monotonically_increasing_id())
    numbered = materialize(numbered, "asked")
    terms = numbered.select("asked", F.explode(F.split("terms", "\n")).alias("word"))
    terms = materialize(terms, "asked_terms")

    words = terms.select("word").distinct()
    if documents is None:
        frequency = postings_of(index, words, words_in_memory).groupBy("word").agg(F.count("*").alias("n"))
    else:
        frequency = documents.join(words, "word", "left_semi").select("word", F.col("documents_number").alias("n"))
    frequency = materialize(frequency.withColumn("number", F.monotonically_increasing_id()), "asked_words")
    asking = HotKeys(terms.groupBy("word").agg(F.count("*").alias("n")), "word", "n")
    # the words of a query, the rarest first
    asked = (
        skew_join(terms, frequency, "word", ["asked"], asking, "left")
        .groupBy("asked")
        .agg(F.sort_array(F.collect_list(F.struct("n", "number"))).alias("words"), F.count("n").alias("found"), F.count("*").alias("n_terms"))
        .filter(F.col("found") == F.col("n_terms"))
        .select("asked", F.col("words.number").alias("numbers"))
    )
    asked = materialize(asked, "answerable")
    n_terms = asked.agg(F.sum(F.size("numbers"))).first()[0] or 0
    goes = max(1, -(-n_terms // terms_together))
    found = []
    for go in range(goes):
        some = asked.filter(F.pmod(F.xxhash64("asked"), F.lit(goes)) == go)
        found.append(_matches(index, some, frequency, k, words_in_memory, documents, pages is None))
    best = reduce(DataFrame.unionByName, found)
    if pages is None:
        best = materialize(top_k(best.withColumn("score", F.col("text") + F.col("rank_score")), "asked", k), "best")
        best = _with_titles(best, index, asked, frequency, words_in_memory, documents, best.count() <= words_in_memory)
    else:
        titled = _with_titles(best, index, asked, frequency, words_in_memory, documents, False)
        scored = _with_rank(titled, pages).withColumn("score", F.col("text") + scoring.rank_score(F.col("page_rank")))
        best = top_k(scored.select("asked", "page_id", "title", "url", "score"), "asked", k)
    wanting = named.join(numbered, "terms").select("query_id", "asked")
    return wanting.join(best, "asked").select("query_id", "page_id", "title", "url", "score", "rank")


def _variant() -> Column:
    """Which title and URL a page goes by: an id may be indexed with several."""
    return F.xxhash64(F.col("title").isNull(), "title", F.col("url").isNull(), "url").alias("variant")


def _matches(
    index: DataFrame, asked: DataFrame, frequency: DataFrame, k: int, words_in_memory: int, documents: DataFrame | None, ranked: bool
) -> DataFrame:
    """Pages that hold all words of a query: (asked, number, page_id, variant, text, rank_score).

    ``number`` is that of the query's rarest word. With ranks in the index, what cannot be among the best k
    of a task is left out.
    """
    spark = index.sparkSession
    words = materialize(frequency.join(asked.select(F.explode("numbers").alias("number")).distinct(), "number", "left_semi"), "words")
    n_postings = words.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_postings // POSTINGS_OF_TASK))
    shared = spark.sparkContext.broadcast(asked.toArrow())
    used = postings_of(index, words.select("word", "number"), words_in_memory, documents, "inner").filter("page_id IS NOT NULL")
    rank = scoring.rank_score(F.col("page_rank")) if ranked else F.lit(None).cast("double")
    used = used.select("number", "page_id", _variant(), scoring.text_score(F.col("tf_idf")).alias("text"), rank.alias("rank_score"))
    page_type = index.schema["page_id"].dataType.simpleString()
    schema = f"asked LONG, number LONG, page_id {page_type}, variant LONG, text DOUBLE, rank_score DOUBLE"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = [batch for batch in batches if batch.num_rows]
        if postings:
            yield from PagePostings(pa.Table.from_batches(postings)).answers(shared.value, k if ranked else None)

    return used.repartition(tasks, "page_id").mapInArrow(run, schema)


def _with_titles(
    found: DataFrame, index: DataFrame, asked: DataFrame, frequency: DataFrame, words_in_memory: int, documents: DataFrame | None, few: bool
) -> DataFrame:
    """The pages found, with title and URL, which come from the postings of each query's rarest word."""
    rarest = frequency.join(asked.select(F.get("numbers", F.lit(0)).alias("number")).distinct(), "number", "left_semi")
    keys = ["number", "page_id", "variant"]
    postings = postings_of(index, materialize(rarest.select("word", "number"), "rarest"), words_in_memory, documents, "inner")
    postings = postings.select("number", "page_id", _variant(), "title", "url")
    wanted = found.select(keys).distinct()
    titles = postings.join(F.broadcast(wanted) if few else wanted, keys, "left_semi").dropDuplicates(keys)
    return found.join(titles, keys)


class PagePostings:
    """Postings of some pages by word, all asked words of a page among them."""

    def __init__(self, postings: pa.Table):
        numbers, variants = (postings.column(name).to_numpy() for name in ("number", "variant"))
        coded = postings.column("page_id").combine_chunks().dictionary_encode()
        self.ids, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        order = np.lexsort((variants, codes))
        starts = _starts(codes[order], variants[order])
        page = np.empty(len(order), np.int64)
        page[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        self.codes, self.variants, n_pages = codes[order[starts]], variants[order[starts]], len(starts)
        self.words, word = np.unique(numbers, return_inverse=True)
        order = np.lexsort((page, word))
        starts = _starts(word[order], page[order])
        (text, scored), (rank, placed) = (_filled(postings.column(name)) for name in ("text", "rank_score"))
        # a page that is indexed twice has each word twice; sums leave out what is NULL
        self.text = np.add.reduceat(np.where(scored, text, 0.0)[order], starts)
        self.scored = np.logical_or.reduceat(scored[order], starts)
        self.rank = np.maximum.reduceat(np.where(placed, rank, -np.inf)[order], starts)
        self.pages = page[order[starts]]
        self.borders = np.searchsorted(word[order[starts]], np.arange(len(self.words) + 1))

    def answers(self, queries: pa.Table, k: int | None) -> Iterator[pa.RecordBatch]:
        """The pages of each query (asked, numbers), which cannot be ruled out of its best k."""
        asked, lists = queries.column("asked").to_numpy(), queries.column("numbers").combine_chunks()
        numbers, stops = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(self.words, numbers), len(self.words) - 1)
        missing = np.concatenate([[0], np.cumsum(self.words[at] != numbers)])
        rows, n = [], 0
        for query in np.flatnonzero(missing[stops[1:]] == missing[stops[:-1]]).tolist():
            start = stops[query]
            pages, text, rank = self._pages(at[start : stops[query + 1]], k)
            if len(pages):
                rows.append((np.full(len(pages), asked[query]), np.full(len(pages), numbers[start]), pages, text, rank))
                n += len(pages)
            if n > _ANSWERS_TOGETHER:
                yield self._batch(rows)
                rows, n = [], 0
        if rows:
            yield self._batch(rows)

    def _pages(self, words: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pages that hold some words, their text scores and rank scores (-inf if none)."""
        slices = [slice(self.borders[w], self.borders[w + 1]) for w in words.tolist()]
        pages = None
        for own in sorted(slices, key=lambda s: s.stop - s.start):
            pages = self.pages[own] if pages is None else pages[self._there(own, pages)]
        text, scored, rank = np.zeros(len(pages)), np.zeros(len(pages), bool), np.full(len(pages), -np.inf)
        for own in slices:
            at = own.start + np.searchsorted(self.pages[own], pages)
            text += self.text[at]
            scored |= self.scored[at]
            rank = np.maximum(rank, self.rank[at])
        text = np.where(scored, text, _NO_TEXT)
        if k is not None and len(pages) > k:
            # what has no score comes first; sums of scores in another order differ by less than the slack
            score = np.where(scored & (rank > -np.inf), text + rank, np.inf)
            score[np.isnan(score)] = np.inf
            kept = score >= np.partition(score, len(score) - k)[len(score) - k] - _SLACK
            pages, text, rank = pages[kept], text[kept], rank[kept]
        return pages, text, rank

    def _there(self, own: slice, pages: np.ndarray) -> np.ndarray:
        held = self.pages[own]
        return held[np.minimum(np.searchsorted(held, pages), len(held) - 1)] == pages

    def _batch(self, rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        asked, numbers, pages, text, rank = (np.concatenate(x) for x in zip(*rows))
        columns = {
            "asked": pa.array(asked),
            "number": pa.array(numbers),
            "page_id": self.ids.take(pa.array(self.codes[pages])),
            "variant": pa.array(self.variants[pages]),
            "text": pa.array(text, mask=text == _NO_TEXT),
            "rank_score": pa.array(rank, mask=rank == -np.inf),
        }
        return pa.RecordBatch.from_pydict(columns)


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(sorted_by[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
    return np.flatnonzero(new)


def _filled(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, 0 where they are NULL, and where they are not."""
    return pc.fill_null(values, 0.0).to_numpy(), pc.is_valid(values).to_numpy()


def postings_of(
    index: DataFrame, words: DataFrame, words_in_memory: int = WORDS_IN_MEMORY, documents: DataFrame | None = None, how: str = "left_semi"
) -> DataFrame:
    """Postings of the words in use. The words are broadcast only when measured to be few."""
    n, n_bytes = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if n <= words_in_memory and n_bytes <= _WORD_BYTES_IN_MEMORY:
        return index.join(F.broadcast(words), "word", how)
    hot = None if documents is None else HotKeys(documents, "word", "documents_number")
    return skew_join(index, words, "word", ["page_id"], hot, how)


def top_k(results: DataFrame, by: str, k: int) -> DataFrame:
    """Best k rows per key with their rank, by score (NULL first) and page.

    Spark keeps the best k of each task before the shuffle; for a larger k, where it does not,
    each key is first ranked in slices.
    """
    order = _best_first("score")
    if k > _PARTIAL_TOP_K:
        sliced = Window.partitionBy(by, F.pmod(F.xxhash64("page_id"), F.lit(256))).orderBy(*order)
        results = results.withColumn("rank", F.row_number().over(sliced)).filter(F.col("rank") <= k).drop("rank")
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def answer_json(results: DataFrame) -> DataFrame:
    """One JSON answer per query, in rank order: (query_id, answer). Takes ranked top-k rows."""
    item = F.struct("rank", F.struct("title", "url").alias("result"))  # as many per query as its k
    in_order = F.transform(F.array_sort(F.collect_list(item)), lambda r: r["result"])
    return results.groupBy("query_id").agg(F.to_json(F.struct(in_order.alias("results"))).alias("answer"))
