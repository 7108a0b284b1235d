"""Batched top-k search that reads only blocks of pages which can still hold a result.

Pages are cut in blocks by their number. For every word and block the bounds say how good the best text score
and the best rank in it are. The bounds of a query's words add up to the most that a page of a block can
reach. So the blocks that promise most are searched first; the k-th score found there is a threshold, and of
the other blocks only those above it are searched. Bounds are a small part of the postings (one row for
thousands of them), and the result is the same as that of ``search.search_batch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import scoring
from webloom.functions import text as tx
from webloom.operators.search import postings_of, top_k
from webloom.plans.lineage import discard, materialize, shuffles_removed
from webloom.plans.skew import HotKeys, skew_join
from webloom.sources.layout import word_ranges

#: Pages of a block, by their number, and blocks of each query that are searched to find the threshold.
BLOCK, PROBES = 4096, 4

BOUNDS = "word STRING, block BIGINT, best DOUBLE, rank DOUBLE, unsure BOOLEAN, n BIGINT"

# Sums of scores in another order differ by less than this.
_SLACK = 1e-9


def block_of(size: int = BLOCK) -> Column:
    return F.floor(F.col("page_id") / F.lit(size)).cast("long")


def block_bounds(index: DataFrame, size: int = BLOCK) -> DataFrame:
    """Bounds (word, block, best, rank, unsure, n) of an index whose postings carry the rank of their page.

    ``unsure`` tells of postings without a score or a rank: their pages come before all others.
    """
    unsure = F.col("tf_idf").isNull() | F.col("page_rank").isNull()
    return index.groupBy("word", block_of(size).alias("block")).agg(
        F.max(scoring.text_score(F.col("tf_idf"))).alias("best"),
        F.max(scoring.rank_score(F.col("page_rank"))).alias("rank"),
        F.max(unsure).alias("unsure"),
        F.count("*").alias("n"),
    )


def write_bounds(index: DataFrame, path: str, size: int = BLOCK, n_postings: int = 0) -> None:
    """Store the bounds of an index, in several goes by ranges of words if it has many postings."""
    for k, part in enumerate(word_ranges(index, n_postings)):
        with shuffles_removed(index.sparkSession):
            block_bounds(index.filter(part), size).write.mode("append" if k else "error").parquet(path)


def search_batch_bounded(
    index: DataFrame, bounds: DataFrame, queries: DataFrame, k: int = 20, strip_punct: bool = False, size: int = BLOCK, probes: int = PROBES
) -> DataFrame:
    """Answer a table of queries (query_id, query): (query_id, rank, page_id, title, url, score).

    ``bounds`` are those of the index for blocks of the same size, stored. Equal queries are answered once.
    """
    named, terms, best, used = _answers(index, bounds, queries, k, strip_punct, size, probes)
    asked = terms.select("asked", "terms").distinct()
    discard(used)
    return named.join(asked, "terms").drop("terms").join(best, "asked").drop("asked")


def _answers(
    index: DataFrame, bounds: DataFrame, queries: DataFrame, k: int, strip_punct: bool, size: int, probes: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries by their terms, terms by number, the best k of each, and the blocks that were searched."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    as_terms = F.sort_array(F.array_distinct(tx.query_terms(F.col("query"), strip_punct)))
    named = materialize(queries.select("query_id", F.array_join(as_terms, "\n").alias("terms")).filter("terms <> ''"), "queries")
    numbered = named.select("terms").distinct().withColumn("asked", F.monotonically_increasing_id())
    numbered = materialize(numbered, "asked")
    terms = materialize(numbered.select("asked", "terms", F.explode(F.split("terms", "\n")).alias("word")), "asked_terms")
    words = terms.select("asked", "word")

    blocks = materialize(_promising(bounds, words), "asked_blocks")
    by_promise = Window.partitionBy("asked").orderBy(F.desc("bound"), F.asc("block"))
    probed = blocks.withColumn("place", F.row_number().over(by_promise)).filter(F.col("place") <= probes)
    probed = materialize(probed.drop("place"), "probed_blocks")
    first = materialize(top_k(_scores(index, probed, words, size), "asked", k), "probed_best")
    # a page without a score beats every other; only blocks that may have such pages can change the result then
    least = first.filter(F.col("rank") == k).select("asked", F.coalesce("score", F.lit(float("inf"))).alias("least"))
    others = blocks.join(probed, ["asked", "block"], "left_anti").join(least, "asked", "left")
    others = others.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - _SLACK)).drop("least")
    others = materialize(others, "other_blocks")
    found = first.drop("rank").unionByName(_scores(index, others, words, size))
    used = materialize(probed.unionByName(others), "searched_blocks")
    return named, terms, top_k(found, "asked", k), used


def _promising(bounds: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks (asked, block, n_terms, bound, n) that have every word of a query, and the most that a page can reach there.

    The blocks of a query are those of the word that is in the fewest; the other words are looked up by
    (word, block), a key that is never hot.
    """
    asked = words.select("word").distinct()
    own = materialize(bounds.join(asked, "word", "left_semi"), "asked_bounds")
    frequency = materialize(own.groupBy("word").agg(F.count("*").alias("blocks")), "asked_words")
    rarest = (
        words.join(frequency, "word", "left")
        .groupBy("asked")
        .agg(F.min(F.struct("blocks", "word")).alias("rarest"), F.count("blocks").alias("found"), F.count("*").alias("n_terms"))
        .filter(F.col("found") == F.col("n_terms"))
        .select("asked", "n_terms", F.col("rarest.word").alias("word"))
    )
    candidates = skew_join(own.select("word", "block"), rarest, "word", ["block"], HotKeys(frequency, "word", "blocks"))
    wanted = candidates.select("asked", "block", "n_terms").join(words, "asked")
    each = wanted.join(own, ["word", "block"]).groupBy("asked", "block", "n_terms")
    summed = each.agg(
        (F.sum("best") + F.max("rank")).alias("bound"), F.max("unsure").alias("unsure"), F.sum("n").alias("n"), F.count("*").alias("found")
    )
    bound = F.when(F.col("unsure") | F.col("bound").isNull(), F.lit(float("inf"))).otherwise(F.col("bound"))
    return summed.filter(F.col("found") == F.col("n_terms")).select("asked", "block", "n_terms", bound.alias("bound"), "n")


def _scores(index: DataFrame, blocks: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """Scores (asked, page_id, title, url, score) of the pages of some blocks that have every word of a query."""
    wanted = blocks.select("asked", "block", "n_terms").join(words, "asked")
    wanted = materialize(wanted, "wanted_blocks")
    placed = postings_of(index, wanted.select("word").distinct()).withColumn("block", block_of(size))
    matched = (
        placed.join(wanted, ["word", "block"])
        .groupBy("asked", "page_id", "title", "url", "n_terms")
        .agg(
            F.sum(scoring.text_score(F.col("tf_idf"))).alias("text"),
            F.size(F.collect_set("word")).alias("matched"),
            F.max("page_rank").alias("page_rank"),
        )
        .filter(F.col("matched") == F.col("n_terms"))
    )
    score = F.col("text") + scoring.rank_score(F.col("page_rank"))
    return matched.select("asked", "page_id", "title", "url", score.alias("score"))
