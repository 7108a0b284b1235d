"""PageRank over the graph of parts bought one after the other."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import common as c
from webloom.operators import rank as rk
from webloom.operators import rerank
from webloom.plans.lineage import materialize

# Sweeps of the original; the bench also times ten.
_STEPS = 100


def _url(column):
    return F.concat(F.lit("https://shop.example.com/part/"), F.col(column).cast("string"))


def bought_next(spark, sf_dir, *keep):
    """Edges from each part of an order to the next part of the same order."""
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = c.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pairs = lines.withColumn("next", F.lead("l_partkey").over(in_order)).filter("next IS NOT NULL")
    return pairs.select(_url("l_partkey").alias("source_url"), _url("next").alias("target_url"), *keep)


def parts(spark, sf_dir):
    return c.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), _url("p_partkey").alias("url"))


def _pagerank(spark, sf_dir, iterations=_STEPS):
    pages = parts(spark, sf_dir)
    ranks = rk.pagerank(pages, bought_next(spark, sf_dir), pages.count(), iterations=iterations)
    return ranks.select("url", F.round("page_rank", 9).alias("page_rank"))


def pagerank_ten(spark, sf_dir):
    return _pagerank(spark, sf_dir, iterations=10)


def _pagerank_update(spark, sf_dir):
    """Ranks of the graph without the orders of every hundredth number, brought up to date with them."""
    pages = parts(spark, sf_dir)
    edges = materialize(bought_next(spark, sf_dir, "l_orderkey"), "edges")
    old, added = edges.filter("l_orderkey % 100 <> 0"), edges.filter("l_orderkey % 100 = 0")
    n = pages.count()
    ranks = rk.pagerank(pages, old, n, iterations=_STEPS)
    updated = rerank.update_ranks(ranks, n, pages, n, old, added)
    return updated.ranks.select("url", F.round("page_rank", 9).alias("page_rank"))


def _pagerank_pages(spark, sf_dir):
    """Ranks on pages; only the parts of one brand count as indexed pages."""
    pages = parts(spark, sf_dir)
    indexed = pages.join(
        c.table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("page_id")), "page_id"
    )
    ranks = rk.pagerank(indexed, bought_next(spark, sf_dir), indexed.count(), iterations=_STEPS)
    ranked = rk.rank_pages(pages, ranks)
    return ranked.select("page_id", "url", F.round("page_rank", 9).alias("page_rank"))


def _sql(pages: str, result: str) -> str:
    steps = [
        f"""
    step{k} AS MATERIALIZED (
      SELECT url, CASE WHEN is_target THEN 0.15 / (SELECT n FROM total) + 0.85 * coalesce(part, 0) ELSE rank END AS rank,
             is_target
      FROM step{k - 1} LEFT JOIN (
        SELECT target AS url, sum(rank * w) AS part
        FROM weights JOIN step{k - 1} ON source = step{k - 1}.url GROUP BY target) USING (url))"""
        for k in range(1, _STEPS + 1)
    ]
    return f"""WITH
    bought AS (SELECT l_partkey AS source,
                      lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target
               FROM lineitem),
    edges AS (SELECT source, target FROM bought WHERE target IS NOT NULL),
    degrees AS (SELECT source, count(*) AS degree FROM edges GROUP BY source),
    weights AS MATERIALIZED (SELECT source, target, count(*) / max(degree) AS w
                             FROM edges JOIN degrees USING (source) GROUP BY source, target),
    indexed AS (SELECT p_partkey AS url FROM part WHERE {pages}),
    total AS (SELECT count(*)::DOUBLE AS n FROM indexed),
    step0 AS MATERIALIZED (
      SELECT url, CASE WHEN max(page) = 1 THEN 1.0::DOUBLE / (SELECT n FROM total) END AS rank, max(target) = 1 AS is_target
      FROM (SELECT url, 1 AS page, 0 AS target FROM indexed UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY url),
    {",".join(steps)}
    {result}"""


QUERIES = {
    "pagerank": (
        _pagerank,
        _sql("true", f"""SELECT 'https://shop.example.com/part/' || url AS url, round(rank, 9) AS page_rank
        FROM step{_STEPS} WHERE rank IS NOT NULL"""),
    ),
    "pagerank_update": (
        _pagerank_update,
        _sql("true", f"""SELECT 'https://shop.example.com/part/' || url AS url, round(rank, 9) AS page_rank
        FROM step{_STEPS} WHERE rank IS NOT NULL"""),
    ),
    "pagerank_pages": (
        _pagerank_pages,
        _sql("p_size > 10", f"""SELECT p_partkey AS page_id, 'https://shop.example.com/part/' || p_partkey AS url,
        round(rank, 9) AS page_rank FROM part LEFT JOIN step{_STEPS} ON url = p_partkey"""),
    ),
}
