"""Searches over the indexed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import common as c
from webloom.operators import bitmaps as bm
from webloom.operators import search as se
from webloom.operators import topk

QUERY = "In the OF"
TERMS = ["in", "the", "of"]


def _parts(spark, sf_dir):
    return c.Index.of(spark, sf_dir).scored, None


def _documents(spark, sf_dir):
    return c.Index.of(spark, sf_dir).documents


def sentences(spark, sf_dir):
    """Every sentence of the benchmark items as a query."""
    items = c.table(spark, sf_dir, "benchmark")
    split = items.select("item_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("pos", "query"))
    return split.select(
        F.concat(F.col("item_id").cast("string"), F.lit("-"), F.col("pos").cast("string")).alias("query_id"), "query"
    )


def _and_pages(spark, sf_dir):
    return se.and_pages(_parts(spark, sf_dir)[0], TERMS)


def _and_pages_intersect(spark, sf_dir):
    return se.and_pages_intersect(_parts(spark, sf_dir)[0], TERMS)


def _and_pages_bitmap(spark, sf_dir):
    return bm.and_pages_bitmap(c.Index.of(spark, sf_dir).bitmaps, TERMS)


def _bounded(k, strip_punct):
    def query(spark, sf_dir):
        index = c.Index.of(spark, sf_dir)
        found = topk.search_batch_bounded(index.scored, index.bounds, sentences(spark, sf_dir), k, strip_punct, index.block)
        return rounded(found, "score")

    return query


def _search_rows(spark, sf_dir):
    rows = se.search_rows(*_parts(spark, sf_dir), QUERY, n_results=-1)
    return rounded(rows, "score", "order_key")


def _search_pages(spark, sf_dir):
    return rounded(se.search_pages(*_parts(spark, sf_dir), QUERY, n_results=-1), "score")


def search_top_pages(spark, sf_dir):
    return rounded(se.search_pages(*_parts(spark, sf_dir), QUERY), "score")


def _search_count(spark, sf_dir):
    return se.search_count(se.search_pages(*_parts(spark, sf_dir), QUERY, n_results=-1))


def _search_batch(spark, sf_dir):
    found = se.search_batch(*_parts(spark, sf_dir), sentences(spark, sf_dir), k=20, strip_punct=True, documents=_documents(spark, sf_dir))
    return rounded(found, "score")


def _search_topk_batch(spark, sf_dir):
    return rounded(se.search_batch(*_parts(spark, sf_dir), sentences(spark, sf_dir), k=3, documents=_documents(spark, sf_dir)), "score")


def _search_json(spark, sf_dir):
    return se.answer_json(se.search_batch(*_parts(spark, sf_dir), sentences(spark, sf_dir), k=5, strip_punct=True, documents=_documents(spark, sf_dir)))


def _with_gaps(spark, sf_dir):
    """The index with unscored postings, unranked pages and pages whose words have equal scores."""
    index, page = c.Index.of(spark, sf_dir).scored, F.col("page_id")
    unscored = (page % 7 == 0) | ((page % 3 == 0) & (F.col("word") == "the"))
    tf_idf = F.when(unscored, F.lit(None)).when(page % 5 == 0, 0.25).otherwise(F.col("tf_idf"))
    return index.withColumns({"tf_idf": tf_idf, "page_rank": F.when(page % 11 != 0, F.col("page_rank"))})


def _search_pages_gaps(spark, sf_dir):
    return rounded(se.search_pages(_with_gaps(spark, sf_dir), None, QUERY, n_results=-1), "score")


def _search_rows_gaps(spark, sf_dir):
    return rounded(se.search_rows(_with_gaps(spark, sf_dir), None, QUERY, n_results=-1), "score", "order_key")


def _search_batch_gaps(spark, sf_dir):
    queries = sentences(spark, sf_dir)
    found = se.search_batch(_with_gaps(spark, sf_dir), None, queries, 20, True, documents=_documents(spark, sf_dir))
    return rounded(found, "score")


def rounded(df, *columns):
    for column in columns:
        df = df.withColumn(column, F.round(column, 6))
    return df


_IN_TERMS = "('in', 'the', 'of')"

_HITS = f"""{c.SQL_INDEX},
matching AS (SELECT page_id FROM scored WHERE word IN {_IN_TERMS} GROUP BY page_id HAVING count(DISTINCT word) = 3),
hits AS (SELECT word, page_id, title, url, tf_idf, page_rank FROM scored JOIN corpus USING (page_id)
         WHERE word IN {_IN_TERMS} AND page_id IN (SELECT page_id FROM matching)),
page_scores AS (SELECT page_id, title, url,
                       sum(0.7 * log10(tf_idf + 1)) + 0.3 * log10(max(page_rank) + 1) AS score
                FROM hits GROUP BY page_id, title, url)
"""


_GAPS = """gaps AS (
  SELECT word, page_id, title, url, CASE WHEN page_id % 11 <> 0 THEN page_rank END AS page_rank,
         CASE WHEN page_id % 7 = 0 OR (page_id % 3 = 0 AND word = 'the') THEN NULL WHEN page_id % 5 = 0 THEN 0.25
              ELSE tf_idf END AS tf_idf
  FROM scored JOIN corpus USING (page_id))
"""


def batch_sql(k: int, splitter: str, scored: str = "scored JOIN corpus USING (page_id)", more: str = "") -> str:
    return f"""{c.SQL_INDEX}, {more}
    split AS (SELECT item_id, regexp_split_to_array(text, '[.!?\\n]+') AS parts FROM benchmark),
    asked AS (SELECT item_id || '-' || (generate_subscripts(parts, 1) - 1) AS query_id, unnest(parts) AS query FROM split),
    asked_raw AS (SELECT query_id, unnest(regexp_split_to_array(query, '{splitter}')) AS token FROM asked),
    asked_terms AS (SELECT DISTINCT query_id, strip_accents(lower(token)) AS word FROM asked_raw WHERE token <> ''),
    sizes AS (SELECT query_id, count(*) AS n FROM asked_terms GROUP BY query_id),
    found AS (
      SELECT query_id, page_id, title, url, page_rank, sum(0.7 * log10(tf_idf + 1)) AS text_score, count(*) AS n_found
      FROM asked_terms JOIN (SELECT * FROM {scored}) USING (word) GROUP BY ALL),
    ranked AS (
      SELECT query_id, page_id, title, url, text_score + 0.3 * log10(page_rank + 1) AS score
      FROM found JOIN sizes USING (query_id) WHERE n_found = n),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC NULLS FIRST, page_id) AS rank
      FROM ranked),
    answers AS (SELECT query_id, rank::INTEGER AS rank, page_id, title, url, score FROM placed WHERE rank <= {k})
    """


SQL_ROUNDED = "SELECT query_id, rank, page_id, title, url, round(score, 6) AS score FROM answers"

QUERIES = {
    "and_pages": (_and_pages, f"{_HITS} SELECT page_id FROM matching"),
    "and_pages_intersect": (
        _and_pages_intersect,
        f"{c.SQL_INDEX} "
        + " INTERSECT ".join(f"SELECT page_id FROM scored WHERE word = '{term}'" for term in TERMS),
    ),
    "and_pages_bitmap": (_and_pages_bitmap, f"{_HITS} SELECT page_id FROM matching"),
    "search_batch_bounds": (_bounded(20, True), batch_sql(20, c.SQL_SPLIT) + SQL_ROUNDED),
    "search_topk_bounds": (_bounded(3, False), batch_sql(3, c.SQL_SPLIT_PLAIN) + SQL_ROUNDED),
    "search_rows": (
        _search_rows,
        f"""{_HITS} SELECT page_id, title, url,
        round(0.7 * log10(tf_idf + 1) + 0.3 * log10(page_rank + 1), 6) AS score,
        round(sum(0.7 * log10(tf_idf + 1)) + 0.3 * log10(max(page_rank) + 1), 6) AS order_key, count(*) AS n_words
        FROM hits GROUP BY page_id, title, url, tf_idf, page_rank""",
    ),
    "search_pages_gaps": (
        _search_pages_gaps,
        f"""{_HITS}, {_GAPS} SELECT page_id, title, url,
        round(sum(0.7 * log10(tf_idf + 1)) + 0.3 * log10(max(page_rank) + 1), 6) AS score
        FROM gaps WHERE word IN {_IN_TERMS} AND page_id IN (SELECT page_id FROM matching) GROUP BY page_id, title, url""",
    ),
    "search_rows_gaps": (
        _search_rows_gaps,
        f"""{_HITS}, {_GAPS} SELECT page_id, title, url,
        round(0.7 * log10(tf_idf + 1) + 0.3 * log10(page_rank + 1), 6) AS score,
        round(sum(0.7 * log10(tf_idf + 1)) + 0.3 * log10(max(page_rank) + 1), 6) AS order_key, count(*) AS n_words
        FROM gaps WHERE word IN {_IN_TERMS} AND page_id IN (SELECT page_id FROM matching)
        GROUP BY page_id, title, url, tf_idf, page_rank""",
    ),
    "search_batch_gaps": (_search_batch_gaps, batch_sql(20, c.SQL_SPLIT, "gaps", _GAPS + ",") + SQL_ROUNDED),
    "search_pages": (_search_pages, f"{_HITS} SELECT page_id, title, url, round(score, 6) AS score FROM page_scores"),
    "search_top_pages": (
        search_top_pages,
        f"""{_HITS}, best AS (SELECT * FROM page_scores ORDER BY round(score, 12) DESC NULLS FIRST, page_id LIMIT 20)
        SELECT page_id, title, url, round(score, 6) AS score FROM best""",
    ),
    "search_count": (
        _search_count,
        f"""{_HITS} SELECT count(*) AS n_results,
        CASE count(*) WHEN 0 THEN 'No results' WHEN 1 THEN '1 result' ELSE count(*) || ' results' END AS message
        FROM page_scores""",
    ),
    "search_batch": (_search_batch, batch_sql(20, c.SQL_SPLIT) + SQL_ROUNDED),
    "search_topk_batch": (_search_topk_batch, batch_sql(3, c.SQL_SPLIT_PLAIN) + SQL_ROUNDED),
    "search_json": (
        _search_json,
        batch_sql(5, c.SQL_SPLIT)
        + """SELECT query_id, '{"results":[' ||
        string_agg('{"title":"' || title || '","url":"' || url || '"}', ',' ORDER BY rank) || ']}' AS answer
        FROM answers GROUP BY query_id""",
    ),
}
