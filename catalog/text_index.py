"""Words, postings and scores of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import common as c
from webloom.functions import text as tx
from webloom.operators import index as ix
from webloom.operators import pages as pg
from webloom.plans.lineage import materialize, scratch_path, spread
from webloom.sources import snapshots, tables


def _tokens(spark, sf_dir):
    rows = spread(c.corpus(spark, sf_dir)).select(
        "page_id", F.posexplode(tx.raw_tokens(F.col("text"))).alias("pos", "token")
    )
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


def _normalized_tokens(spark, sf_dir):
    rows = spread(c.corpus(spark, sf_dir)).select("page_id", F.explode(tx.terms(F.col("text"))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"))


def _query_terms(spark, sf_dir):
    items = c.table(spark, sf_dir, "benchmark")
    return items.select("item_id", F.posexplode(tx.query_terms(F.col("text"))).alias("pos", "term"))


def _term_counts(spark, sf_dir):
    return ix.term_counts(spread(c.corpus(spark, sf_dir)), F.col("text"))


def _term_frequency(spark, sf_dir):
    return c.postings(spark, sf_dir).select("page_id", "word", F.round("tf", 9).alias("tf"))


def _postings(spark, sf_dir):
    return c.postings(spark, sf_dir).withColumn("tf", F.round("tf", 9))


def _term_documents(spark, sf_dir):
    return ix.term_documents(c.postings(spark, sf_dir))


def _term_documents_merge(spark, sf_dir):
    """Counters of the documents, brought up to date with those of the conversations."""
    turns = c.table(spark, sf_dir, "conversations").withColumn("page_id", F.struct("conv_id", "turn"))
    added = ix.term_documents(ix.term_counts(spread(turns), F.col("text")))
    return ix.merge_term_documents(c.Index.of(spark, sf_dir).documents, added)


def _term_documents_snapshot(spark, sf_dir):
    """Counters as a keyed snapshot, brought up to date with four parts of the documents, the second of them twice."""
    path, postings = scratch_path(spark, "counters"), c.Index.of(spark, sf_dir).postings
    counted = [materialize(ix.term_documents(postings.filter(F.pmod("page_id", F.lit(4)) == k)), "counters") for k in range(4)]
    for version in (0, 1, 1, 2, 3):
        snapshots.upsert(spark, path, tables.TERM_DOCUMENTS, "word", counted[version], ix.merge_term_documents, version)
    return snapshots.read_snapshot(spark, path, tables.TERM_DOCUMENTS)


def _corpus_size(spark, sf_dir):
    return ix.corpus_size(c.corpus(spark, sf_dir))


def _idf(spark, sf_dir):
    index = c.Index.of(spark, sf_dir)
    return ix.idf(index.documents, index.corpus).withColumn("idf", F.round("idf", 9))


def _tf_idf(spark, sf_dir):
    index = c.Index.of(spark, sf_dir)
    scored = ix.score_postings(index.postings, index.corpus, index.documents)
    return scored.select("page_id", "word", F.round("tf_idf", 9).alias("tf_idf"))


def _labelled(spark, sf_dir):
    labels = c.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("indexation")
    )
    return c.corpus(spark, sf_dir).select("page_id", "url").join(labels, "page_id")


def _indexable_pages(spark, sf_dir):
    return pg.indexable(_labelled(spark, sf_dir)).select("page_id", "url")


def _pending_pages(spark, sf_dir):
    labels = c.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    return pg.pending(c.corpus(spark, sf_dir).select("page_id", "url"), labels, "indexed")


def _parse_batch(spark, sf_dir):
    return pg.batch(_pending_pages(spark, sf_dir), "indexed").select("page_id", "url")


_LABELLED = f"""
WITH {c.SQL_CORPUS},
labelled AS (SELECT page_id, url, quality = 1 AS indexation FROM corpus JOIN labels ON doc_id = page_id),
pending AS (SELECT page_id, url, EXISTS (SELECT 1 FROM labels WHERE doc_id = page_id) AS indexed FROM corpus)
"""

QUERIES = {
    "tokens": (
        _tokens,
        f"""WITH {c.SQL_CORPUS},
        split AS (SELECT page_id, regexp_split_to_array(text, '{c.SQL_SPLIT}') AS parts FROM corpus),
        placed AS (SELECT page_id, unnest(parts) AS token, generate_subscripts(parts, 1) AS place FROM split),
        words AS (SELECT token, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS pos
                  FROM placed WHERE token <> '')
        SELECT token, count(*) AS n, sum(pos)::BIGINT AS sum_pos FROM words GROUP BY token""",
    ),
    "normalized_tokens": (
        _normalized_tokens,
        f"WITH {c.SQL_CORPUS}, {c.SQL_TERMS} SELECT word, count(*) AS n FROM terms GROUP BY word",
    ),
    "query_terms": (
        _query_terms,
        f"""WITH split AS (SELECT item_id, regexp_split_to_array(text, '{c.SQL_SPLIT_PLAIN}') AS parts FROM benchmark),
        placed AS (SELECT item_id, unnest(parts) AS token, generate_subscripts(parts, 1) AS place FROM split)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY place) - 1)::INTEGER AS pos,
               strip_accents(lower(token)) AS term FROM placed WHERE token <> ''""",
    ),
    "term_counts": (_term_counts, f"{c.SQL_INDEX} SELECT page_id, word, cnt FROM counts"),
    "term_frequency": (_term_frequency, f"{c.SQL_INDEX} SELECT page_id, word, round(tf, 9) AS tf FROM freq"),
    "postings": (
        _postings,
        f"""{c.SQL_INDEX} SELECT word, page_id, url, title, round(tf, 9) AS tf
        FROM freq JOIN corpus USING (page_id)""",
    ),
    "term_documents": (_term_documents, f"{c.SQL_INDEX} SELECT word, documents_number FROM df"),
    "term_documents_snapshot": (_term_documents_snapshot, f"{c.SQL_INDEX} SELECT word, documents_number FROM df"),
    "term_documents_merge": (
        _term_documents_merge,
        f"""{c.SQL_INDEX},
        turns AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '{c.SQL_SPLIT}')) AS token
                  FROM conversations),
        turn_words AS (SELECT DISTINCT conv_id, turn, strip_accents(lower(token)) AS word FROM turns WHERE token <> ''),
        both_sides AS (SELECT word, documents_number FROM df
                 UNION ALL SELECT word, count(*) FROM turn_words GROUP BY word)
        SELECT word, sum(documents_number)::BIGINT AS documents_number FROM both_sides GROUP BY word""",
    ),
    "corpus_size": (_corpus_size, "SELECT count(*) AS n_pages FROM documents"),
    "idf": (
        _idf,
        f"""{c.SQL_INDEX} SELECT word, documents_number,
        round(ln((SELECT count(*) FROM documents) / documents_number), 9) AS idf FROM df""",
    ),
    "tf_idf": (_tf_idf, f"{c.SQL_INDEX} SELECT page_id, word, round(tf_idf, 9) AS tf_idf FROM scored"),
    "indexable_pages": (_indexable_pages, f"{_LABELLED} SELECT page_id, url FROM labelled WHERE indexation"),
    "pending_pages": (_pending_pages, f"{_LABELLED} SELECT page_id, url, indexed FROM pending"),
    "parse_batch": (
        _parse_batch,
        f"{_LABELLED} SELECT page_id, url FROM pending WHERE NOT indexed ORDER BY page_id LIMIT 10",
    ),
}
