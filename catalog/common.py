"""Inputs the registered queries share, as Spark frames and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import bitmaps as bm
from webloom.operators import index as ix
from webloom.operators import topk
from webloom.plans.lineage import materialize, scratch_path, spread
from webloom.sources.layout import write_index
from webloom.sources.tables import RANKED_INDEX, read_table


# Suffixes of the hosts in the test tables and in derived ones; a real job passes the complete list.
SUFFIXES = ["com", "net", "org", "uk", "co.uk", "*.ck", "!www.ck"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of parsed pages: (page_id, url, title, page_rank, text)."""
    return as_corpus(table(spark, sf_dir, "documents"))


def as_corpus(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat("source", F.lit(" "), "lang").alias("title"),
        (F.lit(1.0) / (F.col("n_chars") + 1)).alias("page_rank"),
        "text",
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.build_postings(spread(corpus(spark, sf_dir)), F.col("text"))


class Index:
    """Stored index of the documents of one folder: postings, word counters and scores."""

    _built: dict[tuple[str, str], "Index"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.pages = corpus(spark, sf_dir).select("page_id", "url", "title", "page_rank")
        self.corpus = ix.corpus_size(self.pages)

    # Each part is built when a query first asks for it.

    @cached_property
    def postings(self) -> DataFrame:
        built = ix.build_postings(spread(corpus(self.spark, self.sf_dir)), F.col("text"), "page_rank")
        return materialize(built, "postings")

    @cached_property
    def documents(self) -> DataFrame:
        return materialize(ix.term_documents(self.postings), "term_documents")

    @cached_property
    def n_postings(self) -> int:
        return self.documents.agg(F.sum("documents_number")).first()[0] or 0

    @cached_property
    def scored(self) -> DataFrame:
        scored = scratch_path(self.spark, "scored")
        write_index(ix.score_postings(self.postings, self.corpus, self.documents), scored, n_postings=self.n_postings)
        return read_table(self.spark, scored, RANKED_INDEX)

    #: Pages of a block of score bounds; the test tables have too few for blocks of the usual size.
    block = 64

    @cached_property
    def bounds(self) -> DataFrame:
        path = scratch_path(self.spark, "bounds")
        topk.write_bounds(self.scored, path, self.block, self.n_postings)
        return read_table(self.spark, path, topk.BOUNDS)

    @cached_property
    def bitmaps(self) -> DataFrame:
        path = scratch_path(self.spark, "bitmaps")
        bm.write_bitmaps(bm.page_bitmaps(self.postings), path)
        return read_table(self.spark, path, bm.PAGE_BITMAPS)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Index":
        """The index of a folder, built once per session and read by every query after that."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._built:
            cls._built[key] = cls(spark, sf_dir)
        return cls._built[key]


# Separators of words: punctuation and white space, or white space alone.
SQL_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SQL_SPLIT = r"[’''/\-,!?.*()" + SQL_SPACE + "]+"
SQL_SPLIT_PLAIN = "[" + SQL_SPACE + "]+"

SQL_CORPUS = """
corpus AS (
  SELECT doc_id AS page_id, 'https://' || source || '.example.com/' || doc_id AS url,
         source || ' ' || lang AS title, 1.0::DOUBLE / (n_chars + 1) AS page_rank, text
  FROM documents)
"""

SQL_TERMS = f"""
raw AS (SELECT page_id, unnest(regexp_split_to_array(text, '{SQL_SPLIT}')) AS token FROM corpus),
terms AS (SELECT page_id, strip_accents(lower(token)) AS word FROM raw WHERE token <> '')
"""

SQL_COUNTS = """
counts AS (SELECT page_id, word, count(*) AS cnt FROM terms GROUP BY ALL),
freq AS (SELECT page_id, word, cnt, cnt / sum(cnt) OVER (PARTITION BY page_id) AS tf FROM counts)
"""

SQL_SCORED = """
df AS (SELECT word, count(*) AS documents_number FROM freq GROUP BY word),
scored AS (
  SELECT word, page_id, tf, documents_number,
         tf * ln((SELECT count(*) FROM documents) / documents_number) AS tf_idf
  FROM freq JOIN df USING (word))
"""

SQL_INDEX = f"WITH {SQL_CORPUS}, {SQL_TERMS}, {SQL_COUNTS}, {SQL_SCORED}"
