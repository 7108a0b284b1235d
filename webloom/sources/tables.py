"""Schemas of all tables as DDL text, and readers that never infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUEUE = "id BIGINT, url STRING, domain STRING"
VISITED_URLS = "id BIGINT, url STRING, indexation BOOLEAN, page_key STRING, html STRING"
VISITED_DOMAINS = "domain STRING, crawl_delay DOUBLE, last_visit TIMESTAMP"
PAGE_LINKS = "source_url STRING, target_url STRING"
PAGE_INFORMATIONS = "page_id BIGINT, url STRING, title STRING, page_rank DOUBLE"
INVERTED_INDEX = "word STRING, page_id BIGINT, url STRING, title STRING, tf DOUBLE, tf_idf DOUBLE"
RANKED_INDEX = INVERTED_INDEX + ", page_rank DOUBLE"
TERM_DOCUMENTS = "word STRING, documents_number BIGINT"
FETCH_LOG = "url STRING, content_type STRING, headers MAP<STRING,STRING>, html STRING"
ROBOTS = "host STRING, content STRING, fetch_failed BOOLEAN"
STORED_PAGES = "page_id BIGINT, url STRING, html STRING"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table. Columns that are not used later are not read."""
    return spark.read.schema(schema).parquet(path)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages (page_id, url, html)."""
    return read_table(spark, path, STORED_PAGES)


def append_links(edges: DataFrame, path: str) -> None:
    """Append link edges to the stored link graph."""
    edges.select("source_url", "target_url").write.mode("append").parquet(path)
