"""Storage layouts: pages by key prefix, the index by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.keys import key_prefix, page_key
from webloom.plans.lineage import shuffles_removed

_STORED = "page_id BIGINT, url STRING, html STRING, page_key STRING, prefix STRING"

#: Up to so many keys are filtered by the scan itself; more are joined.
FEW_KEYS = 1000

#: Postings that one task sorts, of about 150 bytes each in memory.
SORTED_IN_MEMORY = 2_000_000

#: Postings that are shuffled before their shuffle files are removed (about 28 bytes each), and those looked at to part them.
POSTINGS_OF_GO, _SAMPLED = 1 << 27, 1000


def write_pages(pages: DataFrame, path: str) -> DataFrame:
    """Store pages under the two-digit prefix of their key and return where each one is:
    (page_id, url, page_key, prefix).

    Keys are hashes, so ranges of them are even; a range holds few prefixes, so a task writes few
    files.
    """
    keyed = pages.withColumn("page_key", page_key(F.col("url"))).withColumn("prefix", key_prefix(F.col("page_key")))
    keyed.repartitionByRange("page_key").sortWithinPartitions("page_key").write.partitionBy("prefix").parquet(path)
    return page_manifest(pages.sparkSession, path)


def page_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Where each stored page is: (page_id, url, page_key, prefix); the HTML is not read."""
    stored = spark.read.schema(_STORED).parquet(path)
    return stored.select("page_id", "url", "page_key", "prefix")


def lookup_pages(keys: DataFrame, path: str) -> DataFrame:
    """Stored pages (page_id, url, html, page_key, prefix) of a table of keys (page_key); other columns are not looked at.

    The prefixes of the keys, 256 at most, become a partition filter, so folders without any of the keys are
    neither listed for reading nor opened. Few keys (``FEW_KEYS``) are passed on to the scan as well, which then
    skips row groups, as files are in key order. Keys that are not stored give no row.
    """
    spark = keys.sparkSession
    wanted = keys.select("page_key").filter("page_key IS NOT NULL").distinct()
    prefixes = [r[0] for r in wanted.select(key_prefix(F.col("page_key"))).distinct().collect()]
    found = spark.read.schema(_STORED).parquet(path).filter(F.col("prefix").isin(prefixes))
    few = [r[0] for r in wanted.limit(FEW_KEYS + 1).collect()]
    if len(few) <= FEW_KEYS:
        return found.filter(F.col("page_key").isin(few))
    return found.join(wanted.withColumn("prefix", key_prefix(F.col("page_key"))), ["prefix", "page_key"], "left_semi").select(found.columns)


def word_ranges(postings: DataFrame, n_postings: int) -> list[Column]:
    """Conditions that part the postings by ranges of words, of about ``POSTINGS_OF_GO`` each; every row meets one of them."""
    goes = -(-n_postings // POSTINGS_OF_GO)
    if goes <= 1:
        return [F.lit(True)]
    some = F.pmod(F.xxhash64("word", "page_id"), F.lit(max(1, n_postings // (_SAMPLED * goes)))) == 0
    words = sorted(r.word for r in postings.filter(some & F.col("word").isNotNull()).select("word").collect())
    borders = sorted({words[len(words) * k // goes] for k in range(1, goes)}) if words else []
    if not borders:
        return [F.lit(True)]
    word = F.col("word")
    between = [(word >= a) & (word < b) for a, b in zip(borders, borders[1:])]
    return [word.isNull() | (word < borders[0]), *between, word >= borders[-1]]


def write_index(postings: DataFrame, path: str, mode: str = "error", n_postings: int = 0, at_once: bool = False) -> None:
    """Store postings in word order.

    A query then reads the row groups whose word range holds a term and skips the rest. The range
    covers the page as well, so a word of many pages fills several files. With the number of postings
    a task gets as many as it can sort in memory, whatever the size of the index, and an index of many
    postings is written in several goes, by ranges of words. So no more than those of a go are shuffled
    at a time; the postings are read in each, so pass a stored table, or else ``at_once``.
    """
    parts = [F.lit(True)] if at_once else word_ranges(postings, n_postings)
    tasks = -(-n_postings // (SORTED_IN_MEMORY * len(parts)))
    more = [tasks] if tasks > int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    for k, part in enumerate(parts):
        ranged = postings.filter(part).repartitionByRange(*more, "word", "page_id").sortWithinPartitions("word", "page_id")
        with shuffles_removed(postings.sparkSession):
            ranged.write.mode("append" if k else mode).option("compression", "zstd").parquet(path)
