"""Page sets of words as bitmaps: AND of terms without a row per page.

Page numbers are cut in blocks of 32,768. A word has one bitmap of 4,096 bytes for each block that it has
pages in, so a word on a third of all pages is a bit per page. Terms are combined block by block, and only
blocks that all of them have can hold a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_BITMAPS = "word STRING, block BIGINT, pages BINARY, n_pages BIGINT"


def page_bitmaps(postings: DataFrame) -> DataFrame:
    """Bitmaps (word, block, pages, n_pages) from postings (word, page_id), in word order. A group has one block of pages at most.

    Page numbers are shuffled and sorted, not bitmaps, which are made one at a time from there on.
    """
    placed = postings.select("word", F.bitmap_bucket_number("page_id").alias("block"), F.bitmap_bit_position("page_id").alias("at"))
    ranged = placed.repartitionByRange("word", "block").sortWithinPartitions("word", "block")
    built = ranged.groupBy("word", "block").agg(F.bitmap_construct_agg("at").alias("pages"))
    return built.withColumn("n_pages", F.bitmap_count("pages"))


def write_bitmaps(bitmaps: DataFrame, path: str, mode: str = "error") -> None:
    """Store bitmaps as ``page_bitmaps`` gives them, in word order. Most bytes of a bitmap are zero, and are stored as runs."""
    bitmaps.sortWithinPartitions("word", "block").write.mode(mode).option("compression", "zstd").parquet(path)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _positions(bitmaps: pa.Array) -> pa.Array:
    """Positions of the bits that are set, the lowest bit of a byte first."""
    bits = (np.unpackbits(np.frombuffer(b.as_py(), np.uint8), bitorder="little") for b in bitmaps)
    return pa.array([np.flatnonzero(x).astype(np.int32) for x in bits], pa.list_(pa.int32()))


def bitmap_pages(bitmaps: DataFrame) -> DataFrame:
    """Page numbers of bitmaps (block, pages): (page_id)."""
    block, at = F.col("block"), F.col("at").cast("long")
    # blocks above 0 start at 1; block 0 and those below hold 0 and negative numbers
    page = F.when(block > 0, (block - 1) * 32768 + at + 1).otherwise(block * 32768 - at)
    return bitmaps.select("block", F.explode(_positions("pages")).alias("at")).select(page.alias("page_id"))


def all_terms(bitmaps: DataFrame, terms: list[str]) -> DataFrame:
    """Bitmaps (block, pages) of the pages that hold every term; one row per block and task is shuffled."""
    wanted = sorted(set(terms))
    found = bitmaps.filter(F.col("word").isin(wanted)).groupBy("block").agg(F.bitmap_and_agg("pages").alias("pages"), F.count("*").alias("n"))
    return found.filter(F.col("n") == len(wanted)).filter(F.bitmap_count("pages") > 0).select("block", "pages")


def and_pages_bitmap(bitmaps: DataFrame, terms: list[str]) -> DataFrame:
    """Pages that hold every term: (page_id), as ``search.and_pages`` finds them in postings."""
    if not terms:
        return bitmap_pages(bitmaps.limit(0))
    return bitmap_pages(all_terms(bitmaps, terms))


def and_count(bitmaps: DataFrame, terms: list[str]) -> DataFrame:
    """Number of pages that hold every term, without listing them: one row (n_pages)."""
    found = all_terms(bitmaps, terms) if terms else bitmaps.limit(0)
    return found.agg(F.coalesce(F.sum(F.bitmap_count("pages")), F.lit(0)).alias("n_pages"))


def any_term(bitmaps: DataFrame, terms: list[str]) -> Column | DataFrame:
    """Bitmaps (block, pages) of the pages that hold one term at least."""
    return bitmaps.filter(F.col("word").isin(terms)).groupBy("block").agg(F.bitmap_or_agg("pages").alias("pages"))
