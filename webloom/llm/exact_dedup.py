"""Exact dedup: texts that are equal once white space is deleted. DataFrame operations only.

Copies are combined in three steps, each of which compares whole normalised texts: within the task
that read them, then per (digest, salt), then over the salts of a digest. A group of copies, however
large, sends one row per task into the second step and one per salt into the third.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import SPACE, column, free_name, picked, stored
from webloom.plans.skew import HotKeys, skew_join

SALTS = 16

# Rank of a row as one number, so that hash aggregation can keep the best: length first, then the smaller id.
_STEP = "100000000000000000000BD"
_TOP = "9223372036854775808BD"


def _columns(doc_id: Column, text: Column) -> tuple[Column, Column, Column]:
    """Text without white space, its digest, and the rank of the row."""
    text = F.coalesce(text, F.lit(""))
    content = F.regexp_replace(text, SPACE + "+", "")
    place = F.coalesce(F.expr(_TOP) - doc_id.cast("decimal(20, 0)"), F.expr("0BD"))
    rank = F.char_length(text).cast("decimal(10, 0)") * F.expr(_STEP) + place
    return content, F.sha2(content.cast("binary"), 256), rank.cast("decimal(38, 0)")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = picked(docs, doc_id=id_col, text=text_col)
    content, _, rank = _columns(F.col("doc_id"), F.col("text"))
    rows = rows.withColumn("content", content)
    return rows.select("doc_id", "content", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), rank.alias("rank"))


def _best() -> list:
    return [F.max("rank").alias("rank")]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One stored row per digest: (digest, contents, rank, group_size).

    ``contents`` counts the different texts behind a digest. It is 1 unless two texts collide; only
    then the digest does not identify the text, and ``verdicts`` compares the texts once more.
    """
    keyed = _keyed(docs, id_col, text_col).withColumn("salt", F.spark_partition_id() % salts)
    merged = keyed.groupBy("digest", "salt", "content").agg(*_best(), F.count("*").alias("n"))
    combined = merged.repartition("digest").groupBy("digest", "content").agg(*_best(), F.sum("n").alias("n"))
    per_digest = combined.groupBy("digest").agg(F.count("*").alias("contents"), *_best(), F.sum("n").alias("group_size"))
    return stored(per_digest, "exact_groups")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Of equal texts the row with the most code points in the original text stays, then the smallest
    id. A null text counts as empty, and empty and blank texts are one group. A null id is larger than
    any id. Rows that repeat the kept id within its group are that document and are kept with it. Ids
    are longs. An empty table gives no rows. Other columns are never looked at.
    """
    return _verdicts(docs, id_col, text_col, salts).drop("rank", "best")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    best = groups(docs, id_col, text_col, salts).withColumnRenamed("rank", "best")
    hot = HotKeys(best, "digest", "group_size")
    joined = skew_join(keyed.drop("content"), best, "digest", ["doc_id", "rank"], hot)
    columns = ["doc_id", "digest", "rank", "best", "group_size"]
    out = joined.filter("contents = 1").select(*columns)
    if not best.filter("contents > 1").isEmpty():
        out = out.unionByName(_collided(keyed, best).select(*columns))
    place = F.expr(f"best % {_STEP}")
    keep_id = F.when(place > 0, F.expr(f"{_TOP} - best % {_STEP}")).cast("long")
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("rank") == F.col("best")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "rank",
        "best",
    )


def _collided(keyed: DataFrame, best: DataFrame) -> DataFrame:
    """Groups by text of the digests that stand for several texts."""
    rows = keyed.join(best.filter("contents > 1").select("digest"), "digest", "left_semi")
    per_text = rows.groupBy("digest", "content").agg(F.max("rank").alias("best"), F.count("*").alias("group_size"))
    return rows.join(per_text, ["digest", "content"])


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns: one row of every group of ``verdicts``.

    Of rows that tie for a group (same id or none, same text up to white space, same length) any one stays.
    Only if there are such rows, tasks first reduce what they read to a row per key, so that ties meet in
    no task however many they are.
    """
    kept = _verdicts(docs, id_col, text_col, salts).filter("kept").groupBy("text_sha256", "rank").agg(F.count("*").alias("copies"))
    kept = stored(kept, "exact_kept")
    keys = [free_name(docs, "__digest"), free_name(docs, "__rank")]
    _, digest, rank = _columns(column(id_col), column(text_col))
    rows = docs.withColumns(dict(zip(keys, (digest, rank))))
    if not kept.filter("copies > 1").isEmpty():
        rows = rows.dropDuplicates(keys)
    return rows.join(kept.select("text_sha256", "rank").toDF(*keys), keys, "left_semi").select(*[column(name) for name in docs.columns])
