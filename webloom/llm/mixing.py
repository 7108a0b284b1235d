"""Mixing sources to target weights with hash thresholds.

Every document has a hash. A source takes all its documents a whole number of times, and those with a
hash below its threshold once more. Thresholds come from histograms: words are summed by source and
hash bucket, the bucket in which the budget ends is found, and only that bucket is split into finer
ones, until it holds no more than one document. Nothing is sorted and no document is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import WORD, column, free_name, picked, stored, temporary_tables
from webloom.plans.skew import HotKeys, skew_join

WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes in all, and the most that a source gives, as multiples of sizes.
SHARE, MOST = 1.5, 2

#: Up to this many sources, with keys of this many bytes, are held in memory by every task that takes documents.
SOURCES_IN_MEMORY = 50_000
_SOURCE_BYTES_IN_MEMORY = 8 << 20

# The hash has 60 bits; every histogram looks at 10 more of them.
BITS, STEP = 60, 10


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 without text; no list of words is built."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_hash(doc_id: Column, text: Column) -> Column:
    """60-bit hash of an id, the first digits of its MD5; without an id that of a mark and the text."""
    of_text = F.concat(F.lit("text "), F.coalesce(text, F.lit("")))
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), of_text).cast("binary")), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Never null and ordered as sources are: by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds ``place``: 0 for the first source by key and so on, however many sources there are."""
    ranged = stored(sources.repartitionByRange("source").withColumn("part", F.spark_partition_id()), "mix_sources")
    counts = sorted(ranged.groupBy("part").count().collect())  # one row per partition
    starts, start = [], 0
    for part, count in counts:
        starts.append((part, start))
        start += count
    offsets = ranged.sparkSession.createDataFrame(starts, "part INT, start LONG")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    return ranged.join(F.broadcast(offsets), "part").withColumn("place", F.col("start") + rank).drop("part", "start")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, n, source_size, target) of each source, from (source, n, source_size); stored.

    Targets are in proportion to the weights, which repeat in the order of the sources, and stop at
    ``most`` times the source's size; what is above is shared among the others until none is above.
    """
    at = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int"))
    weighed = stored(_numbered(sources).withColumn("weight", at.cast("long")), "mix_weights")
    limit, full = F.col("source_size") * most, F.lit(False)
    budget = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    n_full = -1
    while True:  # every turn fills at least one more source
        sums = weighed.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            F.count_if(full),
        ).first()
        if sums[2] == n_full or not sums[1]:
            break
        n_full, unit = sums[2], (budget - sums[0]) / sums[1]
        full = F.col("weight") * F.lit(unit) > limit
    unit = unit if n_full >= 0 else 0.0
    target = F.when(full, limit.cast("double")).otherwise(F.col("weight") * F.lit(float(unit)))
    return stored(weighed.select("source", "n", "source_size", target.alias("target")), "mix_targets")


def _threshold_step(open_: DataFrame, buckets: DataFrame) -> DataFrame:
    """Find in the next finer histogram where each budget ends: the bucket and what lies before it."""
    before = Window.partitionBy("source").orderBy("bucket")
    summed = buckets.withColumn("upto", F.sum("words").over(before))
    ends = open_.select("source", "prefix", "left").join(summed, "source").filter((F.col("upto") - F.col("words") < F.col("left")) & (F.col("left") <= F.col("upto")))
    return ends.select(
        "source",
        (F.col("prefix") * (1 << STEP) + F.col("bucket")).alias("prefix"),
        (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"),
        "words",
        "docs",
    )


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, n, source_size, target, times, below): documents with a hash under ``below`` count once more.

    The document at which the budget ends is taken if that brings the sum nearer to the budget.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = wanted.withColumn("times", times).withColumn("left", F.col("target") - F.col("times") * F.col("source_size"))
    plan = stored(plan, "mix_plan")
    open_ = plan.filter("left > 0").select("source", F.lit(0).cast("long").alias("prefix"), "left")
    found = []
    for level in range(1, BITS // STEP + 1):
        shift = BITS - level * STEP
        prefix, bucket = F.shiftright("hash", shift + STEP), F.shiftright("hash", shift) % (1 << STEP)
        rows = sized.filter("size > 0").select("source", "size", prefix.alias("prefix"), bucket.alias("bucket"))
        if level > 1:  # only the bucket in which the budget ends is looked at again
            rows = rows.join(open_.select("source", "prefix"), ["source", "prefix"], "left_semi")
        histogram = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        ends = stored(_threshold_step(open_, histogram), "mix_ends")
        last = level == BITS // STEP
        done = ends if last else ends.filter("docs = 1")
        nearer = (2 * F.col("left") >= F.col("words")).cast("long")
        found.append(done.select("source", ((F.col("prefix") + nearer) * (1 << shift)).alias("below")))
        open_ = ends.filter("docs > 1")
        if last or open_.isEmpty():
            break
    below = found[0]
    for more in found[1:]:
        below = below.unionByName(more)
    return stored(plan.join(below, "source", "left").fillna(0, ["below"]), "mix_thresholds", keep=True)


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = picked(docs, doc_id=id_col, text=text_col, source=source_col)
    return rows.select("doc_id", source_key(F.col("source")).alias("source"), n_words(F.col("text")).alias("size"), key_hash(F.col("doc_id"), F.col("text")).alias("hash"))


def plan_mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    sources = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    with temporary_tables():
        return thresholds(sized, targets(sources, weights, share, most))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken).

    ``taken`` is the size times how often the document is in the mix, never above ``most`` times. Null
    texts and texts without words have size 0 and take nothing; a null source is a source of its own;
    rows that repeat an id share its hash and so its fate. All sizes 0: all targets are 0. An empty
    table gives no rows. Nothing depends on the order of rows or on partitions.
    """
    sized = stored(sizes(docs, id_col, text_col, source_col), "mix_sizes")
    plan = plan_mix(sized, weights, share, most)
    joined = skew_join(sized, plan.drop("n", "left"), "source", ["hash"], HotKeys(plan, "source", "n"))
    copies = F.col("times") + (F.col("hash") < F.col("below")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def take_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """The documents of the mix with all their columns, each as many times as the mix takes it.

    The plan has one row per source. Measured to be few they are broadcast, and no text is shuffled.
    """
    plan = plan_mix(stored(sizes(docs, id_col, text_col, source_col), "mix_sizes"), weights, share, most)
    key, hashed, copies = (free_name(docs, name) for name in ("__source", "__hash", "__copies"))
    rows = docs.withColumns({key: source_key(column(source_col)), hashed: key_hash(column(id_col), column(text_col))})
    fates = plan.select(F.col("source").alias(key), "n", "times", "below").toDF(key, f"{key}_n", f"{key}_times", f"{key}_below")
    n, n_bytes = fates.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(column(key))), F.lit(0))).first()
    if n <= SOURCES_IN_MEMORY and n_bytes <= _SOURCE_BYTES_IN_MEMORY:
        joined = rows.join(F.broadcast(fates), key)
    else:
        joined = skew_join(rows, fates, key, [hashed], HotKeys(fates, key, f"{key}_n"))
    often = column(f"{key}_times") + (column(hashed) < column(f"{key}_below")).cast("long")
    often = F.when(n_words(column(text_col)) > 0, often).otherwise(0)
    repeated = joined.withColumn(copies, F.explode(F.array_repeat(F.lit(1), often.cast("int"))))
    return repeated.select(*[column(name) for name in docs.columns])
