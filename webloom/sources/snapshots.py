"""Keyed tables that are changed in place: hash buckets, copied on write, under versioned manifests.

A table is a folder. ``data/version=v/bucket=b`` holds the rows of a bucket as version v wrote them, and
``manifest/version=v`` names for every bucket the version whose files hold it. A version is complete once
its manifest is. An upsert reads and writes the buckets that its own keys fall in; the files of all others
stay where they are. Versions are numbered by the caller, as by the id of a micro-batch: one that is
complete is never written again, so a job that runs again changes nothing, and one that was left half
done is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.plans.lineage import discard_folders, exists, folders

#: Hash buckets of a table. A parameter of its layout: the same number must be passed every time.
BUCKETS = 64

_MANIFEST = "bucket INT, data_version BIGINT"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, in order."""
    found = [int(name.removeprefix("version=")) for name in folders(spark, f"{path}/manifest") if name.startswith("version=")]
    return sorted(v for v in found if exists(spark, f"{path}/manifest/version={v}/_SUCCESS"))


def manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Bucket to the version that wrote its rows; buckets without rows are not named."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={version}").collect()  # a row per bucket
    return {r.bucket: r.data_version for r in rows}


def read_snapshot(
    spark: SparkSession, path: str, schema: str, version: int | None = None, buckets: list[int] | None = None
) -> DataFrame:
    """Rows of a version, or of the newest one; of some buckets only if those are given. Empty if there is none."""
    complete = versions(spark, path)
    version = (complete[-1] if complete else None) if version is None else version
    where = {} if version is None else manifest(spark, path, version)
    chosen = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(where.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*chosen) if chosen else spark.createDataFrame([], schema)


def upsert(
    spark: SparkSession, path: str, schema: str, key: str, changes: DataFrame, merge: Merge, version: int, buckets: int = BUCKETS
) -> bool:
    """Publish a version: the newest one before it, with changes merged in. False if it is complete already.

    ``merge(old, changes)`` gets the rows of the buckets that the changes fall in, and returns the new rows
    of these buckets; a key must have one row. ``changes`` is read twice, so pass a stored table. Rows of it
    without a key are left out.
    """
    complete = versions(spark, path)
    if version in complete:
        return False
    earlier = [v for v in complete if v < version]
    where = manifest(spark, path, earlier[-1]) if earlier else {}
    changes = changes.filter(F.col(key).isNotNull())
    touched = sorted(r[0] for r in changes.select(bucket_of(key, buckets)).distinct().collect())  # at most ``buckets``
    old = read_snapshot(spark, path, schema, earlier[-1] if earlier else None, touched)
    data = f"{path}/data/version={version}"
    merged = merge(old, changes).withColumn("bucket", bucket_of(key, buckets))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    written = [int(name.removeprefix("bucket=")) for name in folders(spark, data) if name.startswith("bucket=")]
    where = {b: v for b, v in where.items() if b not in touched} | dict.fromkeys(written, version)
    rows = spark.createDataFrame(sorted(where.items()), _MANIFEST)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return True


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Forget all complete versions but the newest ``keep``, and delete the files that none of these names."""
    complete = versions(spark, path)
    old, kept = complete[:-keep], complete[-keep:]
    if not old:
        return
    used = {(v, b) for k in kept for b, v in manifest(spark, path, k).items()}
    unused = []
    for version in sorted({v for k in old for v in manifest(spark, path, k).values()}):
        of_version = [name for name in folders(spark, f"{path}/data/version={version}") if name.startswith("bucket=")]
        unused += [f"{path}/data/version={version}/{name}" for name in of_version if (version, int(name.removeprefix("bucket="))) not in used]
    discard_folders(spark, *[f"{path}/manifest/version={v}" for v in old], *unused)
