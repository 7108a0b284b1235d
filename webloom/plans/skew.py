"""Joins in which one key may hold a large share of the rows.

AQE splits skewed partitions only where a plain shuffle feeds the join; a side that is the
result of an aggregation is left alone. Here the split is part of the plan: a hot key is cut in
as many slices as its share asks for, the rows of the large side go to a slice by a hash, and
the matching rows of the other side are repeated once per slice. Without hot keys the join is an
ordinary one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "__webloom_slice"
_SLICES = "__webloom_slices"


def count_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows per key: (key, n). Counts are combined before the shuffle."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


class HotKeys:
    """The hot keys of a table of key counts, with the number of slices of each.

    A key is hot if it has more rows than a task gets on average (all rows over the number of shuffle
    partitions), and each of its slices holds at most that many. So there are fewer hot keys than
    shuffle partitions, whatever the size of the data; that is why they may pass through the driver
    and be broadcast. ``counts`` should be a small or stored table: it is read at once.
    """

    def __init__(self, counts: DataFrame, key: str, n: str, limit: int | None = None):
        if limit is None:
            partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            limit = max(1, -(-(counts.agg(F.sum(n)).first()[0] or 0) // partitions))
        found = counts.filter((F.col(n) > limit) & F.col(key).isNotNull()).select(key, F.ceil(F.col(n) / limit).cast("int"))
        self.rows = [tuple(row) for row in found.collect()]
        self.key = key
        self._type = counts.schema[key].dataType

    def __bool__(self) -> bool:
        return bool(self.rows)

    def _attach(self, df: DataFrame, key: str) -> DataFrame:
        schema = T.StructType([T.StructField(key, self._type), T.StructField(_SLICES, T.IntegerType())])
        return df.join(F.broadcast(df.sparkSession.createDataFrame(self.rows, schema)), key, "left")

    def scatter(self, df: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
        """Each row gets one slice of its key; rows with a NULL key are spread as well."""
        by_hash = F.xxhash64(*spread_by)
        slices = F.when(F.col(key).isNull(), 1 << 20).otherwise(self._slices())
        return self._attach(df, key).withColumn(SLICE, F.pmod(by_hash, slices).cast("int")).drop(_SLICES)

    def repeat(self, df: DataFrame, key: str) -> DataFrame:
        """Each row is repeated for every slice of its key."""
        every = F.sequence(F.lit(0), self._slices() - 1)
        return self._attach(df, key).withColumn(SLICE, F.explode(every)).drop(_SLICES)

    @staticmethod
    def _slices() -> Column:
        return F.coalesce(F.col(_SLICES), F.lit(1))


def skew_join(
    large: DataFrame,
    small: DataFrame,
    key: str,
    spread_by: list[str],
    hot: HotKeys | None = None,
    how: str = "inner",
    slices: int | None = None,
) -> DataFrame:
    """Join ``large`` to ``small`` on ``key``, whatever share of ``large`` one key holds.

    ``spread_by`` names columns of ``large`` that differ between the rows of a key. ``how`` is
    inner, left, left_semi or left_anti. With ``hot`` the hot keys are sliced by their counts. Where
    no counts are stored, ``slices`` cuts every key in that many, for a ``small`` that is small enough
    to be repeated; both sides then come from a plain shuffle, so AQE may split them further. Neither
    runs the input at plan time.
    """
    if slices is not None:
        at = F.pmod(F.xxhash64(*spread_by), F.lit(slices)).cast("int")
        left = large.withColumn(SLICE, at)
        right = small.withColumn(SLICE, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    elif hot:
        left, right = hot.scatter(large, key, spread_by), hot.repeat(small, key)
    else:
        return large.join(small, key, how)
    return left.join(right, [key, SLICE], how).drop(SLICE)
