"""What the operators share: picking columns, white space, tables in the shared folder."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.plans.lineage import discard, scratch_path

#: White space that separates words, as a regular expression and as characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def column(name: str) -> Column:
    """A column by its plain name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def picked(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that no other column can clash."""
    return docs.select(*[column(name).alias(own) for own, name in columns.items()])


def free_name(docs: DataFrame, wish: str) -> str:
    """A column name that the table does not use, ignoring case."""
    used = {name.lower() for name in docs.columns}
    while wish.lower() in used:
        wish += "_"
    return wish


_MADE: ContextVar[list[DataFrame] | None] = ContextVar("_MADE", default=None)


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for those to be kept. Nothing lazy may still read them."""
    made: list[DataFrame] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        discard(*made)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if not keep and (made := _MADE.get()) is not None:
        made.append(table)
    return table


@F.arrow_udf(T.BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    """Texts packed for a shuffle, as UTF-8 under zlib; null stays null."""
    return pa.array([zlib.compress(text.as_py().encode(), 1) if text.is_valid else None for text in texts], pa.binary())
