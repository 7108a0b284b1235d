"""Stable page keys."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def page_key(url: Column) -> Column:
    """Key of a stored page: 128-bit hash of its URL, in hex."""
    return F.md5(url)


def page_key_blake2b(url: Column) -> Column:
    """BLAKE2b-128 form of the key, which Spark has no function for."""

    @F.arrow_udf("string")
    def digest(urls: pa.Array) -> pa.Array:
        return pa.array(
            [u if u is None else hashlib.blake2b(u.encode(), digest_size=16).hexdigest() for u in urls.to_pylist()],
            pa.string(),
        )

    return digest(url)


def key_prefix(key: Column) -> Column:
    """First two digits of a key: the folder a page is stored in."""
    return F.substring(key, 1, 2)
