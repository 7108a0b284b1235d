"""Bloom filters of a fixed size, made by all tasks and tested before any shuffle.

A filter says of a value that it is not in a set, or that it may be. The bits are cut in blocks, by the
highest bits of a value's hash, and each block is made in one task. So a filter takes the same memory
whatever the set's size; of a larger set it lets more values through by mistake.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (a power of two; 2**26 are 8 MB), and of a block.
BITS, BLOCK_BITS = 26, 20

_SHIFTS = (0, 19, 38)


def places(hashes: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Three bits of the filter for each 64-bit hash, all in the block that its highest bits name."""
    inside = min(bits, BLOCK_BITS)
    block = (hashes >> np.uint64(64 - bits + inside)) << np.uint64(inside) if bits > inside else np.uint64(0)
    return [(block | ((hashes >> np.uint64(shift)) & np.uint64((1 << inside) - 1))).astype(np.int64) for shift in _SHIFTS]


def passes(packed: bytes, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """False where a hash is certainly not in the set."""
    table, out = np.frombuffer(packed, np.uint8), np.ones(len(hashes), bool)
    for at in places(hashes, bits):
        out &= (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def build(hashes: DataFrame, bits: int = BITS) -> bytes:
    """The filter of a column of 64-bit hashes, the only one of the frame. Its bits pass through the driver."""
    (column,) = hashes.columns
    inside = min(bits, BLOCK_BITS)
    blocks = 1 << (bits - inside)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in places(values, bits):
                which = at >> inside
                for block in np.unique(which).tolist():
                    made.setdefault(block, np.zeros(1 << inside, bool))[at[which == block] & ((1 << inside) - 1)] = True
        packed = [zlib.compress(np.packbits(x).tobytes(), 1) for x in made.values()]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.int32()), pa.array(packed, pa.binary())], ["block", "bits"])

    block = F.shiftrightunsigned(column, 64 - bits + inside) if blocks > 1 else F.lit(0).cast("long")
    dealt = hashes.withColumn("__block", block).repartition(blocks, "__block").select(column)
    size = (1 << inside) // 8
    out = bytearray(blocks * size)
    for at, part in dealt.mapInArrow(fill, "block INT, bits BINARY").collect():
        out[at * size : (at + 1) * size] = zlib.decompress(part)
    return bytes(out)


def may_hold(packed: bytes, hashes: Column, df: DataFrame, bits: int = BITS) -> Column:
    """Column that is false where a hash is certainly not in the set; null hashes are in none. ``df`` has the session."""
    shared = df.sparkSession.sparkContext.broadcast(packed)

    @F.arrow_udf("boolean")
    def test(values: pa.Array) -> pa.Array:
        known = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return pa.array(passes(shared.value, known, bits) & values.is_valid().to_numpy(zero_copy_only=False), pa.bool_())

    return test(hashes)
