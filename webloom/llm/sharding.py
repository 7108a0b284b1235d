"""Resharding by minimum-cost flow.

Old shards have sizes, new shards have capacities; a byte that stays costs nothing, a byte that moves
costs one. The cheapest flow says how many bytes go from each old shard to each new one. Old shards
consist of blocks, and whole blocks are dealt out so that they follow the flow; only blocks that go to
another shard are written again.

The number of blocks is a parameter and does not grow with the data, so their sizes may be planned on
the driver.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import column
from webloom.plans.lineage import scratch_path

N_SHARDS = 8
BLOCKS = 1024
OLD, BLOCK, NEW = "old_shard", "block", "shard"


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """Units from old to new shards at the least cost, where a unit that keeps its number costs 0 and any other 1.

    Capacities hold all supplies in sum. Cheapest augmenting paths on the residual graph, found by
    relaxing all edges, so that a unit already placed may give way.
    """
    source, sink = ("source", 0), ("sink", 0)
    room: dict = defaultdict(dict)
    cost: dict = {}

    def edge(a, b, units, price):
        room[a][b] = units
        room[b].setdefault(a, 0)
        cost[a, b], cost[b, a] = price, -price

    for i, units in supply.items():
        edge(source, ("old", i), units, 0)
        for j in capacity:
            edge(("old", i), ("new", j), units, int(i != j))
    for j, units in capacity.items():
        edge(("new", j), sink, units, 0)
    while True:
        best, came = {source: 0}, {}
        for _ in range(len(room)):
            changed = False
            for a in list(best):
                for b, units in room[a].items():
                    if units > 0 and best[a] + cost[a, b] < best.get(b, float("inf")):
                        best[b], came[b], changed = best[a] + cost[a, b], a, True
            if not changed:
                break
        if sink not in best:
            break
        path, at = [], sink
        while at != source:
            path.append((came[at], at))
            at = came[at]
        units = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= units
            room[b][a] += units
    return {(i, j): room["new", j]["old", i] for i in supply for j in capacity if room["new", j].get(("old", i), 0) > 0}


def equal_capacities(total: int, n_shards: int) -> dict[int, int]:
    return {j: total // n_shards + (j < total % n_shards) for j in range(n_shards)}


def deal_blocks(blocks: list[tuple[int, int, int]], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """New shard of each (old shard, block), from (old shard, block, size).

    Blocks are whole, so a shard may miss its capacity by part of a block. Larger blocks are placed
    first, each where the most of its old shard's flow is still to come, so that the smallest blocks
    even out what is left.
    """
    supply: dict[int, int] = defaultdict(int)
    for old, _, size in blocks:
        supply[old] += size
    flow = min_cost_flow(dict(sorted(supply.items())), capacity)
    to_come: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), units in flow.items():
        to_come[i][j] = units
    placed: dict[tuple[int, int], int] = {}
    for old, block, size in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        goes = max(to_come[old], key=lambda j: (to_come[old][j], j == old, -j), default=old if old in capacity else min(capacity))
        placed[old, block] = goes
        to_come[old][goes] = to_come[old].get(goes, 0) - size
    return placed


def plan(blocked: DataFrame, n_shards: int = N_SHARDS) -> list[tuple[int, int, int, int, int]]:
    """(old_shard, block, shard, first slot, rows) of each block, for shards of equal bytes.

    ``blocked`` has old_shard, block and size. A null old shard is shard 0.
    """
    sums = blocked.groupBy(OLD, BLOCK).agg(F.sum("size"), F.count("*")).orderBy(OLD, BLOCK).collect()
    sizes = [(r[0], r[1], r[2]) for r in sums]
    shard = deal_blocks(sizes, equal_capacities(sum(s for *_, s in sizes), n_shards))
    out, slot = [], dict.fromkeys(range(n_shards), 0)
    for old, block, _, rows in sums:
        goes = shard[old, block]
        out.append((old, block, goes, slot[goes], rows))
        slot[goes] += rows
    return out


def plan_frame(spark: SparkSession, planned: list) -> DataFrame:
    """The plan as a table; it has one row per block, which is why it may be broadcast."""
    return F.broadcast(spark.createDataFrame(planned, f"{OLD} INT, {BLOCK} INT, {NEW} INT, first_slot LONG, block_rows LONG"))


def reshard(
    docs: DataFrame, old_shard: Column, text_col: str = "text", id_col: str = "doc_id", n_shards: int = N_SHARDS, blocks: int = BLOCKS, path: str | None = None
) -> DataFrame:
    """All documents in their new shards: (doc_id, size, text_crc32, shard, slot, old_shard).

    The law is equal bytes: a row's size is its UTF-8 bytes plus 1, null texts have none. Rows of
    blocks that stay are read where they are; rows of blocks that move are written to ``path``, by
    default a folder in the shared one, and read from there. Slots number the rows of a shard without
    gaps, block by block, in a block by id, then by text. A null id comes first; repeated rows each get a
    slot. An empty table gives no rows.
    """
    spark = docs.sparkSession
    doc_id, text = column(id_col), column(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    digest = F.coalesce(F.crc32(text.cast("binary")), F.lit(-1))
    rows = docs.select(
        doc_id.alias("doc_id"),
        text.alias("text"),
        size.alias("size"),
        F.coalesce(old_shard, F.lit(0)).cast("int").alias(OLD),
        F.pmod(F.xxhash64(doc_id, digest), F.lit(blocks)).cast("int").alias(BLOCK),
    )
    planned = plan(rows, n_shards)
    placed = rows.join(plan_frame(spark, planned), [OLD, BLOCK])
    moved = [p for p in planned if p[0] != p[2]]
    stays = placed.filter(F.col(OLD) == F.col(NEW))
    if moved:
        path = path or scratch_path(spark, "moved_blocks")
        write_blocks(placed.filter(F.col(OLD) != F.col(NEW)), path)
        placed = stays.unionByName(spark.read.parquet(path).select(*stays.columns))
    else:
        placed = stays
    in_block = Window.partitionBy(OLD, BLOCK).orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    digested = placed.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    slotted = digested.drop("text").withColumn("slot", F.col("first_slot") + F.row_number().over(in_block) - 1)
    return slotted.select("doc_id", "size", "text_crc32", NEW, "slot", OLD)


def write_blocks(rows: DataFrame, path: str) -> None:
    """Write rows to ``path/shard=…``, one set of files per shard, as they come: nothing is shuffled."""
    rows.write.option("compression", "zstd").partitionBy(NEW).parquet(path)

