"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. A text's word shingles are hashed once. The hashes fall in bins; the smallest of each bin is the
   signature, and an empty bin borrows from bins that a fixed sequence of probes names (optimal
   densification).
2. Documents with equal shingle sets are one class from then on, with a number of its own.
3. Runs of signature bins are bucket keys. In every bucket the smallest class is the hub, and edges go
   from hubs to members only.
4. Edges whose signatures are far apart go, the others are confirmed on full sets. Confirmed ones are
   merged to components.
5. A hub has been compared with all of its bucket and leaves it. Where the others are not all of one
   component, a star may have missed a link between two members that are far from the hub. These members
   meet in blocks of bounded size, which compare them with each other and report the links that connect
   components. So no two members of a bucket stay uncompared unless they are linked already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import column, free_name, picked, stored, temporary_tables
from webloom.llm.shingles import mixed, runs, word_hashes
from webloom.plans import bloom

SHINGLE, PERCENT = 5, 80
#: Bands and bins of a band. A pair at 0.8 misses all bands with a probability of 1.5e-5, one at 0.85 of 1e-7.
BANDS, ROWS = 28, 5
BINS = BANDS * ROWS
#: A true pair at 0.8 has fewer equal bins than this (five standard deviations) with a probability of 3e-7.
LEAST_EQUAL = int(0.8 * BINS - 5 * (0.16 * BINS) ** 0.5)

#: Shingles, and members, of a block of those that stars have left open.
BLOCK, BLOCK_ROWS = 1 << 16, 256

_PROBES = (mixed(np.arange(BINS * 256, dtype=np.uint64).reshape(256, BINS) + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)


def shingle_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words of a text in UTF-8, in lower case (A-Z only).

    With fewer words their whole sequence is the one shingle; without words there is none.
    """
    words = word_hashes(text.lower())
    if len(words) >= n:
        return np.unique(runs(words, n))
    return mixed(runs(words, len(words)) + np.uint64(len(words))) if len(words) else words


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest hash of each bin of a sorted set that is not empty; empty bins are densified."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], filled[bins[first]] = shingles[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        hits = filled[_PROBES[:, empty]]
        chosen = _PROBES[hits.argmax(0), empty]
        # all probes missed, which takes a nearly empty set: the next filled bin
        after = bins[first][np.searchsorted(bins[first], empty) % len(first)]
        out[empty] = out[np.where(hits.any(0), chosen, after)]
    return out


def _bands(values: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column_values in values.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column_values)
    return keys


_SKETCH = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_id", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("bits", T.BinaryType()),
    ]
)


def _sketched(text: Column, n: int) -> Column:
    """Struct: size of the set, digest of the set, band keys, eight bits of each bin; null but the size without shingles."""

    @F.arrow_udf(_SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        sizes, digests, bands, bits = [], [], [], []
        for value in texts:
            shingles = shingle_set((value.as_py() or "").encode(), n)
            sizes.append(len(shingles))
            if not len(shingles):
                digests.append(None), bands.append(None), bits.append(None)
                continue
            values = signature(shingles)
            digests.append(_set_id(shingles))
            bands.append(_bands(values).view(np.int64))
            bits.append(mixed(values).astype(np.uint8).tobytes())
        columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
        return pa.StructArray.from_arrays(columns, _SKETCH.names)

    return sketch(text)


_FULL = T.StructType([T.StructField("set_id", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def _set_id(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


@F.arrow_udf(_FULL)
def _full_sets(texts: pa.Array, lengths: pa.Array) -> pa.Array:
    """Digest and full set of each text; of runs of ``lengths`` words."""
    n = lengths[0].as_py() if len(lengths) else 0
    sets = [shingle_set((text.as_py() or "").encode(), n) for text in texts]
    columns = [pa.array(list(map(_set_id, sets)), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
    return pa.StructArray.from_arrays(columns, _FULL.names)


@F.arrow_udf(T.IntegerType())
def _equal_bins(left: pa.Array, right: pa.Array) -> pa.Array:
    shape = (len(left), BINS)
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(shape) for x in (left, right))
    return pa.array((a == b).sum(1).astype(np.int32))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of (a, b): label is the smallest node that can be reached.

    Every task first replaces its edges by stars. Large-star and small-star steps in turn, each stored,
    follow until all that is left are stars.
    """
    edges = links.select("a", "b").filter("a <> b").mapInArrow(_contracted, "a LONG, b LONG").distinct()
    edges = stored(edges, "cc_edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stored(_star(both, larger_only=True), "cc_large")
        edges = stored(_star(large, larger_only=False), "cc_edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, smallest node that the edges of a batch connect it to) in place of the edges of a batch."""
    for batch in batches:
        parent: dict[int, int] = {}
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            low, high = sorted((_root(parent, a), _root(parent, b)))
            parent[high] = low
        stars = [(x, root) for x in parent if (root := _root(parent, x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in stars], pa.int64()) for k in (0, 1)], ["a", "b"])


def _root(parent: dict[int, int], x: int) -> int:
    parent.setdefault(x, x)
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def _are_stars(edges: DataFrame) -> bool:
    """Every node has one edge to a smaller node, or edges to larger ones only."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1").isEmpty()


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Connect the neighbours of every node to the smallest of them (or to the node itself if that is smaller).

    The smallest neighbours are stored, so that plain shuffles feed the join and AQE can split the node
    that a third of all edges have.
    """
    smallest = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "cc_min")
    joined = edges.join(smallest, "a")
    moved = joined.filter("b > a") if larger_only else joined
    out = moved.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    if not larger_only:
        out = out.unionByName(smallest.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def _attached(edges: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Edges with a value of both ends, as ``value_a`` and ``value_b``."""
    for key in ("b", "a"):
        edges = edges.join(table.select(F.col("node").alias(key), F.col(value).alias(f"{value}_{key}")), key)
    return edges


def _confirmed(edges: DataFrame, busy: DataFrame, percent: int) -> DataFrame:
    """The edges whose full sets have the similarity; stored. ``busy`` has one row per node."""
    likely = _attached(edges, busy, "bits").filter(_equal_bins("bits_a", "bits_b") >= LEAST_EQUAL).select("a", "b")
    whole = _attached(likely, busy, "shingles")
    common = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    union = F.size("shingles_a") + F.size("shingles_b") - common
    return stored(whole.filter(100 * common >= percent * union).select("a", "b"), "near_links")


def _classes(sketch: DataFrame) -> DataFrame:
    """One stored row per class of equal sets: (node, set_id, rep, bands, bits). Copies are combined in the task that read them."""
    named = sketch.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    return stored(stored(classes, "near_classes").withColumn("node", F.monotonically_increasing_id()), "near_nodes")


def _linked(classes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, label) of the classes that are linked to others.

    All joins read stored tables through plain shuffles, so AQE can split a class or a bucket of many rows.
    """
    banded = classes.select(F.explode("bands").alias("bucket"), "node")
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    buckets = stored(buckets.select("bucket", "hub"), "near_buckets")
    members = stored(banded.join(buckets, "bucket"), "near_members")
    busy = _busy(members, classes, texts, n)
    links = _confirmed(_star_edges(members), busy, percent)
    labels = components(links)
    rest, several = _still_open(members, labels, busy)
    if several.isEmpty():
        return labels
    more = stored(_block_links(rest, several, busy, percent), "near_block_links")
    if more.isEmpty():
        return labels
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return components(known.unionByName(more))


def _busy(members: DataFrame, classes: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Stored (node, bits, shingles, n_shingles) of the classes that share a bucket.

    A class's full set is made from the text of its smallest id. A filter of those ids keeps the other texts
    out of the shuffle.
    """
    nodes = stored(members.select("node").distinct().join(classes.select("node", "set_id", "rep", "bits"), "node"), "near_busy")
    ids = bloom.build(nodes.select(F.xxhash64("rep").alias("hash")))
    wanted = texts.filter("doc_id IS NOT NULL").filter(bloom.may_hold(ids, F.xxhash64("doc_id"), texts))
    # rows of one id may have different texts: a class takes one that has its set
    own = wanted.select(F.col("doc_id").alias("rep"), _full_sets("text", F.lit(n)).alias("s")).select("rep", "s.*")
    own = own.filter("set_id IS NOT NULL").groupBy("rep", "set_id").agg(F.first("shingles").alias("shingles"))
    made = stored(own, "near_full_sets")
    return stored(nodes.join(made, ["rep", "set_id"]).select("node", "bits", "shingles", F.size("shingles").alias("size")), "near_sets")


def _star_edges(members: DataFrame) -> DataFrame:
    """Edges (a, b) from the hub of every bucket to its members."""
    return members.filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()


def _still_open(members: DataFrame, labels: DataFrame, busy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members that are no hubs, with their labels; and the buckets of them that have several labels left, with sizes."""
    rest = members.filter("hub <> node").join(labels, "node", "left")
    rest = stored(rest.select("bucket", "node", F.coalesce("label", "node").alias("label")), "near_rest")
    spread = rest.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    several = stored(spread.select("bucket"), "near_open")
    return rest, several


def _block_links(rest: DataFrame, several: DataFrame, busy: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of open buckets that are not linked yet; enough of them to connect all.

    A bucket is dealt out in blocks of a bounded number of members and of shingles, and every two of its
    blocks meet in one task, so no task grows with a bucket and no pair leaves its task unless it is a
    link that connects two labels.
    """
    placed = stored(rest.join(several, "bucket").join(busy, "node"), "near_placed")
    blocks = placed.groupBy("bucket").agg(F.greatest(F.ceil(F.sum("size") / BLOCK), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks"))
    dealt = placed.join(stored(blocks, "near_blocks"), "bucket")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def links(block_pair: pa.Table) -> pa.Table:
        return pa.table(list(map(list, zip(*_connecting(block_pair, percent)))) or [[], []], pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    columns = ["bucket", "low", "high", "block", "node", "label", "bits", "shingles"]
    return met.select(*columns).groupBy("bucket", "low", "high").applyInArrow(links, "a LONG, b LONG").distinct()


def _connecting(pair: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between the members of two blocks, or in one, leaving out those between labels that are connected.

    Two members of different labels are not both of the label that most members have, so only the others
    are compared with all.
    """
    low, high = pair["low"][0].as_py(), pair["high"][0].as_py()
    node, label = (pair[name].to_numpy() for name in ("node", "label"))
    own = pair["block"].to_numpy()
    bits = np.frombuffer(b"".join(pair["bits"].to_pylist()), np.uint8).reshape(len(node), BINS)
    sets = [s.values.to_numpy() for s in pair["shingles"]]
    sizes = np.array(list(map(len, sets)))
    names, groups, counts = np.unique(label, return_inverse=True, return_counts=True)
    parent: dict[int, int] = {}
    found = []
    for i in np.flatnonzero(groups != counts.argmax()).tolist():
        near = (groups != groups[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if low != high:
            near &= own != own[i]
        at = np.flatnonzero(near)
        at = at[(bits[at] == bits[i]).sum(1) >= LEAST_EQUAL]
        for j in at.tolist():
            one, other = _root(parent, groups[i]), _root(parent, groups[j])
            if one != other:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                    found.append((int(node[i]), int(node[j])))
                    parent[one] = other
    return found


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept).

    Documents are linked if their sets of shingles of ``n`` words have ``percent`` of their union in
    common, 80 at least, for which the bands are made; the component is the smallest id that links lead to,
    and the document with that id stays. A text that is null, empty or blank has no shingles and is linked
    with nothing. A document without an id is linked with nothing and stays; its component is null. Rows
    that repeat an id and a text share their fate; with another text under the same id each row has the
    component of its own text. An empty table gives no rows.
    """
    if percent < PERCENT:
        raise ValueError(f"links below {PERCENT} percent are not looked for")
    texts = picked(docs, doc_id=id_col, text=text_col)
    sketch = stored(texts.select("doc_id", _sketched(F.col("text"), n).alias("s")).select("doc_id", "s.*"), "near_sketch")
    with temporary_tables():
        classes = _classes(sketch)
        labels = stored(_linked(classes, texts, n, percent), "near_labels")
        named = classes.select("node", "set_id", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        smallest = stored(named.groupBy("label").agg(F.min("rep").alias("component_id")), "near_components")
        named = stored(named.join(smallest, "label").select("set_id", "component_id"), "near_named", keep=True)
    joined = sketch.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, with all their columns."""
    gone = stored(classes_of(docs, id_col, text_col, n, percent).filter("NOT kept").select("doc_id").distinct(), "near_gone")
    key = free_name(docs, "__gone_id")
    return docs.join(gone.select(F.col("doc_id").alias(key)), column(id_col) == column(key), "left_anti")
