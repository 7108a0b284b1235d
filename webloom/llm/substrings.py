"""Substring dedup on the de Bruijn graph of runs of words.

A window of 20 words is an edge of the graph, its first and last 19 words are the nodes. Consecutive
windows of a document that share their smallest 6-word run are compacted to one path, a piece, whose
windows follow each other without a branch. Pieces meet by their 6-word run: windows can only be equal
where the runs are.

- A run that is found in one piece only is not repeated; its windows go no further.
- A run whose pieces are all equal is an unbranched path that repeats as a whole: all but the piece
  with the first source coordinates (document, position) are removed.
- A run with different pieces is where paths branch. Only the first of each of its pieces is taken
  apart into windows again, and windows are compared by source coordinates.

Copies that meet within a batch of documents are settled there, so that a passage found in a third of
all documents sends one row per batch through a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import packed, picked, stored
from webloom.llm.shingles import joined, mixed, runs, word_chunks, word_hashes
from webloom.plans.skew import SLICE, HotKeys

WINDOW, RUN = 20, 6
#: Documents of the deterministic sample in which hot runs are counted; it shapes the plan, not the result.
SAMPLE = 64
_WORDS = 1 << 21
_OTHER = 0xD1B54A32D192ED03


def pieces_of(words: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, run hash, content hash) of the pieces of a document, from its word hashes."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams, windows = runs(words, RUN), runs(words, WINDOW)
    width = WINDOW - RUN + 1
    # smallest run of each window, by doubling; of equal ones the first
    at, reach = np.arange(len(grams)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[:-step], at[step:]
        at = np.where(grams[right] < grams[left], right, left)
        reach += step
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    counts = np.diff(starts, append=n)
    # a piece's words are those of its first and last window
    content = joined(joined(windows[starts], windows[starts + counts - 1]), counts.astype(np.uint64))
    return starts, counts, grams[at[starts]], content


def edge_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window, which mix the words' own hashes in different ways: 128 bits in all."""
    return runs(words, WINDOW), runs(mixed(words + np.uint64(_OTHER)), WINDOW)


def _not_first(keys: list[np.ndarray], docs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True where the same keys are found at smaller coordinates among these rows."""
    order = np.lexsort([at, docs, *keys])
    new = np.ones(len(order), bool)
    same = np.ones(max(len(order) - 1, 0), bool)
    for key in keys:
        same &= key[order][1:] == key[order][:-1]
    new[1:] = ~same
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = (docs[order] != docs[order][first]) | (at[order] != at[order][first])
    out = np.zeros(len(order), bool)
    out[order] = later
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and word hashes of documents, a bounded number of words at a time (a longer document by itself)."""
    ids, hashes, total = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids.append(doc_id.as_py())
            hashes.append(word_hashes(text.as_buffer().to_pybytes() if text.is_valid else b""))
            total += len(hashes[-1])
            if total > _WORDS:
                yield ids, hashes
                ids, hashes, total = [], [], 0
    if ids:
        yield ids, hashes


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of documents; those whose copy in the same batch comes first have no run: they are settled."""
    for ids, hashes in _grouped(batches):
        parts = [pieces_of(words) for words in hashes]
        docs = np.repeat(np.array(ids, np.int64), [len(p[0]) for p in parts])
        starts, counts, grams, content = (np.concatenate([p[k] for p in parts]) for k in range(4))
        settled = _not_first([content, grams], docs, starts)
        columns = [
            pa.array(docs),
            pa.array(starts.astype(np.int32)),
            pa.array(counts.astype(np.int32)),
            pa.array(grams.view(np.int64), mask=settled),
            pa.array(content.view(np.int64), mask=settled),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "windows", "run", "content"])


def _classified(texts: DataFrame) -> DataFrame:
    """(doc_id, start, windows, branch) of repeated pieces: to be removed, or at a branch and to be taken apart."""
    schema = "doc_id LONG, start INT, windows INT, run LONG, content LONG"
    rows = texts.mapInArrow(_pieces, schema)
    sampled = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(_pieces, schema)
    counts = stored(sampled.filter("run IS NOT NULL").groupBy("run").agg(F.count("*").alias("n")).filter("n > 1"), "sub_counts")
    hot = HotKeys(counts, "run", "n", limit=_hot_limit(texts))
    spread = hot.scatter(rows, "run", ["content"])
    same_run, same = Window.partitionBy("run", SLICE), Window.partitionBy("run", SLICE, "content")
    settled = F.col("run").isNull()
    # rows without a run are spread by a value of their own, not gathered in one task
    spread = spread.withColumn(SLICE, F.when(settled, -1 - F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 30))).otherwise(F.col(SLICE)))
    ranked = spread.withColumn("low", F.min("content").over(same_run)).withColumn("high", F.max("content").over(same_run))
    ranked = ranked.withColumn("place", F.rank().over(same.orderBy("doc_id", "start")))
    # the slices of a hot run do not see each other: it counts as branching
    cut = F.col("run").isin([key for key, _ in hot.rows]) if hot else F.lit(False)
    remove = settled | (F.col("place") > 1)
    branch = ~remove & ((F.col("low") < F.col("high")) | cut)
    return ranked.filter(remove | branch).select("doc_id", "start", "windows", branch.alias("branch"))


def _hot_limit(texts: DataFrame) -> int:
    """Rows in the sample from which on a run is hot: as many as a task gets on average, at least 16."""
    n = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).count()
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, n // partitions)


def _marked(n: int, starts, counts) -> np.ndarray:
    """True for each word that one of the windows covers, of runs of windows given by start and number."""
    change = np.zeros(n + 1, np.int64)
    if len(starts):
        starts = np.asarray(starts, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, np.minimum(starts + np.asarray(counts, np.int64) + WINDOW - 1, n), -1)
    return np.cumsum(change[:-1]) > 0


def _kept_digest(text: bytes, removed: np.ndarray) -> str:
    """SHA-256 of the words that stay, joined by single spaces."""
    digest, at, gap = hashlib.sha256(), 0, b""
    for words in word_chunks(text):
        kept = list(compress(words, ~removed[at : at + len(words)]))
        at += len(words)
        if kept:
            digest.update(gap + b" ".join(kept))
            gap = b" "
    return digest.hexdigest()


RESULT = "doc_id LONG, n_words LONG, n_removed LONG, kept_sha256 STRING"
OPENED = RESULT + ", text BINARY, starts ARRAY<INT>, counts ARRAY<INT>, at ARRAY<INT>, edges ARRAY<LONG>, checks ARRAY<LONG>"


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of documents without branches; the others with their text, removed pieces and windows."""
    for batch in batches:
        rows = []
        for doc_id, shipped, pieces in zip(*(batch.column(name) for name in ("doc_id", "packed", "pieces"))):
            text = zlib.decompress(shipped.as_py()) if shipped.is_valid else b""
            found = pieces.as_py() or []
            n_words = sum(map(len, word_chunks(text)))
            gone = [(p["start"], p["windows"]) for p in found if not p["branch"]]
            starts, counts = ([list(x) for x in zip(*gone)] if gone else [[], []])
            branches = [p for p in found if p["branch"]]
            removed = _marked(n_words, starts, counts)
            if not branches:
                rows.append((doc_id.as_py(), n_words, int(removed.sum()), _kept_digest(text, removed), None, None, None, None, None, None))
                continue
            at = np.concatenate([np.arange(p["start"], p["start"] + p["windows"]) for p in branches])
            edges, checks = (hashes[at].view(np.int64) for hashes in edge_hashes(word_hashes(text)))
            rows.append((doc_id.as_py(), n_words, None, None, shipped.as_py(), starts, counts, at, edges, checks))
        yield _batch(rows, OPENED_ARROW)


OPENED_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("text", pa.binary()),
        ("starts", pa.list_(pa.int32())),
        ("counts", pa.list_(pa.int32())),
        ("at", pa.list_(pa.int32())),
        ("edges", pa.list_(pa.int64())),
        ("checks", pa.list_(pa.int64())),
    ]
)
RESULT_ARROW = pa.schema(list(OPENED_ARROW)[:4])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the documents with branches, once their repeated windows are known."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            again = row["again"] or []
            removed = _marked(row["n_words"], row["starts"] + again, row["counts"] + [1] * len(again))
            rows.append((row["doc_id"], row["n_words"], int(removed.sum()), _kept_digest(zlib.decompress(row["text"]), removed)))
        yield _batch(rows, RESULT_ARROW)


def repeated_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_words, n_removed, kept_sha256).

    Every word goes that is covered by a window of 20 words which also starts earlier: in a document
    with a smaller id, or further left in the same document. Null and empty texts have no words. A
    document without an id has no place in the order: it loses nothing and no other loses anything to
    it. Rows that repeat an id should repeat the text; they are one document and each get its row. An
    empty table gives no rows.
    """
    texts = picked(docs, doc_id=id_col, text=text_col)
    in_order = texts.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    marked = stored(_classified(in_order), "sub_pieces")
    per_doc = marked.groupBy("doc_id").agg(F.collect_set(F.struct("start", "windows", "branch")).alias("pieces"))
    shipped = texts.select("doc_id", packed("text").alias("packed"))
    opened = shipped.join(per_doc, "doc_id", "left").select("doc_id", "packed", "pieces").mapInArrow(_opened, OPENED)
    opened = stored(opened, "sub_opened")
    edges = opened.filter("text IS NOT NULL").select("doc_id", F.explode(F.arrays_zip("edges", "checks", "at")).alias("e")).select("doc_id", "e.*")
    again = _later_edges(edges).groupBy("doc_id").agg(F.collect_set("at").alias("again"))
    branched = opened.filter("text IS NOT NULL").select("doc_id", "n_words", "text", "starts", "counts")
    closed = branched.join(again, "doc_id", "left").mapInArrow(_closed, RESULT)
    done = opened.filter("text IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256")
    return done.unionByName(closed)


def _later_edges(edges: DataFrame) -> DataFrame:
    """(doc_id, at) of windows that are found at smaller coordinates as well."""
    place = F.struct("doc_id", "at")
    firsts = edges.groupBy("edges", "checks").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = stored(firsts, "sub_firsts")
    hot = HotKeys(firsts, "edges", "n")
    left, right = (hot.scatter(edges, "edges", ["doc_id"]), hot.repeat(firsts, "edges")) if hot else (edges, firsts)
    found = left.join(right, ["edges", "checks", SLICE] if hot else ["edges", "checks"])
    return found.filter(place != F.col("first")).select("doc_id", "at")
