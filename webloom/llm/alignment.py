"""Alignment of the tokens of two tokenizers at the bytes where tokens of both end.

Arrow does the work of a batch: token ids are flattened with their parent indices, lengths of tokens are
summed up within their documents, and tokens of the two sides meet in a hash join on (document, end). Pairs
of ids are counted per batch with ``Table.group_by``, and Spark adds the partial counts up.

1. ``aligned`` tokenizes and cuts documents into groups of tokens that cover the same bytes.
2. ``pair_counts`` counts how often two ids end together in all documents.
3. ``counted`` looks the counts of a document's links up.

Of two tokens that end together the bytes of one are the end of the other's. So the number of id pairs is
bounded by the two vocabularies (``pair_bound``), whatever the corpus, and their counts can be broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import picked

#: Bytes of texts that are aligned together (a longer text by itself), and characters of a text that are tokenized together.
_SLICE, _CHUNK = 1 << 20, 1 << 20
#: Links that are looked up together.
_LINKS = 1 << 19
_BORDER = re.compile(r"\S(?= .)", re.DOTALL)
_BYTE = re.compile("<0x([0-9A-F]{2})>")
SPACE_MARK = "▁"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, others are moved up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


# Fixed value: where byte-level texts are split before any merge, unless the vocabulary's file has a pattern of its own.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pair:
    """A byte-level BPE vocabulary (A, in JSON) and a SentencePiece model (B), with the bytes of their tokens.

    The merges of A are in the order of the ids that they make, so the ids are all that its encoder needs.
    Special tokens are left out of it: their strings in a text are plain text.
    """

    def __init__(self, a_json: str, b_proto: bytes):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        self.b = SentencePieceProcessor(model_proto=b_proto)
        letters, file = _byte_letters(), json.loads(a_json)
        vocabulary = file["model"]["vocab"]
        special = {token["content"]: token["id"] for token in file.get("added_tokens", [])}
        a_bytes = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for token, place in vocabulary.items():
            a_bytes[place] = token.encode() if token in special else bytes(letters[c] for c in token)
        ranks = {a_bytes[place]: place for token, place in vocabulary.items() if token not in special}
        self.a = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        b_bytes = []
        for place in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(place)
            value = _BYTE.fullmatch(piece) if self.b.is_byte(place) else None
            b_bytes.append(bytes([int(value[1], 16)]) if value else piece.replace(SPACE_MARK, " ").encode())
        self.bytes_of = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.names = pa.array([str(i) for i in range(max(len(a_bytes), len(b_bytes)))])

    def pair_bound(self) -> int:
        """Most pairs of ids of which the bytes of one end with those of the other."""
        a, b = ([x for x in ids.to_pylist()] for ids in self.bytes_of)
        times_a, times_b = {}, {}
        for times, values in ((times_a, a), (times_b, b)):
            for value in values:
                times[value] = times.get(value, 0) + 1
        longer = sum(times_b.get(value[k:], 0) for value in a for k in range(len(value) + 1))
        return longer + sum(times_a.get(value[k:], 0) for value in b for k in range(1, len(value) + 1))

    def encode(self, texts: list[str]) -> list[pa.ListArray]:
        """Ids of A, which gets a space before a text, and of B, which adds one itself."""
        parts, owners = [], []
        for place, text in enumerate(texts):
            for part in _parts(text):
                parts.append(part)
                owners.append(place)
        a = [self.a.encode_ordinary(" " + part) for part in parts]
        b = self.b.encode(parts, num_threads=1)
        sides = []
        for ids in (a, b):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            sizes = np.bincount(np.array(owners, np.int64), n, len(texts)).astype(np.int64)
            flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())))
            sides.append(pa.ListArray.from_arrays(pa.array(_offsets(sizes), pa.int32()), flat))
        return sides


def _parts(text: str) -> Iterator[str]:
    """A text in parts to be tokenized one by one, without the space between two: no token of either side goes across it."""
    at = 0
    while at < len(text):
        border = _BORDER.search(text, at + _CHUNK)
        if border is None:
            yield text[at:]
            return
        yield text[at : border.end()]
        at = border.end() + 1


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class Side:
    """Tokens of the documents of a batch, flat: ids, parents, and ends within the document."""

    def __init__(self, ids: pa.ListArray, bytes_of: pa.Array):
        self.flat = pc.list_flatten(ids)
        self.parents = pc.list_parent_indices(ids)
        self.counts = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = bytes_of.take(self.flat)
        self.offsets = _offsets(self.counts)
        running = pc.cumulative_sum(pc.cast(pc.binary_length(pieces), pa.int64())).to_numpy(zero_copy_only=False)
        running = np.concatenate([[0], running]).astype(np.int64)
        self.stops = running[self.offsets]  # bytes up to each document
        self.ends = running[1:] - self.stops[self.parents.to_numpy()]
        self.joined = memoryview(pieces.buffers()[2] or b"")  # of a new array, so from its first byte on

    def of(self, place: int) -> bytes:
        return bytes(self.joined[self.stops[place] : self.stops[place + 1]])

    def table(self, name: str) -> pa.Table:
        place = pa.array(np.arange(len(self.flat)))
        return pa.table({"doc": self.parents, "end": pa.array(self.ends), name: self.flat, f"{name}_place": place})

    def groups(self, cuts: np.ndarray, width: int, names: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of each group, joined by commas, and the number of groups of each document."""
        keys = self.parents.to_numpy() * np.int64(width) + self.ends
        group = np.searchsorted(cuts, keys)  # a token belongs to the first cut that is not before its end
        sizes = np.bincount(group, minlength=len(cuts))
        lists = pa.ListArray.from_arrays(pa.array(_offsets(sizes), pa.int32()), names.take(self.flat))
        return pc.binary_join(lists, ","), np.bincount(cuts // width, minlength=len(self.counts))


FIELDS = [
    ("n_a", pa.int64()),
    ("n_b", pa.int64()),
    ("n_groups", pa.int64()),
    ("groups", pa.string()),
    ("a", pa.list_(pa.int32())),
    ("b", pa.list_(pa.int32())),
]
_ALIGNED = "n_a LONG, n_b LONG, n_groups LONG, groups STRING, a ARRAY<INT>, b ARRAY<INT>"


def align(pair: Pair, texts: list[str | None], digest: bool = False) -> pa.StructArray:
    """Tokens, groups and links of some texts; without tokens where the bytes of a side are not those of the text."""
    given = [text or "" for text in texts]
    encoded = pair.encode(given)
    sides = [Side(ids, table) for ids, table in zip(encoded, pair.bytes_of)]
    same = np.array([bool(t) and sides[0].of(i) == sides[1].of(i) == b" " + t.encode() for i, t in enumerate(given)], bool)
    if not same.all():
        keep = pa.array(same)
        encoded = [pc.if_else(keep, ids, pa.array([[]] * len(ids), ids.type)) for ids in encoded]
        sides = [Side(ids, table) for ids, table in zip(encoded, pair.bytes_of)]
    a, b = sides
    links = a.table("a").join(b.table("b"), ["doc", "end"], join_type="inner", use_threads=False)
    # places count on from document to document, so they give the order of documents and ends as well
    order = np.lexsort([links["b_place"].to_numpy(), links["a_place"].to_numpy()])
    links = links.take(pa.array(order)).combine_chunks()
    docs, ends = (links[name].to_numpy().astype(np.int64) for name in ("doc", "end"))
    width = int(max(a.ends.max(initial=0), b.ends.max(initial=0))) + 1
    cuts = docs * width + ends
    cuts = cuts[np.diff(cuts, prepend=-1) > 0]
    (a_groups, n_groups), (b_groups, _) = (side.groups(cuts, width, pair.names) for side in sides)
    groups = pc.binary_join_element_wise(a_groups, b_groups, "|")
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(_offsets(n_groups), pa.int32()), groups), ";")
    if digest:
        whole = pa.array([hashlib.sha256(text.as_buffer()).hexdigest() if n else "" for text, n in zip(whole, n_groups)], pa.string())
    at = pa.array(_offsets(np.bincount(docs, minlength=len(given))), pa.int32())
    columns = [pa.array(a.counts), pa.array(b.counts), pa.array(n_groups.astype(np.int64)), whole]
    columns += [pa.ListArray.from_arrays(at, links[name].combine_chunks()) for name in ("a", "b")]
    return pa.StructArray.from_arrays([c.cast(kind) for c, (_, kind) in zip(columns, FIELDS)], [name for name, _ in FIELDS])


_BUILT: dict[int, Pair] = {}


def _pair(shared) -> Pair:
    which = zlib.crc32(shared.value[1], zlib.crc32(shared.value[0].encode()))
    if which not in _BUILT:
        _BUILT.clear()
        _BUILT[which] = Pair(*shared.value)
    return _BUILT[which]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, number) of rows whose sizes add up to about so much at a time (a larger row by itself)."""
    place = np.cumsum(sizes) // most
    for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(place)) + 1):
        if len(part):
            yield int(part[0]), len(part)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: (doc_id, n_a, n_b, n_groups, groups, a, b).

    A is a byte-level BPE in JSON and encodes a space and the text, B is a SentencePiece model. Special tokens
    in a text are plain text. ``groups`` lists the ids of the groups, such as ``1,2|3;4|5,6``; with
    ``digest`` its SHA-256 stands there, or nothing without tokens. ``a`` and ``b`` are the ids of the
    links in order: pairs of tokens whose bytes end together.

    Null and empty texts, and texts that the bytes of A or B do not give back, have no tokens. Repeated rows
    and null ids each get a row. An empty table gives no rows. Texts of over a million characters are tokenized
    in parts, cut at a single space, where tokens of both sides end. The driver reads the two files.
    """
    with open(a_path, encoding="utf-8") as file:
        a_json = json.dumps(json.load(file), ensure_ascii=False)
    with open(b_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast((a_json, file.read()))

    rows = picked(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shared)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, n in _slices(sizes, _SLICE):
                found = align(pair, batch.column("text").slice(at, n).to_pylist(), digest)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), *found.flatten()], ["doc_id", *[name for name, _ in FIELDS]])
                pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_ALIGNED}")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Table]]:
    """Rows of a bounded number of links at a time, and their links with the row they are in."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("a")).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, n in _slices(sizes, _LINKS):
            part = batch.slice(at, n)
            doc = pc.list_parent_indices(part.column("a"))
            yield part, pa.table({"doc": doc, "a": pc.list_flatten(part.column("a")), "b": pc.list_flatten(part.column("b"))})
            pa.default_memory_pool().release_unused()


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n): in how many links two ids are. Counts of a batch are made in Arrow and added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _links(batches):
            counts = found.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
            yield from counts.rename_columns({"count_all": "n"}).select(["a", "b", "n"]).to_batches()

    return links.select("a", "b").mapInArrow(run, "a INT, b INT, n LONG").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _look_up(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with pa.ipc.open_stream(shared.value) as reader:
            counts = reader.read_all()
        for part, links in _links(batches):
            found = links.join(counts, ["a", "b"], join_type="inner", use_threads=False)
            sums = found.group_by("doc", use_threads=False).aggregate([("best", "sum"), ("n", "sum")])
            best, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            docs = sums["doc"].to_numpy()
            best[docs], total[docs] = sums["best_sum"].to_numpy(), sums["n_sum"].to_numpy()
            n_links = pc.cast(pc.list_value_length(part.column("a")), pa.int64())
            kept = [part.column(name) for name in _KEPT]
            yield pa.RecordBatch.from_arrays([*kept, n_links, pa.array(best), pa.array(total)], [*_KEPT, "n_links", "n_best", "count_sum"])

    return run


_KEPT = ["doc_id", "n_a", "n_b", "n_groups", "groups"]


def counted(links: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of ``aligned`` with (n_links, n_best, count_sum) in place of their links.

    ``n_best`` counts the links whose count is the highest that their id of B has, ``count_sum`` adds up the
    counts of all links. ``counts`` has one row per pair of ids; how many there can be depends on the two
    vocabularies alone (``Pair.pair_bound``), so they are broadcast.
    """
    table = counts.select("a", "b", "n").toArrow()
    table = table.sort_by([("a", "ascending"), ("b", "ascending")])
    highest = table.group_by("b").aggregate([("n", "max")]).rename_columns({"n_max": "highest"})
    table = table.join(highest, "b")
    best = pc.cast(pc.equal(table["n"], table["highest"]), pa.int64())
    table = table.drop_columns(["highest"]).append_column("best", best)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    shared = links.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    kind = links.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a LONG, n_b LONG, n_groups LONG, groups STRING, n_links LONG, n_best LONG, count_sum LONG"
    return links.select(*_KEPT, "a", "b").mapInArrow(_look_up(shared), schema)
