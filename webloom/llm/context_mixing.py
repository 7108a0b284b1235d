"""Language-model scoring by logistic context mixing over bits.

A text is the sequence of its words in lower case (A-Z only), each followed by a space, and one end mark.
A byte is a path in a Huffman tree of the training bytes; every turn of the path is one bit to predict.

1. Hashed contexts count the bits that followed them in the training texts. The first byte of a word is
   seen from the words before it (nothing, their last two bytes, one word, two words), the bytes after it
   from the word itself (two bytes, three bytes, all of it so far). Counts become logits.
2. The logits of a bit are added with weights that a gate chooses: by the place in the word and by how sure
   the sharpest predictors are. Inside words the weights are learned online from the training words, each
   task for itself, and averaged; a table that maps mixed logits to observed bits refines the result.
3. At first bytes every text, however short, has weights of its own. They start alike and learn online through the
   text that is scored, from each first byte before the next. A table of observed bits, filled by doing the same on
   all training texts, refines the result there too.

So a word's inner bits cost the same wherever it stands, and are worked out once for each distinct word. The
sum of all bits is a proper probability of the sequence.

The tables of hashed contexts have a fixed number of slots, so the model has a fixed size (``SLOTS``); it
passes through the driver and is broadcast. Word counts are exact and stay a distributed table.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import shingles
from webloom.llm.common import free_name, picked, stored
from webloom.plans.lineage import discard

#: Slots (powers of two) of the tables: of the contexts of first bytes, then of those inside a word.
ACROSS, INSIDE = (15, 16, 20, 20), (16, 20, 22)
SLOTS = sum(1 << bits for bits in ACROSS + INSIDE)
#: Words that are counted on the spot, as the most frequent ones; the counts of others come by a join.
COMMON = 1 << 16
END = b"\n"
#: Bytes of a word that are modelled together, and of a common word.
_PART, _KEY = 4096, 64
#: What stands for a word of more bytes: parts, which are modelled, and one digest, which is counted. Words have no spaces.
_OF_LONG, _LONG = b" ", b"  "
_CHUNK_SLOTS, _SCALE, _PRIOR = 1 << 15, 16.0, 0.4
#: Bytes of short texts that are read together, and words that are costed together.
_TOGETHER, _COSTED = 3 << 19, 1 << 13
#: Words, and distinct ones, of parts that are read together.
_TOKENS, _WORDS = 1 << 18, 1 << 17
#: Words whose first bytes are laid out at once.
_STRETCH = 1 << 15
_SALTS = 16
#: First bytes of a text after which its weights learn.
_BLOCK = 1
_STEP = 1024
_PLACES, _SURE, _LEVELS = 8, 20, 49
GATES = _PLACES * _SURE
_FIRST_GATES = 12
#: Weights at the start, steps of learning, and least probability of a bit.
START, RATE, ONLINE_RATE, LEAST = 0.33, 0.3, 0.05, 1e-4
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64
_LN10 = float(np.log(10.0))
_NODES = (np.arange(256, dtype=np.uint64) * _U(0x9E3779B1)).astype(np.uint32)


class Code:
    """Huffman code of bytes: the turns (2 * node + bit) of a byte are ``turns[at[byte]:][:sizes[byte]]``."""

    def __init__(self, counts: list[int]):
        heap = [(n + 1, byte, byte) for byte, n in enumerate(counts)]
        heapq.heapify(heap)
        children = []
        while len(heap) > 1:
            (n, _, left), (m, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            children.append((left, right))
            node = 255 + len(children)
            heapq.heappush(heap, (n + m, node, node))
        paths, open_nodes = [[]] * 256, [(heap[0][2], [])]
        while open_nodes:
            node, path = open_nodes.pop()
            if node < 256:
                paths[node] = path
            else:
                open_nodes += [(child, [*path, 2 * (node - 256) + bit]) for bit, child in enumerate(children[node - 256])]
        self.sizes = np.array([len(path) for path in paths], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.turns = np.array([turn for path in paths for turn in path], np.int64)

    def bits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of turns of each byte, and the turns of all in order."""
        sizes = self.sizes[values]
        ends = np.cumsum(sizes)
        places = np.repeat(self.at[values] - (ends - sizes), sizes)
        places += np.arange(len(places))
        return sizes, self.turns[places]


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


_POWER = _powers(_ODD, 2 * _PART)


def _hashed(values: np.ndarray, which: int) -> np.ndarray:
    values = ((values ^ (values >> _U(31))) + _U(which + 1)) * _U(0xD6E8FEB86659FD93)
    return (values >> _U(32)).astype(np.uint32)


class Laid:
    """Words side by side, each with a space after it, and hashes of what each byte has before it in its word."""

    def __init__(self, words: list[bytes]):
        self.bytes = np.frombuffer(b"".join([word + b" " for word in words]), np.uint8)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        _, sums = self._sums()
        self.hashes = sums[self.starts + self.sizes - 1] - sums[self.starts]

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Place of each byte in its word, and running sums of digits. A word's bytes are digits of a number, modulo 2 ** 64."""
        places = np.arange(len(self.bytes)) - np.repeat(self.starts, self.sizes)
        digits = (self.bytes.astype(np.uint64) + _U(1)) * _POWER[places]
        sums = np.zeros(len(digits) + 1, np.uint64)
        np.cumsum(digits, out=sums[1:])
        return places, sums

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are modelled, and which are counted as words."""
        spaces = [self.bytes[np.minimum(self.starts + k, self.starts + self.sizes - 2)] == _OF_LONG[0] for k in (0, 1)]
        digest = spaces[0] & spaces[1]
        return ~digest, ~spaces[0] | digest

    def inside(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of the bytes after the first ones: byte, number of the word, place in the word, context hashes."""
        x = np.concatenate([np.zeros(3, np.uint64), self.bytes.astype(np.uint64)])
        n = len(self.bytes)
        places, sums = self._sums()
        before = sums[:-1] - np.repeat(sums[self.starts], self.sizes)
        two = x[2 : 2 + n] | (np.where(places > 1, x[1 : 1 + n], _U(0)) << _U(8))
        three = two | (np.where(places > 2, x[:n], _U(0)) << _U(16))
        later = places > 0
        owners = np.repeat(np.arange(len(self.sizes)), self.sizes)
        hashes = [_hashed(values[later], k) for k, values in enumerate((two, three, before))]
        return self.bytes[later], owners[later], places[later], hashes

    def ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every word: its hash, its first byte, its last two bytes."""
        last = self.starts + self.sizes - 2
        one, other = (self.bytes[np.maximum(at, self.starts)].astype(np.uint64) for at in (last, last - 1))
        two = one | (np.where(last > self.starts, other, _U(0)) << _U(8))
        return self.hashes, self.bytes[self.starts], two


def _slots(hashes: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, bits: int) -> np.ndarray:
    slots = np.repeat(hashes, sizes)
    slots ^= nodes
    slots &= np.uint32((1 << bits) - 1)
    return slots


def first_bytes(parts: list[np.ndarray], closed: list[bool], laid: Laid) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """First bytes of the words of some parts of texts, the end mark included, with their contexts.

    A part is an array of places in ``laid``; ``closed`` says that the text ends with it. The third result
    has the number of first bytes of each part.
    """
    hashes, firsts, lasts = laid.ends()
    sizes = np.array([len(part) + end for part, end in zip(parts, closed)], np.int64)
    stops = np.cumsum(sizes)
    mark = len(hashes)  # stands for the end, and for what is before a part
    sequence = np.concatenate([np.append(part, [mark] * end) for part, end in zip(parts, closed)] or [[]]).astype(np.int64)
    hashes, firsts, lasts = np.append(hashes, _U(0)), np.append(firsts, END[0]), np.append(lasts, _U(0))
    place = np.arange(len(sequence)) - np.repeat(stops - sizes, sizes)
    one = np.where(place > 0, np.roll(sequence, 1), mark)
    two = np.where(place > 1, np.roll(sequence, 2), mark)
    both = hashes[one] * _U(_ODD) + (hashes[two] ^ (hashes[two] >> _U(29)))
    zero = np.zeros(len(sequence), np.uint64)
    contexts = [_hashed(values, 8 + k) for k, values in enumerate((zero, lasts[one], hashes[one], both))]
    return firsts[sequence], contexts, sizes


def _stretches(parts: list[np.ndarray]) -> Iterator[slice]:
    """Parts in a row that together have a bounded number of words; a part of more comes alone."""
    start, n = 0, 0
    for at, part in enumerate(parts):
        if at > start and n + len(part) > _STRETCH:
            yield slice(start, at)
            start, n = at, 0
        n += len(part)
    if start < len(parts):
        yield slice(start, len(parts))


class _Places(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def _keys(word: bytes) -> list[bytes]:
    """A word itself, or the parts and the digest that stand for a long one."""
    if len(word) <= _PART:
        return [word]
    parts = [_OF_LONG + word[at : at + _PART] for at in range(0, len(word), _PART)]
    return [*parts, _LONG + hashlib.sha256(word).digest()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[tuple[dict, np.ndarray, bool]]]]:
    """Words, and parts of texts as (row without the text, places of their words, is the last part).

    A part has about a megabyte at most, and there are a bounded number of words and parts at a time.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        start = total = 0
        for at, size in enumerate(sizes):
            if at > start and total + size > _TOGETHER:
                yield from _read_some(batch.slice(start, at - start))
                start, total = at, 0
            total += size
        if start < len(sizes):
            yield from _read_some(batch.slice(start))


def _read_some(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[tuple[dict, np.ndarray, bool]]]]:
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    if (sizes > shingles._CHUNK).any():
        yield from _read_apart(batch, sizes > shingles._CHUNK)
        return
    # splits at the same six characters as SPACE; bytes are looked at, not characters
    split = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text").view(pa.string())))
    coded = split.values.dictionary_encode()
    words, places = coded.dictionary.view(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64)
    stops = split.offsets.to_numpy().astype(np.int64)
    long = np.fromiter(map(len, words), np.int64, len(words)) > _PART
    if long.any():
        owners = np.repeat(np.arange(batch.num_rows), np.diff(stops))
        yield from _read_apart(batch, np.bincount(owners, long[places], batch.num_rows) > 0)
        return
    if b"" in words:  # white space before the first word, or after the last one
        empty = words.index(b"")
        kept = places != empty
        stops = np.concatenate([[0], np.cumsum(kept)])[stops]
        places = places[kept]
        places -= places > empty
        del words[empty]
    rows = batch.drop_columns(["text"]).to_pylist()
    yield words, [(row, part, True) for row, part in zip(rows, np.split(places, stops[1:-1]))]


def _read_apart(batch: pa.RecordBatch, long: np.ndarray) -> Iterator[tuple[list[bytes], list[tuple[dict, np.ndarray, bool]]]]:
    """Rows of long texts or long words in parts, the others together."""
    if not long.all():
        yield from _read_some(batch.filter(pa.array(~long)))
    places, parts, n = _Places(), [], 0
    apart = batch.filter(pa.array(long))
    for row, text in zip(apart.drop_columns(["text"]).to_pylist(), apart.column("text")):
        chunks = shingles.word_chunks(text.as_buffer().to_pybytes().lower())
        words = next(chunks, [])
        while words is not None:
            following = next(chunks, None)
            keys = [key for word in words for key in _keys(word)]
            part = np.fromiter(map(places.__getitem__, keys), np.int64, len(keys))
            parts.append((row, part, following is None))
            n += len(keys) + 16
            words = following
            if n > _TOKENS or len(places) > _WORDS:
                yield list(places), parts
                places, parts, n = _Places(), [], 0
    if parts:
        yield list(places), parts


COUNTS = "chunk INT, slots BINARY, counts BINARY"
_COUNTS = pa.schema([("chunk", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())])


def _sparse(counts: np.ndarray) -> dict[str, list]:
    """Columns of ``COUNTS``: the places in a stretch of a table that are not zero, and their numbers."""
    out = {"chunk": [], "slots": [], "counts": []}
    for chunk, part in enumerate(counts.reshape(-1, 2 * _CHUNK_SLOTS)):
        slots = np.flatnonzero(part)
        if len(slots):
            out["chunk"].append(chunk)
            out["slots"].append(zlib.compress(slots.astype("<u2").tobytes(), 1))
            out["counts"].append(zlib.compress(part[slots].astype("<i8").tobytes(), 1))
    return out


def _dense(slots: bytes, counts: bytes) -> np.ndarray:
    out = np.zeros(2 * _CHUNK_SLOTS, np.int64)
    out[np.frombuffer(zlib.decompress(slots), "<u2")] = np.frombuffer(zlib.decompress(counts), "<i8")
    return out


def _offsets(bits: tuple[int, ...]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([1 << b for b in bits])])


def _add(counts: np.ndarray, bits: tuple[int, ...], hashes: list[np.ndarray], sizes, turns, weights=None) -> None:
    """Count bits under each of their contexts; a slot has two counts in a row."""
    nodes, bit = _NODES[turns >> 1], turns & 1
    for k, at in enumerate(_offsets(bits)[:-1]):
        slots = (_slots(hashes[k], sizes, nodes, bits[k]).astype(np.int64) << 1) + bit
        where = counts[2 * at : 2 * (at + (1 << bits[k]))]
        if weights is None and len(slots) > len(where) // 8:
            where += np.bincount(slots, minlength=len(where))
        else:
            np.add.at(where, slots, 1 if weights is None else weights)


GATHERED = f"word BINARY, trained LONG, everywhere LONG, {COUNTS}"
_GATHERED = pa.schema([("word", pa.binary()), ("trained", pa.int64()), ("everywhere", pa.int64()), *_COUNTS])


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _gather(code: Code) -> Callable:
    """Counts of words, and of bits after the contexts of first bytes, over the texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * int(_offsets(ACROSS)[-1]), np.int64)
        for words, parts in _read(batches):
            learned = [(part, last) for row, part, last in parts if row["learn"]]
            laid = Laid(words)
            modelled, _ = laid.kinds()
            kept, closed = [p[modelled[p]] for p, _ in learned], [last for _, last in learned]
            for some in _stretches(kept):
                values, hashes, _ = first_bytes(kept[some], closed[some], laid)
                _add(counts, ACROSS, hashes, *code.bits(values))
            size = len(words)
            everywhere = np.bincount(np.concatenate([part for _, part, _ in parts]), minlength=size)
            trained = np.bincount(np.concatenate([part for part, _ in learned] or [[]]).astype(np.int64), minlength=size)
            ends = [sum(last for _, _, last in parts), sum(last for _, last in learned)]
            yield _rows(_GATHERED, word=[*words, END], trained=np.append(trained, ends[1]), everywhere=np.append(everywhere, ends[0]))
        yield _rows(_GATHERED, **_sparse(counts))

    return run


def _count_inside(code: Code) -> Callable:
    """Counts of bits after the contexts inside words, over the words of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * int(_offsets(INSIDE)[-1]), np.int64)
        for batch in batches:
            values, owners, _, hashes = Laid(batch.column("word").to_pylist()).inside()
            sizes, turns = code.bits(values)
            weights = batch.column("trained").to_numpy()[owners]
            _add(counts, INSIDE, hashes, sizes, turns, np.repeat(weights, sizes))
        yield _rows(_COUNTS, **_sparse(counts))

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            values = _dense(row["slots"], row["counts"])
            total[row["chunk"]] = total[row["chunk"]] + values if row["chunk"] in total else values
    for chunk, values in total.items():
        yield _rows(_COUNTS, **_sparse(values) | {"chunk": [chunk]})


def _tables(rows: DataFrame, bits: tuple[int, ...]) -> list[np.ndarray]:
    """Logits of the slots, in steps of 1/16, one byte each.

    Counts are added up in two steps, so that no task reads the rows of a stretch from all tasks.
    """

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_logits(_dense(row["slots"], row["counts"])).tobytes() for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], ["chunk", "steps"])

    salted = rows.withColumn("salt", F.spark_partition_id() % _SALTS).repartition("chunk", "salt")
    part = salted.select("chunk", "slots", "counts").mapInArrow(_summed, COUNTS)
    whole = part.repartition("chunk").mapInArrow(_summed, COUNTS)
    table = np.zeros(int(_offsets(bits)[-1]), np.int8)
    for chunk, steps in whole.mapInArrow(logits, "chunk INT, steps BINARY").collect():
        table[chunk * _CHUNK_SLOTS : (chunk + 1) * _CHUNK_SLOTS] = np.frombuffer(steps, np.int8)
    at = _offsets(bits)
    return [table[a:b] for a, b in zip(at, at[1:])]


def _logits(counts: np.ndarray) -> np.ndarray:
    zeros, ones = counts[0::2], counts[1::2]
    return np.clip(np.rint(_SCALE * np.log((ones + _PRIOR) / (zeros + _PRIOR))), -127, 127).astype(np.int8)


class Model:
    """Code, tables of logits, weights inside words, and the tables that refine the logits inside words and at first bytes."""

    def __init__(self, code: Code, across: list[np.ndarray], inside: list[np.ndarray]):
        self.code, self.across, self.inside = code, across, inside
        self.weights = np.full((len(INSIDE), GATES), START, np.float32)
        self.refined = self.refined_first = None

    def _inside(self, laid: Laid):
        """Of the bits inside words: owner's number, bit, gate, logits of the predictors."""
        values, owners, places, hashes = laid.inside()
        sizes, turns = self.code.bits(values)
        nodes = _NODES[turns >> 1]
        x = [t.take(_slots(h, sizes, nodes, b)).astype(np.float32) / np.float32(_SCALE) for t, h, b in zip(self.inside, hashes, INSIDE)]
        sure = _levels(x[2], (0.1, 1, 2.2, 3.5)) * 4 + _levels(x[1], (0.5, 1.5, 3))
        gates = np.repeat(np.minimum(places, _PLACES - 1), sizes) * _SURE + sure
        return np.repeat(owners, sizes), (turns & 1).astype(np.float32), gates, x

    def learn(self, words: list[bytes], counts: np.ndarray, seen: np.ndarray, bits: np.ndarray, weight: np.ndarray) -> None:
        """One step of the weights along the error on some words; adds up bits per gate and level, and gates' weights."""
        owners, bit, gates, x = self._inside(Laid(words))
        mixed = sum(w[gates] * v for w, v in zip(self.weights, x))
        times = counts[owners].astype(np.float32)
        n = np.bincount(gates, times, GATES)
        error = (bit - _chance(mixed)) * times
        cells = gates * _LEVELS + _level(mixed)
        seen += np.bincount(cells, times, GATES * _LEVELS)
        bits += np.bincount(cells, times * bit, GATES * _LEVELS)
        weight += n
        for w, v in zip(self.weights, x):
            w += (RATE * np.bincount(gates, error * v, GATES) / (n + 1)).astype(np.float32)

    def word_costs(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of what follows the first byte of each word, its space included; 0 for a digest."""
        laid = Laid(words)
        owners, bit, gates, x = self._inside(laid)
        mixed = sum(w[gates] * v for w, v in zip(self.weights, x))
        chance = _chance(mixed)
        if self.refined is not None:
            chance = (chance + self.refined[gates * _LEVELS + _level(mixed)]) / 2
        chance = np.clip(chance, LEAST, 1 - LEAST)
        costs = np.bincount(owners, np.log(np.where(bit > 0, chance, 1 - chance)), len(words)) / _LN10
        return np.where(laid.kinds()[0], costs, 0.0)

    def first_costs(self, parts: list[np.ndarray], closed: list[bool], laid: Laid, observed: np.ndarray | None = None) -> list[float]:
        """log10 probability of the first bytes of each part; its weights are learned on the way, from its first block on.

        ``observed`` adds up the bits per gate and level of the mixed logit: all, and those that are 1.
        """
        # parts of about the same length come together, for their blocks are gone through side by side
        order = sorted(range(len(parts)), key=lambda at: len(parts[at]))
        parts, closed = [parts[at] for at in order], [closed[at] for at in order]
        costs = np.empty(len(parts))
        costs[order] = [cost for some in _stretches(parts) for cost in self._first_costs(parts[some], closed[some], laid, observed)]
        return costs.tolist()

    def _first_costs(self, parts: list[np.ndarray], closed: list[bool], laid: Laid, observed: np.ndarray | None) -> list[float]:
        values, hashes, n_bytes = first_bytes(parts, closed, laid)
        sizes, turns = self.code.bits(values)
        nodes, ones = _NODES[turns >> 1], (turns & 1) > 0
        steps = [t.take(_slots(h, sizes, nodes, b)) for t, h, b in zip(self.across, hashes, ACROSS)]
        gates = _GATES_OF[0][steps[2].view(np.uint8)] + _GATES_OF[1][steps[3].view(np.uint8)]
        v = np.stack(steps).astype(np.float32)
        v /= np.float32(_SCALE)
        signs = np.where(ones, np.float32(1), np.float32(-1))
        mixed = self._mix(n_bytes, sizes, gates, v, signs)
        chance = _chance(signs * mixed)
        if observed is not None or self.refined_first is not None:
            cells = gates * _LEVELS + _level(mixed)
        if observed is not None:
            observed[0] += np.bincount(cells, minlength=_FIRST_GATES * _LEVELS)
            observed[1] += np.bincount(cells[ones], minlength=_FIRST_GATES * _LEVELS)
        if self.refined_first is not None:
            refined = self.refined_first[cells]
            chance = (chance + np.where(ones, refined, 1 - refined)) / 2
        owners = np.repeat(np.repeat(np.arange(len(parts)), n_bytes), sizes)
        return (np.bincount(owners, np.log(np.maximum(chance, LEAST)), len(parts)) / _LN10).tolist()

    @staticmethod
    def _mix(n_bytes: np.ndarray, sizes: np.ndarray, gates: np.ndarray, v: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Mixed logits of the bits of all parts. The weights of each part learn from every block of first bytes before the
        next one; blocks of the same number are taken together, the parts of many blocks first."""
        n_cells = _FIRST_GATES * len(ACROSS)  # of a part; a cell has a predictor's weight under a gate
        n_blocks = -(-n_bytes // _BLOCK)
        place = np.empty(len(n_bytes), np.int64)
        place[np.argsort(-n_blocks, kind="stable")] = np.arange(len(n_bytes))
        block = (np.arange(len(sizes)) - np.repeat(np.cumsum(n_bytes) - n_bytes, n_bytes)) // _BLOCK
        block, owner = np.repeat(block, sizes), np.repeat(np.repeat(place, n_bytes), sizes)
        order = np.argsort(block, kind="stable")
        cells = (owner * n_cells + gates)[order]
        own, sign, mixed = v[:, order], signs[order], np.empty(len(order), np.float32)
        active = len(n_blocks) - np.cumsum(np.bincount(n_blocks))  # parts that have a block of each number
        borders = np.searchsorted(block[order], np.arange(len(active)))
        shifts = _FIRST_GATES * np.arange(len(ACROSS))[:, None]
        weights = np.full(len(n_blocks) * n_cells, START, np.float32)
        for k, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())):
            cell, x = cells[a:b] + shifts, own[:, a:b]
            mixed[a:b] = (weights.take(cell) * x).sum(0)
            if active[k + 1]:
                size = n_cells * int(active[k])
                wrong = sign[a:b] * (1 - _chance(sign[a:b] * mixed[a:b]))
                cell = cell.ravel()
                step = np.bincount(cell, (wrong * x).ravel(), size)
                step *= ONLINE_RATE / np.sqrt(np.bincount(cell, minlength=size) + 1)
                weights[:size] += step.astype(np.float32)
        out = np.empty_like(mixed)
        out[order] = mixed
        return out


def _levels(x: np.ndarray, borders: tuple[float, ...]) -> np.ndarray:
    size = np.abs(x)
    out = np.zeros(x.shape, np.int64)
    for border in borders:
        out += size > border
    return out


#: Gates of first bytes by the logits of the third and of the fourth predictor, in steps; the sum of both is the gate.
_STEPS = np.arange(256, dtype=np.uint8).view(np.int8) / np.float32(_SCALE)
_GATES_OF = 3 * _levels(_STEPS, (0.1, 1, 2.2)), _levels(_STEPS, (0.1, 1.5))


def _chance(mixed: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-mixed))


def _level(mixed: np.ndarray) -> np.ndarray:
    half = _LEVELS // 2
    return np.clip(np.rint(mixed * 3), -half, half).astype(np.int64) + half


def _code(docs: DataFrame) -> Code:
    """Code by the bytes of the texts to learn from; 256 counts reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                if text.is_valid:
                    total += np.bincount(np.frombuffer(text.as_buffer().to_pybytes().lower(), np.uint8), minlength=256)
            total[END[0]] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    rows = docs.filter("learn").select("text").mapInArrow(count, "byte LONG, n LONG").groupBy("byte").agg(F.sum("n").alias("n"))
    counts = dict.fromkeys(range(256), 0) | {r.byte: r.n for r in rows.collect()}
    return Code([counts[byte] for byte in range(256)])


def _fit_inside(words: DataFrame, model: Model) -> None:
    """Learn weights and the refining table online, task by task, and merge them."""
    shared = words.sparkSession.sparkContext.broadcast(pickle.dumps(model, protocol=5))
    size = GATES * _LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        seen, bits, weight = np.zeros(size), np.zeros(size), np.zeros(GATES)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                own.learn(part.column("word").to_pylist(), part.column("trained").to_numpy(), seen, bits, weight)
        values = np.concatenate([seen, bits, weight, (own.weights * weight).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])

    rows = words.mapInArrow(run, "place LONG, value DOUBLE").groupBy("place").agg(F.sum("value").alias("value")).collect()
    if rows:
        values = np.zeros(2 * size + GATES * (1 + len(INSIDE)))
        values[[r.place for r in rows]] = [r.value for r in rows]
        seen, bits, weight = values[:size], values[size : 2 * size], values[2 * size : 2 * size + GATES]
        weights = values[2 * size + GATES :].reshape(len(INSIDE), GATES)
        model.weights = np.where(weight > 0, weights / np.maximum(weight, 1e-9), START).astype(np.float32)
        model.refined = _refining(seen, bits, GATES)
    shared.destroy()


def _fit_first(docs: DataFrame, model: Model) -> None:
    """Fill the table that refines first bytes: all texts to learn from are gone through as if they were scored."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model, protocol=5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, observed = pickle.loads(shared.value), np.zeros((2, _FIRST_GATES * _LEVELS))
        for words, parts in _read(batches):
            laid = Laid(words)
            modelled, _ = laid.kinds()
            own.first_costs([part[modelled[part]] for _, part, _ in parts], [last for *_, last in parts], laid, observed)
        values = observed.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])

    texts = docs.filter("learn").select("learn", "text")
    rows = texts.mapInArrow(run, "place LONG, value DOUBLE").groupBy("place").agg(F.sum("value").alias("value")).collect()
    observed = np.zeros(2 * _FIRST_GATES * _LEVELS)
    observed[[r.place for r in rows]] = [r.value for r in rows]
    seen, ones = observed.reshape(2, -1)
    if seen.any():
        model.refined_first = _refining(seen, ones, _FIRST_GATES)
    shared.destroy()


def _refining(seen: np.ndarray, ones: np.ndarray, gates: int) -> np.ndarray:
    """Chance of a 1 per gate and level: what was observed, and the level's own chance for want of it."""
    middles = _chance((np.arange(_LEVELS) - _LEVELS // 2) / 3)
    return ((ones + 4 * np.tile(middles, gates)) / (seen + 4)).astype(np.float32)


class Corpus:
    """What is gathered from the texts: exact word counts (a stored table), their sums, and the model."""

    def __init__(self, docs: DataFrame):
        code = _code(docs)
        gathered = stored(docs.select("learn", "text").mapInArrow(_gather(code), GATHERED), "lm_gathered")
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        words = gathered.filter("word IS NOT NULL").repartition(partitions, "word").groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("everywhere").alias("everywhere"))
        # a steady order that is not the alphabet's, for the weights that learn word by word
        self.words = stored(words.sortWithinPartitions(F.xxhash64("word")), "lm_words")
        long_word, part_of_long = F.startswith("word", F.lit(_LONG)), F.startswith("word", F.lit(_OF_LONG))
        known = self.words.filter("trained > 0")
        self.total, self.distinct = known.filter(long_word | ~part_of_long).agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count("*")).first()
        inside = known.filter(~long_word & (F.col("word") != F.lit(END))).select("word", "trained")
        across = gathered.filter("chunk IS NOT NULL").select("chunk", "slots", "counts")
        self.model = Model(code, _tables(across, ACROSS), _tables(inside.mapInArrow(_count_inside(code), COUNTS), INSIDE))
        _fit_inside(inside, self.model)
        _fit_first(docs, self.model)
        discard(gathered)
        self.shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(self.model, protocol=5))

    def costed(self, words: DataFrame) -> DataFrame:
        """(word, trained, cost) of rows of ``words``: the cost of a word's inner bytes is worked out once here."""
        return words.select("word", "trained").mapInArrow(_cost(self.shared), "word BINARY, trained LONG, cost DOUBLE")

    def common(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
        """Places, training counts and costs of the most frequent words: all with a count from a border on that at most ``COMMON`` reach."""
        levels = self.words.groupBy(F.floor(8 * F.log2("everywhere")).alias("level")).agg(F.count("*").alias("n")).collect()
        left, border = COMMON, None
        for level, n in sorted(map(tuple, levels), reverse=True):
            left -= n
            if left < 0:
                break
            border = level
        chosen = F.col("word") == F.lit(END)
        if border is not None:
            chosen = chosen | ((F.floor(8 * F.log2("everywhere")) >= border) & (F.length("word") <= _KEY))
        rows = self.costed(self.words.filter(chosen)).collect()
        counts, costs = np.array([r.trained for r in rows], np.int64), np.array([r.cost for r in rows], np.float64)
        return {bytes(r.word): place for place, r in enumerate(rows)}, counts, costs


SCORED = "row LONG, doc_id LONG, learned BOOLEAN, n_tokens LONG, n_known LONG, base DOUBLE, score DOUBLE, n_bytes LONG, words ARRAY<BINARY>, times ARRAY<LONG>"
_SCORED = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("learned", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base", pa.float64()),
        ("score", pa.float64()),
        ("n_bytes", pa.int64()),
        ("words", pa.list_(pa.binary())),
        ("times", pa.list_(pa.int64())),
    ]
)

_BUILT: dict[int, object] = {}


def _built(packed: bytes):
    """What was broadcast, unpacked once per worker."""
    which = zlib.crc32(packed)
    if which not in _BUILT:
        if len(_BUILT) > 1:  # a model, and the common words
            _BUILT.clear()
        _BUILT[which] = pickle.loads(packed)
    return _BUILT[which]


def _cost(shared) -> Callable:
    """Costs of words, 0 for digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _built(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _COSTED):
                part = batch.slice(at, _COSTED)
                costs = model.word_costs(part.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("trained"), pa.array(costs)], ["word", "trained", "cost"])

    return run


def _score(shared, shared_common, slots: float) -> Callable:
    """Scores of the parts of texts; words that are not common are listed, for their counts and costs are in a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (common, counts, costs) = _built(shared.value), _built(shared_common.value)
        end = int(counts[common[END]]) if END in common else 0
        at_end = np.log10((end + 1) / slots)
        # the last place stands for words that are not common
        counts, costs = np.append(counts, -1), np.append(costs, 0.0)
        bases = np.append(np.log10((counts[:-1] + 1) / slots), 0.0)
        for words, parts in _read(batches):
            laid = Laid(words)
            modelled, counted = laid.kinds()
            firsts = model.first_costs([part[modelled[part]] for _, part, _ in parts], [last for *_, last in parts], laid)
            at = np.fromiter(map(common.get, words, repeat(-1)), np.int64, len(words))
            known, cost, base = (counts[at] > 0) & counted, costs[at], np.where(counted, bases[at], 0.0)
            sizes = laid.sizes * modelled
            rows, rare = [], []
            for (row, part, last), first in zip(parts, firsts):
                rare.append(np.unique(part[at[part] < 0], return_counts=True))
                n_known = int(known[part].sum()) + (last and end > 0)
                score = first + float(cost[part].sum())
                rows.append((row["row"], row["doc_id"], row["learn"], int(counted[part].sum()) + last, n_known, float(base[part].sum()) + (at_end if last else 0.0), score, int(sizes[part].sum()) + last))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(places) for places, _ in rare])]), pa.int32())
            places, times = (pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*rare))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(words, pa.binary()).take(places), times)]
            columns = [pa.array(x, f.type) for x, f in zip(zip(*rows), _SCORED)]
            yield pa.RecordBatch.from_arrays(columns + lists, schema=_SCORED)

    return run


def scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, learned, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    ``learn`` says which rows the counts and the model are learned from. Tokens are the words in lower case
    (A-Z only) and one end. ``base_score`` is the sum of log10((c + 1) / (N + V + 1)) over the tokens, with c
    the token's count, N all and V the distinct tokens learned from; ``n_known`` has c > 0. ``score`` is the
    log10 probability of the words in order, as the module describes, and ``bits_per_byte`` the same over
    bytes, with one for the space after each word and one for the end. Unlike the base, the score sums to
    one over all texts: an unknown word costs what spelling it costs.

    A null or empty text is the end alone. Words of over 4,096 bytes are counted like others and modelled in
    parts of that length. Texts are scored in parts of about a megabyte, at whose borders contexts and online
    weights begin anew. A null ``learn`` is false. Repeated rows and null ids each get a row. An empty table
    gives no rows; if nothing is learned from, all bits are even. Ids are longs.
    """
    flag = free_name(docs, "__learn")
    rows = picked(docs.withColumn(flag, F.coalesce(learn, F.lit(False))), doc_id=id_col, text=text_col, learn=flag)
    rows = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), "learn")
    corpus = Corpus(rows)
    slots = float(corpus.total + corpus.distinct + 1)
    common = docs.sparkSession.sparkContext.broadcast(pickle.dumps(corpus.common(), protocol=5))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    parts = stored(numbered.mapInArrow(_score(corpus.shared, common, slots), SCORED), "lm_parts")
    rare = parts.select("row", F.inline(F.arrays_zip("words", "times"))).join(corpus.costed(corpus.words).withColumnRenamed("word", "words"), "words", "left")
    count = F.coalesce("trained", F.lit(0))
    counted = F.startswith("words", F.lit(_LONG)) | ~F.startswith("words", F.lit(_OF_LONG))
    zero = F.lit(0).cast("long")
    of_rare = rare.select(
        "row",
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("boolean").alias("learned"),
        zero.alias("n_tokens"),
        F.when((count > 0) & counted, F.col("times")).otherwise(zero).alias("n_known"),
        F.when(counted, F.col("times") * F.log10((count + 1) / F.lit(slots))).otherwise(0.0).alias("base"),
        (F.col("times") * F.col("cost")).alias("score"),
        zero.alias("n_bytes"),
    )
    summed = parts.drop("words", "times").unionByName(of_rare).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("learned").alias("learned"),
        *[F.sum(name).alias(name) for name in ("n_tokens", "n_known", "base", "score", "n_bytes")],
    )
    return summed.select(
        "doc_id",
        "learned",
        "n_tokens",
        "n_known",
        F.lit(corpus.total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        (-F.col("score") / (F.lit(np.log10(2.0).item()) * F.col("n_bytes"))).alias("bits_per_byte"),
    )
