"""SentencePiece encoding with seeded merge dropout, and decoding.

Byte-pair pieces are merged by an agenda: the best pair of neighbours first. A candidate merge that
comes up is skipped if a keyed hash says so: of the seed, the document, its copy, the unit's place in
the text, and the merge's place in the unit. Other merges then come up, and the text is cut in other
pieces, which decode to the same text. So every occurrence of a word is cut by its own dropout.

What is remembered of a unit (a word with the spaces before it) does not depend on any key: its cuts, one
for each set of merges that were skipped, with the merges that were made. An occurrence starts at the cut
without skips, hashes the merges made there, and goes on to the cut without those it skips, until it skips
none. That is the cut which the agenda comes to, for a merge that is skipped whenever it comes up is the
same as one that is never made.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import column, picked

ALPHA, SEED = 0.1, 0
#: Cuts that a worker remembers (it keeps them through later stages), and bytes of text that are encoded together.
_CACHED, _TOGETHER = 100_000, 1 << 20
#: Units up to this length are cut side by side in arrays, longer ones by a heap.
_SHORT = 32
_BORDER = re.compile(r"[^ ](?= )")
#: Characters of a long text that are cut in units at a time, and units of one array.
_CHUNK, _ARRAY = 1 << 20, 1 << 12
#: Merges of occurrences that are hashed at a time, and ids that are decoded at a time.
_STRETCH, _DECODED = 1 << 15, 1 << 14
_NEVER = 1 << 30
#: Texts that are encoded and sent on together.
_ROWS = 256
NOTHING = hashlib.sha256(b"").hexdigest()
_MASK = (1 << 64) - 1
# Odd constants that mix the bits of places.
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def _mixed(x):
    """Mixes 64-bit numbers without sign, one or an array of them."""
    x = (x ^ (x >> 32)) * _MIX[2] & _MASK
    x = (x ^ (x >> 29)) * _MIX[1] & _MASK
    return x ^ (x >> 32)


def _skips(keys: np.ndarray, merges: np.ndarray, limit: int) -> np.ndarray:
    """Places of the merges that are skipped, by the keys of their occurrences; a stretch that fits a cache at a time."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(merges), _STRETCH):
        x = keys[at : at + _STRETCH] ^ merges[at : at + _STRETCH]
        # as _mixed, in place
        for shift, factor in ((32, _MIX[2]), (29, _MIX[1])):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(32)
        x >>= np.uint64(32)
        found.append(at + np.flatnonzero(x < np.uint64(limit)))
    return np.concatenate(found)


def _code(i, middle, stop):
    """A merge by its place in a unit, as a number that can be mixed; of numbers or arrays."""
    return ((i * _MIX[0] + middle) * _MIX[0] + stop) & _MASK


class _Lists:
    """Lists of numbers, one after the other in an array that grows."""

    def __init__(self, kind: type):
        self.flat, self.stops = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64)
        self.n = 0

    def __len__(self) -> int:
        return self.n

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        begin = int(self.stops[self.n])
        self.flat = _room(self.flat, begin + len(flat))
        self.stops = _room(self.stops, self.n + len(sizes) + 1)
        self.flat[begin : begin + len(flat)] = flat
        self.stops[self.n + 1 : self.n + len(sizes) + 1] = begin + np.cumsum(sizes)
        self.n += len(sizes)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of some lists in a row, and how many each has."""
        sizes = self.stops[which + 1] - self.stops[which]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.stops[which] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))], sizes


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    out = np.zeros(max(n, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class Pieces:
    """Vocabulary, encoder and decoder of a byte-pair SentencePiece model.

    A space stands for the model's space mark, so that the mark itself, if a text has it, is encoded
    in bytes and decodes to itself.
    """

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=proto)
        self.ids: dict[str, int] = {}
        self.costs: dict[str, float] = {}
        self.bytes_of: list[bytes] = [b""] * model.get_piece_size()
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i)):
                piece = piece.replace("▁", " ")
                self.ids[piece], self.costs[piece], self.bytes_of[i] = i, -model.get_score(i), piece.encode()
        # no piece joins what lies on two sides of a unit's border
        assert not any(" " in piece.lstrip(" ") for piece in self.ids)
        breaks = "" if any("\n" in piece for piece in self.ids) else r"\n"
        self.units = re.compile(rf"[{breaks}]| *[^ {breaks}]+| +" if breaks else r" *[^ ]+| +")
        self.piece_sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.numbers = np.arange(1 << 16)
        self._pairs()
        self._forget()

    def _pairs(self) -> None:
        """Hash table of the pairs of pieces that make up a piece, with its cost and id."""
        n = len(self.bytes_of)
        found = {}
        for piece, at in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    found[left * n + right] = (int(self.costs[piece]), at)
        self.size = 1 << max(4, (4 * len(found)).bit_length())
        self.pair_keys = np.full(self.size, -1, np.int64)
        self.pair_costs, self.pair_ids = np.full(self.size, _NEVER, np.int32), np.zeros(self.size, np.int32)
        waiting, self.probes = np.array(list(found), np.int64), 0
        values = np.array(list(found.values()), np.int64).reshape(-1, 2)
        while len(waiting):
            at = self._slots(waiting, self.probes)
            free = self.pair_keys[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.pair_keys[at[first]], self.pair_costs[at[first]], self.pair_ids[at[first]] = waiting[first], *values[first].T
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            waiting, values, self.probes = waiting[rest], values[rest], self.probes + 1
        self.char_ids = np.full(0x110000, -1, np.int32)
        for piece, at in self.ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = at

    def _slots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(_MIX[0])) >> np.uint64(40)
        return (mixed.astype(np.int64) + probe) & (self.size - 1)

    def _merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and id of the merge of pieces with these ids; the cost is ``_NEVER`` if they do not merge."""
        shape = left.shape
        keys = np.where((left < 0) | (right < 0), -2, left.astype(np.int64) * len(self.bytes_of) + right).ravel()
        at = self._slots(keys, 0)
        found = self.pair_keys[at]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = self._slots(keys[open_], probe)
            there = self.pair_keys[at[open_]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_costs[at], np.int32(_NEVER)).reshape(shape), self.pair_ids[at].reshape(shape)

    # cuts: of a unit without some merges, its ids and the merges made

    def _cut_short(self, units: list[str], without: list[tuple[int, ...]]) -> tuple[np.ndarray, ...]:
        """Cuts of short units: ids and numbers of ids, merges made and numbers of them.

        Each turn takes the best candidate merge of every unit. Places are those in the flat arrays.
        """
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        n, width = len(units), int(lengths.max()) + 1
        symbols = np.full((n, width), -1, np.int32)
        symbols[:, :-1] = self.char_ids[np.array(units, f"U{width - 1}").view(np.uint32).reshape(n, width - 1)]
        starts = np.arange(width) < lengths[:, None]
        symbols[~starts] = -1
        cost, merged = np.full((n, width), _NEVER, np.int32), np.zeros((n, width), np.int32)
        cost[:, :-1], merged[:, :-1] = self._merge(symbols[:, :-1], symbols[:, 1:])
        banned = np.zeros((n, max(map(len, without))), np.uint64)
        for row, codes in enumerate(without):
            if codes:
                banned[row, : len(codes)] = codes
        end = np.arange(1, n * width + 1)
        before = np.arange(-1, n * width - 1)
        before[::width] = -1
        grid = cost
        symbols, starts, cost, merged = (x.ravel() for x in (symbols, starts, cost, merged))
        rows, made_rows, made = np.arange(n), [], []
        while True:
            base = rows * width
            i = base + (grid if len(rows) == n else grid[rows]).argmin(1)
            live = cost[i] < _NEVER
            if not live.all():
                rows, base, i = rows[live], base[live], i[live]
                if not rows.size:
                    break
            middle = end[i]
            stop = end[middle]
            codes = _code(*((x - base).astype(np.uint64) for x in (i, middle, stop)))
            r = rows
            if banned.shape[1]:
                skipped = (banned[rows] == codes[:, None]).any(1)
                cost[i[skipped]] = _NEVER
                r, i, middle, stop, codes = (x[~skipped] for x in (r, i, middle, stop, codes))
            made_rows.append(r)
            made.append(codes)
            symbols[i] = own = merged[i]
            cost[middle], starts[middle] = _NEVER, False
            end[i], before[stop] = stop, i
            left = before[i]
            there = np.flatnonzero(left >= 0)
            left = left[there]
            # the pairs with the next piece, and with the one before
            costs, ids = self._merge(np.concatenate([own, symbols[left]]), np.concatenate([symbols[stop], own[there]]))
            changed = np.concatenate([i, left])
            cost[changed], merged[changed] = costs, ids
        flat, sizes = symbols[starts], starts.reshape(n, width).sum(1)
        if (flat < 0).any():
            flat, sizes = self._in_bytes(units, flat, sizes, starts.reshape(n, width))
        of_row = np.concatenate([*made_rows, np.zeros(0, np.int64)])
        order = np.argsort(of_row, kind="stable")
        return flat, sizes, np.concatenate([*made, np.zeros(0, np.uint64)])[order], np.bincount(of_row, minlength=n)

    def _in_bytes(self, units: list[str], flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in which single characters that are no pieces are encoded in bytes."""
        lists = np.split(flat, np.cumsum(sizes)[:-1])
        for row in np.unique(np.repeat(np.arange(len(units)), sizes)[flat < 0]).tolist():
            lists[row] = np.array(self._ids(units[row], [*np.flatnonzero(starts[row]).tolist(), len(units[row])]), np.int32)
        return np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))

    def _cut_long(self, unit: str, without: tuple[int, ...]) -> tuple[tuple, tuple]:
        """The same for a unit of any length; the agenda is a heap."""
        n, costs, banned, made = len(unit), self.costs, set(without), []
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(costs[unit[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if unit[i : i + 2] in costs]
        heapq.heapify(agenda)
        while agenda:
            _, i, middle, stop = heapq.heappop(agenda)
            if end[i] != middle or end[middle] != stop:
                continue  # one of the two has been merged meanwhile
            code = _code(i, middle, stop)
            if code in banned:
                continue
            made.append(code)
            end[i], end[middle] = stop, -1
            if before[i] >= 0 and (cost := costs.get(unit[before[i] : stop])) is not None:
                heapq.heappush(agenda, (cost, before[i], i, stop))
            if stop < n:
                before[stop] = i
                if (cost := costs.get(unit[i : end[stop]])) is not None:
                    heapq.heappush(agenda, (cost, i, stop, end[stop]))
        borders = [0]
        while borders[-1] < n:
            borders.append(end[borders[-1]])
        return self._ids(unit, borders), tuple(made)

    def _ids(self, unit: str, borders: list[int]) -> tuple[int, ...]:
        out: list[int] = []
        for i, stop in zip(borders, borders[1:]):
            piece = self.ids.get(unit[i:stop])
            # a single character that is no piece is encoded in bytes
            out += [self.byte_ids[b] for b in unit[i:stop].encode()] if piece is None else [piece]
        return tuple(out)

    # remembered cuts, by number

    def _forget(self) -> None:
        self.roots: dict[str, int] = {}
        self.following: dict[int, int] = {}
        self.unit_of: list[str] = []
        self.without: list[tuple[int, ...]] = []
        self.cut_ids, self.cut_made = _Lists(np.int32), _Lists(np.uint64)

    def _add(self, units: list[str], without: list[tuple[int, ...]]) -> np.ndarray:
        """Make and remember cuts; returns their numbers."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(lengths, kind="stable")
        n_short = int(np.searchsorted(lengths[order], _SHORT, side="right"))
        numbers = np.zeros(len(units), np.int64)
        numbers[order] = len(self.unit_of) + np.arange(len(units))
        for at in range(0, n_short, _ARRAY):
            part = order[at : min(at + _ARRAY, n_short)].tolist()
            ids, n_ids, made, n_made = self._cut_short([units[k] for k in part], [without[k] for k in part])
            self.cut_ids.add(ids, n_ids)
            self.cut_made.add(made, n_made)
        for k in order[n_short:].tolist():
            ids, made = self._cut_long(units[k], without[k])
            self.cut_ids.add(np.array(ids, np.int32), np.array([len(ids)]))
            self.cut_made.add(np.array(made, np.uint64), np.array([len(made)]))
        self.unit_of += [units[k] for k in order.tolist()]
        self.without += [without[k] for k in order.tolist()]
        return numbers

    def _roots(self, units: list[str]) -> np.ndarray:
        """Numbers of the cuts of units without skips."""
        known = self.roots
        cuts = np.fromiter(map(known.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(cuts < 0)
        if len(missing):
            unknown = list(map(units.__getitem__, missing.tolist()))
            new = list(dict.fromkeys(unknown))
            known.update(zip(new, self._add(new, [()] * len(new)).tolist()))
            cuts[missing] = list(map(known.__getitem__, unknown))
        return cuts

    def _next(self, cuts: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the occurrences that skip some of the merges made in their cuts, and the cuts they go on to."""
        merges, n = self.cut_made.of(cuts)
        hit = _skips(np.repeat(keys, n), merges, limit)
        if not len(hit):
            return hit, hit
        owner = np.searchsorted(np.cumsum(n), hit, side="right")
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        who = owner[first]
        # occurrences that skip the same merges of the same cut go on together; a hash stands for the merges
        skipped = merges[hit]
        summed = np.add.reduceat(_mixed(skipped), first)
        groups, chosen, at = np.unique(_mixed(summed ^ cuts[who].astype(np.uint64)), return_index=True, return_inverse=True)
        known = self.following
        names = groups.tolist()
        new = [k for k, name in enumerate(names) if name not in known]
        if new:
            borders = np.append(first, len(hit))
            picked_ = chosen[new]
            parents = cuts[who[picked_]].tolist()
            more = [tuple(skipped[a:b].tolist()) for a, b in zip(borders[picked_].tolist(), borders[picked_ + 1].tolist())]
            made = self._add([self.unit_of[c] for c in parents], [self.without[c] + m for c, m in zip(parents, more)])
            known.update(zip([names[k] for k in new], made.tolist()))
        numbers = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        return who, numbers[at]

    def _cut(self, units: list[str], keys: np.ndarray, limit: int) -> np.ndarray:
        """The cut of each occurrence of a unit under its own key."""
        cuts = self._roots(units)
        if not limit:
            return cuts
        open_ = np.arange(len(units))
        while len(open_):
            who, following = self._next(cuts[open_], keys[open_], limit)
            open_ = open_[who]
            cuts[open_] = following
        return cuts

    def _chunks(self, text: str):
        """Lists of the units of a text, cut off where a unit starts."""
        at = 0
        while at < len(text):
            border = _BORDER.search(text, at + _CHUNK)
            stop = border.end() if border else len(text)
            yield self.units.findall(text, at, stop)
            at = stop

    def encode(self, texts: list[str], alpha: float = 0.0, keys: list[int] | None = None) -> list[np.ndarray]:
        """Ids of whole texts, each under its own key. Cuts that the texts share are made once."""
        limit = min(int(alpha * (1 << 32)), 1 << 32)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        todo: list[tuple[int, int, list[str]]] = []
        n_todo = 0

        def finish():
            if len(self.unit_of) > _CACHED:
                self._forget()
            units = list(chain.from_iterable(part for *_, part in todo))
            sizes = [len(part) for *_, part in todo]
            if limit:
                starts = [np.uint64(keys[place] & _MASK) ^ _mixed(np.arange(at, at + len(part), dtype=np.uint64) * np.uint64(_MIX[0])) for place, at, part in todo]
                cuts = self._cut(units, np.concatenate([*starts, np.zeros(0, np.uint64)]), limit)
            else:
                cuts = self._roots(units)
            all_ids, n = self.cut_ids.of(cuts)
            stops = np.concatenate([[0], np.cumsum(n)])
            borders = stops[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].tolist()
            for (place, *_), a, b in zip(todo, borders, borders[1:]):
                out[place].append(all_ids[a:b])
            todo.clear()

        for place, text in enumerate(texts):
            at = 0
            for units in self._chunks(" " + text if text else ""):
                todo.append((place, at, units))
                at += len(units)
                n_todo += len(units)
                if n_todo > _TOGETHER // 4:
                    finish()
                    n_todo = 0
        finish()
        return [np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.int32) for parts in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text whose ids these are, without the space that encoding puts in front."""
        return b"".join(self._bytes(ids[at : at + _DECODED]) for at in range(0, len(ids), _DECODED)).decode()[1:]

    def _bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of pieces; those of the vocabulary lie side by side."""
        sizes = self.piece_sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.piece_starts[ids] - (ends - sizes), sizes)
        places += self._counted(len(places))
        return self.piece_bytes[places].tobytes()

    def _counted(self, n: int) -> np.ndarray:
        """Numbers from 0 on."""
        return self.numbers[:n] if n <= len(self.numbers) else np.arange(n)


_BUILT: dict[int, Pieces] = {}
#: The file that was asked for last, and its checksum, which takes time to work out for every text.
_LATEST: list = [None, 0]


def _built(shared) -> Pieces:
    """The model of a broadcast file, built once per Python worker."""
    if shared.value is not _LATEST[0]:
        _LATEST[:] = shared.value, zlib.crc32(shared.value)
    which = _LATEST[1]
    if which not in _BUILT:
        _BUILT.clear()
        _BUILT[which] = Pieces(shared.value)
    return _BUILT[which]


def _shared(docs: DataFrame, path: str):
    """The model file, read on the driver; its size does not depend on the data."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def _parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Rows of a bounded number and of bounded texts at a time (a longer text by itself)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = total = 0
        for row, size in enumerate(sizes.tolist()):
            if row > at and (row - at == _ROWS or total + size > _TOGETHER):
                yield batch.slice(at, row - at)
                at, total = row, 0
            total += size
        if batch.num_rows > at:
            yield batch.slice(at)


def _encoded_parts(shared, batches: Iterator[pa.RecordBatch], text: str, key: str, alpha: float) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows with the ids of their texts (None of a null text).

    Rows of one key that follow each other are copies of a document: the copy's number goes into its key.
    """
    last, copy = None, 0
    for part in _parts(batches, text):
        texts, keys = part.column(text).to_pylist(), []
        for value, one in zip(part.column(key).to_pylist(), texts):
            copy = copy + 1 if (value, one) == last else 0
            last = (value, one)
            keys.append(_mixed((value ^ copy * _MIX[1]) & _MASK))
        given = [place for place, one in enumerate(texts) if one is not None]
        found = _built(shared).encode([texts[place] for place in given], alpha, [keys[place] for place in given])
        ids: list = [None] * len(texts)
        for place, one in zip(given, found):
            ids[place] = one
        yield part, ids


def encoded(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", out_col: str = "piece_ids", alpha: float = ALPHA, seed: int = SEED
) -> DataFrame:
    """The documents with the ids of their pieces in ``out_col``, which replaces a column of that name.

    ``alpha`` is the share of candidate merges that are skipped; with 0 the result is the plain
    segmentation. A document's key is its id. Rows that repeat id and text next to each other, as a mix
    that takes a document twice gives them, are copies and are cut by dropouts of their own. A null text
    has null ids, an empty one none. A null id has a key as well. An empty table gives no rows. Nothing is
    shuffled, and rows are sent on some hundreds at a time.
    """
    shared = _shared(docs, path)
    rest = [name for name in docs.columns if name != out_col]
    # inside, columns have names of their own, as not every name can be passed to a function
    own = [f"c{k}" for k in range(len(rest))]
    text = own[rest.index(text_col)]
    rows = docs.select(*[column(name).alias(c) for name, c in zip(rest, own)], F.xxhash64(column(id_col), F.lit(seed)).alias("key"))
    schema = T.StructType([*[rows.schema[c] for c in own], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _encoded_parts(shared, batches, text, "key", alpha):
            columns = [part.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))], [*own, "ids"])

    return rows.mapInArrow(run, schema).toDF(*rest, out_col)


def decoded(rows: DataFrame, path: str, ids_col: str = "piece_ids", out_col: str = "text") -> DataFrame:
    """The rows with the text of their piece ids in ``out_col``; null ids have a null text."""
    shared = _shared(rows, path)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        pieces = _built(shared)
        return pa.array((pieces.decode(row.values.to_numpy()) if row.is_valid else None for row in ids), pa.string())

    return rows.withColumn(out_col, decode(column(ids_col)))


def _with_key(docs: DataFrame, id_col: str, text_col: str, seed: int, **more: str) -> DataFrame:
    rows = picked(docs, doc_id=id_col, text=text_col, **more)
    return rows.withColumn("key", F.xxhash64("doc_id", F.lit(seed)))


ROUND_TRIPS = [("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())]


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """One row per document: (doc_id, n_pieces, ids_sha256, decoded_sha256, lossless).

    Encodes as ``encoded``, decodes as ``decoded``, and keeps digests of the ids (little-endian 32-bit
    numbers) and of the decoded text. A null text counts as empty: no pieces.
    """
    shared = _shared(docs, path)
    rows = _with_key(docs, id_col, text_col, seed)

    def trip(pieces: Pieces, text: str | None, ids: np.ndarray | None) -> tuple[int, str, str, bool]:
        if ids is None:
            return 0, NOTHING, NOTHING, True
        back = pieces.decode(ids)
        digests = hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
        return len(ids), *digests, back == text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _encoded_parts(shared, batches, "text", "key", alpha):
            pieces = _built(shared)
            trips = zip(*(trip(pieces, *pair) for pair in zip(part.column("text").to_pylist(), ids)))
            columns = [pa.array(values, kind) for values, (_, kind) in zip(trips, ROUND_TRIPS)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *[name for name, _ in ROUND_TRIPS]])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_pieces LONG, ids_sha256 STRING, decoded_sha256 STRING, lossless BOOLEAN")


def encoded_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", alpha: float = ALPHA, seed: int = SEED
) -> DataFrame:
    """One row per document and copy: (doc_id, source, n_pieces, piece_ids, lossless), encoded as by ``encoded``.

    The ids are decoded again at once; ``lossless`` says whether the text came back. Texts are not sent on.
    """
    shared = _shared(docs, path)
    rows = _with_key(docs, id_col, text_col, seed, source=source_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _encoded_parts(shared, batches, "text", "key", alpha):
            pieces = _built(shared)
            texts = part.column("text").to_pylist()
            lossless = [None if one is None else pieces.decode(one) == text for one, text in zip(ids, texts)]
            sizes = [None if one is None else len(one) for one in ids]
            columns = [pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(lossless, pa.bool_())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), *columns], ["doc_id", "source", "n_pieces", "piece_ids", "lossless"])

    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("doc_id", "source")}
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, n_pieces LONG, piece_ids ARRAY<INT>, lossless BOOLEAN")
