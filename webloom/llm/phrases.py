"""Phrase collocations by prefix-free parsing.

A text is a sequence of words with a mark at every break that no phrase crosses, and two marks at the end.

1. Every pair of neighbours whose hash has a certain remainder is a trigger. A chunk goes from one trigger to
   the end of the next, so neighbouring chunks share two words. Distinct chunks with their frequencies are
   the dictionary; repeated passages become one row each.
2. Phrases are counted inside the distinct chunks, weighed by frequency. A phrase belongs to the chunk in
   which it starts before the last two words, so what two chunks share is counted once.
3. Pairs are counted by hash first, and then triples made of two pairs that reach the least count, for a
   triple is never more frequent than its pairs. Sorted hashes are sent as differences, a few bytes each.
4. Pairs and triples whose hashes reach the least count are counted by their words. Filters of fixed size
   tell them apart; a phrase that passes by mistake only costs a row.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import picked, stored
from webloom.llm.shingles import joined, mixed
from webloom.plans import bloom
from webloom.plans.lineage import discard

LEAST, TOP, SCALE, INSIDE_PERCENT = 10, 2000, 1_000_000, 50
UNKNOWN = "und"
#: One of so many pairs of neighbours is a trigger; words of a chunk at most; words that two chunks share.
EVERY, _LONGEST, SHARED = 64, 4096, 2
#: The break between pieces. It is no part of any UTF-8 text.
BREAK = b"\xff"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_BREAKS + b"\t", BREAK * len(_BREAKS) + b" ")
_PART = 1 << 20
_WORDS = 1 << 20
#: Bits of the hashes that are counted; words of the corpus for each range of hashes that is counted by itself.
_BITS, _RANGE = 48, 1 << 20
_SALTS = 32


class _Places(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 400_000:
            self[word] = value
        return value


_HASHES = _Hashes()


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _sequence(text: bytes) -> Iterator[list[bytes]]:
    """Words and breaks of a whole text in lower case (A-Z only), a bounded part at a time."""
    at = 0
    while at < len(text):
        stop = min(at + _PART, len(text))
        while stop < len(text) and text[stop] not in b" \t\n":
            stop += 1
        yield text[at:stop].lower().translate(_TABLE).replace(BREAK, b" " + BREAK + b" ").split()
        at = stop


def chunks(text: bytes, every: int = EVERY) -> Iterator[bytes]:
    """The chunks of a text, words joined by spaces; none without words."""
    rest: list[bytes] = []
    for part in _sequence(text):
        rest += part
        if len(rest) > SHARED:
            starts = _starts(rest, every)
            yield from _joined(rest, starts)
            rest = rest[starts[-1] :]
    if rest:
        rest += [BREAK] * SHARED
        starts = _starts(rest, every)
        yield from _joined(rest, starts)
        yield b" ".join(rest[starts[-1] :])


def _starts(words: list[bytes], every: int) -> list[int]:
    """Where chunks start: at triggers, and in between if there is none for long."""
    hashes = _hashed(words)
    pairs = joined(hashes[:-1], hashes[1:])[: len(words) - SHARED]
    starts = [0]
    for trigger in np.flatnonzero(pairs % np.uint64(every) == 0).tolist():
        while trigger - starts[-1] > _LONGEST:
            starts.append(starts[-1] + _LONGEST)
        if trigger:
            starts.append(trigger)
    while len(words) - starts[-1] > 2 * _LONGEST:
        starts.append(starts[-1] + _LONGEST)
    return starts


def _joined(words: list[bytes], starts: list[int]) -> Iterator[bytes]:
    for start, stop in zip(starts, starts[1:]):
        yield b" ".join(words[start : stop + SHARED])


def dictionary(texts: DataFrame, every: int = EVERY) -> DataFrame:
    """One stored row per distinct chunk of a language: (lang, chunk, n), from (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = Counter(), 0
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for chunk in chunks(text.as_buffer().to_pybytes() if text.is_valid else b"", every):
                    found[lang, chunk] += 1
                    size += len(chunk)
                    if size > 16 * _PART:
                        yield _counted(found)
                        found, size = Counter(), 0
            yield _counted(found)

    def _counted(found: Counter) -> pa.RecordBatch:
        columns = [pa.array([lang for lang, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary()), pa.array(found.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "n"])

    found = texts.mapInArrow(run, "lang STRING, chunk BINARY, n LONG")
    return stored(found.groupBy("lang", "chunk").agg(F.sum("n").alias("n")), "phrase_chunks")


class Chunks:
    """Words of many chunks side by side, with what is needed to count phrases in them."""

    def __init__(self, langs: list[str], parts: list[bytes], n: np.ndarray):
        words = b" ".join(parts).split(b" ")
        places = _Places()
        self.ids = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        self.words = list(places)
        lang_places = _Places()
        lang_ids = np.fromiter(map(lang_places.__getitem__, langs), np.int64, len(langs))
        self.langs = list(lang_places)
        sizes = np.fromiter((part.count(b" ") + 1 for part in parts), np.int64, len(parts))
        ends = np.repeat(np.cumsum(sizes), sizes)
        at = np.arange(len(words))
        self.lang = np.repeat(lang_ids, sizes)
        self.n = np.repeat(n, sizes)
        self.is_word = self.ids != places.get(BREAK, -1)
        self.starts = self.is_word & (at < ends - SHARED)  # others start in the next chunk
        following = np.append(self.is_word[1:], False) & (at + 1 < ends)
        self.pairs = self.is_word & following

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """48-bit hashes of the language with the pair, and with the triple, that starts at every place."""
        words = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)[self.ids]
        langs = np.array([xxhash.xxh64_intdigest(x) for x in self.langs], np.uint64)[self.lang]
        pairs = joined(joined(words, np.roll(words, -1)), langs)
        return pairs >> np.uint64(64 - _BITS), joined(pairs, np.roll(words, -2)) >> np.uint64(64 - _BITS)

    def sums(self, where: np.ndarray, length: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Distinct (language, words) of the phrases of a length that start at some places, and their counts."""
        columns = [self.lang[where], *[self.ids[where + k] for k in range(length)]]
        if not len(where):
            return columns, np.zeros(0, np.int64)
        code = columns[0]
        for column in columns[1:]:
            code = np.unique(code, return_inverse=True)[1] * (int(column.max()) + 1) + column
        _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        counts = np.zeros(len(first), np.int64)
        np.add.at(counts, inverse, self.n[where])
        return [column[first] for column in columns], counts


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunks]:
    """Chunks of a bounded number of words together."""
    langs, parts, n, size = [], [], [], 0
    for batch in batches:
        for lang, part, times in zip(*(batch.column(name).to_pylist() for name in ("lang", "chunk", "n"))):
            langs.append(lang)
            parts.append(part)
            n.append(times)
            size += len(part)
            if size > 6 * _WORDS:
                yield Chunks(langs, parts, np.array(n, np.int64))
                langs, parts, n, size = [], [], [], 0
    if parts:
        yield Chunks(langs, parts, np.array(n, np.int64))


COUNTS = "lang STRING, phrase BINARY, n LONG, range INT, hashes BINARY, counts BINARY"
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64()), ("range", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _COUNTS], schema=_COUNTS)


def _phrases(found: Chunks, where: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows (lang, phrase, n) of the phrases that start at some places; a phrase is its words, joined by spaces."""
    columns, counts = found.sums(where, length)
    phrase = pa.array(found.words, pa.binary()).take(pa.array(columns[1]))
    if length > 1:
        flat = pa.array(found.words, pa.binary()).take(pa.array(np.stack(columns[1:], 1).ravel()))
        phrase = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * length, pa.int32()), flat), b" ")
    return _rows(lang=pa.array(found.langs, pa.string()).take(pa.array(columns[0])), phrase=phrase.cast(pa.binary()), n=pa.array(counts))


def _packed(hashes: np.ndarray, n: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Rows (range, hashes, counts): sums of counts by hash, each range of hashes as differences of 48 bits, low parts first."""
    values, inverse = np.unique(hashes, return_inverse=True)
    counts = np.zeros(len(values), np.int64)
    np.add.at(counts, inverse, n)
    which = (values >> np.uint64(_BITS - ranges.bit_length() + 1)).astype(np.int64)
    borders = [*np.flatnonzero(np.diff(which, prepend=-1)).tolist(), len(values)]
    out: list[tuple] = []
    for a, b in zip(borders, borders[1:]):
        steps = np.diff(values[a:b], prepend=np.uint64(0))
        low, high = steps.astype("<u4").tobytes(), zlib.compress((steps >> np.uint64(32)).astype("<u2").tobytes(), 1)
        out.append((int(which[a]), len(high).to_bytes(4, "little") + high + low, zlib.compress(counts[a:b].astype("<i8").tobytes(), 1)))
    columns = list(zip(*out)) or [[], [], []]
    return _rows(range=pa.array(columns[0], pa.int32()), hashes=pa.array(columns[1], pa.binary()), counts=pa.array(columns[2], pa.binary()))


def _unpacked(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(hashes[:4], "little")
    high = np.frombuffer(zlib.decompress(hashes[4 : 4 + size]), "<u2").astype(np.uint64)
    low = np.frombuffer(hashes[4 + size :], "<u4").astype(np.uint64)
    return np.cumsum(low | (high << np.uint64(32)), dtype=np.uint64), np.frombuffer(zlib.decompress(counts), "<i8")


def _count_first(ranges: int) -> Callable:
    """Counts of words by themselves, and of pairs by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _gathered(batches):
            yield _phrases(found, np.flatnonzero(found.starts), 1)
            where = found.starts & found.pairs
            yield _packed(found.hashes()[0][where], found.n[where], ranges)

    return run


def _frequent_places(found: Chunks, pair_filter: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pairs that pass start, where two such pairs follow each other, and the hashes of triples."""
    pair_hashes, triple_hashes = found.hashes()
    pairs = np.zeros(len(found.ids), bool)
    at = np.flatnonzero(found.pairs)
    pairs[at] = bloom.passes(pair_filter, mixed(pair_hashes[at]))
    return found.starts & pairs, found.starts & pairs & np.append(pairs[1:], False), triple_hashes


def _count_triples(ranges: int, pair_filter) -> Callable:
    """Counts by hash of the triples of two pairs that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _gathered(batches):
            _, triples, hashes = _frequent_places(found, pair_filter.value)
            yield _packed(hashes[triples], found.n[triples], ranges)

    return run


def _count_phrases(pair_filter, triple_filter) -> Callable:
    """Counts of the pairs, and of the triples, that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _gathered(batches):
            pairs, triples, hashes = _frequent_places(found, pair_filter.value)
            yield _phrases(found, np.flatnonzero(pairs), 2)
            at = np.flatnonzero(triples)
            yield _phrases(found, at[bloom.passes(triple_filter.value, mixed(hashes[at]))], 3)

    return run


def _frequent(packed: DataFrame, ranges: int, least: int) -> bytes:
    """The filter of the hashes that reach the least count. It has a fixed size and passes through the driver.

    A range of hashes is counted in one task; there are as many as the size of the corpus asks for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                parts = kept.setdefault(row["range"], [])
                parts.append(_unpacked(row["hashes"], row["counts"]))
                if sum(len(h) for h, _ in parts) > 4 * _RANGE:
                    kept[row["range"]] = [_added(parts)]
        for parts in kept.values():
            hashes, counts = _added(parts)
            yield pa.RecordBatch.from_arrays([pa.array(mixed(hashes[counts >= least]).view(np.int64))], ["hash"])

    dealt = packed.select("range", "hashes", "counts").repartition(ranges, "range")
    return bloom.build(dealt.mapInArrow(run, "hash LONG"))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by hash."""
    hashes, inverse = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    counts = np.zeros(len(hashes), np.int64)
    np.add.at(counts, inverse, np.concatenate([c for _, c in parts]))
    return hashes, counts


def _score(a: Column, left: Column, right: Column, scale: int) -> Column:
    """floor(scale * a * a / (left * right)), exact for counts below 10 ** 16."""
    a, left, right = (x.cast("decimal(16, 0)") for x in (a, left, right))
    top, bottom = (a * a * F.lit(scale).cast("decimal(7, 0)")).cast("decimal(38, 0)"), (left * right).cast("decimal(38, 0)")
    return F.call_function("div", top, bottom)


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    scale: int = SCALE,
    inside_percent: int = INSIDE_PERCENT,
) -> DataFrame:
    """The best phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are in lower case (A-Z only). Phrases are two or three words in a row without any of ``.,;:!?`` or
    a line break between them; words are split at spaces and tabs. ``a`` counts the phrase (at least
    ``least``), ``l`` and ``r`` its two parts at the cut that gives the lowest score, floor(scale * a * a /
    (l * r)), the first of equal ones; ``n`` counts the words of the language. Pairs that lie in a triple
    with ``inside_percent`` of their count or more are left out. The first ``top`` by score, count and
    phrase stay.

    A null language is ``und``. Null, empty and blank texts have no words. Repeated rows count as often as
    they come, ids are never looked at. An empty table gives no rows. Counts are below 10 ** 16.
    """
    texts = picked(docs, lang=lang_col, text=text_col)
    texts = texts.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))
    rows = dictionary(texts)
    size = rows.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0
    ranges = 1 << max(4, math.ceil(math.log2(size / (6 * _RANGE) + 1)))
    share = rows.sparkSession.sparkContext.broadcast
    counted = stored(rows.mapInArrow(_count_first(ranges), COUNTS), "phrase_counts")
    pairs = share(_frequent(counted.filter("range IS NOT NULL"), ranges, least))
    triples = share(_frequent(rows.mapInArrow(_count_triples(ranges, pairs), COUNTS), ranges, least))
    words = counted.filter("phrase IS NOT NULL").groupBy("lang", F.col("phrase").alias("word")).agg(F.sum("n").alias("n"))
    words = stored(words, "phrase_words")
    found = rows.mapInArrow(_count_phrases(pairs, triples), COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    found = found.filter(F.col("a") >= least).select("lang", F.split(F.col("phrase").cast("string"), " ").alias("words"), "a")
    found = stored(found, "phrase_candidates")
    discard(rows, counted)
    words = words.withColumn("word", F.col("word").cast("string"))
    return _ranked(_kept(_scored(found, words, scale), found, inside_percent), words, top)


def _scored(found: DataFrame, words: DataFrame, scale: int) -> DataFrame:
    """Candidates with the counts of their parts and the score of the lowest-scoring cut."""
    size = F.size("words")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    counts = words.select("lang", F.array("word").alias("part"), F.col("n").alias("times"))
    counts = counts.unionByName(found.filter(size == 2).select("lang", F.col("words").alias("part"), F.col("a").alias("times")))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("part").alias(part), F.col("times").alias(name)), ["lang", part])
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"), scale))
    best = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "words", "a").agg(best).select("lang", "words", "a", "cut.l", "cut.r", "cut.score")


def _kept(scored: DataFrame, found: DataFrame, inside_percent: int) -> DataFrame:
    """Without the pairs that lie in a triple that is frequent beside them."""
    triples = found.filter(F.size("words") == 3)
    inner = triples.select("lang", "a", F.explode(F.array(F.slice("words", 1, 2), F.slice("words", 2, 2))).alias("words"))
    longest = inner.groupBy("lang", "words").agg(F.max("a").alias("longer"))
    beside = 100 * F.col("longer").cast("decimal(20, 0)") >= inside_percent * F.col("a").cast("decimal(20, 0)")
    return scored.join(longest, ["lang", "words"], "left").filter(~F.coalesce(beside, F.lit(False)))


def _ranked(kept: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The first of each language. They are found in slices first, so that no task sorts all of one."""
    phrase = F.array_join("words", " ")
    named = kept.select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = named.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    for keys in (["lang", "slice"], ["lang"]):
        sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return sliced.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
