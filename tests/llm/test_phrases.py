"""Collocations against phrases counted one by one."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_rows import frame, vocabulary

from webloom.llm import phrases
from webloom.plans import bloom


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", piece) for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low)]


def counted(texts):
    """Phrases of one to three words."""
    out = Counter()
    for text in texts:
        for words in pieces(text):
            for n in (1, 2, 3):
                out.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return out


def brute(rows, least, top):
    by_lang = {}
    for lang, text in rows:
        by_lang.setdefault(lang or "und", []).append(text)
    out = []
    for lang, texts in by_lang.items():
        f = counted(texts)
        n = sum(c for p, c in f.items() if len(p) == 1)
        kept = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            if len(phrase) == 2 and any(len(p) == 3 and b >= least and phrase in (p[:2], p[1:]) and 100 * b >= 50 * a for p, b in f.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def documents(seed, n=120):
    draw, words = random.Random(seed), vocabulary(seed, 25)
    texts = [" ".join(draw.choices(words, weights=range(25, 0, -1), k=draw.randint(0, 60))) for _ in range(n)]
    texts = [re.sub(r"(\w) (\w)", lambda m: m[1] + draw.choice([" ", "  ", "\t", ". ", ",", "\n"] if draw.random() < 0.2 else " ") + m[2], t) for t in texts]
    passage = " ".join(draw.choices(words, k=40))
    texts += [passage, passage.upper(), "x " + passage + " y"] * 6
    texts += ["", None, " \t", "...", "a,b;c:d!e?f", "Ünï cöde \x00 z \x1c q", "again " * 500, "one\r\ntwo\x0bthree\x0cfour"]
    return texts


def test_collocations(spark):
    texts = documents(3)
    rows = [(None if i % 17 == 0 else i, t, (None, "en", "en", "de")[i % 4], "s", 0) for i, t in enumerate(texts)]
    for least, top in ((10, 2000), (3, 15)):
        got = phrases.collocations(frame(spark, rows), least=least, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = brute([(r[2], r[1]) for r in rows], least, top)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 20


@pytest.mark.parametrize("every, longest, part", [(64, 4096, 1 << 20), (2, 4096, 40), (1, 3, 10), (10**9, 5, 1 << 20), (3, 4, 7)])
def test_phrases_are_counted_once_whatever_the_chunks(monkeypatch, every, longest, part):
    monkeypatch.setattr(phrases, "_LONGEST", longest)
    monkeypatch.setattr(phrases, "_PART", part)
    texts = documents(9, 30)
    found = Counter(c for t in texts for c in phrases.chunks((t or "").encode(), every))
    if every == 1 or every > 10**6:
        assert all(c.count(b" ") <= 2 * longest + 2 for c in found)
    laid = phrases.Chunks(["en"] * len(found), list(found), np.array(list(found.values()), np.int64))
    where = [laid.starts, laid.starts & laid.pairs, laid.starts & laid.pairs & np.append(laid.pairs[1:], False)]
    got = Counter()
    for n, places in enumerate(where, 1):
        columns, counts = laid.sums(np.flatnonzero(places), n)
        for *ids, count in zip(*[c.tolist() for c in columns[1:]], counts.tolist()):
            got[tuple(laid.words[i].decode() for i in ids)] += count
    assert got == counted(texts)


def test_repeated_passages_are_one_row(spark):
    text = " ".join(vocabulary(1, 400))
    rows = spark.createDataFrame([("en", bytearray((f"start{i} " + text).encode())) for i in range(50)], "lang STRING, text BINARY")
    found = phrases.dictionary(rows, every=16)
    n_chunks = len(list(phrases.chunks(text.encode(), 16)))
    assert n_chunks > 3
    assert found.filter("n = 50").count() >= n_chunks - 2 > 0 and found.count() <= n_chunks + 60


def test_phrases_that_pass_by_mistake_change_nothing(spark, monkeypatch):
    """With filters that let everything pass the result is the same."""
    rows = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(documents(5, 40))])
    want = sorted(map(tuple, phrases.collocations(rows, least=4).collect()))
    monkeypatch.setattr(phrases, "_frequent", lambda *_: b"\xff" * (1 << (bloom.BITS - 3)))
    assert sorted(map(tuple, phrases.collocations(rows, least=4).collect())) == want and want


def test_packed_hashes():
    draw = random.Random(2)
    hashes = np.array([draw.getrandbits(48) for _ in range(3000)] + [0, 0, 1, (1 << 48) - 1, 1 << 33], np.uint64)
    n = np.arange(1, len(hashes) + 1)
    for ranges in (1, 16, 1024):
        got = {}
        for row in phrases._packed(hashes, n, ranges).to_pylist():
            values, counts = phrases._unpacked(row["hashes"], row["counts"])
            assert all(int(v) * ranges >> 48 == row["range"] for v in values)
            got.update(zip(values.tolist(), counts.tolist()))
        want = Counter()
        for h, c in zip(hashes.tolist(), n.tolist()):
            want[h] += c
        assert got == want
    assert phrases._packed(hashes[:0], n[:0], 16).num_rows == 0


def test_scores_beyond_64_bits(spark):
    a = 3_000_000_000_000_000
    row = spark.createDataFrame([(a, a + 1, a + 7)], "a LONG, l LONG, r LONG")
    got = row.select(phrases._score(F.col("a"), F.col("l"), F.col("r"), 1_000_000).alias("s")).first().s
    assert got == 1_000_000 * a * a // ((a + 1) * (a + 7))


def test_empty_table(spark):
    docs = frame(spark, [(1, None, None, None, 0)])
    assert phrases.collocations(docs).collect() == [] and phrases.collocations(docs.limit(0)).collect() == []
