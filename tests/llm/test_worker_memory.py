"""Python workers outlive their stage: what they keep between tasks is bounded, whatever they have read."""

import tracemalloc

import numpy as np

from webloom.llm import pieces, shingles
from webloom.llm.catalog import MODEL


def _kept(work) -> float:
    """MB that are still held after some work."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[0] / 1e6
    finally:
        tracemalloc.stop()


def test_words_kept(monkeypatch):
    monkeypatch.setattr(shingles, "_WORDS", shingles._Words())
    texts = [" ".join(f"word{k}" for k in range(at, at + 10_000)).encode() for at in range(0, 240_000, 10_000)]
    assert _kept(lambda: [shingles.word_hashes(text) for text in texts]) < 12
    again = shingles.word_hashes(texts[0])
    assert np.array_equal(again, np.array([shingles.xxhash.xxh64_intdigest(w) for w in texts[0].split()], np.uint64))


def test_cuts_kept():
    with open(MODEL, "rb") as file:
        model = pieces.Pieces(file.read())
    for at in range(0, 240_000, 20_000):
        text = " ".join(f"w{k:x}" for k in range(at, at + 20_000))
        [ids] = model.encode([text], 0.1, [at])
        assert model.decode(ids) == text
    assert len(model.unit_of) < 160_000
