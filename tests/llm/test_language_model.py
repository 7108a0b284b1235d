"""Language-model scores against bits predicted one by one, and against counts by hand."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_rows import frame, vocabulary

from webloom.llm import catalog
from webloom.llm import context_mixing as cm


def texts():
    words = vocabulary(21, 120)
    rng = np.random.default_rng(4)
    out = [" ".join(words[int(k) % 120] for k in rng.zipf(1.6, rng.integers(3, 90))) for _ in range(90)]
    return [*out, None, "", " \t\n", "The the THE thé", "new " * 30 + "word", out[0], out[0], "x" * 9000 + " y", "\xa0 \x85 日本"]


@pytest.fixture(scope="module")
def rows():
    return [(i, text, "en", "s", 0) for i, text in enumerate(texts())]


@pytest.fixture(scope="module")
def scored(spark, rows):
    docs = frame(spark, rows)
    learn = catalog.remainder("doc_id", 7) != 2
    return {r.doc_id: r for r in cm.scores(docs, learn).collect()}


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def test_counts_and_base(rows, scored):
    learned = {i for i, r in scored.items() if r.learned}
    assert 0 < len(learned) < len(rows) == len(scored)
    counts = Counter(t for i, text, *_ in rows if i in learned for t in tokens(text))
    total = sum(counts.values())
    for i, text, *_ in rows:
        want = sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in tokens(text))
        got = scored[i]
        assert got.n_tokens == len(tokens(text)) and got.n_known == sum(counts[t] > 0 for t in tokens(text))
        assert got.train_tokens == total and got.base_score == pytest.approx(want, abs=1e-9)


def test_scores_are_probabilities(rows, scored):
    for i, text, *_ in rows:
        assert scored[i].score < 0 and scored[i].bits_per_byte > 0
    assert scored[0].score == scored[len(rows) - 4].score  # the same text
    known, random = scored[0], scored[len(rows) - 1]
    assert known.bits_per_byte < 2 < random.bits_per_byte


def small_model(words, counts, code):
    """A model whose tables are counted from some words, as the Spark job does."""
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "trained"])
    inside = _table(cm._count_inside(code)(iter([batch])), cm.INSIDE)
    rows = [b" ".join(words)] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([True] * 3)], ["text", "learn"])
    across = _table(cm._gather(code)(iter([batch])), cm.ACROSS)
    model = cm.Model(code, across, inside)
    seen, bits, weight = np.zeros(cm.GATES * cm._LEVELS), np.zeros(cm.GATES * cm._LEVELS), np.zeros(cm.GATES)
    for _ in range(3):
        model.learn(words, np.array(counts), seen, bits, weight)
    model.refined = ((bits + 1) / (seen + 2)).astype(np.float32)
    return model


def _table(batches, bits):
    table = np.zeros(int(cm._offsets(bits)[-1]), np.int8)
    for batch in batches:
        for row in batch.to_pylist():
            if row["chunk"] is not None:
                steps = cm._logits(cm._dense(row["slots"], row["counts"]))
                table[row["chunk"] * cm._CHUNK_SLOTS :][: cm._CHUNK_SLOTS] = steps
    at = cm._offsets(bits)
    return [table[a:b] for a, b in zip(at, at[1:])]


MASK = (1 << 64) - 1


def hashed(value, which):
    value = ((value ^ (value >> 31)) + which + 1) * 0xD6E8FEB86659FD93 & MASK
    return value >> 32


def word_hash(word):
    return sum((byte + 1) * pow(cm._ODD, k, 1 << 64) for k, byte in enumerate(word)) & MASK


def logit(table, context, node, bits):
    return float(table[(context ^ (node * 0x9E3779B1)) & 0xFFFFFFFF & ((1 << bits) - 1)]) / cm._SCALE


def turns(code, byte):
    return code.turns[code.at[byte] :][: code.sizes[byte]].tolist()


def sure(x, borders):
    return sum(abs(x) > b for b in borders)


def chance(x):
    return 1 / (1 + math.exp(-max(-20, min(20, x))))


def word_cost(model, word):
    """The bits after the first byte, one by one."""
    text, total = word + b" ", 0.0
    for place in range(1, len(text)):
        two = text[place - 1] | (text[place - 2] << 8 if place > 1 else 0)
        three = two | (text[place - 3] << 16 if place > 2 else 0)
        contexts = [hashed(v, k) for k, v in enumerate((two, three, word_hash(text[:place])))]
        for turn in turns(model.code, text[place]):
            x = [logit(t, c, turn >> 1, b) for t, c, b in zip(model.inside, contexts, cm.INSIDE)]
            gate = min(place, cm._PLACES - 1) * cm._SURE + sure(x[2], (0.1, 1, 2.2, 3.5)) * 4 + sure(x[1], (0.5, 1.5, 3))
            mixed = sum(model.weights[k, gate] * x[k] for k in range(3))
            half = cm._LEVELS // 2
            level = int(max(-half, min(half, np.rint(mixed * 3)))) + half
            p = (chance(mixed) + model.refined[gate * cm._LEVELS + level]) / 2
            p = min(max(p, cm.LEAST), 1 - cm.LEAST)
            total += math.log10(p if turn & 1 else 1 - p)
    return total


def first_cost(model, words, closed):
    """The bits of first bytes, one by one; weights move once per block."""
    sequence = [(word_hash(w), w[0], w[-1] | (w[-2] << 8 if len(w) > 1 else 0)) for w in words] + [(0, 10, 0)] * closed
    weights, total = np.full((4, 12), cm.START, np.float32), 0.0
    for start in range(0, len(sequence), cm._BLOCK):
        step, n = np.zeros((4, 12)), np.zeros(12)
        for at in range(start, min(start + cm._BLOCK, len(sequence))):
            one = sequence[at - 1] if at > 0 else (0, 10, 0)
            two = sequence[at - 2] if at > 1 else (0, 10, 0)
            both = (one[0] * cm._ODD + (two[0] ^ (two[0] >> 29))) & MASK
            contexts = [hashed(v, 8 + k) for k, v in enumerate((0, one[2], one[0], both))]
            for turn in turns(model.code, sequence[at][1]):
                x = [logit(t, c, turn >> 1, b) for t, c, b in zip(model.across, contexts, cm.ACROSS)]
                gate = sure(x[2], (0.1, 1, 2.2)) * 3 + sure(x[3], (0.1, 1.5))
                sign = 1 if turn & 1 else -1
                right = chance(sign * sum(weights[k, gate] * x[k] for k in range(4)))
                total += math.log10(max(right, cm.LEAST))
                n[gate] += 1
                step[:, gate] += sign * (1 - right) * np.array(x)
        weights += (cm.ONLINE_RATE * step / np.sqrt(n + 1)).astype(np.float32)
    return total


@pytest.fixture(scope="module")
def model():
    words = [w.encode() for w in vocabulary(5, 60)] + [b"the", b"of", b"a"]
    counts = [1 + (k * 7) % 23 for k in range(len(words))]
    byte_counts = [0] * 256
    for word, n in zip(words, counts):
        for byte in word + b" ":
            byte_counts[byte] += n
    return words, small_model(words, counts, cm.Code(byte_counts))


def test_word_costs_bit_by_bit(model):
    words, model = model
    asked = [*words[:20], b"unseen", "日本".encode(), b"thethe", b"q"]
    got = model.word_costs(asked)
    assert got == pytest.approx([word_cost(model, w) for w in asked], rel=2e-4, abs=1e-4)


def test_first_bytes_bit_by_bit(model, monkeypatch):
    words, model = model
    monkeypatch.setattr(cm, "_BLOCK", 7)
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, len(words), n) for n in (0, 1, 2, 40)]
    closed = [True, False, True, True]
    got = model.first_costs(parts, closed, cm.Laid(words))
    want = [first_cost(model, [words[k] for k in part], end) for part, end in zip(parts, closed)]
    assert got == pytest.approx(want, rel=2e-4, abs=1e-4)


def test_bits_of_all_bytes_sum_to_one(model):
    """The probabilities of what may follow add up: no text is dearer or cheaper than a probability."""
    _, model = model
    words = [b"ab" + bytes([byte]) for byte in range(256) if bytes([byte]).strip()]
    start = model.word_costs([b"ab"])[0]  # "b" and then the space
    stem = word_cost(model, b"ab")
    assert start == pytest.approx(stem, abs=1e-4)
    one = [10 ** (first_cost(model, [bytes([byte])], False)) for byte in range(256)]
    assert sum(one) == pytest.approx(1, abs=0.02)
    assert len(words) > 200


def test_code_is_a_prefix_code():
    code = cm.Code([k * k for k in range(256)])
    assert sum(2.0 ** -int(size) for size in code.sizes) == pytest.approx(1)
    sizes, turns_of = code.bits(np.array([7, 200, 7], np.uint8))
    assert turns_of.tolist() == [*turns(code, 7), *turns(code, 200), *turns(code, 7)] and sizes.sum() == len(turns_of)


def test_long_texts_come_in_parts(monkeypatch):
    from webloom.llm import shingles

    monkeypatch.setattr(shingles, "_CHUNK", 50)
    text = ("word " * 40 + "y" * 5000 + " end").encode()
    batch = pa.RecordBatch.from_arrays([pa.array([text], pa.binary()), pa.array([3])], ["text", "row"])
    found = [part for _, parts in cm._read(iter([batch])) for part in parts]
    assert len(found) > 3 and [last for *_, last in found] == [False] * (len(found) - 1) + [True]
    words, parts = next(cm._read(iter([batch])))
    modelled, counted = cm.Laid(words).kinds()
    assert sum(counted[part].sum() for _, part, _ in parts) == 42 and modelled.sum() == len(words) - 1


def test_empty_table_and_nothing_to_learn(spark):
    docs = frame(spark, [(1, "a b", None, None, 0), (None, None, None, None, 0)])
    assert cm.scores(docs.limit(0), F.lit(True)).collect() == []
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in cm.scores(docs, F.lit(None).cast("boolean")).collect())
    assert got == [(0, 1, 0, 0, 0.0), (1, 3, 0, 0, 0.0)]


def test_first_bytes_are_refined_by_observed_bits(model):
    """The table is counted over texts and moves each bit half way to what was observed; chances still sum to one."""
    words, model = model
    rng = np.random.default_rng(3)
    parts, laid = [rng.integers(0, len(words), 30) for _ in range(20)], cm.Laid(words)
    closed, observed = [True] * 20, np.zeros((2, 12 * cm._LEVELS))
    plain = model.first_costs(parts, closed, laid, observed)
    turns_of = [turns(model.code, b) for part in parts for b in [*(words[k][0] for k in part), 10]]
    assert observed.sum(1).tolist() == [sum(map(len, turns_of)), sum(t & 1 for path in turns_of for t in path)]
    model.refined_first = cm._refining(*observed, 12)
    try:
        assert sum(model.first_costs(parts, closed, laid)) > sum(plain)
        single = [bytes([byte]) for byte in range(256)]
        one = [10 ** model.first_costs([np.array([0])], [False], cm.Laid([word]))[0] for word in single]
        assert sum(one) == pytest.approx(1, abs=0.02)
    finally:
        model.refined_first = None


def test_corpus_learns_how_to_refine_first_bytes(spark, rows):
    docs = frame(spark, rows).select(F.col("text").cast("binary").alias("text"), (F.col("doc_id") % 7 != 2).alias("learn"))
    model = cm.Corpus(docs).model
    assert model.refined_first.shape == (12 * cm._LEVELS,)
    assert 0 < model.refined_first.min() and model.refined_first.max() < 1


def test_parts_are_laid_out_in_stretches(model, monkeypatch):
    words, model = model
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, len(words), n) for n in (0, 9, 4, 60, 1, 0, 12)]
    closed, laid = [True, False, True, True, False, True, True], cm.Laid(words)
    whole = model.first_costs(parts, closed, laid)
    monkeypatch.setattr(cm, "_STRETCH", 10)
    assert [(s.start, s.stop) for s in cm._stretches(parts)] == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
    assert model.first_costs(parts, closed, laid) == whole


def test_weights_of_short_texts_learn(model, monkeypatch):
    """Every first byte counts for the next one, in texts of a few words as well."""
    words, model = model
    rng = np.random.default_rng(5)
    parts, laid = [rng.integers(0, len(words), n) for n in (100, 9, 30)], cm.Laid(words)
    learned = model.first_costs(parts, [True] * 3, laid)
    assert learned == pytest.approx([first_cost(model, [words[k] for k in part], True) for part in parts], rel=2e-4, abs=1e-4)
    monkeypatch.setattr(cm, "_BLOCK", 1 << 20)
    fixed = model.first_costs(parts, [True] * 3, laid)
    assert all(abs(a - b) > 1e-3 for a, b in zip(learned, fixed))
