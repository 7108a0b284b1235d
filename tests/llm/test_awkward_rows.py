"""Rows loaded many times, documents without ids, long texts, rejected hosts, and models step by step."""

import math
import random
import time

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_rows import frame, vocabulary

from webloom.llm import language, mixing, near_dedup, quality, substrings


def near_pair(n):
    words = vocabulary(4, n)
    return " ".join(words), " ".join([*words[:-2], "new", "words"])


def test_two_near_documents_of_a_thousand_rows_each(spark):
    one, other = near_pair(300)
    rows = [(1, one, None, None, 0)] * 1000 + [(2, other, None, None, 0)] * 1000 + [(3, "alone here and now", None, None, 0)]
    begin = time.time()
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.classes_of(frame(spark, rows)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True)} and time.time() - begin < 120


def test_one_id_with_two_texts(spark):
    one, other = near_pair(300)
    far = " ".join(vocabulary(77, 100))
    rows = [(1, one, None, None, 0), (5, other, None, None, 0), (5, far, None, None, 0), (9, far + " x", None, None, 0)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.classes_of(frame(spark, rows)).collect())
    assert got == [(1, 296, 1), (5, 96, 5), (5, 296, 1), (9, 97, 5)]


def test_links_below_what_the_bands_find_are_refused(spark):
    with pytest.raises(ValueError):
        near_dedup.classes_of(frame(spark, []), percent=79)


def test_stars_that_miss_links_in_blocks_of_few_rows(spark, monkeypatch):
    """Members of one large bucket meet two blocks at a time."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    draw, words = random.Random(8), vocabulary(9, 300)
    base, rows = draw.choices(words, k=130), []
    for group in range(8):
        own = list(base)
        for _ in range(16):
            own[draw.randrange(130)] = f"g{group}x{draw.random()}"
        for copy in range(4):
            text = list(own)
            text[draw.randrange(130)] = f"c{copy}{draw.random()}"
            rows.append((len(rows), " ".join(text), None, None, 0))
    got = {r.doc_id: r.component_id for r in near_dedup.classes_of(frame(spark, rows), n=1).collect()}
    assert got == {d: c for d, (_, c) in brute.near([r[:2] for r in rows], 1).items()}


def test_repeats_of_an_id_cost_a_row_each(spark):
    """A text under one id, and many rows that repeat it under another."""
    words = vocabulary(5, 400)
    text = " ".join(words)
    rows = [(1, text, None, None, 0)] + [(2, "own start " + text, None, None, 0)] * 300
    got = {tuple(r)[:3] for r in substrings.repeated_removed(frame(spark, rows)).collect()}
    assert got == {(1, 400, 0), (2, 402, 400)}


def test_windows_have_two_hashes():
    words = np.arange(1, 200, dtype=np.uint64)
    edges, checks = substrings.edge_hashes(words)
    assert len(edges) == len(checks) == 180 and not set(edges.tolist()) & set(checks.tolist())
    again, _ = substrings.edge_hashes(words[50:90])
    assert again.tolist() == edges[50:71].tolist()


def test_documents_without_ids_are_mixed_one_by_one(spark):
    rows = [(None, f"{i} " + "w " * (i % 40), None, "a", 0) for i in range(400)] + [(i, "w " * 30, None, "b", 0) for i in range(200)]
    for source in ("a", "b"):
        mine = [r for r in mixing.mix(frame(spark, rows)).collect() if (r.doc_id is None) == (source == "a")]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 40
        assert all(0 <= r.taken <= 2 * r["size"] for r in mine)


def test_measures_of_long_texts(monkeypatch):
    draw, words = random.Random(1), ["a", "b", "c", "dé", "e"]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(200)] + ["a b\nc a b c\n\na", "x", " ", "a a a", "a b c a b"]
    want = [brute.measures(t) for t in texts]
    monkeypatch.setattr(quality, "_LONG", -1)
    assert [quality.base_measures(t) if t else (0,) * 5 for t in texts] == [w if t else (0,) * 5 for t, w in zip(texts, want)]


def test_a_text_of_many_megabytes():
    words = vocabulary(2, 5000)
    text = " ".join(words * 400)  # 2,000,000 words
    n_words, chars, _, _, again = quality.base_measures(text)
    assert n_words == 2_000_000 and again == n_words and chars == len(text) - n_words + 1


def test_the_pipeline_rejects_a_host(spark, tmp_path):
    """Of a host that fails nearly always the documents that pass by themselves go as well."""
    draw, words = random.Random(3), vocabulary(7, 400)
    good = lambda: " ".join(draw.choices(words, k=80))
    rows = [(i, good(), "en", f"s{i % 6}", 0) for i in range(60)]
    rows += [(100 + i, "too short", "en", "foul", 0) for i in range(120)] + [(300, good(), "en", "foul", 0), (301, good(), "en", None, 0)]
    frame(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()}
    assert kept == {*range(60), 301}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= kept


def buckets_of(text, n=language.BUCKETS):
    """Bucket of every run of two to four bytes, one by one."""
    data = (" " + text.lower() + " ").encode()
    kept = [b if b >= 128 or chr(b).isalpha() else 32 for b in data]
    out = []
    for size in (2, 3, 4):
        for at in range(len(kept) - size + 1):
            mixed = 0
            for k in range(size):
                mixed = (mixed + kept[at + k] * int(language._MULTIPLIERS[k])) & 0xFFFFFFFF
            out.append((((mixed ^ (mixed >> 15)) * int(language._MULTIPLIERS[0]) & 0xFFFFFFFF) >> 8) % n)
    return out


def test_predictions_by_hand():
    rng = np.random.default_rng(3)
    model = language.Model(["a", "b", "c"], rng.normal(size=(language.BUCKETS, 3)), rng.normal(size=3), 1.7, 0.5)
    for text in ("Ein kurzer Text", "ab", "x 12 é!", "The quick brown fox. " * 30):
        buckets = buckets_of(text)
        logits = [sum(model.weights[b][k] for b in buckets) / len(buckets) + model.bias[k] for k in range(3)]
        e = [math.exp(1.7 * x) for x in logits]
        best = max(range(3), key=lambda k: e[k])
        name, score, rejected = model.guess(text)
        assert name == model.languages[best] and score == pytest.approx(e[best] / sum(e)) and rejected == (score < 0.5)


def test_a_step_of_training_by_hand(monkeypatch):
    monkeypatch.setattr(language, "WIDTH", 2)
    monkeypatch.setattr(language, "BATCH", 3)
    monkeypatch.setattr(language, "STEPS", 1)
    x = [(np.array([k, (k + 1) % 6]), np.array([0.25, 0.75], np.float32)) for k in range(6)]
    y = np.array([0, 1, 0, 1, 0, 1])
    model = language.train(x, y, ["a", "b"], seed=5)
    rng = np.random.default_rng(5)
    order = rng.permutation(6)
    used = order[np.arange(6) % 5 != 0]
    e = rng.normal(0, 0.1, (language.BUCKETS, 2)).astype(np.float32).astype(float).tolist()
    rows = rng.permutation(used)[:3].tolist()
    grad = [[0.0, 0.0] for _ in range(2)]
    bias = [0.0, 0.0]
    for i in rows:
        hidden = [sum(v * e[b][w] for b, v in zip(*(a.tolist() for a in x[i]))) for w in range(2)]
        wrong = [(0.5 - (y[i] == k)) / 3 for k in range(2)]  # the layer starts at zero: both languages are even
        for k in range(2):
            bias[k] -= language.RATE * wrong[k]
            for w in range(2):
                grad[w][k] -= 10 * language.RATE * hidden[w] * wrong[k]
    want = [[sum(e[b][w] * grad[w][k] for w in range(2)) for k in range(2)] for b in range(6)]
    assert np.allclose(model.weights[:6], want, atol=1e-5) and np.allclose(model.bias, bias, atol=1e-6)


def test_all_labels_are_learned(spark, monkeypatch):
    draw = random.Random(1)
    letters = [chr(0x4E00 + 40 * k) for k in range(70)]
    rows = [(i, " ".join(letters[i % 70] * draw.randint(1, 5) for _ in range(12)), f"l{i % 70:02}", None, 0) for i in range(700)]
    docs = frame(spark, rows)
    model = language.fit(docs, F.lit(True))
    assert model.languages == [f"l{k:02}" for k in range(70)]
    monkeypatch.setattr(language, "MAX_LANGUAGES", 69)
    with pytest.raises(ValueError):
        language.fit(docs, F.lit(True))
