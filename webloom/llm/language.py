"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are runs of two to four bytes of the lower-cased text, hashed to buckets. A text is the mean
of its buckets' embeddings; a linear layer with a softmax gives the languages. Both are trained by
stochastic gradient descent on a bounded sample of labelled documents. Scores are calibrated on
sampled documents that training did not see, and so is the score under which a guess is rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import column, picked

BUCKETS, WIDTH = 1 << 14, 16
#: Bounds of the sample: documents of a language, and documents in all. Every label is learned; a table with more than
#: ``MAX_LANGUAGES`` of them is refused, for its labels are no languages.
PER_LANGUAGE, SAMPLE, MAX_LANGUAGES = 800, 4000, 1000
STEPS, BATCH, RATE = 700, 32, 0.5
#: Share of right guesses among the accepted ones that the rejection threshold aims at.
PRECISION = 0.99
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 18
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
# All bytes that are no ASCII letter and no part of a longer character count as a space.
_KEPT = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def subwords(text: str, buckets: int = BUCKETS):
    """Bucket numbers of all subwords of a text, in arrays of bounded length."""
    data = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)
    for at in range(0, len(data), _CHUNK):
        part = _KEPT[data[at : at + _CHUNK + 3]]
        mixed = np.uint32(0)
        for n in range(4):
            mixed = (mixed[: len(part) - n] if n else mixed) + part[n:] * _MULTIPLIERS[n]
            if n and len(mixed):
                yield ((mixed[:_CHUNK] ^ (mixed[:_CHUNK] >> np.uint32(15))) * _MULTIPLIERS[0] >> np.uint32(8)) % np.uint32(buckets)


def shares(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Share of each bucket among the subwords of a text."""
    counts = np.zeros(buckets)
    for part in subwords(text, buckets):
        counts += np.bincount(part, minlength=buckets)
    return (counts / max(counts.sum(), 1)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages: embeddings times the linear layer
    bias: np.ndarray
    sharpness: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for part in subwords(text, len(self.weights)):
            total += np.bincount(part, minlength=len(self.weights)) @ self.weights
            n += len(part)
        return total / max(n, 1) + self.bias

    def guess(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); without text, letters or languages ("und", 0, True)."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        chances = softmax(self.logits(text) * self.sharpness)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best]), bool(chances[best] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def dense(rows: list[tuple[np.ndarray, np.ndarray]], buckets: int = BUCKETS) -> np.ndarray:
    out = np.zeros((len(rows), buckets), np.float32)
    for i, (at, values) in enumerate(rows):
        out[i, at] = values
    return out


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], seed: int = 0) -> Model:
    """Fit on bucket shares, given as (buckets, shares) of each row; every fifth row is kept for calibration."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[::5], order[np.arange(len(x)) % 5 != 0]
    if not len(used):
        used = order
    embeddings = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    linear, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    waiting = np.zeros(0, np.int64)
    for step in range(STEPS):
        if len(waiting) < BATCH:
            waiting = np.concatenate([waiting, rng.permutation(used)])
        rows, waiting = waiting[:BATCH], waiting[BATCH:]
        rate = RATE * (1 - step / STEPS)
        batch = dense([x[i] for i in rows])
        hidden = batch @ embeddings
        wrong = softmax(hidden @ linear + bias)
        wrong[np.arange(len(rows)), y[rows]] -= 1
        wrong /= len(rows)
        back = wrong @ linear.T
        linear -= 10 * rate * hidden.T @ wrong
        bias -= rate * wrong.sum(0)
        embeddings -= 100 * rate * batch.T @ back
    model = Model(languages, (embeddings @ linear).astype(np.float64), bias.astype(np.float64))
    logits = [values @ model.weights[at] + model.bias for at, values in (x[i] for i in held)]
    calibrate(model, np.array(logits).reshape(len(held), len(languages)), y[held])
    return model


def calibrate(model: Model, logits: np.ndarray, truth: np.ndarray) -> None:
    """Sharpness with the least log loss, and the lowest threshold with enough right guesses above it."""
    if not len(truth):
        return
    tried = 2.0 ** np.arange(-4, 8.25, 0.25)
    losses = [-np.log(softmax(logits * s)[np.arange(len(truth)), truth] + 1e-12).mean() for s in tried]
    model.sharpness = float(tried[int(np.argmin(losses))])
    chances = softmax(logits * model.sharpness)
    right, score = chances.argmax(1) == truth, chances.max(1)
    order = np.argsort(-score)
    last_of_ties = np.append(np.diff(score[order]) != 0, True)
    precise = last_of_ties & (np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
    model.threshold = float(score[order][precise][-1]) if precise.any() else 1.0


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` documents of each language (label, text, hash), chosen by a hash of the row."""
    counts = labelled.groupBy("label").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    if not counts:
        return labelled.withColumn("hash", F.lit(0).cast("long")).limit(0)
    per_language = min(per_language, max(1, SAMPLE // len(counts)))
    share = F.create_map(*[F.lit(v) for label, n in counts for v in (label, min(1.0, per_language / n))])
    hashed = labelled.withColumn("hash", F.xxhash64("doc_id", "text"))
    chosen = F.pmod("hash", F.lit(1 << 30)) < F.coalesce(F.try_element_at(share, F.col("label")), F.lit(0.0)) * (1 << 30)
    return hashed.filter(chosen).limit(2 * per_language * len(counts))


@F.arrow_udf(T.StructType([T.StructField("buckets", T.BinaryType()), T.StructField("shares", T.BinaryType())]))
def _features(texts: pa.Array) -> pa.Array:
    """Buckets and shares of each text, as bytes of 32-bit numbers."""
    buckets, values = [], []
    for text in texts:
        all_shares = shares(text.as_py() or "")
        at = np.flatnonzero(all_shares)
        buckets.append(at.astype("<i4").tobytes())
        values.append(all_shares[at].astype("<f4").tobytes())
    return pa.StructArray.from_arrays([pa.array(buckets, pa.binary()), pa.array(values, pa.binary())], ["buckets", "shares"])


def fit(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Train on documents that have text, a language and a true ``use``.

    The driver gets bucket shares, no texts: at most ``BUCKETS`` numbers of each of about ``SAMPLE``
    documents, never more than twice as many. Without any the model knows no language.
    """
    labelled = docs.filter(use & column(lang_col).isNotNull() & column(text_col).isNotNull())
    labelled = picked(labelled, doc_id=id_col, text=text_col, label=lang_col)
    rows = _sample(labelled, per_language).select("label", "hash", _features("text").alias("f")).collect()
    rows.sort(key=lambda r: (r["label"], r["hash"], len(r["f"]["buckets"])))
    languages = sorted({r["label"] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    x = [(np.frombuffer(r["f"]["buckets"], "<i4"), np.frombuffer(r["f"]["shares"], "<f4")) for r in rows]
    return train(x, np.array([languages.index(r["label"]) for r in rows]), languages)


GUESS = [("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]


def predict(text: Column, model: Model) -> Column:
    """Struct (lang_pred, score, rejected) of each text; looks at nothing but the text."""

    @F.arrow_udf("lang_pred STRING, score DOUBLE, rejected BOOLEAN")
    def guess(texts: pa.Array) -> pa.Array:
        rows = [model.guess(value.as_py()) for value in texts]
        values = zip(*rows) if rows else [[]] * len(GUESS)
        return pa.StructArray.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(values, GUESS)], [n for n, _ in GUESS])

    return guess(text)


def identify(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: (doc_id, lang_pred, score, rejected), learned from the documents with ``use``.

    A text that is null or has no letter is "und" with score 0, and so is every text if nothing could
    be learned. All labels are learned; with more than ``MAX_LANGUAGES`` the call fails. Otherwise ``lang_pred`` is the best learned language, and ``rejected`` says that its
    score is below the calibrated threshold. Equal texts get equal guesses; rows that repeat and null
    ids each get a row. An empty table gives no rows.
    """
    model = fit(docs, use, id_col, text_col, lang_col, per_language)
    rows = picked(docs, doc_id=id_col, text=text_col).select("doc_id", predict(F.col("text"), model).alias("g"))
    return rows.select("doc_id", "g.*")
