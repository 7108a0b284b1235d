"""The inner bytes of a word are costed once per distinct word, not where it is met."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_rows import frame
from webloom.llm import context_mixing as cm
from webloom.llm import shingles


def test_scoring_costs_no_word(monkeypatch):
    class Shared:
        def __init__(self, value):
            self.value = value

    model = cm.Model(cm.Code([1] * 256), *([np.zeros(1 << b, np.int8) for b in bits] for bits in (cm.ACROSS, cm.INSIDE)))
    monkeypatch.setattr(cm, "_built", lambda packed: packed)
    monkeypatch.setattr(cm.Model, "word_costs", lambda *_: pytest.fail("a word was costed again"))
    texts = pa.array([b"a B\tb", None, b" "], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([5, 6, None]), texts, pa.array([True, False, True])], ["row", "doc_id", "text", "learn"])
    common = {b"a": 0, cm.END: 1}, np.array([3, 2]), np.array([-1.0, 0.0])
    rows = [row for out in cm._score(Shared(model), Shared(common), 100.0)(iter([batch])) for row in out.to_pylist()]
    assert [(r["n_tokens"], r["n_known"], r["words"], r["times"]) for r in rows] == [(4, 2, [b"b"], [2]), (1, 1, [], []), (1, 1, [], [])]
    assert rows[0]["base"] == pytest.approx(np.log10(4 / 100) + np.log10(3 / 100))


def test_rows_read_together_and_apart(monkeypatch):
    """Long words and long texts come by themselves; the words of all rows are those of Python's split."""
    monkeypatch.setattr(shingles, "_CHUNK", 6000)
    monkeypatch.setattr(cm, "_TOGETHER", 9000)
    texts = [b" A b\xc3\x89 \x0bb\x85c\xa0", None, b"", b"\n\r", b"q " * 1200, b"z" * 5000 + b" z", b"w v " * 4000, b"end\x0c", b"\xff B b"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(range(len(texts)))], ["text", "row"])
    got, ends = {}, {}
    for words, parts in cm._read(iter([batch.slice(0, 4), batch.slice(4)])):
        for row, part, last in parts:
            got.setdefault(row["row"], []).extend(words[k] for k in part)
            ends[row["row"]] = ends.get(row["row"], 0) + last
    assert ends == dict.fromkeys(range(len(texts)), 1)
    assert got == {row: [key for word in (text or b"").lower().split() for key in cm._keys(word)] for row, text in enumerate(texts)}


def test_scores_do_not_depend_on_what_is_common(spark, monkeypatch):
    rows = [(k, f"aa bb cc{k % 3} " + "y" * (5000 if k == 4 else 9) + " aa", None, "s", 0) for k in range(12)] + [(None, None, None, None, 0)]

    def scored(common):
        monkeypatch.setattr(cm, "COMMON", common)
        found = cm.scores(frame(spark, rows), F.coalesce(F.col("doc_id") % 4 != 1, F.lit(False))).collect()
        return {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, pytest.approx(r.base_score), pytest.approx(r.score)) for r in found}

    few, many = scored(0), scored(1 << 16)
    assert few.keys() == many.keys() and all(few[k][:3] == many[k][:3] and few[k][3].expected == many[k][3] and few[k][4].expected == many[k][4] for k in few)
