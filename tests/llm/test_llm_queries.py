"""Registered queries: SQL where there is one, held-out accuracy, the pipeline against brute force."""

import hashlib
import pathlib
import random

import brute
import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from test_llm_rows import DDL, frame, vocabulary

import __spark_entry__ as registered
from webloom.llm import catalog, language

DATA = pathlib.Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def hashed(rows):
    return sorted(repr(tuple(row)) for row in rows)


def compare(spark, folder, name):
    query, sql = catalog.QUERIES[name]
    got = query(spark, str(folder))
    db = duckdb.connect()
    files = folder / "documents.parquet"
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}{'/*.parquet' if files.is_dir() else ''}'")
    want = db.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert hashed(got.select(*columns).collect()) == hashed(want.fetchall())


@needs_data
@pytest.mark.parametrize("name", [n for n, (_, sql) in catalog.QUERIES.items() if sql])
def test_sql(spark, name):
    compare(spark, DATA, name)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with copies, near copies, junk and a null source, as a folder of tables."""
    draw, words = random.Random(12), vocabulary(13, 500)
    texts = [draw.choices(words, k=draw.randint(55, 120)) for _ in range(60)]
    texts += [t + ["end"] for t in texts[:12]] + [["again"] * 80, draw.choices(words, k=20)]
    joined = [" ".join(t) for t in texts]
    joined += [t.replace(" ", "\n", 3) for t in joined[20:30]] + joined[5:8] + ["", None]
    rows = [(5 + 3 * i, t, "en", None if i % 9 == 0 else f"s{i % 5}", len(t or "")) for i, t in enumerate(joined)]
    folder = tmp_path_factory.mktemp("tables")
    frame(spark, rows, extra=False).write.parquet(str(folder / "documents.parquet"))
    return folder, rows


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalog.QUERIES.items() if sql])
def test_sql_on_awkward_rows(spark, small, name):
    compare(spark, small[0], name)


def test_pipeline_against_brute_force(spark, small):
    folder, rows = small
    left = [(d, t, s) for d, t, _, s, _ in rows]
    rates = {}
    for _, t, s in left:
        n, *_, again = brute.measures(t)
        rates.setdefault(s, []).append(n < 50 or 100 * again > 50 * n)
    assert all(sum(r) < 0.5 * len(r) for r in rates.values())  # so no host can be rejected
    left = [(d, t, s) for d, t, s in left if (m := brute.measures(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    stays = {d for d, v in brute.exact([x[:2] for x in left]).items() if v[2]}
    left = [x for x in left if x[0] in stays]
    stays = {d for d, (_, c) in brute.near([x[:2] for x in left], 5).items() if c == d}
    assert len(stays) < len(left)
    left = [x for x in left if x[0] in stays]
    mixed = brute.mix(left)
    want = sorted((d, s) for d, t, s in left for _ in range(mixed[d][3] // mixed[d][0]) if s) + sorted(d for d, t, s in left for _ in range(mixed[d][3] // mixed[d][0]) if not s)
    got = corpus_pipeline.run(spark, str(folder)).collect()
    assert sorted((r.doc_id, r.source) for r in got if r.source) + sorted(r.doc_id for r in got if not r.source) == want
    library = SentencePieceProcessor(model_file=catalog.MODEL)
    texts = {d: t for d, t, _ in left}
    assert all(library.decode(r.piece_ids) == texts[r.doc_id] and r.n_pieces == len(r.piece_ids) for r in got)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(str(small[0] / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(small[0])).schema.names == docs.schema.names


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DDL)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []


@needs_data
def test_registered():
    assert set(catalog.QUERIES) | {"pipeline"} <= set(registered.queries())


@needs_data
def test_language_accuracy(spark):
    rows = catalog.languages(spark, str(DATA)).join(catalog.documents(spark, str(DATA)).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.95


@needs_data
def test_language_uses_the_text_alone(spark):
    docs = catalog.documents(spark, str(DATA))
    model = language.fit(docs, ~catalog.held_out())
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "the of and that with"), (5, "THE OF AND THAT WITH"), (6, "z")]
    out = spark.createDataFrame(rows, "i INT, text STRING").select("i", language.predict(F.col("text"), model).alias("g")).collect()
    guesses = {r.i: r.g for r in out}
    assert [tuple(guesses[i]) for i in (1, 2, 3)] == [("und", 0.0, True)] * 3
    assert guesses[4].lang_pred == guesses[5].lang_pred == "en" and guesses[4].score == guesses[5].score
    assert guesses[6].lang_pred in model.languages


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None, None, 0), (None, None, "en", None, 0)], DDL)
    assert [r.lang_pred for r in language.identify(docs, F.lit(True)).collect()] == ["und", "und"]
    assert language.identify(docs.limit(0), F.lit(True)).collect() == []


def test_calibration():
    model = language.Model(["a", "b"], np.zeros((4, 2)), np.zeros(2))
    logits = np.array([[2.0, 0], [1.5, 0], [0.2, 0], [0.1, 0]] * 50)
    truth = np.array([0, 0, 0, 1] * 50)
    language.calibrate(model, logits, truth)
    scores = language.softmax(logits * model.sharpness).max(1)
    accepted = scores >= model.threshold
    assert accepted.any() and not accepted.all() and (truth[accepted] == 0).mean() >= language.PRECISION


def test_subwords_in_parts_are_all_subwords(monkeypatch):
    text = "Einige Wörter, deren Teile gezählt werden. " * 40
    whole = language.shares(text)
    monkeypatch.setattr(language, "_CHUNK", 64)
    assert np.allclose(language.shares(text), whole)


def test_digest_of_ids(spark, small):
    docs = spark.read.parquet(str(small[0] / "documents.parquet"))
    from webloom.llm import pieces

    ids = {r.doc_id: r.piece_ids for r in pieces.encoded(docs, catalog.MODEL).collect()}
    for row in catalog.merge_dropout(spark, str(small[0])).collect():
        numbers = np.array(ids[row.doc_id] or [], "<i4")
        assert row.n_pieces == len(numbers) and row.ids_sha256 == hashlib.sha256(numbers.tobytes()).hexdigest()
