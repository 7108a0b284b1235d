import json
import pathlib

import golden
import pytest
from pyspark.sql import functions as F

from webloom.operators import index as ix
from webloom.operators import pages as pg
from webloom.operators import rank as rk
from webloom.operators import search as se
from webloom.streaming import jobs

RAW = "page_id BIGINT, url STRING, html STRING, indexation BOOLEAN"
PARSED = "page_id BIGINT, url STRING, title STRING, text STRING"


def add_file(spark, path, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)


def forget_last_batch(checkpoint):
    """As after a crash between the write of a batch and its commit."""
    commits = sorted((p for p in pathlib.Path(checkpoint, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)


def test_stream_parse_equals_batch(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    first = [(1, "a", "<title>A</title>", True), (2, "b", "<title>B</title>", True), (3, "c", "", False)]
    second = [(4, "a", "<title>A again</title>", True), (5, "d", "<title>D</title>", True), (6, "d", "", True)]
    for rows in (first, second):
        add_file(spark, source, rows, RAW)
        stream = jobs.read_stream(spark, source, RAW)
        jobs.stream_parse(stream, out, checkpoint).awaitTermination()
    want = sorted(map(tuple, pg.parse_pages(spark.createDataFrame(first + second, RAW)).collect()))
    assert sorted(map(tuple, jobs.read_batches(spark, out, jobs.PARSED).collect())) == want


def test_stream_index_equals_batch_and_survives_a_retry(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = [(i, url, title, title) for i, url, title in golden.PAGES]

    def run():
        stream = jobs.read_stream(spark, source, PARSED)
        jobs.stream_index(stream, out, checkpoint).awaitTermination()

    for part in (rows[:2], rows[2:]):
        add_file(spark, source, part, PARSED)
        run()
    forget_last_batch(checkpoint)
    run()
    want = ix.build_postings(spark.createDataFrame(rows, PARSED), F.col("text"))
    got = jobs.read_batches(spark, f"{out}/postings", jobs.POSTINGS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    counted = jobs.indexed_term_documents(spark, out)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, ix.term_documents(want).collect()))


def test_scores_are_renewed_every_few_pages(spark, tmp_path, monkeypatch):
    few_sweeps = lambda pages, links, n_docs: rk.pagerank(pages, links, n_docs, iterations=5)
    monkeypatch.setattr(jobs, "pagerank", few_sweeps)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = [(i, url, title, title) for i, url, title in golden.PAGES]
    links = lambda session: session.createDataFrame(golden.LINKS, "source_url STRING, target_url STRING")
    refreshed = []
    for part in (rows[:1], rows[1:2], rows[2:3], rows[3:]):
        add_file(spark, source, part, PARSED)
        stream = jobs.read_stream(spark, source, PARSED)
        jobs.stream_index(stream, out, checkpoint, refresh_every=2, links=links).awaitTermination()
        refreshed.append([r[0] for r in jobs.read_batches(spark, f"{out}/refreshes", jobs.REFRESHES).orderBy("n_pages").collect()])
    assert refreshed == [[], [2], [2], [2, 4]]
    scored = spark.read.parquet(f"{out}/scored/batch_id=3").collect()
    assert {(r["page_id"], r["word"]): r["tf_idf"] for r in scored} == {
        key: pytest.approx(value[1], abs=1e-6) for key, value in golden.POSTINGS.items()
    }
    ranks = spark.read.parquet(f"{out}/ranks/batch_id=3").collect()
    assert {r["url"]: r["page_rank"] for r in ranks} == {u: pytest.approx(v, abs=1e-6) for u, v in golden.RANKS_AFTER_5.items()}


def test_stream_frontier_keeps_urls_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for rows in ([("u", "d"), ("u", "d"), ("v", "d")], [("u", "d"), ("w", "e")]):
        add_file(spark, source, rows, "url STRING, domain STRING")
        stream = jobs.read_stream(spark, source, "url STRING, domain STRING")
        jobs.stream_frontier(stream, out, checkpoint).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == ["u", "v", "w"]


def test_the_published_version_can_be_searched(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "pagerank", lambda pages, links, n_docs: rk.pagerank(pages, links, n_docs, iterations=5))
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = [(i, url, title, title) for i, url, title in golden.PAGES]
    links = lambda session: session.createDataFrame(golden.LINKS, "source_url STRING, target_url STRING")
    assert jobs.current_index(spark, out).count() == 0
    for part in (rows[:1], rows[1:2], rows[2:3], rows[3:]):
        add_file(spark, source, part, PARSED)
        jobs.stream_index(jobs.read_stream(spark, source, PARSED), out, checkpoint, refresh_every=1, links=links).awaitTermination()
    kept = sorted(p.name for p in pathlib.Path(out, "scored").iterdir() if p.is_dir())
    assert kept == ["batch_id=2", "batch_id=3"]
    index = jobs.current_index(spark, out)
    assert index.count() == len(golden.POSTINGS)
    assert [r["page_id"] for r in se.search_pages(index, None, "chat").collect()]


def test_a_batch_reads_only_its_buckets(spark, tmp_path, capsys):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for rows in ([(f"u{i}", "d") for i in range(300)], [("u7", "d"), ("new", "d")]):
        add_file(spark, source, rows, "url STRING, domain STRING")
        jobs.stream_frontier(jobs.read_stream(spark, source, "url STRING, domain STRING"), out, checkpoint).awaitTermination()
    asked = spark.createDataFrame([("u7",), ("new",)], "url STRING")
    buckets = [r[0] for r in asked.select(jobs._bucket()).collect()]
    known = jobs.known_urls(spark, f"{out}_urls", 2, buckets)
    known.explain("formatted")
    assert "PartitionFilters" in (plan := capsys.readouterr().out) and "bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert 0 < known.count() < 20 and len(set(buckets)) <= 2
    assert spark.read.parquet(out).count() == 301


def test_known_urls_are_merged(spark, tmp_path, monkeypatch):
    """Six batches, merged two by two: nothing is forgotten, and what a merge replaced goes one merge later."""
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 2)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for batch in range(6):
        rows = [(f"u{k}", "d") for k in range(batch, batch + 3)] + [("u0", "d")]
        add_file(spark, source, rows, "url STRING, domain STRING")
        jobs.stream_frontier(jobs.read_stream(spark, source, "url STRING, domain STRING"), out, checkpoint).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == [f"u{k}" for k in range(8)]
    assert sorted(r["url"] for r in jobs.known_urls(spark, f"{out}_urls", 6).collect()) == [f"u{k}" for k in range(8)]
    left = {kind: sorted(p.name for p in pathlib.Path(f"{out}_urls", kind).iterdir() if "=" in p.name) for kind in ("batches", "compact")}
    assert left == {"batches": ["batch_id=4", "batch_id=5"], "compact": ["upto=3", "upto=5"]}
