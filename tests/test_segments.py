"""Segmented index, score bounds, page bitmaps, first pages without HTML, and rank updates."""

import pathlib
import random

import golden
import pytest
from pyspark.sql import functions as F
from test_streaming import PARSED, RAW, add_file, forget_last_batch

from webloom.operators import bitmaps as bm
from webloom.operators import firsts
from webloom.operators import index as ix
from webloom.operators import pages as pg
from webloom.operators import rank as rk
from webloom.operators import rerank
from webloom.operators import search as se
from webloom.operators import topk
from webloom.plans import bloom
from webloom.sources import segments, tables
from webloom.streaming import jobs


def corpus(n, seed=5):
    draw = random.Random(seed)
    words = ["the", "of", "and", *[f"w{i}" for i in range(60)]]
    weights = [40, 30, 20, *[60 / (i + 1) for i in range(60)]]
    rows = []
    for i in range(n):
        text = " ".join(draw.choices(words, weights, k=draw.randint(0, 25)))
        rows.append((i, f"https://h{i % 7}.com/{i}", f"T{i}", text))
    return rows


def one_shot(spark, rows, ranks=None):
    pages = spark.createDataFrame(rows, PARSED)
    postings = ix.build_postings(pages, F.col("text"))
    return ix.score_postings(postings, ix.corpus_size(pages))


def answers(index, pages, query):
    found = se.search_pages(index, pages, query, n_results=-1).collect()
    return [(r.page_id, None if r.score is None else round(r.score, 9)) for r in found]


def test_forty_batches(spark, tmp_path):
    """Segments stay few, answers equal an index made at once, and a refresh writes no posting."""
    path, rows = str(tmp_path / "index"), corpus(400)
    for batch in range(40):
        live = segments.add_pages(spark.createDataFrame(rows[batch::40], PARSED).coalesce(1), path, batch)
        by_tier = [s.tier for s in live]
        assert max(by_tier.count(t) for t in by_tier) < segments.FANOUT
        if batch % 10 == 9:
            segments.expire(spark, path)
    assert len(live) <= 3 * 6 and sum(s.n_pages for s in live) == 400  # 4 ** 6 = 4,096 postings
    assert len([p for p in pathlib.Path(path, "segments").iterdir() if p.is_dir()]) <= 2 * len(live) + segments.FANOUT + 1
    postings = {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("postings/*.parquet")}
    assert segments.scored(spark, path).collect() == []  # nothing has been published yet
    ranks = spark.createDataFrame([(r[1], 1 / (1 + r[0])) for r in rows], "url STRING, page_rank DOUBLE")
    segments.refresh(spark, path, 39, ranks)
    assert {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("postings/*.parquet")} == postings
    known, index = segments.statistics(spark, path), segments.scored(spark, path)
    want = one_shot(spark, rows)
    assert known.n_pages == 400
    for all_words in (False, True):
        got = segments.scored(spark, path, all_words).select("word", "page_id", F.round("tf_idf", 12))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("word", "page_id", F.round("tf_idf", 12)).collect()))
    for query in ("the of", "the w3 w1", "w50", "unknown the", ""):
        assert answers(index, known.ranks, query) == answers(want, ranks, query)


def test_a_search_reads_the_statistics_of_its_words(spark, tmp_path, capsys):
    path = str(tmp_path / "index")
    segments.add_pages(spark.createDataFrame(corpus(30), PARSED), path, 0)
    segments.refresh(spark, path, 0)
    segments.scored(spark, path).filter(F.col("word").isin("the", "of")).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("In(word, [of,the])") + plan.count("In(word, [the,of])") >= 2


def test_stream_of_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "pagerank", lambda pages, links, n_docs: rk.pagerank(pages, links, n_docs, iterations=5))
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = [(i, url, title, title) for i, url, title in golden.PAGES]
    links = lambda session: session.createDataFrame(golden.LINKS, "source_url STRING, target_url STRING")

    def run():
        jobs.stream_segments(jobs.read_stream(spark, source, PARSED), out, checkpoint, refresh_every=2, links=links).awaitTermination()

    refreshed = []
    for part in (rows[:1], rows[1:2], rows[2:3], rows[3:]):
        add_file(spark, source, part, PARSED)
        run()
        known = segments.statistics(spark, out)
        refreshed.append(known.n_pages if known else 0)
    forget_last_batch(checkpoint)
    run()
    assert refreshed == [0, 2, 2, 4]
    got = {(r.page_id, r.word): r.tf_idf for r in segments.scored(spark, out).collect()}
    assert got == {key: pytest.approx(value[1], abs=1e-6) for key, value in golden.POSTINGS.items()}
    ranks = segments.statistics(spark, out).ranks.collect()
    assert {r.url: r.page_rank for r in ranks} == {u: pytest.approx(v, abs=1e-6) for u, v in golden.RANKS_AFTER_5.items()}


@pytest.fixture(scope="module")
def ranked(spark):
    rows = corpus(600, 8)
    ranks = spark.createDataFrame([(r[0], None if r[0] % 97 == 0 else 1 / (1 + r[0] % 50)) for r in rows], "page_id BIGINT, page_rank DOUBLE")
    index = one_shot(spark, rows).join(ranks, "page_id")
    index = index.withColumn("tf_idf", F.when((F.col("page_id") % 31 == 0) & (F.col("word") != "of"), F.lit(None)).otherwise(F.col("tf_idf")))
    return index.cache(), rows


QUERIES = ["the of", "the", "of and the", "w1 w2", "w59 the", "missing the", "", "The OF", "w40", "the of and w0 w1"]


@pytest.mark.parametrize("k, size, probes", [(1, 16, 1), (20, 64, 4), (1000, 16, 1), (3, 4096, 1)])
def test_bounded_search_equals_the_whole_one(spark, ranked, k, size, probes):
    index, _ = ranked
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id INT, query STRING")
    bounds = topk.block_bounds(index, size)
    columns = ["query_id", "rank", "page_id", "title", "url", F.round("score", 10).alias("score")]
    got = topk.search_batch_bounded(index, bounds, queries, k, size=size, probes=probes).select(*columns)
    want = se.search_batch(index, None, queries, k).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_bounds_spare_postings(spark):
    """Of two words that are on all pages, top pages are found in a small part of their postings."""
    draw, rows = random.Random(3), []
    for i in range(3000):
        often = 8 if i // 32 % 20 == 0 else 2
        words = ["the"] * draw.randint(1, often) + ["of"] * draw.randint(1, often)
        rows.append((i, f"https://h.com/{i}", "T", " ".join(words + ["x"] * (40 - len(words)) + [f"only{i % 3}"])))
    # every page has the words, so their idf is made up
    index = ix.build_postings(spark.createDataFrame(rows, PARSED), F.col("text")).withColumn("tf_idf", F.col("tf") * 2)
    index = index.withColumn("page_rank", 1 / (1000 + F.col("page_id"))).cache()
    bounds, asked = topk.block_bounds(index, 32).cache(), spark.createDataFrame([(1, "the of")], "query_id INT, query STRING")
    *_, used = topk._answers(index, bounds, asked, 10, False, 32, 4)
    read = used.agg(F.sum("n")).first()[0]
    every = bounds.filter(F.col("word").isin("the", "of")).agg(F.sum("n")).first()[0]
    assert every == 6000 and 0 < read < 0.1 * every
    got = topk.search_batch_bounded(index, bounds, asked, 10, size=32).orderBy("rank").collect()
    want = se.search_pages(index, None, "the of", 10).collect()
    assert [r.page_id for r in got] == [r.page_id for r in want]
    index.unpersist(), bounds.unpersist()


@pytest.mark.parametrize("terms", [["the"], ["the", "of", "and"], ["w3", "the"], ["the", "the"], ["missing", "the"], ["the", "of", "and", *[f"w{i}" for i in range(7)]], []])
def test_bitmaps_equal_page_sets(spark, ranked, terms):
    index, _ = ranked
    sets = bm.page_bitmaps(index)
    want = sorted(r.page_id for r in se.and_pages(index, terms).collect())
    assert sorted(r.page_id for r in bm.and_pages_bitmap(sets, terms).collect()) == want
    assert bm.and_count(sets, terms).first().n_pages == len(want)


def test_bitmaps_of_all_kinds_of_numbers(spark, tmp_path):
    numbers = [0, 1, 2, 32767, 32768, 32769, 65536, 65537, 10**12, -1, -32767, -32768, -32769, -65537]
    postings = spark.createDataFrame([("x", n) for n in numbers] + [("y", 1), ("y", 32769)], "word STRING, page_id BIGINT")
    bm.write_bitmaps(bm.page_bitmaps(postings), str(tmp_path / "sets"))
    sets = tables.read_table(spark, str(tmp_path / "sets"), bm.PAGE_BITMAPS)
    assert sorted(r.page_id for r in bm.and_pages_bitmap(sets, ["x"]).collect()) == sorted(numbers)
    assert sorted(r.page_id for r in bm.and_pages_bitmap(sets, ["x", "y"]).collect()) == [1, 32769]
    assert sorted(r.page_id for r in bm.bitmap_pages(bm.any_term(sets, ["y"])).collect()) == [1, 32769]


def test_bitmaps_shuffle_less(spark):
    """Rows that cross the exchange: a block of pages and task against a page."""
    postings = spark.range(40_000).selectExpr("id AS page_id", "CASE id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS word")
    postings = postings.unionByName(spark.range(40_000).selectExpr("id AS page_id", "'all' AS word")).cache()
    sets = bm.page_bitmaps(postings).cache()
    assert sets.count() == 2 * 2 + 2 + 2  # the page 0 is a block by itself
    found = bm.and_pages_bitmap(sets, ["all", "even"])
    assert found.count() == 20_000
    assert sum(len(r.pages) for r in sets.collect()) < 8 * postings.count()
    postings.unpersist(), sets.unpersist()


def crawled(n=300, seed=2):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        url = f"u{draw.randrange(n // 2)}" if i % 10 else "hot"
        rows.append((i, None if i % 41 == 0 else url, f"<title>T{i}</title>", i % 13 != 0))
    return rows


@pytest.mark.parametrize("bits", [4, 12, 26])
def test_first_pages_equal_the_plain_form(spark, bits):
    """Also with filters so small that they hold everything."""
    pages = spark.createDataFrame(crawled(), RAW)
    known = spark.createDataFrame([(f"u{i}",) for i in range(0, 150, 3)] + [("u3",)], "url STRING")
    for given in (None, known):
        want = sorted(map(tuple, pg.parse_pages(pages, given).collect()))
        assert sorted(map(tuple, firsts.parse_first_pages(pages, given, bits=bits).collect())) == [r for r in want if r[1] is not None]
    listed = firsts.keep_first_new(pages, known, bits=bits, listed=0)  # falls back to a join
    kept = sorted(r.page_id for r in firsts.keep_first_new(pages, known, bits=bits).collect())
    assert sorted(r.page_id for r in listed.collect()) == kept and listed.columns == pages.columns


def test_no_html_crosses_an_exchange(spark, tmp_path):
    pages = spark.createDataFrame(crawled(), RAW)
    pages.write.parquet(str(tmp_path / "pages"))
    found = firsts.keep_first_new(spark.read.schema(RAW).parquet(str(tmp_path / "pages")), spark.createDataFrame([("u3",)], "url STRING"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange" in line]
    assert len(moved) == 1 and "BroadcastExchange" in moved[0]


def test_known_filter_can_be_kept(spark):
    known = spark.createDataFrame([(f"u{i}",) for i in range(1000)], "url STRING")
    packed = firsts.known_filter(known, 16)
    assert len(packed) == (1 << 16) // 8
    asked = spark.createDataFrame([("u5",), ("v",), (None,)], "url STRING")
    got = asked.withColumn("maybe", bloom.may_hold(packed, F.when(F.col("url").isNotNull(), F.xxhash64("url")), asked, 16)).collect()
    assert {r.url: r.maybe for r in got} == {"u5": True, "v": False, None: False}
    pages = spark.createDataFrame([(1, "u5"), (2, "v"), (3, "v"), (4, None)], "page_id BIGINT, url STRING")
    assert [tuple(r) for r in firsts.first_new_ids(pages, known, packed, 16).collect()] == [(2, "v")]


def test_filter_of_many_hashes(spark):
    numbers = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    packed = bloom.build(numbers, 22)
    marked = spark.range(40_000).withColumn("in", bloom.may_hold(packed, F.xxhash64("id"), numbers, 22))
    found = {r[0]: r[1] for r in marked.groupBy("in").count().collect()}
    assert marked.filter("id < 20000 AND NOT in").count() == 0 and found[False] > 19_500
    assert bloom.build(numbers.limit(0), 22) == bytes(1 << 19)


def graph(seed, n=60):
    draw = random.Random(seed)
    pages = [f"p{i}" for i in range(n)]
    edges = [(draw.choice(pages), draw.choice([*pages, "x1", "x2"])) for _ in range(3 * n)]
    edges += [("p0", f"p{i}") for i in range(n // 2)] + [("lost", "p1"), ("p2", "p3"), ("p2", "p3")]
    return pages, edges


@pytest.mark.parametrize("seed", [2])
def test_updated_ranks_equal_a_full_run(spark, seed):
    pages, edges = graph(seed)
    linked = {t for _, t in edges}
    alone = [p for p in pages if p not in linked]
    added = [("p5", "p6"), ("p7", "new"), ("newpage", "p8"), ("p9", "lost"), ("p2", "p3"), ("fresh", "p1"), *[("p1", a) for a in alone[:2]]]
    more = [*pages, "newpage", "another"]
    ddl = "source_url STRING, target_url STRING"
    frames = [spark.createDataFrame([(p,) for p in x], "url STRING") for x in (pages, more)]
    old, new = spark.createDataFrame(edges, ddl), spark.createDataFrame(added, ddl)
    full = lambda p, e, n: rk.pagerank(p, e, n, d=0.5, iterations=45)
    ranks = full(frames[0], old, len(pages))
    got = rerank.update_ranks(ranks, len(pages), frames[1], len(more), old, new, d=0.5)
    want = {r.url: r.page_rank for r in full(frames[1], old.unionByName(new), len(more)).collect()}
    assert {r.url: r.page_rank for r in got.ranks.collect()} == {u: pytest.approx(v, abs=1e-9) for u, v in want.items()}


def test_an_update_passes_on_less(spark):
    """One more link in many separate rings moves the ranks of its own ring only."""
    edges = [(f"r{r}n{i}", f"r{r}n{(i + step) % 6}") for r in range(40) for i in range(6) for step in (1, 2)]
    pages = spark.createDataFrame([(f"r{r}n{i}",) for r in range(40) for i in range(6)], "url STRING")
    ddl = "source_url STRING, target_url STRING"
    old, new = spark.createDataFrame(edges, ddl), spark.createDataFrame([("r3n0", "r3n3")], ddl)
    full = lambda e: rk.pagerank(pages, e, 240, d=0.5, iterations=45)
    ranks = full(old)
    got = rerank.update_ranks(ranks, 240, pages, 240, old, new, d=0.5, bound=1e-12)
    assert got.shares and max(got.shares) <= 13 < len(edges) / 10
    want = {r.url: r.page_rank for r in full(old.unionByName(new)).collect()}
    assert {r.url: r.page_rank for r in got.ranks.collect()} == {u: pytest.approx(v, abs=1e-9) for u, v in want.items()}
    same = rerank.update_ranks(ranks, 240, pages, 240, old, new.limit(0), d=0.5, bound=1e-9)
    assert same.shares == []


def test_a_part_of_the_documents_is_a_micro_batch_of_many_files(spark, tmp_path):
    """No task writes or reads a whole part; the segments hold every document once."""
    from catalog import streams

    rows = [(i, f"w{i} all", "en", "s", 5) for i in range(48)]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").repartition(4)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        path = streams._segments(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(spark.read.parquet(f"{path.removesuffix('/index')}/documents").inputFiles()) > 6
    assert segments.newest(spark, path) == 5
    assert sorted(r.page_id for r in segments.read_pages(spark, path).collect()) == list(range(48))
    assert {r.word: r.documents_number for r in segments.read_counters(spark, path).collect()}["all"] == 48
