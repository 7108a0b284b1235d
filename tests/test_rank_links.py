import pathlib
import random

import golden
import pytest
from catalog.common import SUFFIXES
from pyspark.sql import functions as F

from webloom.operators import link_blocks as lb
from webloom.operators import links as ln
from webloom.operators import rank as rk
from webloom.operators.robots import robots_allow
from webloom.plans import skew


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, url) for i, url, _ in golden.PAGES], "page_id LONG, url STRING")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(golden.LINKS, "source_url STRING, target_url STRING")


def ranks_of(frame):
    return {r["url"]: r["page_rank"] for r in frame.collect()}


def test_pagerank_after_few_sweeps(pages, edges):
    got = ranks_of(rk.pagerank(pages, edges, 4, iterations=5))
    assert got == {u: pytest.approx(v, abs=1e-6) for u, v in golden.RANKS_AFTER_5.items()}


def test_pagerank_converged(pages, edges):
    got = ranks_of(rk.pagerank(pages, edges, 4))
    assert got == {u: pytest.approx(v, abs=1e-8) for u, v in golden.RANKS.items()}


def test_pagerank_stops_early(pages, edges):
    got = ranks_of(rk.pagerank(pages, edges, 4, iterations=400, tol=1e-6))
    assert got == {u: pytest.approx(v, abs=1e-5) for u, v in golden.RANKS.items()}


def test_pagerank_without_sweeps(pages, edges):
    got = ranks_of(rk.pagerank(pages, edges, 4, iterations=0))
    assert got == {url: 0.25 for _, url, _ in golden.PAGES}


def test_rank_pages(pages, edges):
    ranked = rk.rank_pages(pages, rk.pagerank(pages, edges, 4, iterations=5))
    got = {r["url"]: r["page_rank"] for r in ranked.collect()}
    assert got == {url: pytest.approx(golden.RANKS_AFTER_5[url], abs=1e-6) for _, url, _ in golden.PAGES}


def ranks_by_hand(pages, edges, n_docs, sweeps):
    """All URLs of a sweep at once, in plain Python."""
    ranks = {url: 1 / n_docs for url in pages}
    degree, sources = {}, {}
    for s, t in edges:
        degree[s] = degree.get(s, 0) + 1
        sources.setdefault(t, []).append(s)
    for _ in range(sweeps):
        ranks |= {
            t: 0.15 / n_docs + 0.85 * sum(ranks[s] / degree[s] for s in linked if s in ranks)
            for t, linked in sources.items()
        }
    return ranks


def files_under(path):
    return {p.parent for p in pathlib.Path(path).rglob("part-*")}


def test_pagerank_leaves_what_its_result_reads(spark, pages, edges):
    """Whatever the number of sweeps, the nodes and the last ranks stay."""
    folder = spark.conf.get("spark.checkpoint.dir")
    before = files_under(folder)
    ranks = rk.pagerank(pages, edges, 4, iterations=23)
    assert len(files_under(folder) - before) == 2
    assert ranks.count() == len(golden.RANKS)


def test_pagerank_with_hub_and_sink(spark):
    """One source owns a third of the links, one target another third."""
    draw = random.Random(5)
    urls = [f"u{i}" for i in range(120)]
    edges = [("u0", draw.choice(urls)) for _ in range(400)] + [(draw.choice(urls), "u1") for _ in range(400)]
    edges += [(draw.choice(urls + ["ext1", "ext2"]), draw.choice(urls + ["ext1"])) for _ in range(400)]
    indexed = urls[:90]
    frame = spark.createDataFrame(edges, "source_url STRING, target_url STRING")
    pages = spark.createDataFrame([(u,) for u in indexed], "url STRING")
    want = ranks_by_hand(indexed, edges, 90, 12)
    got = ranks_of(rk.pagerank(pages, frame, 90, iterations=12))
    assert got == {u: pytest.approx(v, abs=1e-12) for u, v in want.items()}


def test_a_sweep_shuffles_once(spark, capsys):
    """Edges lie by source and ranks come out by URL, so only contributions move."""
    numbered = spark.range(1000).select(F.col("id").alias("src"), ((F.col("id") * 7) % 1000).alias("dst"), F.lit(0.5).alias("w"))
    graph = rk._Graph(numbered, None, 4)
    ranks = spark.range(1000).select("id", F.lit(1.0).alias("rank")).groupBy("id").agg(F.sum("rank").alias("rank"))
    for _ in range(3):
        ranks = graph.contributions(ranks, 0.85).groupBy("id").agg(F.sum("part").alias("rank"))
    ranks.collect()
    ranks.explain()
    final = capsys.readouterr().out.split("\n+- == Initial Plan ==")[0]
    assert final.count("ENSURE_REQUIREMENTS") == 3 + 1
    graph.release()


def test_degrees_and_neighbours(edges):
    out = {r["source_url"]: r["out_degree"] for r in ln.out_degree(edges).collect()}
    assert out == {golden.A: 3, golden.B: 1, golden.C: 3, golden.H: 1, golden.O: 1}
    pairs = {(r["target_url"], r["source_url"]): r["n_links"] for r in ln.in_links(edges).collect()}
    assert pairs[golden.B, golden.A] == 2 and sum(pairs.values()) == 9


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, how):
    draw = random.Random(11)
    keys = ["hot"] * 700 + [None] * 20 + [f"k{draw.randint(0, 400)}" for _ in range(1400)]
    large = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id LONG, k STRING")
    small = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 400, 2)]], "k STRING, v LONG")
    hot = skew.HotKeys(skew.count_keys(large, "k"), "k", "n", limit=20)
    assert "hot" in dict(hot.rows)
    got = skew.skew_join(large, small, "k", ["id"], hot, how)
    want = large.join(small, "k", how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    got = skew.skew_join(large, small, "k", ["id"], how=how, slices=5)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_hot_keys_are_few_and_sliced(spark):
    """20% and 0.05% of the rows in one key: with 1,000 partitions no slice holds more than a task's share."""
    counts = spark.createDataFrame([("hot", 200_000), ("warm", 2_000), *[(f"k{i}", 399) for i in range(2000)]], "k STRING, n LONG")
    assert dict(skew.HotKeys(counts, "k", "n", limit=1000).rows) == {"hot": 200, "warm": 2}
    assert dict(skew.HotKeys(counts, "k", "n").rows) == {}  # four partitions, none above a quarter
    assert dict(skew.HotKeys(counts.filter("k < 'k5'"), "k", "n").rows)["hot"] >= 1
    large = spark.range(5000).select(F.when(F.col("id") % 5 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), "id")
    hot = skew.HotKeys(skew.count_keys(large, "k"), "k", "n", limit=100)
    sizes = hot.scatter(large, "k", ["id"]).filter("k = 'hot'").groupBy(skew.SLICE).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 150


def test_rules_are_joined_with_one_run_of_the_links(spark):
    """Nothing is counted at plan time: the rows are evaluated once, by the action."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(url):
        seen.add(1)
        return url

    links = spark.range(200).select(noted(F.concat(F.lit("https://h.example.com/"), F.col("id").cast("string"))).alias("url"))
    files = spark.createDataFrame([("h.example.com", "User-agent: *\nDisallow: /1", False)] * 2, "host STRING, content STRING, fetch_failed BOOLEAN")
    allowed = robots_allow(links, files, "bot")
    assert seen.value == 0
    rows = allowed.collect()
    assert seen.value == len(rows) == 200 and sum(not r["visit"] for r in rows) == 111


def test_link_edges(spark):
    html = '<a href="/x">1</a><a href="/x">2</a><a href="b.html">3</a><a>4</a><a href="http://o.example.co.uk/p/?q#f">5</a>'
    rows = [(1, "https://s.example.com/d?z=1", html, True), (2, "https://s.example.com/e", html, False), (3, "u", None, True)]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, follow BOOLEAN")
    got = sorted(map(tuple, ln.link_edges(pages, SUFFIXES).collect()))
    source = "https://s.example.com/d?z=1"
    assert got == [
        (source, "http://o.example.co.uk/p", "example.co.uk"),
        (source, "https://s.example.com/x", "example.com"),
        (source, "https://s.example.com/x", "example.com"),
    ]
    canonical = ln.link_edges(pages, SUFFIXES, canonicalize_sources=True).select("source_url").distinct().collect()
    assert [r[0] for r in canonical] == ["https://s.example.com/d"]


def test_sweeps_in_blocks_equal_sums_by_hand(spark, monkeypatch):
    """Several blocks, columns and chunks; one source with links to all, one target linked by all; parts few and many."""
    monkeypatch.setattr(lb, "_CHUNK", 300)
    draw, n = random.Random(8), 5000
    links = {(0, t) for t in range(n)} | {(s, 7) for s in range(n)} | {(draw.randrange(n), draw.randrange(n)) for _ in range(6000)}
    rows = [(s, t, draw.random()) for s, t in links]
    graph = lb.LinkBlocks(spark.createDataFrame(rows, "src LONG, dst LONG, w DOUBLE"), n)
    assert graph.shape.n_blocks == 5 and graph.shape.columns > 1
    values = {i: draw.random() for i in range(0, n, 2)}
    for _ in range(2):
        vector = graph.summed(graph.packed(spark.createDataFrame(list(values.items()), "id LONG, value DOUBLE"), "value"))
        want = {}
        for s, t, w in rows:
            want[t] = want.get(t, 0) + values.get(s, 0.0) * w
        got = {r.id: r.value for r in graph.unpacked(graph.summed(graph.shares(vector)), "values", "value").collect()}
        assert {i: v for i, v in got.items() if v} == {i: pytest.approx(v, rel=1e-12) for i, v in want.items() if v}
        values = want
    graph.release()


def test_shuffle_files_go_with_their_sweeps(spark, pages, edges):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = blocks.getAllFiles().size()
    ranks = rk.pagerank(pages, edges, 4, iterations=20)
    assert blocks.getAllFiles().size() < before + 50  # 40 shuffles of 4 tasks, with two files each, would be 320
    assert ranks.count() == len(golden.RANKS)
