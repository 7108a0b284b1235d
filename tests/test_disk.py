"""What large tables would otherwise leave on, or send over, the disks of the workers."""

import pyarrow as pa
from pyspark.sql import functions as F

from webloom.operators import topk
from webloom.plans.lineage import materialize
from webloom.sources import layout, segments
from webloom.streaming import jobs

PARSED = "page_id BIGINT, url STRING, title STRING, text STRING"


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    rows = spark.range(4000).select(F.concat(F.lit("w"), F.col("id") % 50).alias("word"), F.col("id").alias("page_id"))
    before = blocks.getAllFiles().size()
    layout.write_index(rows, str(tmp_path / "index"))
    counted = materialize(rows.groupBy("word").agg(F.count("*").alias("n")))
    assert counted.count() == 50
    shuffled = [f.getName() for f in _listed(blocks.getAllFiles()) if f.getName().startswith("shuffle")]
    assert blocks.getAllFiles().size() <= before + 6, shuffled  # of the last count alone


def test_an_index_is_written_in_several_goes(spark, tmp_path, monkeypatch):
    rows = [(f"w{k % 40:02d}" if k % 9 else None, k if k % 7 else None, f"u{k}", "t", 0.5, k / 500, 1 / (k + 1)) for k in range(500)]
    rows += [("hot", k, "u", None, 0.1, None, None) for k in range(200)] + rows[:30]
    index = spark.createDataFrame(rows, "word STRING, page_id LONG, url STRING, title STRING, tf DOUBLE, tf_idf DOUBLE, page_rank DOUBLE")
    monkeypatch.setattr(layout, "POSTINGS_OF_GO", 100)
    parts = layout.word_ranges(index, len(rows))
    counts = [index.filter(part).count() for part in parts]
    assert 3 < len(parts) <= 8 and sum(counts) == len(rows) and max(counts) < 400
    layout.write_index(index, f"{tmp_path}/index", n_postings=len(rows))
    topk.write_bounds(index, f"{tmp_path}/bounds", 64, len(rows))
    stored = spark.read.schema(index.schema).parquet(f"{tmp_path}/index")
    assert sorted(map(str, stored.collect())) == sorted(map(str, index.collect()))
    bounds = spark.read.schema(topk.BOUNDS).parquet(f"{tmp_path}/bounds")
    assert sorted(map(str, bounds.collect())) == sorted(map(str, topk.block_bounds(index, 64).collect()))
    layout.write_index(index.limit(0), f"{tmp_path}/none", n_postings=500)
    assert spark.read.schema(index.schema).parquet(f"{tmp_path}/none").count() == 0


def _listed(files):
    return [files.apply(k) for k in range(files.size())]


def test_words_are_looked_for_below_the_join_that_scores(spark, tmp_path):
    path = str(tmp_path / "index")
    segments.add_pages(spark.createDataFrame([(k, f"u{k}", "t", f"the w{k}") for k in range(20)], PARSED), path, 0, spread=3)
    segments.refresh(spark, path, 0)
    words = spark.createDataFrame([("the",), ("w3",)], "word STRING")
    found, whole = segments.scored(spark, path, words=words), segments.scored(spark, path)
    assert sorted(found.collect()) == sorted(whole.filter("word IN ('the', 'w3')").collect()) and found.count() == 21
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {kind: [line.index("Join") for line in plan if f"Join {kind}" in line] for kind in ("Inner", "LeftSemi")}
    assert depth["LeftSemi"] and max(depth["LeftSemi"]) > max(depth["Inner"])


def test_ranks_are_joined_to_pages_and_not_to_postings(spark):
    rows = [("a", 1, "u", "t", 0.5), ("b", 1, "u", "t", 0.25), ("b", 1, "u", "t", 0.25), (None, 1, "u", None, 1.0)]
    rows += [("a", None, None, "t", 1.0), ("a", 2, "v", "t", None), ("c", 1, "u", "t", 0.5)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["word", "page_id", "url", "title", "tf"])
    assert [len(r["terms"]) for out in jobs._by_page(iter([batch, batch.slice(0, 0)])) for r in out.to_pylist()] == [3, 1, 1, 1, 1]
    postings = spark.createDataFrame(rows, jobs.POSTINGS)
    ranks = spark.createDataFrame([("u", 0.1), ("w", 0.2)], jobs.RANKS)
    pages = spark.createDataFrame([(1, "u"), (1, "u"), (2, "v"), (None, None)], jobs.INDEXED)
    got = jobs._ranked(postings, ranks, pages)
    assert sorted(map(str, got.collect())) == sorted(map(str, postings.join(ranks, "url", "left").select(got.columns).collect()))
