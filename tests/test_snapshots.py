"""Keyed snapshots, keyed streaming state, and lookups by page key."""

import pathlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_streaming import add_file, forget_last_batch

from webloom.functions.keys import page_key
from webloom.operators import frontier as fr
from webloom.operators import index as ix
from webloom.sources import layout, snapshots, tables
from webloom.streaming import jobs, state

COUNTS = "word STRING, documents_number BIGINT"


def counted(spark, counts):
    return spark.createDataFrame(list(counts.items()), COUNTS)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def test_an_upsert_writes_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "counters")
    first = {f"w{i}": i for i in range(200)}
    assert snapshots.read_snapshot(spark, path, COUNTS).collect() == []
    assert snapshots.upsert(spark, path, COUNTS, "word", counted(spark, first), ix.merge_term_documents, 1, buckets=16)
    before = files(path)
    second = {"w3": 10, "w7": 10, "new": 1, None: 5}
    assert snapshots.upsert(spark, path, COUNTS, "word", counted(spark, second), ix.merge_term_documents, 5, buckets=16)
    after = files(path)
    want = first | {"w3": 13, "w7": 17, "new": 1}
    assert {r.word: r.documents_number for r in snapshots.read_snapshot(spark, path, COUNTS).collect()} == want
    assert {r.word: r.documents_number for r in snapshots.read_snapshot(spark, path, COUNTS, version=1).collect()} == first
    buckets = {r[0] for r in counted(spark, second).filter("word IS NOT NULL").select(snapshots.bucket_of("word", 16)).collect()}
    where = snapshots.manifest(spark, path, 5)
    assert {b for b, v in where.items() if v == 5} == buckets and len(buckets) <= 3 and len(where) > 10
    assert {name for name in after if name not in before} == {n for n in after if "version=5" in n}
    assert all(after[name] == time for name, time in before.items())
    # the same number again changes nothing, as does a job that runs again
    assert not snapshots.upsert(spark, path, COUNTS, "word", counted(spark, {"w3": 99}), ix.merge_term_documents, 5, buckets=16)
    assert files(path) == after


def test_a_version_left_half_done_is_written_again(spark, tmp_path):
    path = str(tmp_path / "counters")
    snapshots.upsert(spark, path, COUNTS, "word", counted(spark, {"a": 1, "b": 2}), ix.merge_term_documents, 1)
    snapshots.upsert(spark, path, COUNTS, "word", counted(spark, {"a": 1}), ix.merge_term_documents, 2)
    pathlib.Path(path, "manifest", "version=2", "_SUCCESS").unlink()
    assert snapshots.versions(spark, path) == [1]
    assert snapshots.upsert(spark, path, COUNTS, "word", counted(spark, {"a": 5}), ix.merge_term_documents, 2)
    assert {tuple(r) for r in snapshots.read_snapshot(spark, path, COUNTS).collect()} == {("a", 6), ("b", 2)}


def test_old_versions_go_with_the_files_that_only_they_name(spark, tmp_path):
    path = str(tmp_path / "counters")
    drop_zero = lambda old, new: ix.merge_term_documents(old, new).filter("documents_number > 0")
    for version in range(6):
        changes = {f"w{i}": 1 for i in range(version, 40, 7)} | ({"w0": -1} if version == 5 else {})
        snapshots.upsert(spark, path, COUNTS, "word", counted(spark, changes), drop_zero, version, buckets=8)
    want = {tuple(r) for r in snapshots.read_snapshot(spark, path, COUNTS).collect()}
    snapshots.expire(spark, path)
    assert snapshots.versions(spark, path) == [4, 5]
    assert {tuple(r) for r in snapshots.read_snapshot(spark, path, COUNTS).collect()} == want and not any(w == "w0" for w, _ in want)
    named = {(v, b) for k in (4, 5) for b, v in snapshots.manifest(spark, path, k).items()}
    left = {(int(p.parent.name[8:]), int(p.name[7:])) for p in pathlib.Path(path, "data").glob("version=*/bucket=*")}
    assert left == named


NOON = datetime(2024, 1, 1, 12)


def visits(seed, n=300):
    draw = random.Random(seed)
    rows = []
    for seq in range(n):
        domain = "hot" if draw.random() < 0.4 else f"d{draw.randrange(40)}"
        delay = None if draw.random() < 0.1 else round(draw.random() * 200, 2)
        rows.append((domain, delay, NOON + timedelta(seconds=draw.randrange(3000), milliseconds=draw.randrange(1000)), seq))
    rows += [("tie", 5.0, NOON, 7), ("tie", 9.0, NOON, 7), ("tie", None, NOON, 7)]
    return rows


def followed(spark, source, out, checkpoint, **options):
    stream = jobs.read_stream(spark, source, state.VISITS)
    state.stream_domain_state(stream, out, checkpoint, buckets=4, **options).awaitTermination()


def expected(spark, rows):
    given = spark.createDataFrame(rows, state.VISITS).filter("domain IS NOT NULL AND last_visit IS NOT NULL AND seq IS NOT NULL")
    nothing = spark.createDataFrame([], "domain STRING, crawl_delay DOUBLE, last_visit TIMESTAMP")
    now = given.agg(F.max(F.unix_millis("last_visit"))).first()[0]
    out = []
    for keep in (False, True):
        rows = fr.domain_state_upsert(nothing, given, keep_delay=keep)
        out.append({r.domain: (r.crawl_delay, r.last_visit) for r in rows.collect()})
    over = F.floor((F.unix_micros("last_visit") + (F.coalesce("crawl_delay", F.lit(0.0)) * 1_000_000).cast("long")) / 1000)
    ready = {r.domain for r in fr.domain_state_upsert(nothing, given).filter(over < now).collect()}
    return (*out, ready)


def test_stream_state_equals_the_batch_form(spark, tmp_path):
    """Three batches out of order, one of them twice, and one that runs again after a crash."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = [*visits(1), (None, 1.0, NOON, 1), ("d1", 1.0, None, 900), ("d1", 1.0, NOON, None)]
    random.Random(2).shuffle(rows)
    parts = [rows[:120], rows[120:200], rows[120:200], rows[200:]]
    for part in parts:
        add_file(spark, source, part, state.VISITS)
        followed(spark, source, out, checkpoint)
    forget_last_batch(checkpoint)
    followed(spark, source, out, checkpoint)
    last, first, ready = expected(spark, rows)
    for keep, want in ((False, last), (True, first)):
        got = {r.domain: (r.crawl_delay, r.last_visit) for r in state.domain_state(spark, out, keep_delay=keep).collect()}
        assert got == want
    assert {r.domain for r in state.ready_domains(spark, out).collect()} == ready
    assert 3 < len(ready) < len(last)


def test_a_timer_tells_when_a_delay_is_over(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    ready = lambda: {r.domain for r in state.ready_domains(spark, out).collect()}
    at = lambda seconds: NOON + timedelta(seconds=seconds)
    for part, want in (
        ([("a", 10.0, at(0), 1), ("b", 100.0, at(0), 2)], set()),
        ([("c", 1000.0, at(50), 3)], {"a"}),  # no visit of "a": its timer went off
        ([("a", 10.0, at(60), 4)], set()),  # visited again
        ([("d", 0.0, at(200), 5)], {"a", "b"}),
    ):
        add_file(spark, source, part, state.VISITS)
        followed(spark, source, out, checkpoint)
        assert ready() == want


def test_python_is_called_by_bucket_and_not_by_domain(spark, tmp_path, monkeypatch):
    """Domains of one bucket share a call; a timer of one of them changes only those whose delay is over."""
    source, out, checkpoint, calls = (str(tmp_path / n) for n in ("in", "out", "checkpoint", "calls"))
    monkeypatch.setattr(state, "STATE_BUCKETS", 2)
    follow = state._follow

    def counted(unit):
        each = follow(unit)

        def run(key, parts, kept):
            with open(calls, "a") as f:
                f.write(f"{key[0]}\n")
            return each(key, parts, kept)

        return run

    monkeypatch.setattr(state, "_follow", counted)
    rows = [(f"d{i}", float(i), NOON, i) for i in range(100)]
    for part in (rows, [("late", 1e6, NOON + timedelta(seconds=50, milliseconds=1), 200)], [("d7", None, NOON - timedelta(1), 300)]):
        add_file(spark, source, part, state.VISITS)
        followed(spark, source, out, checkpoint)
    assert {r.domain for r in state.ready_domains(spark, out).collect()} == {f"d{i}" for i in range(51)}
    assert pathlib.Path(calls).read_text().count("\n") < 40
    got = {r.domain: r.crawl_delay for r in state.domain_state(spark, out).collect()}
    assert got == {f"d{i}": float(i) for i in range(100) if i != 7} | {"d7": None, "late": 1e6}


def test_only_the_rows_of_a_domain_per_task_are_shuffled():
    import pyarrow as pa

    rows = visits(3, 5000)
    micros = [int(t.timestamp() * 1_000_000) for _, _, t, _ in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in ([r[0] for r in rows], [r[3] for r in rows], micros, [r[1] for r in rows])], ["domain", "seq", "visit", "delay"])
    (found,) = state._combined(iter([batch]))
    assert found.num_rows == len({r[0] for r in rows}) + 1 and found.to_pylist()[-1]["seen"] == max(micros)
    tie = next(r for r in found.to_pylist() if r["domain"] == "tie")
    assert (tie["delay"], tie["last_delay"]) == (None, 9.0)


def test_lookup_opens_only_the_folders_of_its_keys(spark, tmp_path, capsys):
    path = str(tmp_path / "pages")
    rows = [(i, f"https://h{i % 9}.com/{i}", f"<p>{i}</p>") for i in range(2000)]
    layout.write_pages(spark.createDataFrame(rows, tables.STORED_PAGES), path)
    wanted = [rows[i] for i in range(0, 2000, 100)]
    keys = spark.createDataFrame([(r[1],) for r in wanted] + [(wanted[0][1],), ("https://not.there",), (None,)], "url STRING").select("url", page_key(F.col("url")).alias("page_key"))
    for limit in (layout.FEW_KEYS, 3):
        layout.FEW_KEYS, before = limit, layout.FEW_KEYS
        found = layout.lookup_pages(keys, path)
        assert sorted((r.page_id, r.url, r.html) for r in found.collect()) == sorted(wanted)
        found.explain("formatted")
        layout.FEW_KEYS = before
        plan = capsys.readouterr().out
        assert "prefix" in plan.split("PartitionFilters")[1].split("\n")[0]
        prefixes = {r[0] for r in keys.filter("page_key IS NOT NULL").select(F.substring("page_key", 1, 2)).collect()}
        opened = {pathlib.Path(f).parent.name for f in spark.read.parquet(path).filter(F.col("prefix").isin(list(prefixes))).inputFiles()}
        read = found.select("prefix").distinct().collect()
        assert {r[0] for r in read} <= prefixes and len(opened) >= len(prefixes) - 1


def test_lookup_of_nothing(spark, tmp_path):
    path = str(tmp_path / "pages")
    layout.write_pages(spark.createDataFrame([(1, "u", "h")], tables.STORED_PAGES), path)
    assert layout.lookup_pages(spark.createDataFrame([], "page_key STRING"), path).collect() == []


@pytest.mark.parametrize("n", [0, 1])
def test_expire_of_little(spark, tmp_path, n):
    path = str(tmp_path / "t")
    if n:
        snapshots.upsert(spark, path, COUNTS, "word", counted(spark, {"a": 1}), ix.merge_term_documents, 1)
    snapshots.expire(spark, path)
    assert len(snapshots.versions(spark, path)) == n
