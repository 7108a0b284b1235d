"""Operators on small tables with every awkward row, against plain Python."""

import pathlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from webloom.llm import exact_dedup, licenses, mixing, near_dedup, pieces, quality, sharding, substrings, token_counts
from webloom.llm.catalog import MODEL

CLASHING = ["content", "Digest", "rank", "salt", "hash", "size", "block", "shard", "label", "host", "start", "run", "__slice", "rep", "slot", "piece.ids"]
DDL = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def frame(spark, rows, extra=True):
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    return docs.select("*", *[F.lit("x").alias(name) for name in CLASHING]) if extra else docs


def vocabulary(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefgéß", k=draw.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies in chains, shared passages, periodic, blank, empty, null and long texts."""
    draw, words = random.Random(3), vocabulary(4, 900)
    texts = [draw.choices(words, k=draw.randint(1, 160)) for _ in range(60)]
    passage = draw.choices(words, k=45)
    for text in texts[:25]:
        at = draw.randint(0, len(text))
        text[at:at] = passage[draw.randint(0, 15) :]
    chain = draw.choices(words, k=200)
    for _ in range(15):  # each is near to the one before, the ends are far apart
        chain = list(chain)
        chain[draw.randrange(200)] = "new" + draw.choice(words)
        chain[draw.randrange(200)] = "more" + draw.choice(words)
        texts.append(chain)
    texts += [["echo"] * 70, ["a", "b", "c"] * 30, draw.choices(words, k=6000)]
    joined = [" ".join(t) for t in texts]
    joined += joined[:6] + ["  " + joined[7].replace(" ", "\n\n"), joined[8].upper(), joined[9] + "."]
    joined += ["", "", " \t\n", None, None, "one", "One", "one two three", "a\nb\na\n\n\nb", "#*$ % & |x <> ", "日本語 のテキスト ▁ \x00 x", "😀"]
    out = []
    for i, text in enumerate(joined):
        out.append((1000 - 7 * i, text, None if i % 11 == 0 else "en", None if i % 13 == 0 else f"s{i % 4}", len(text or "")))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_exact_dedup(docs, rows):
    got = {r[0]: tuple(r)[1:] for r in exact_dedup.verdicts(docs, salts=3).collect()}
    assert got == brute.exact(pairs(rows))


def test_exact_drop(docs, rows):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, v in brute.exact(pairs(rows)).items() if v[2])


def test_exact_ties_nulls_and_repeats(spark):
    rows = [(1, "a b", None, None, 0), (1, "a b", None, None, 0), (None, "ab", None, None, 0), (None, "a  b", None, None, 0), (2, "c ", None, None, 0), (3, " c", None, None, 0)]
    got = sorted(map(str, (tuple(r)[:4] for r in exact_dedup.verdicts(frame(spark, rows)).collect())))
    want = [(1, None, 4, False), (1, None, 4, False), (None, None, 4, False), (None, None, 4, True), (2, 2, 2, True), (3, 2, 2, False)]
    assert got == sorted(map(str, want))


def test_exact_digest_collisions(spark, monkeypatch):
    """With a digest that says nothing, whole texts still tell groups apart."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda content, bits: F.substring(F.base64(content), 1, 1))
    rows = [(i, t, None, None, 0) for i, t in enumerate(["ab", "a b", "ac", "ac", "x", "ab c"])]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.verdicts(frame(spark, rows)).collect()}
    assert got == {0: (1, 2, False), 1: (1, 2, True), 2: (2, 2, True), 3: (2, 2, False), 4: (4, 1, True), 5: (5, 1, True)}


def test_base_measures(rows):
    for _, text, *_ in rows:
        assert quality.base_measures(text) == brute.measures(text)


def test_host_verdicts_are_shrunk(spark):
    rows = [(f"h{i}", i % 10 == 0) for i in range(10) for _ in range(30)] + [("bad", True)] * 40 + [("once", True)] + [(None, True)]
    got = {r.host: r for r in quality.host_verdicts(spark.createDataFrame(rows, "host STRING, base_failed BOOLEAN")).collect()}
    assert got["bad"].rejected and not got["h1"].rejected
    assert got["once"].rate < got["bad"].rate < 1 and got["h1"].rate > 0 and None not in got
    equal = spark.createDataFrame([("a", False), ("b", False)], "host STRING, base_failed BOOLEAN")
    assert [r.rate for r in quality.host_verdicts(equal).collect()] == [0, 0]


def test_quality_drops_hosts_and_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, None, "fine", 0) for i in range(20)] + [(20 + i, "short", None, "foul", 0) for i in range(40)]
    rows += [(60, good, None, "foul", 0), (61, good, None, None, 0), (62, None, None, "fine", 0)]
    docs = frame(spark, rows)
    assert {r.doc_id for r in quality.verdicts(docs).filter("kept").collect()} == {*range(20), 61}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(20), 61}


@pytest.mark.parametrize("n", [4, 5])
def test_near_dedup(docs, rows, n):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.classes_of(docs, n=n).collect()}
    assert got == {d: (size, c, c == d) for d, (size, c) in brute.near(pairs(rows), n).items()}
    kept = near_dedup.drop_near_copies(docs, n=n)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, v in got.items() if v[2]}


def test_near_dedup_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f", None, None, 0), (5, "a b c d e f", None, None, 0), (5, "a b c d e f", None, None, 0), (2, "A B C d e f", None, None, 0)]
    got = sorted(map(str, map(tuple, near_dedup.classes_of(frame(spark, rows)).collect())))
    assert got == sorted(map(str, [(None, 2, None, True), (5, 2, 2, False), (5, 2, 2, False), (2, 2, 2, True)]))


def test_near_dedup_rounds(spark):
    """A bucket in which no star reaches all: hubs far from members that are near to each other."""
    draw, words = random.Random(8), vocabulary(9, 300)
    base = draw.choices(words, k=130)
    rows = []
    for group in range(12):
        own = list(base)
        for _ in range(16):
            own[draw.randrange(130)] = f"g{group}x{draw.random()}"
        for copy in range(3):
            text = list(own)
            text[draw.randrange(130)] = f"c{copy}{draw.random()}"
            rows.append((len(rows), " ".join(text), None, None, 0))
    got = {r.doc_id: r.component_id for r in near_dedup.classes_of(frame(spark, rows), n=1).collect()}
    assert got == {d: c for d, (_, c) in brute.near(pairs(rows), 1).items()}


def test_components(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100 + draw.randrange(60), 100 + draw.randrange(60)) for _ in range(40)] + [(7, 300 + i) for i in range(50)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(links, "a LONG, b LONG")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_repeated_spans(docs, rows):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.repeated_removed(docs).collect()}
    assert got == brute.repeated(pairs(rows))


def test_repeated_spans_across_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        draw, words = random.Random(2), vocabulary(6, 40)
        passage = draw.choices(words, k=37)
        table = [(i, " ".join(draw.choices(words, k=draw.randint(0, 30)) + passage[draw.randint(0, 10) :] + draw.choices(words, k=9)), None, None, 0) for i in range(80)]
        docs = frame(spark, table)
        got = {r.doc_id: tuple(r)[1:] for r in substrings.repeated_removed(docs).collect()}
        assert got == brute.repeated(pairs(table))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_spans_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, None, None, 0), (4, text, None, None, 0), (4, text, None, None, 0), (9, text, None, None, 0)]
    got = sorted(str(tuple(r)[:3]) for r in substrings.repeated_removed(frame(spark, rows)).collect())
    assert got == sorted(map(str, [(None, 30, 0), (4, 30, 0), (4, 30, 0), (9, 30, 30)]))


def test_mix(docs, rows):
    want = brute.mix([(r[0], r[1], r[3]) for r in rows])
    got = {r.doc_id: tuple(r)[1:] for r in mixing.mix(docs).collect()}
    assert {d: v[:2] + v[3:] for d, v in got.items()} == {d: v[:2] + v[3:] for d, v in want.items()}
    assert all(v[2] == pytest.approx(want[d][2]) for d, v in got.items())
    taken = sorted(r.doc_id for r in mixing.take_mix(docs).collect())
    assert taken == sorted(d for d, v in want.items() for _ in range(v[3] // v[0] if v[0] else 0))
    assert mixing.take_mix(docs).columns == docs.columns


def test_mix_many_sources(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), None, f"s{i % 97:03}", 0) for i in range(3000)]
    want = brute.mix([(r[0], r[1], r[3]) for r in rows])
    assert {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows)).collect()} == {d: v[3] for d, v in want.items()}


def test_reshard(spark, docs, rows, tmp_path):
    path = str(tmp_path / "moved")
    out = sharding.reshard(docs, F.pmod("doc_id", F.lit(3)), n_shards=4, blocks=64, path=path).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    sizes = {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    assert all(r.size == sizes[r.doc_id] for r in out)
    for shard in range(4):
        mine = [r for r in out if r["shard"] == shard]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    moved = {r.doc_id for r in spark.read.parquet(path).select("doc_id").collect()}
    assert moved == {r.doc_id for r in out if r["shard"] != r.old_shard}


def test_reshard_evens_out(spark):
    rows = [(i, "x" * (i * 37 % 200), None, "s", 0) for i in range(6000)]
    out = sharding.reshard(frame(spark, rows), F.lit(0)).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sums = [r.b for r in out]
    assert len(sums) == 8 and max(sums) - min(sums) < 0.005 * sum(sums)


def test_min_cost_flow_moves_the_least():
    draw = random.Random(0)
    for _ in range(30):
        supply = {i: draw.randrange(100) for i in range(draw.randint(1, 6))}
        capacity = sharding.equal_capacities(sum(supply.values()), draw.randint(1, 7))
        flow = sharding.min_cost_flow(supply, capacity)
        for i, units in supply.items():
            assert sum(v for (a, _), v in flow.items() if a == i) == units
        for j, units in capacity.items():
            assert sum(v for (_, b), v in flow.items() if b == j) == units
        moved = sum(v for (a, b), v in flow.items() if a != b)
        assert moved == sum(max(0, units - capacity.get(i, 0)) for i, units in supply.items())


def test_token_counts(docs, rows):
    initial, following = map(set, token_counts.vocabulary(MODEL))
    for row in token_counts.count_tokens(docs, MODEL).collect():
        words = token_counts.WORDS.findall(dict(pairs(rows))[row.doc_id] or "")
        counts = [brute.greedy(w, initial, following) for w in words]
        assert tuple(row)[1:] == (len(words), sum(map(abs, counts)), sum(c < 0 for c in counts))


def test_automaton_on_random_vocabularies():
    draw = random.Random(5)
    for _ in range(60):
        pieces_ = ["".join(draw.choices("ab", k=draw.randint(1, 5))) for _ in range(12)]
        initial, following = pieces_[:6], pieces_[6:]
        automaton = token_counts.Automaton(initial, following)
        for _ in range(60):
            word = "".join(draw.choices("ab", k=draw.randint(1, 14)))
            assert automaton.count(word) == brute.greedy(word, set(initial), set(following))


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as file:
        return pieces.Pieces(file.read())


def test_plain_encoding_equals_the_library(model, rows):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    texts = [t for _, t, *_ in rows if t and "▁" not in t and "\x00" not in t]
    for text, ids in zip(texts, model.encode(texts)):
        assert ids.tolist() == library.encode(text)


def by_agenda(model, text, alpha, key):
    """Ids by one agenda for each unit; a merge that comes up is skipped by its keyed hash."""
    out, limit = [], int(alpha * 2**32)
    for place, unit in enumerate(model.units.findall(" " + text) if text else []):
        own = key ^ pieces._mixed(place * pieces._MIX[0] & pieces._MASK)
        parts, skipped = [(i, i + 1) for i in range(len(unit))], set()
        while True:
            found = [(model.costs[unit[a:c]], a, b, c) for (a, b), (_, c) in zip(parts, parts[1:]) if unit[a:c] in model.costs and (a, b, c) not in skipped]
            if not found:
                break
            _, a, b, c = min(found)
            if pieces._mixed(own ^ pieces._code(a, b, c)) >> 32 < limit:
                skipped.add((a, b, c))
                continue
            at = parts.index((a, b))
            parts[at : at + 2] = [(a, c)]
        out += model._ids(unit, [0, *[c for _, c in parts]])
    return out


def test_dropout_by_agendas_one_by_one(model, rows, monkeypatch):
    draw = random.Random(6)
    texts = [t for _, t, *_ in rows[:60] if t is not None] + ["  " * 60 + "x", "▁a ▁", "x" * 90, "", "the " * 50, "日本語 é"]
    keys = [draw.getrandbits(64) for _ in texts]
    for alpha in (0.1, 0.6, 1.0):
        want = [by_agenda(model, t, alpha, k) for t, k in zip(texts, keys)]
        assert [ids.tolist() for ids in model.encode(texts, alpha, keys)] == want
    monkeypatch.setattr(pieces, "_SHORT", 0)  # all units by the heap
    model._forget()
    assert [ids.tolist() for ids in model.encode(texts, 0.6, keys)] == [by_agenda(model, t, 0.6, k) for t, k in zip(texts, keys)]
    model._forget()


def test_dropout_varies_and_is_lossless(model, rows, monkeypatch):
    texts = [t for _, t, *_ in rows if t is not None] + ["  " * 60 + "x", "▁a ▁", "x" * 500, "again and again " * 300]
    keys = list(range(1, len(texts) + 1))
    plain, one, other = (model.encode(texts, *args) for args in ((0.0,), (0.3, keys), (0.3, keys[::-1])))
    lists = [[ids.tolist() for ids in kind] for kind in (plain, one, other)]
    assert all(a != b for k, a in enumerate(lists) for b in lists[k + 1 :])
    for kind in (plain, one, other, model.encode(texts, 1.0, keys)):
        assert [model.decode(ids) for ids in kind] == texts
    monkeypatch.setattr(pieces, "_CACHED", 50)  # cuts are forgotten all the time
    assert [ids.tolist() for ids in model.encode(texts, 0.3, keys)] == lists[1]
    monkeypatch.setattr(pieces, "_CHUNK", 50)  # long texts in parts
    assert [ids.tolist() for ids in model.encode(texts, 0.3, keys)] == lists[1]


def test_a_model_is_not_gone_through_for_each_text(model, monkeypatch):
    """Its checksum is worked out once for a file, not at every look-up; another file has its own."""
    class Shared:
        def __init__(self, value):
            self.value = value

    sums = []
    monkeypatch.setattr(pieces, "_BUILT", {})
    monkeypatch.setattr(pieces, "Pieces", lambda proto: proto)
    monkeypatch.setattr(pieces.zlib, "crc32", lambda value: sums.append(value) or hash(value))
    one, other = Shared(b"one model"), Shared(b"another")
    assert [pieces._built(x) for x in (one, one, one, other, other, one)] == [b"one model"] * 3 + [b"another"] * 2 + [b"one model"]
    assert sums == [b"one model", b"another", b"one model"]


def test_long_texts_are_decoded_in_stretches(model, monkeypatch):
    text = "naïve 東京 words \t and  spaces " * 50
    (ids,) = model.encode([text])
    for n in (1, 7, 1 << 14):
        monkeypatch.setattr(pieces, "_DECODED", n)
        assert model.decode(ids) == text and model.decode(ids[:0]) == ""


def test_a_word_is_cut_in_many_ways(model):
    """Each time it occurs, by its own place; not by a few patterns."""
    text = "internationalization " * 400
    (ids,) = model.encode([text], 0.1, [5])
    cuts, word = set(), []
    for i in ids.tolist():
        if model.bytes_of[i].startswith(b" ") and word:
            cuts.add(tuple(word))
            word = []
        word.append(i)
    assert len(cuts) > 40


def test_copies_are_cut_in_their_own_ways(spark):
    text = " ".join(vocabulary(3, 80))
    rows = [(7, text, None, "s", 0)] * 2 + [(7, "other", None, "s", 0), (8, text, None, "s", 0), (None, text, None, "s", 0)]
    docs = spark.createDataFrame(rows, DDL).coalesce(1)
    got = [tuple(r.piece_ids) for r in pieces.encoded(docs, MODEL).collect()]
    assert len(set(got)) == 5
    assert sorted(got) == sorted(tuple(r.piece_ids) for r in pieces.encoded_documents(docs, MODEL).collect())
    assert got == [tuple(r.piece_ids) for r in pieces.encoded(docs, MODEL).collect()]
    assert [tuple(r.piece_ids) for r in pieces.encoded(docs, MODEL, seed=1).collect()] != got
    assert all(r.lossless and r.n_pieces == len(r.piece_ids) for r in pieces.encoded_documents(docs, MODEL).collect())


def test_encoded_tables_decode(docs, rows):
    encoded = pieces.encoded(docs, MODEL, out_col="piece ids")
    back = pieces.decoded(encoded.select("doc_id", "piece ids"), MODEL, "piece ids", "back")
    assert {r.doc_id: r.back for r in back.collect()} == dict(pairs(rows))
    for row in pieces.round_trips(docs, MODEL).collect():
        assert row.lossless and (row.n_pieces > 0) == bool(dict(pairs(rows))[row.doc_id])


def test_license_scan(spark):
    mit = dict(licenses.KNOWN)["MIT"]
    rows = [
        (1, "// Copyright (c) 2020 A. Person\n" + mit.upper().replace("\n", "\n   * "), None, None, 0),
        (2, mit.replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "Noninfringement"), None, None, 0),
        (3, mit + " And more.", None, None, 0),
        (4, "Text.\nlicensed UNDER the Apache Licence; version 2.0\nLicensed under CC BY-NC 4.0.\nText", None, None, 0),
        (5, None, None, None, 0),
        (6, "  \n", None, None, 0),
        (None, "(c) 1999", None, None, 0),
        (None, "(c) 1999", None, None, 0),
    ]
    got = sorted(licenses.scan(frame(spark, rows)).collect(), key=lambda r: r.doc_id or 99)
    assert [(r.license_id, r.n_notices, r.notice_id) for r in got][:6] == [
        ("MIT", 0, None), ("MIT", 0, None), (None, 0, None), (None, 2, "Apache-2.0-notice"), (None, 0, None), (None, 0, None)
    ]
    assert [r.canonical_chars for r in got][4:] == [0, 0, 0, 0]


@pytest.mark.parametrize(
    "run",
    [
        exact_dedup.verdicts,
        exact_dedup.drop_copies,
        quality.verdicts,
        quality.keep_good,
        near_dedup.classes_of,
        near_dedup.drop_near_copies,
        mixing.mix,
        mixing.take_mix,
        substrings.repeated_removed,
        licenses.scan,
        lambda d: sharding.reshard(d, F.lit(0)),
        lambda d: token_counts.count_tokens(d, MODEL),
        lambda d: pieces.encoded(d, MODEL),
        lambda d: pieces.round_trips(d, MODEL),
        lambda d: pieces.encoded_documents(d, MODEL),
    ],
)
def test_empty_table(spark, run):
    assert run(frame(spark, [])).collect() == []


def test_all_null_rows(spark):
    docs = frame(spark, [(None, None, None, None, None)] * 3)
    assert len(exact_dedup.verdicts(docs).collect()) == 3
    assert [r.kept for r in quality.verdicts(docs).collect()] == [False] * 3
    assert [r.kept for r in near_dedup.classes_of(docs).collect()] == [True] * 3
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0, 0.0, 0)] * 3
    assert mixing.take_mix(docs).collect() == []
    assert [(r.n_words, r.n_removed) for r in substrings.repeated_removed(docs).collect()] == [(0, 0)] * 3
    assert sorted(r.slot for r in sharding.reshard(docs, F.lit(None).cast("int")).filter("shard >= 0").collect())[0] == 0
    assert [r.n_tokens for r in token_counts.count_tokens(docs, MODEL).collect()] == [0] * 3
    assert [r.n_pieces for r in pieces.round_trips(docs, MODEL).collect()] == [0] * 3
    assert [r.piece_ids for r in pieces.encoded(docs, MODEL).collect()] == [None] * 3


def test_what_is_left_behind(spark, docs):
    """Only the tables that a result still reads stay in the shared folder."""
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    near_dedup.classes_of(docs)
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} == {"near_sketch", "near_named"}
    before = set(folder.iterdir())
    mixing.mix(docs)
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} == {"mix_sizes", "mix_thresholds"}


def test_a_mix_of_few_sources_shuffles_no_text(spark, monkeypatch, capsys):
    """One source has most documents; the plan of the sources is broadcast, or else its hot source is sliced."""
    docs = frame(spark, [(i, " ".join(["w"] * (1 + i * 7 % 50)), None, "hot" if i % 5 else f"s{i % 3}", 0) for i in range(300)])
    found = mixing.take_mix(docs)
    found.explain()
    assert "Exchange hashpartitioning(__source" not in capsys.readouterr().out
    few = sorted(map(repr, found.collect()))
    monkeypatch.setattr(mixing, "SOURCES_IN_MEMORY", 0)
    many = mixing.take_mix(docs)
    many.explain()
    assert "Exchange hashpartitioning(__source" in capsys.readouterr().out
    assert few == sorted(map(repr, many.collect())) and few
