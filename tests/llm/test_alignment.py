"""Cross-tokenizer alignment against tokens taken one by one."""

import hashlib
import pathlib
from collections import Counter

import pytest
import sentencepiece
import tokenizers
from test_llm_rows import frame, vocabulary

from webloom.llm import alignment, catalog


def texts():
    words = vocabulary(8, 300)
    out = [" ".join(words[(7 * i + k * k) % 300] for k in range(5 + i)) for i in range(40)]
    out += ["Plain English words, with punctuation; and numbers 12345 and it's all right.\n\nNew  paragraph\ttab "]
    out += ["<|endoftext|> is text, so are <s> and </s> <unk> <0x41>", "日本語 のテキスト 😀 é", " leading", "trailing ", "  ", " ", "\n", "a"]
    out += ["mark ▁ here", "nul \x00 x", "  two  spaces  ", "\x85\xa0x  y"]
    return [*out, None, "", out[3], out[3]]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(pathlib.Path(catalog.BYTE_MODEL).read_text("utf-8"), pathlib.Path(catalog.MODEL).read_bytes())


def byte_tokens(pair, text):
    """(id, bytes) of both sides, by the libraries' own calls; nothing if a side does not give the text back."""
    if not text:
        return [], []
    a = tokenizers.Tokenizer.from_file(catalog.BYTE_MODEL) if not hasattr(byte_tokens, "a") else byte_tokens.a
    b = sentencepiece.SentencePieceProcessor(model_file=catalog.MODEL) if not hasattr(byte_tokens, "b") else byte_tokens.b
    a.encode_special_tokens = True
    byte_tokens.a, byte_tokens.b = a, b
    sides = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    tables = [x.to_pylist() for x in pair.bytes_of]
    sides = [[(i, table[i]) for i in ids] for ids, table in zip(sides, tables)]
    return sides if all(b"".join(x for _, x in side) == (" " + text).encode() for side in sides) else ([], [])


def ends(side):
    out, at = [], 0
    for i, piece in side:
        at += len(piece)
        out.append((at, i))
    return out


def brute(pair, given):
    rows = []
    for text in given:
        a, b = (ends(side) for side in byte_tokens(pair, text))
        common = sorted({e for e, _ in a} & {e for e, _ in b})
        links = [(i, j) for e, i in a for f, j in b if e == f]
        groups, low = [], 0
        for cut in common:
            groups.append("|".join(",".join(str(i) for e, i in side if low < e <= cut) for side in (a, b)))
            low = cut
        rows.append((len(a), len(b), len(common), ";".join(groups), links))
    counts = Counter(link for row in rows for link in row[4])
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(n, highest.get(j, 0))
    return [
        (n_a, n_b, n_groups, groups, len(links), sum(counts[link] == highest[link[1]] for link in links), sum(counts[link] for link in links))
        for n_a, n_b, n_groups, groups, links in rows
    ]


def test_alignment(spark, pair):
    given = texts()
    docs = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(given)])
    links = alignment.aligned(docs, catalog.BYTE_MODEL, catalog.MODEL)
    got = {r.doc_id: r for r in alignment.counted(links, alignment.pair_counts(links)).collect()}
    want = brute(pair, given)
    assert len(got) == len(given) and any(row[0] for row in want) and want[-2][0] > 0
    for i, row in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.groups, r.n_links, r.n_best, r.count_sum) == row
    marked = given.index("mark ▁ here")
    assert want[marked][:4] == (0, 0, 0, "")  # the piece for a space is no space


def test_query(spark, pair, tmp_path):
    given = texts()
    frame(spark, [(i, t, None, None, 0) for i, t in enumerate(given)], extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.asDict() for r in catalog.token_alignment(spark, str(tmp_path)).collect()}
    for i, row in enumerate(brute(pair, given)):
        digest = hashlib.sha256(row[3].encode()).hexdigest() if row[3] else ""
        names = ("n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum")
        assert tuple(got[i][name] for name in names) == (*row[:3], digest, *row[4:])


def test_long_texts_are_tokenized_in_parts(pair, monkeypatch):
    given = [t for t in texts() if t and "▁" not in t]
    text = " ".join(given) + "  x \n y\n z"
    whole = pair.encode([text, "", text])
    monkeypatch.setattr(alignment, "_CHUNK", 13)
    assert len(list(alignment._parts(text))) > 50
    assert [x.to_pylist() for x in pair.encode([text, "", text])] == [x.to_pylist() for x in whole]


def test_pairs_are_bounded_by_the_vocabularies(pair):
    bound = pair.pair_bound()
    a, b = (len(x) for x in pair.bytes_of)
    assert a + b < bound < 1_500_000


def test_repeats_nulls_and_empty_tables(spark):
    docs = frame(spark, [(5, "same text", None, None, 0)] * 3 + [(None, "same text", None, None, 0), (6, None, None, None, 0)])
    links = alignment.aligned(docs, catalog.BYTE_MODEL, catalog.MODEL, digest=True)
    got = sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in alignment.counted(links, alignment.pair_counts(links)).collect())
    assert [g[0] for g in got] == [0, 5, 5, 5, 6] and got[0][1:] == got[1][1:] and got[0][2] == 4 * got[0][1] and got[-1] == (6, 0, 0)
    nothing = alignment.aligned(docs.limit(0), catalog.BYTE_MODEL, catalog.MODEL)
    assert alignment.counted(nothing, alignment.pair_counts(nothing)).collect() == []
