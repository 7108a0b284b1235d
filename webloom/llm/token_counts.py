"""Token counts of greedy word pieces, in time linear in the text.

The vocabulary is a trie. A node from which the next character does not go on has a failure link to
the node that is reached once the longest pieces are taken off, and the number of pieces taken off is
stored with the link. A word is read once, character by character, and no piece is ever built.
"""

from __future__ import annotations

import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import picked

#: Words: runs of letters, digits and underscores; any other visible character by itself.
WORDS = re.compile(r"\w+|[^\w\s]")
START = "▁"
_CACHED = 200_000


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that start a word, and pieces that go on in one, of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    initial = [p[len(START) :] for p in pieces if p.startswith(START)]
    return [p for p in initial if p and START not in p], [p for p in pieces if START not in p]


class Automaton:
    """Trie of the pieces with failure links; node 0 starts a word, node 1 goes on in one."""

    def __init__(self, initial: list[str], following: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = set()
        for root, pieces in ((0, initial), (1, following)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                    node = self.next[node][c]
                ends.add(node)
        self.fail: list[int | None] = [None] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if node in ends:
                    self.fail[node], self.popped[node] = 1, 1
                    continue
                at, count = self.fail[parent], self.popped[parent]
                while at is not None and c not in self.next[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if at is not None:
                    self.fail[node], self.popped[node] = self.next[at][c], count

    def count(self, word: str) -> int:
        """Pieces of a word by greedy longest match; -1 if they cannot make up the word."""
        node, n = 0, 0
        for c in word:
            while c not in self.next[node]:
                if self.fail[node] is None:
                    return -1
                n += self.popped[node]
                node = self.fail[node]
            node = self.next[node][c]
        while node > 1:
            if self.fail[node] is None:
                return -1
            n += self.popped[node]
            node = self.fail[node]
        return n


class Counts:
    """Counts of whole texts; remembers a bounded number of words."""

    def __init__(self, initial: list[str], following: list[str]):
        self.automaton = Automaton(initial, following)
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, unknown words); a word that pieces cannot make up is one token."""
        n_words = n_tokens = n_unknown = 0
        for word, times in Counter(WORDS.findall(text or "")).items():
            pieces = self.known.get(word)
            if pieces is None:
                if len(self.known) >= _CACHED:
                    self.known.clear()
                pieces = self.automaton.count(word)
                if len(word) < 64:
                    self.known[word] = pieces
            n_words += times
            n_tokens += times * abs(pieces)
            n_unknown += times * (pieces < 0)
        return n_words, n_tokens, n_unknown


FIELDS = ["n_words", "n_tokens", "n_unknown"]
_BUILT: dict[int, Counts] = {}


def _built(shared) -> Counts:
    """The counter of a broadcast vocabulary, built once per Python worker."""
    if shared.value[0] not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.value[0]] = Counts(*shared.value[1:])
    return _BUILT[shared.value[0]]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_words, n_tokens, n_unknown).

    ``path`` is a SentencePiece model file that only the driver reads; the vocabulary, whose size does
    not depend on the data, is broadcast. A null or empty text has no tokens. Repeated rows and null
    ids each get a row. An empty table gives no rows. Nothing is shuffled.
    """
    spark: SparkSession = docs.sparkSession
    initial, following = vocabulary(path)
    shared = spark.sparkContext.broadcast((hash((tuple(initial), tuple(following))), initial, following))

    @F.arrow_udf(", ".join(f"{name} BIGINT" for name in FIELDS))
    def counts(texts: pa.Array) -> pa.Array:
        counter = _built(shared)
        rows = [counter(text.as_py()) for text in texts]
        columns = [pa.array(values, pa.int64()) for values in zip(*rows)] or [pa.array([], pa.int64())] * len(FIELDS)
        return pa.StructArray.from_arrays(columns, FIELDS)

    rows = picked(docs, doc_id=id_col, text=text_col).select("doc_id", counts("text").alias("c"))
    return rows.select("doc_id", "c.*")
