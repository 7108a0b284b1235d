"""Quality rules per document and per host.

Every document gets base measures from its whole text. A host's failure rate is shrunk towards the
rate of all hosts with a beta prior that is fitted to the hosts themselves, so that a host with few
documents is not condemned by chance. The host's verdict goes back to its documents.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import SPACE_CHARS, column, free_name, picked, stored
from webloom.llm.shingles import runs, word_hashes
from webloom.plans.skew import HotKeys, skew_join

SYMBOLS = "#*$%&|<>"
#: Longer texts (characters) are compared by hashes of windows, in arrays.
_LONG = 1 << 20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.8
#: Documents that the prior counts for, at least and at most.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1e6

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """Measures of one text in the order of ``MEASURES``; all 0 without text.

    A repeated window is three consecutive words that the text has twice or more; the words that any
    repeated window covers count once each.
    """
    if not text:
        return 0, 0, 0, 0, 0
    word_chars = len(text) - sum(map(text.count, SPACE_CHARS))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen, n_dup_lines = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n_dup_lines += 1
        elif line.strip(SPACE_CHARS):
            seen.add(line)
    if len(text) > _LONG:
        n_words, covered = _repeats_of_long(text)
        return n_words, word_chars, n_symbols, n_dup_lines, covered
    words = text.encode().split()  # bytes split at the same six characters as SPACE
    windows = list(zip(words, words[1:], words[2:]))
    counts, covered, free = Counter(windows), 0, 0
    if len(counts) < len(windows):
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered += i + 3 - max(i, free)
                free = i + 3
    return len(words), word_chars, n_symbols, n_dup_lines, covered


def _repeats_of_long(text: str) -> tuple[int, int]:
    """Words of a long text, and those that repeated windows cover, by 64-bit hashes of windows."""
    hashes = word_hashes(text.encode())
    windows = runs(hashes, 3)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, np.flatnonzero(again), 1)
    np.add.at(change, np.flatnonzero(again) + 3, -1)
    return len(hashes), int((np.cumsum(change[:-1]) > 0).sum())


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def _measure(texts: pa.Array) -> pa.Array:
    rows = [base_measures(text.as_py()) for text in texts]
    columns = [pa.array(values, pa.int64()) for values in zip(*rows)] or [pa.array([], pa.int64())] * len(MEASURES)
    return pa.StructArray.from_arrays(columns, MEASURES)


def _failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One stored row per host: (host, n, failed, rate, rejected), from (host, base_failed).

    The prior's mean and strength are those of a beta distribution with the mean and the variance of
    the hosts' own rates. If all rates are equal the shrunk rate is that mean.
    """
    hosts = measured.filter(F.col("host").isNotNull()).groupBy("host")
    hosts = stored(hosts.agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed")), "host_failures")
    own = F.col("failed") / F.col("n")
    mean, variance = hosts.agg(F.avg(own), F.var_pop(own)).first()
    if mean is None:
        mean, variance = 0.0, 0.0
    strength = min(max(mean * (1 - mean) / variance - 1, LEAST_PRIOR), MOST_PRIOR) if variance > 0 else MOST_PRIOR
    rate = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    return stored(hosts.select("*", rate.alias("rate"), (rate > max_rate).alias("rejected")), "host_verdicts")


def verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """One row per document: (doc_id, host, the measures, base_failed, host_rate, kept).

    A null or empty text has no words and fails. A document without a host is judged by itself alone.
    Repeated rows each get their row and count in their host's rate. An empty table gives no rows.
    """
    rows = picked(docs, doc_id=id_col, host=host_col, text=text_col)
    measured = rows.select("doc_id", "host", _measure("text").alias("m"))
    measured = stored(measured.select("doc_id", "host", "m.*", _failed(F.col("m")).alias("base_failed")), "measured")
    hosts = host_verdicts(measured, max_rate)
    hot = HotKeys(hosts, "host", "n")
    judged = skew_join(measured, hosts.select("host", "rate", "rejected"), "host", ["doc_id", "word_chars"], hot, "left")
    kept = ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))
    return judged.select("doc_id", "host", *MEASURES, "base_failed", F.col("rate").alias("host_rate"), kept.alias("kept"))


def keep_good(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """The documents that pass, with all their columns; the same verdicts as ``verdicts``.

    Texts are measured once: the documents are stored with what the rules say of them. Only rejected hosts
    are joined to them.
    """
    flag = free_name(docs, "__failed")
    judged = stored(docs.withColumn(flag, _failed(_measure(column(text_col)))), "judged_documents")
    hosts = host_verdicts(judged.select(column(host_col).alias("host"), column(flag).alias("base_failed")), max_rate)
    rejected = stored(hosts.filter("rejected").select("host", "n"), "rejected_hosts")
    good = judged.filter(~column(flag)).drop(flag)
    if rejected.isEmpty():
        return good
    key = free_name(docs, "__host")
    keyed = good.withColumn(key, column(host_col))
    others = rejected.withColumnRenamed("host", key)
    return skew_join(keyed, others, key, [key, text_col], HotKeys(others, key, "n"), "left_anti").drop(key)
