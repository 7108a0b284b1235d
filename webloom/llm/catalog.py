"""Queries over the test tables: one of each operator, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import (
    alignment,
    context_mixing,
    exact_dedup,
    language,
    licenses,
    mixing,
    near_dedup,
    phrases,
    pieces,
    quality,
    sharding,
    substrings,
    token_counts,
)
from webloom.llm.common import stored

#: SentencePiece model file; the driver reads it.
MODEL = os.environ.get("WEBLOOM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Byte-level vocabulary with its merges, in JSON; the driver reads it.
BYTE_MODEL = os.environ.get("WEBLOOM_BYTE_MODEL", "/opt/tokenizers/byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(documents(spark, sf_dir))


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(content) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY content ORDER BY length(text) DESC, doc_id)
"""


def host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.verdicts(documents(spark, sf_dir))
    return out.select("doc_id", *quality.MEASURES, "base_failed", "kept")


HOST_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, line, count(*) - 1 AS again
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dups AS (SELECT doc_id, sum(again) AS n FROM lines GROUP BY doc_id),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, source, len(w) AS n_words,
         length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count_if(base_failed) AS failed FROM judged WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT avg(failed / n) AS mean, var_pop(failed / n) AS variance FROM hosts),
prior AS (
  SELECT mean, CASE WHEN variance > 0 THEN least(greatest(mean * (1 - mean) / variance - 1, 1.0), 1e6) ELSE 1e6 END AS strength
  FROM moments),
verdicts AS (SELECT source, (failed + mean * strength) / (n + strength) > 0.8 AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM judged LEFT JOIN verdicts USING (source)
"""


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language.identify(docs, ~F.coalesce(held_out(), F.lit(True)))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


#: Shards before; a source is in one of them, so their sizes differ.
OLD_SHARDS = 6


def reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    out = sharding.reshard(docs, old)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes_of(documents(spark, sf_dir), n=4, percent=80)


NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) < 4 THEN [1] ELSE range(1, len(w) - 2) END) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
SELECT a AS doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(b) AS component_id, a = min(b) AS kept
FROM reached LEFT JOIN sizes ON a = doc_id GROUP BY a
"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), MODEL)


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sources),
ordered AS (
  SELECT *, sum(2 * source_size) OVER w - 2 * source_size AS full_before, sum(weight) OVER w - weight AS weight_before,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM weighed WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
units AS (SELECT *, (1.5::DOUBLE * total - full_before) / (weights - weight_before) AS unit FROM ordered),
level AS (SELECT min_by(unit, full_before) AS unit FROM units WHERE weight * unit <= 2 * source_size),
targets AS (
  SELECT source, source_size,
         CASE WHEN level.unit IS NULL OR weight * level.unit > 2 * source_size THEN 2.0::DOUBLE * source_size ELSE weight * level.unit END AS target
  FROM units, level),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM targets),
summed AS (
  SELECT source, hash, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS upto
  FROM d WHERE size > 0 GROUP BY source, hash),
once_more AS (
  SELECT s.source, s.hash FROM summed s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
  WHERE p.target - p.times * p.source_size > 0
    AND (s.upto <= p.target - p.times * p.source_size
         OR (s.upto - s.words < p.target - p.times * p.source_size
             AND 2 * (p.target - p.times * p.source_size - (s.upto - s.words)) >= s.words)))
SELECT d.doc_id, d.size, p.source_size, p.target, (d.size * (p.times + (o.hash IS NOT NULL)::BIGINT))::BIGINT AS taken
FROM d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN once_more o ON d.source IS NOT DISTINCT FROM o.source AND d.hash = o.hash AND d.size > 0
"""


def merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(documents(spark, sf_dir), MODEL)


def repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_removed(documents(spark, sf_dir))


SPANS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, hash(array_to_string(w[i : i + 19], ' ')) AS h, md5(array_to_string(w[i : i + 19], ' ')) AS m
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY h, m ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, (SELECT unnest(range(0, 20)) AS o)),
words AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({out}, {_quoted(licenses.COPYRIGHT_LINE)}, '\\1', 'g')"
    out = f"trim(regexp_replace({out}, {_quoted(licenses.NO_WORD)}, ' ', 'g'))"
    for spelling, form in licenses.SPELLINGS:
        form = form.replace("$", "\\")
        out = f"regexp_replace({out}, {_quoted(spelling)}, {_quoted(form)}, 'g')"
    return out


LICENSE_SQL = f"""
WITH known AS (
  SELECT {_canonical_sql("t")} AS text, min(license_id) AS license_id
  FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in licenses.KNOWN)}) AS v(license_id, t) GROUP BY 1),
lines AS (SELECT doc_id, {_canonical_sql("line")} AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
notices AS (SELECT doc_id, count(*) AS n, min(license_id) AS id FROM lines JOIN known USING (text) GROUP BY doc_id),
whole AS (SELECT doc_id, {_canonical_sql("text")} AS text FROM documents)
SELECT doc_id, length(whole.text)::BIGINT AS canonical_chars, license_id, coalesce(n, 0) AS n_notices, id AS notice_id
FROM whole LEFT JOIN known USING (text) LEFT JOIN notices USING (doc_id)
"""


def remainder(doc_id: str, divisor: int):
    """crc32 of an id as text, modulo a divisor; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = context_mixing.scores(documents(spark, sf_dir), remainder("doc_id", 7) != 2)
    return out.withColumn("held_out", ~F.col("learned")).drop("learned")


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = stored(alignment.aligned(documents(spark, sf_dir), BYTE_MODEL, MODEL, digest=True), "token_links")
    out = alignment.counted(links, alignment.pair_counts(links))
    return out.withColumnRenamed("groups", "groups_sha256")


def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


PHRASES_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d)),
f1 AS (SELECT lang, w AS phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS w FROM p) GROUP BY ALL),
f2 AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w1 || ' ' || w2 AS phrase, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM p) GROUP BY ALL),
f3 AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM p) GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, f2.phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r, 2 AS size
  FROM f2 JOIN f1 x USING (lang) JOIN f1 y USING (lang) WHERE f2.f >= 10 AND x.phrase = w1 AND y.phrase = w2
  UNION ALL
  SELECT lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, f3.f, 1, x.f, y.f, 3
  FROM f3 JOIN f1 x USING (lang) JOIN f2 y USING (lang) WHERE x.phrase = f3.w1 AND y.phrase = f3.w2 || ' ' || w3
  UNION ALL
  SELECT lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, f3.f, 2, x.f, y.f, 3
  FROM f3 JOIN f2 x USING (lang) JOIN f1 y USING (lang) WHERE x.phrase = f3.w1 || ' ' || f3.w2 AND y.phrase = w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner2 AS (
  SELECT lang, phrase, max(f) AS longer
  FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inner2 i ON best.size = 2 AND best.lang = i.lang AND best.phrase = i.phrase
  WHERE NOT coalesce(100 * longer >= 50 * a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES = {
    "op1_exact_dedup": (exact, EXACT_SQL),
    "op2_host_rules": (host_rules, HOST_SQL),
    "op3_language_id": (languages, None),
    "op4_flow_sharding": (reshard, None),
    "op5_minhash_dedup": (near, NEAR_SQL),
    "op6_token_counts": (tokens, None),
    "op7_threshold_mix": (mix, MIX_SQL),
    "op8_merge_dropout": (merge_dropout, None),
    "op9_repeated_spans": (repeated_spans, SPANS_SQL),
    "op10_license_digests": (license_digests, LICENSE_SQL),
    "op11_context_mixing": (language_model, None),
    "op12_token_alignment": (token_alignment, None),
    "op13_phrases": (collocations, PHRASES_SQL),
}
