"""License scans: texts that are a known licence, up to spelling. DataFrame operations only.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent spellings) and
its digest is looked up among the digests of the known licences by a hash join.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import picked, stored

# Equivalent spellings, as patterns on canonical text, each with the form that stands for them and
# with plain strings of which a text that the pattern finds has one.
_SPELLINGS = [
    (r"(^| )licenc", "$1licens", ["licenc"]),
    (r"(^| )sub licens", "$1sublicens", ["sub licens"]),
    (r"(^| )non commercial", "$1noncommercial", ["non commercial"]),
    (r"(^| )(acknowledg|judg)ement", "$1$2ment", ["gement"]),
    (
        r"(^| )(author|organ|initial|recogn|util|custom)is(e|ed|es|ing|ation|ations)( |$)",
        "$1$2iz$3$4",
        ["authoris", "organis", "initialis", "recognis", "utilis", "customis"],
    ),
    (r"(^| )(behavi|fav|hon)our", "$1$2or", ["behaviour", "favour", "honour"]),
    (r"(^| )(analog|catalog)ue", "$1$2", ["alogue"]),
    (r"(^| )artefact", "$1artifact", ["artefact"]),
    (r"(^| )copyright owner", "$1copyright holder", ["copyright owner"]),
    (r"(^| )whilst( |$)", "$1while$2", ["whilst"]),
]
SPELLINGS = [(spelling, form) for spelling, form, _ in _SPELLINGS]


def _known() -> list[tuple[str, str]]:
    """(license_id, text) of the packaged file: notices, then texts, each after its forms with a title."""
    data = json.loads(resources.files("webloom.llm").joinpath("data", "licenses.json").read_text("utf-8"))
    out = [(f"{i}-notice", f"SPDX-License-Identifier: {i}") for i in data["spdx_ids"]]
    for notice in data["notices"]:
        for name in notice["names"]:
            articles = ("", "the ", "a ") if "Creative" in name else ("", "the ")
            starts = [s + (v[0].lower() + v[1:] if s else v) for s in data["subjects"] for v in data["verbs"]]
            out += [(notice["license_id"], f"{start}{article}{name}.") for start in starts for article in articles]
    for entry in data["texts"]:
        out += [(entry["license_id"], f"{title}\n\n{entry['text']}") for title in entry["titles"]]
        out.append((entry["license_id"], entry["text"]))
    return out


#: Texts and notices that are known by name, with titles where licence files usually have one.
KNOWN = _known()


def known_licenses(spark: SparkSession) -> DataFrame:
    """The packaged table of known texts: (license_id, license_text). Pass any other one for more."""
    return spark.createDataFrame(KNOWN, "license_id STRING, license_text STRING")


# Words after "copyright" that go on with a sentence of a licence and name no holder, and words after a
# "(c)" that counts clauses.
_GOES_ON = (
    "holders? owners? ownership notices? licen[cs]es? licensed laws? permissions? rights? claims? statements? lines? interests? protection "
    "protected infringements? status works? acts? terms? treaty treaties disclaimers? doctrines? patents? trademarks? resulting and or nor in on "
    "to is as for of are may shall will must can if also like those that this which with from under each more then than including "
    "information the_(?:software|library|program|work|document|licensed|original|covered|above|following)"
).replace("_", r"[^a-z0-9\n]+").split()
_CLAUSE = (
    "you your the all any an a it its if to in on of for under or and no not each every such this that these those where when which with without "
    "may must shall will representations licensor licensee recipient contributor contributions? redistributions? conveying distribute modify use "
    "make include give provide keep offer cause"
).split()
# No lookahead, as DuckDB has none: a line that goes on with a sentence is matched whole as the group, so that it stays.
_SENTENCE = (
    r"[^a-z0-9\n]*(?:copyright(?:[a-z][^\n]*|[^a-z0-9(©\n]*|[,;.)/\"'][^a-z0-9(©\n]*[a-z][^\n]*|[^a-z0-9(©\n]+(?:"
    + "|".join(_GOES_ON)
    + r")(?:[^a-z0-9\n][^\n]*)?)|\(c\)(?:[^a-z0-9\n]*|[^a-z0-9\n]+(?:"
    + "|".join(_CLAUSE)
    + r")(?:[^a-z0-9\n][^\n]*)?))(?m:$)"
)
#: A line that is a copyright statement (a mark or the word, with a year, a mark or a holder) or a reservation of rights,
#: after comment marks if any. Lines of a licence that merely begin with the word or with a clause "(c)" are none.
COPYRIGHT_LINE = rf"((?:^|\n){_SENTENCE}|^|\n)(?:[^a-z0-9\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*|(?m:$))"
NO_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


_MARKS = ("copyright", "(c)", "©", "all rights reserved")


def _has_any(text: Column, parts: Iterable[str]) -> Column:
    """Whether a text has one of some plain strings; a quick test before a pattern that needs one."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def _lower(text: Column) -> Column:
    """A-Z in lower case, nothing else; null is empty. ASCII texts have a quicker function for that."""
    text = F.coalesce(text, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def _words(line: Column) -> Column:
    """A line in lower case, without copyright statements, and with one space for all else than letters and digits.

    Statements are lines, and no run of other characters is more than a space. So the words of a text are
    those of its lines, one after the other.
    """
    bare = F.when(_has_any(line, _MARKS), F.regexp_replace(line, COPYRIGHT_LINE, "$1")).otherwise(line)
    return F.trim(F.regexp_replace(bare, NO_WORD, " "))


def _whole(lines: str, forms: str) -> Column:
    """Words of a whole text by those of its lines. A text that starts with a line break keeps its second line as it is:
    the pattern's first match in it is the empty first line, which takes the break."""
    second = F.trim(F.regexp_replace(F.get(lines, F.lit(1)), NO_WORD, " "))
    broken = (F.size(lines) > 1) & (F.get(lines, F.lit(0)) == "")
    own = F.when(broken, F.concat(F.array(second), F.slice(forms, F.lit(3), F.size(forms)))).otherwise(F.col(forms))
    return F.array_join(F.filter(own, lambda form: form != ""), " ")


def _respelled(units: DataFrame, name: str) -> DataFrame:
    """One form for equivalent spellings. Patterns are tried on the texts that can have them; each is a step of its own."""
    for spelling, form, parts in _SPELLINGS:
        words = F.col(name)
        units = units.withColumn(name, F.when(_has_any(words, parts), F.regexp_replace(words, spelling, form)).otherwise(words))
    return units


def canonical(text: Column) -> Column:
    """Canonical form: lower case, no copyright lines, one space for all else than letters and digits, one spelling.

    Only ASCII letters change case. Null counts as empty. ``scan`` makes the same form line by line.
    """
    words = _words(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for spelling, form in SPELLINGS:
        words = F.regexp_replace(words, spelling, form)
    return words


def digests(known: DataFrame) -> DataFrame:
    """Canonical digests of known texts: (digest, code, license_id); the smallest id stands for equal texts.

    Codes number the ids in their order.
    """
    text = canonical(F.col("license_text"))
    rows = known.select("license_id", text.alias("text")).filter("text <> '' AND license_id IS NOT NULL")
    ids = rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    codes = ids.select("license_id").distinct().orderBy("license_id").withColumn("code", F.monotonically_increasing_id())
    return ids.join(codes, "license_id")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, canonical_chars, license_id, n_notices, notice_id).

    ``license_id`` names the known text that the whole document is, ``notice_id`` the first by name of
    the known texts that a line of it is, and ``n_notices`` counts such lines; both ids are null where
    nothing matches. A null text counts as empty; empty texts and lines match nothing. Repeated rows
    and null ids each get a row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table = stored(digests(known_licenses(spark) if known is None else known), "license_digests")
    lookup = table.select("digest", "code")
    if known is None:  # of fixed size, so lines need no shuffle
        lookup = F.broadcast(lookup)
    rows = picked(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    lines = rows.select("row", "doc_id", F.split(_lower(F.col("text")), "\n").alias("lines")).withColumn("forms", F.transform("lines", _words))
    units = lines.select("row", "doc_id", F.posexplode(F.concat(F.array(_whole("lines", "forms")), F.filter("forms", lambda form: form != ""))).alias("at", "unit"))
    found = _respelled(units, "unit").withColumn("digest", F.sha2("unit", 256)).join(lookup, "digest", "left")
    whole = F.col("at") == 0
    per_row = found.groupBy("row", "doc_id").agg(
        F.max(F.when(whole, F.char_length("unit"))).cast("long").alias("canonical_chars"),
        F.min(F.when(whole, F.col("code"))).alias("whole_code"),
        F.count(F.when(~whole, F.col("code"))).alias("n_notices"),
        F.min(F.when(~whole, F.col("code"))).alias("line_code"),
    )
    names = table.select("code", "license_id").distinct()
    whole_names = names.select(F.col("code").alias("whole_code"), "license_id")
    line_names = names.select(F.col("code").alias("line_code"), F.col("license_id").alias("notice_id"))
    named = per_row.join(whole_names, "whole_code", "left").join(line_names, "line_code", "left")
    return named.select("doc_id", "canonical_chars", "license_id", "n_notices", "notice_id")
