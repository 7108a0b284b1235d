"""robots.txt: rules, visit permission and crawl delay.

Takes robots files as a table (host, content, fetch_failed). The rules of the standard-library
parser hold: a blank line ends a group, the first group that names the agent counts and else the
first ``*`` group, and in it the first rule whose path is a prefix of the URL's path decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as tx
from webloom.functions import urls
from webloom.plans.skew import skew_join

DEFAULT_CRAWL_DELAY = 1.0

# Tasks that the URLs of one host are shared by, at least; its rules are repeated for each.
_SLICES = 16

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

# The keys that matter and the part they play.
_KINDS = {
    "user-agent": "agent",
    "allow": "allow",
    "disallow": "disallow",
    "crawl-delay": "delay",
    "request-rate": "rate",
}


def unquote(text: Column) -> Column:
    """Percent-decoded text; a ``%`` without two hex digits stays."""
    safe = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(text.contains("%"), F.url_decode(safe)).otherwise(text)


def one_file_per_host(robots: DataFrame) -> DataFrame:
    """One row per host: the file that could be fetched, of several the first by content."""
    failed = F.coalesce("fetch_failed", F.lit(False))
    best = F.min(F.struct(failed.alias("fetch_failed"), F.col("content").isNull().alias("missing"), "content"))
    return robots.groupBy("host").agg(best.alias("file")).select("host", "file.content", "file.fetch_failed")


def robots_groups(robots: DataFrame) -> DataFrame:
    """Lines that belong to a group: (host, section, pos, kind, value, agents).

    A section opens at a user-agent line that does not follow another one, and at every blank
    line; one without an agent is no group. All windows share one shuffle by host, and a host has
    as many rows as its own file has lines.
    """
    lines = robots.select("host", F.posexplode(F.split("content", _LINE_END)).alias("pos", "line"))
    bare = tx.strip(F.regexp_replace("line", r"(?s)#.*\z", ""))
    key = F.lower(tx.strip(F.substring_index("bare", ":", 1)))
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    events = lines.withColumn("bare", bare).select(
        "host",
        "pos",
        F.when(F.col("line") == "", "blank")
        .when(F.col("bare").contains(":"), F.try_element_at(kinds, key))
        .alias("kind"),
        unquote(tx.strip(F.regexp_replace("bare", r"(?s)^[^:]*:", ""))).alias("value"),
    ).filter("kind IS NOT NULL")

    in_order = Window.partitionBy("host").orderBy("pos")
    in_section = Window.partitionBy("host", "section").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    is_agent = F.col("kind") == "agent"
    opens = is_agent & (F.coalesce(F.lag("kind").over(in_order), F.lit("")) != "agent")
    return (
        events.withColumn("opens", (opens | (F.col("kind") == "blank")).cast("int"))
        .withColumn("section", F.sum("opens").over(in_order))
        .withColumn("agents", F.collect_list(F.when(is_agent, F.col("value"))).over(in_section))
        .filter((F.size("agents") > 0) & F.col("kind").isin("allow", "disallow", "delay", "rate"))
        .drop("opens")
    )


def _is_rule() -> Column:
    return F.col("kind").isin("allow", "disallow")


def _allow() -> Column:
    return (F.col("kind") == "allow") | (F.col("value") == "")


def _path() -> Column:
    return F.regexp_replace("value", r"\?\z", "")


def _delay() -> Column:
    return F.when((F.col("kind") == "delay") & F.col("value").rlike(r"^\d+\z"), F.col("value").try_cast("double"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """Rules in file order with their group: (host, section, pos, agents, allow, path, crawl_delay)."""
    last_delay = Window.partitionBy("host", "section").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    lines = robots_groups(one_file_per_host(robots)).withColumn(
        "crawl_delay", F.last(_delay(), ignorenulls=True).over(last_delay)
    )
    return lines.filter(_is_rule()).select(
        "host", "section", "pos", "agents", _allow().alias("allow"), _path().alias("path"), "crawl_delay"
    )


def robots_policy(robots: DataFrame, agent: str) -> DataFrame:
    """What one agent has to follow: (host, fetch_failed, rules, crawl_delay), one row per host."""
    robots = one_file_per_host(robots)
    name = F.lit(agent.split("/")[0].lower())
    named = F.exists("agents", lambda a: name.contains(F.lower(a)))
    is_default = F.array_contains("agents", "*")
    choice = F.when(is_default | named, F.struct(is_default.alias("is_default"), "section"))
    lines = robots_groups(robots).withColumn("chosen", F.min(choice).over(Window.partitionBy("host")))
    followed = lines.filter(F.col("section") == F.col("chosen.section")).groupBy("host").agg(
        F.array_sort(F.collect_list(F.when(_is_rule(), F.struct("pos", _allow().alias("allow"), _path().alias("path"))))).alias("rules"),
        F.max_by(_delay(), F.when(_delay().isNotNull(), F.col("pos"))).alias("crawl_delay"),
    )
    return robots.select("host", F.coalesce("fetch_failed", F.lit(False)).alias("fetch_failed")).join(
        followed, "host", "left"
    )


def _tested_path(parts: Column) -> Column:
    """Path, params, query and fragment of a URL, as rules are tested against."""

    def optional(mark: str, part: str) -> Column:
        return F.when(parts[part] != "", F.concat(F.lit(mark), parts[part])).otherwise("")

    whole = F.concat(parts["path"], optional(";", "params"), optional("?", "query"), optional("#", "fragment"))
    return F.when(whole == "", "/").otherwise(whole)


def robots_allow(links: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """URLs with the visit permission and the crawl delay of their host: (..., visit, crawl_delay).

    A host may own any share of the URLs. Its rules arrive as one row, so they are tested inside
    the row of each URL instead of pairing every URL with every rule. A host without robots file
    allows everything with the default delay; after a failed fetch nothing is visited.
    """
    asked = links.withColumn("host", urls.netloc(F.col("url")))
    joined = skew_join(asked, robots_policy(robots, agent), "host", ["url"], how="left", slices=_SLICES)
    parsed = joined.withColumn("parts", urls.url_parts(unquote(F.col("url"))))
    tested = parsed.withColumn("tested", _tested_path(F.col("parts")))
    matching = F.filter("rules", lambda rule: F.col("tested").startswith(rule["path"]))
    failed = F.coalesce("fetch_failed", F.lit(False))
    return tested.select(
        *links.columns,
        (~failed & F.coalesce(F.get(matching, F.lit(0))["allow"], F.lit(True))).alias("visit"),
        F.when(failed, 0.0)
        .otherwise(F.coalesce(F.nullif(F.col("crawl_delay"), F.lit(0.0)), F.lit(DEFAULT_CRAWL_DELAY)))
        .alias("crawl_delay"),
    )
