"""Permissions, robots rules and the frontier, on inputs derived from the raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import common as c
from catalog.links_pages import SQL_HREFS
from webloom.functions import permissions as pm
from webloom.functions import urls
from webloom.operators import frontier as fr
from webloom.operators import links as ln
from webloom.operators import pages as pg
from webloom.operators import robots as rb
from webloom.plans.lineage import materialize, scratch_path
from webloom.sources import snapshots, tables

AS_OF = "2024-01-01 12:00:06"


def _as_of():
    return F.to_timestamp(F.lit(AS_OF))


def _lang_case(en, fr_, de, other):
    url = F.col("url")
    return (
        F.when(url.contains("/en/"), F.lit(en))
        .when(url.contains("/fr/"), F.lit(fr_))
        .when(url.contains("/de/"), F.lit(de))
        .otherwise(F.lit(other))
    )


def fetch_log(spark, sf_dir):
    """Pages as fetched: robots meta tags by language, headers and content type by host."""
    meta = F.concat(F.lit('<head><meta name="robots" content="'), _lang_case("noindex", "nofollow", "none", "all"), F.lit('">'))
    http = F.col("url").startswith("http:")
    date = F.when(http, "unavailable_after: Wed, 01 Jan 2020 00:00:00 GMT").otherwise(
        "noarchive,unavailable_after: 2030-01-01T00:00:00Z"
    )
    org = F.col("url").contains(".example.org/")
    return c.pages(spark, sf_dir).select(
        "page_id",
        "url",
        F.when(org, "application/pdf").when(http, "text/plain").otherwise("text/html; charset=utf-8").alias("content_type"),
        F.when(F.col("url").contains("?"), F.create_map(F.lit("X-Robots-Tag"), date))
        .otherwise(F.create_map(F.lit("x-robots-tag"), F.lit("none")))
        .alias("headers"),
        F.replace("html", F.lit("<head>"), meta).alias("html"),
    )


def _content_type_gate(spark, sf_dir):
    return fetch_log(spark, sf_dir).filter(pm.is_page_content(F.col("content_type"))).select("page_id", "url")


def _with_meta(spark, sf_dir):
    return pg.with_fields(fetch_log(spark, sf_dir), "meta_robots")


def _meta_robots(spark, sf_dir):
    return _with_meta(spark, sf_dir).select("page_id", pm.meta_directives(F.col("fields.meta_robots")).alias("directives"))


def _x_robots_tag(spark, sf_dir):
    return fetch_log(spark, sf_dir).select("page_id", pm.x_robots_tag(F.col("headers")).alias("directives"))


def _unavailable_after(spark, sf_dir):
    given = F.coalesce(pm.x_robots_tag(F.col("headers")), F.lit(""))
    return fetch_log(spark, sf_dir).select("page_id", pm.expired(given, _as_of()).alias("expired"))


def _page_permissions(spark, sf_dir):
    allowed = pm.page_permissions(F.col("headers"), F.col("fields.meta_robots"), _as_of())
    return _with_meta(spark, sf_dir).select("page_id", allowed.alias("allowed")).select("page_id", "allowed.*")


def robots_files(spark, sf_dir):
    """One robots file per host, by top-level domain; mobile hosts could not be reached."""
    hosts = c.pages(spark, sf_dir).select(urls.netloc(F.col("url")).alias("host")).distinct()
    com = "# rules\nUser-agent: *\nDisallow: /fr\nAllow: /fr/1\nCrawl-delay: 3\n"
    net = "Disallow: /\nUser-agent: WebLoom\nUser-agent: other\nDisallow: /e%6E/ # no\nCrawl-delay: 0\n\nUser-agent: *\nDisallow: /\n"
    org = "User-agent: another\nDisallow: /\n\nUser-agent: *\n\nDisallow: /de\n\nUser-agent: *\nAllow: /es\nDisallow:\nCrawl-delay: 1.5\n"
    host = F.col("host")
    content = F.when(host.endswith(".com"), com).when(host.endswith(".net"), net).otherwise(org)
    return hosts.select("host", content.alias("content"), host.startswith("m.").alias("fetch_failed"))


AGENT = "WebLoomBot/1.0"


def _robots_rules(spark, sf_dir):
    rules = rb.robots_rules(robots_files(spark, sf_dir))
    return rules.select("host", "pos", F.array_join("agents", ",").alias("agents"), "allow", "path", "crawl_delay")


def _visits(spark, sf_dir):
    return rb.robots_allow(c.pages(spark, sf_dir).select("page_id", "url"), robots_files(spark, sf_dir), AGENT)


def _robots_allow(spark, sf_dir):
    return _visits(spark, sf_dir).select("page_id", "visit")


def _crawl_delay(spark, sf_dir):
    return _visits(spark, sf_dir).select("page_id", "crawl_delay")


def _crawl_outcome(spark, sf_dir):
    visits = _visits(spark, sf_dir).select("page_id", F.col("visit").alias("can_visit"))
    fetched = _with_meta(spark, sf_dir).withColumn("meta_robots", F.col("fields.meta_robots"))
    joined = fetched.withColumn("fetched", F.lit(True)).join(visits, "page_id")
    return pg.crawl_outcome(joined, _as_of())


def queue(spark, sf_dir):
    return c.pages(spark, sf_dir).select(F.col("page_id").alias("id"), "url", urls.netloc(F.col("url")).alias("domain"))


def domains(spark, sf_dir):
    """Last visit and delay per host, from the length of its shortest URL and of its name."""
    lengths = queue(spark, sf_dir).groupBy("domain").agg(F.min(F.length("url")).alias("shortest"))
    noon = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    return lengths.select(
        "domain",
        (F.length("domain") * 2).cast("double").alias("crawl_delay"),
        (noon - F.make_dt_interval(secs=F.col("shortest").cast("decimal(18,6)"))).alias("last_visit"),
    )


def _frontier_ready(spark, sf_dir):
    return fr.frontier_ready(queue(spark, sf_dir), domains(spark, sf_dir), _as_of())


def _frontier_batch(spark, sf_dir):
    return fr.frontier_batch(queue(spark, sf_dir), domains(spark, sf_dir), _as_of())[0]


def _frontier_remaining(spark, sf_dir):
    return fr.frontier_batch(queue(spark, sf_dir), domains(spark, sf_dir), _as_of())[1]


def _frontier_domains(spark, sf_dir):
    return fr.frontier_batch(queue(spark, sf_dir), domains(spark, sf_dir), _as_of())[2]


def _frontier_add(spark, sf_dir):
    """Targets of all links, less the targets of French pages (visited) and German ones (queued)."""
    links = ln.page_links(ln.resolved_links(ln.page_hrefs(c.pages(spark, sf_dir))))
    links = materialize(links.select("url", "target_url"), "links")
    visited = links.filter(F.col("url").contains("/fr/")).select(F.col("target_url").alias("url"))
    queued = links.filter(F.col("url").contains("/de/")).select(F.col("target_url").alias("url"))
    return fr.frontier_add(links.select(F.col("target_url").alias("url")), visited, queued, c.SUFFIXES)


def known_domains(spark, sf_dir):
    """The state that customers left."""
    return c.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("domain"),
        F.col("c_acctbal").alias("crawl_delay"),
        F.to_timestamp(F.lit("2023-12-31 00:00:00")).alias("last_visit"),
    )


def domain_visits(spark, sf_dir):
    """Visits of users, who have the numbers of customers."""
    return c.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("domain"),
        F.col("value").alias("crawl_delay"),
        F.col("ts").cast("timestamp").alias("last_visit"),
        F.col("event_id").alias("seq"),
    )


def _domain_state_upsert(spark, sf_dir):
    known, visits = known_domains(spark, sf_dir), domain_visits(spark, sf_dir)
    kept = fr.domain_state_upsert(known, visits, keep_delay=True)
    replaced = fr.domain_state_upsert(known, visits)
    return kept.join(replaced.withColumnRenamed("crawl_delay", "new_delay").drop("last_visit"), "domain")


def _domain_state_snapshot(spark, sf_dir):
    """The same state as a keyed snapshot, brought up to date with three runs of visits, the second of them twice."""
    path = scratch_path(spark, "domains")
    visits = materialize(domain_visits(spark, sf_dir), "visits")
    last = visits.agg(F.max("seq")).first()[0] or 0
    part = F.floor(F.col("seq") * 3 / (last + 1))
    first = materialize(known_domains(spark, sf_dir).withColumn("seq", F.lit(-1).cast("long")), "known")
    parts = [first, *[visits.filter(part == k) for k in range(3)]]
    for version in (0, 1, 2, 2, 3):
        snapshots.upsert(spark, path, tables.VISITED_DOMAINS, "domain", parts[version], fr.domain_state_upsert, version)
    snapshots.expire(spark, path)
    return snapshots.read_snapshot(spark, path, tables.VISITED_DOMAINS)


_LOG = """
WITH log AS (
  SELECT page_id, url,
         regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
         CASE WHEN contains(url, '/en/') THEN 'noindex' WHEN contains(url, '/fr/') THEN 'nofollow'
              WHEN contains(url, '/de/') THEN 'none' ELSE 'all' END AS meta,
         CASE WHEN contains(url, '?') THEN
              CASE WHEN url LIKE 'http:%' THEN 'unavailable_after: Wed, 01 Jan 2020 00:00:00 GMT'
                   ELSE 'noarchive,unavailable_after: 2030-01-01T00:00:00Z' END END AS header,
         contains(url, '?') AND url LIKE 'http:%' AS expired,
         NOT contains(url, '.example.org/') AS is_page
  FROM pages),
allowed AS (
  SELECT *, meta NOT IN ('noindex', 'none') AND NOT expired AS may_index,
         meta NOT IN ('nofollow', 'none') AND NOT expired AS may_follow,
         CASE WHEN host LIKE 'm.%' THEN false
              WHEN host LIKE '%.com' THEN path NOT LIKE '/fr%'
              WHEN host LIKE '%.net' THEN path NOT LIKE '/en/%'
              ELSE true END AS visit,
         CASE WHEN host LIKE 'm.%' THEN 0.0::DOUBLE WHEN host LIKE '%.com' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS delay
  FROM log)
"""

_QUEUE = f"""
WITH queue AS (SELECT page_id AS id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages),
lengths AS (SELECT domain, min(length(url)) AS shortest FROM queue GROUP BY domain),
domains AS (SELECT domain, (2 * length(domain))::DOUBLE AS crawl_delay,
                   TIMESTAMP '2024-01-01 12:00:00' - to_seconds(shortest) AS last_visit FROM lengths),
ready AS (SELECT * FROM queue q WHERE NOT EXISTS (
            SELECT 1 FROM domains d WHERE d.domain = q.domain
            AND d.last_visit + to_seconds(d.crawl_delay::BIGINT) > TIMESTAMP '{AS_OF}')),
batch AS (SELECT * FROM ready ORDER BY id LIMIT 10),
claimed AS (SELECT min(id) AS id, arg_min(url, id) AS url, domain FROM batch GROUP BY domain)
"""

SQL_STATES = """
WITH states AS (
  SELECT c_custkey::VARCHAR AS domain, c_acctbal AS delay, TIMESTAMP '2023-12-31 00:00:00' AS visit, -1 AS seq
  FROM customer
  UNION ALL SELECT user_id::VARCHAR, value, ts, event_id FROM events)
"""

QUERIES = {
    "content_type_gate": (_content_type_gate, f"{_LOG} SELECT page_id, url FROM log WHERE is_page"),
    "meta_robots": (_meta_robots, f"{_LOG} SELECT page_id, meta AS directives FROM log"),
    "x_robots_tag": (_x_robots_tag, f"{_LOG} SELECT page_id, header AS directives FROM log"),
    "unavailable_after": (_unavailable_after, f"{_LOG} SELECT page_id, expired FROM log"),
    "page_permissions": (
        _page_permissions,
        f'{_LOG} SELECT page_id, may_index AS "index", may_follow AS follow FROM allowed',
    ),
    "robots_rules": (
        _robots_rules,
        """WITH hosts AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
        rules AS (SELECT * FROM (VALUES
          ('com', 2, '*', false, '/fr', 3.0::DOUBLE), ('com', 3, '*', true, '/fr/1', 3.0::DOUBLE),
          ('net', 3, 'WebLoom,other', false, '/en/', 0.0::DOUBLE), ('net', 7, '*', false, '/', NULL),
          ('org', 1, 'another', false, '/', NULL),
          ('org', 8, '*', true, '/es', NULL), ('org', 9, '*', true, '', NULL)) AS r(tld, pos, agents, allow, path, crawl_delay))
        SELECT host, pos, agents, allow, path, crawl_delay FROM hosts JOIN rules ON host LIKE '%.' || tld""",
    ),
    "robots_allow": (_robots_allow, f"{_LOG} SELECT page_id, visit FROM allowed"),
    "crawl_delay": (_crawl_delay, f"{_LOG} SELECT page_id, delay AS crawl_delay FROM allowed"),
    "crawl_outcome": (
        _crawl_outcome,
        f"""{_LOG} SELECT url, visit AND is_page AND may_index AS indexation, visit AND is_page AND may_follow AS follow,
        CASE WHEN visit AND is_page THEN md5(url) END AS page_key FROM allowed""",
    ),
    "frontier_add": (
        _frontier_add,
        f"""{SQL_HREFS} SELECT DISTINCT target_url AS url, regexp_extract(netloc, '[^.]+\\.[^.]+$', 0) AS domain
        FROM kept WHERE target_url NOT IN (SELECT target_url FROM kept WHERE contains(url, '/fr/'))
        AND target_url NOT IN (SELECT target_url FROM kept WHERE contains(url, '/de/'))""",
    ),
    "frontier_ready": (_frontier_ready, f"{_QUEUE} SELECT id, url, domain FROM ready"),
    "frontier_batch": (_frontier_batch, f"{_QUEUE} SELECT id, url, domain FROM claimed"),
    "frontier_remaining": (
        _frontier_remaining,
        f"{_QUEUE} SELECT id, url, domain FROM queue WHERE id NOT IN (SELECT id FROM claimed)",
    ),
    "frontier_domains": (
        _frontier_domains,
        f"""{_QUEUE} SELECT domain, crawl_delay,
        CASE WHEN domain IN (SELECT domain FROM claimed) THEN TIMESTAMP '{AS_OF}' ELSE last_visit END AS last_visit
        FROM domains""",
    ),
    "domain_state_snapshot": (
        _domain_state_snapshot,
        f"""{SQL_STATES} SELECT domain, arg_max(delay, seq) AS crawl_delay, arg_max(visit, seq) AS last_visit
        FROM states GROUP BY domain""",
    ),
    "domain_state_upsert": (
        _domain_state_upsert,
        f"""{SQL_STATES} SELECT domain, arg_min(delay, seq) AS crawl_delay, arg_max(delay, seq) AS new_delay,
               arg_max(visit, seq) AS last_visit FROM states GROUP BY domain""",
    ),
}
