"""URL frontier: what to visit next, one URL per domain, no domain before its delay is over."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators.robots import DEFAULT_CRAWL_DELAY
from webloom.plans.lineage import materialize
from webloom.plans.skew import skew_join

# Tasks that the URLs of one domain are shared by, at least.
_SLICES = 16


def frontier_add(
    candidates: DataFrame,
    visited: DataFrame,
    queued: DataFrame,
    suffixes: Iterable[str],
) -> DataFrame:
    """Candidate URLs that are neither visited nor queued, once each: (url, domain).

    All three sides are reduced to distinct URLs before the shuffle, so a URL that a third of all
    pages link to is one row per task. The joins then use the partitioning of those reductions,
    and the domain is worked out for the survivors only.
    """
    fresh = candidates.select("url").distinct()
    for known in (visited, queued):
        fresh = fresh.join(known.select("url").distinct(), "url", "left_anti")
    return fresh.withColumn("domain", urls.registered_domain(F.col("url"), suffixes))


def busy_domains(domains: DataFrame, as_of: Column, unit: float = DEFAULT_CRAWL_DELAY) -> DataFrame:
    """Domains whose delay since the last visit is not over: (domain)."""
    seconds = (F.col("crawl_delay") * unit).cast("decimal(18,6)")
    return domains.filter(F.col("last_visit") + F.make_dt_interval(secs=seconds) > as_of).select("domain").distinct()


def frontier_ready(
    queue: DataFrame, domains: DataFrame, as_of: Column, unit: float = DEFAULT_CRAWL_DELAY
) -> DataFrame:
    """Queued URLs (id, url, domain) that may be visited now."""
    busy = busy_domains(domains, as_of, unit)
    ready = skew_join(queue, busy, "domain", ["id"], how="left_anti", slices=_SLICES)
    return ready.select("id", "url", "domain")


def first_per_domain(batch: DataFrame) -> DataFrame:
    """The row with the lowest id per domain."""
    return batch.groupBy("domain").agg(F.min("id").alias("id"), F.min_by("url", "id").alias("url")).select(
        "id", "url", "domain"
    )


def frontier_claim(
    queue: DataFrame, domains: DataFrame, as_of: Column, n: int = 10, unit: float = DEFAULT_CRAWL_DELAY
) -> DataFrame:
    """First URL of each domain among the first n ready ones, so it may hold fewer than n."""
    ready = frontier_ready(queue, domains, as_of, unit)
    return first_per_domain(ready.orderBy("id").limit(n))


def frontier_batch(
    queue: DataFrame, domains: DataFrame, as_of: Column, n: int = 10, unit: float = DEFAULT_CRAWL_DELAY
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One claim: (claimed, remaining queue, new domain state).

    The claim, at most n rows, is stored first, so the three results agree with each other.
    """
    claimed = materialize(frontier_claim(queue, domains, as_of, n, unit), "claim")
    remaining = queue.join(claimed.select("id"), "id", "left_anti").select("id", "url", "domain")
    visits = claimed.select(
        "domain", F.lit(DEFAULT_CRAWL_DELAY).alias("crawl_delay"), as_of.alias("last_visit"), F.col("id").alias("seq")
    )
    return claimed, remaining, domain_state_upsert(domains, visits, keep_delay=True)


def domain_state_upsert(known: DataFrame, visits: DataFrame, keep_delay: bool = False) -> DataFrame:
    """Domain state (domain, crawl_delay, last_visit) after visits (..., seq), the last one wins.

    With ``keep_delay`` a known domain, or else the first visit, keeps its delay; the visit time
    always moves on. Of visits with the same ``seq`` the later one counts, and then the longer delay, so
    delay and time come from one row. States are combined before the shuffle.
    """
    columns = ["domain", "crawl_delay", "last_visit"]
    states = known.select(*columns, F.lit(-1).cast("long").alias("seq")).unionByName(
        visits.select(*columns, F.col("seq").cast("long").alias("seq"))
    )
    place = F.struct("seq", "last_visit", "crawl_delay")
    delay = F.min(place)["crawl_delay"] if keep_delay else F.max(place)["crawl_delay"]
    return states.groupBy("domain").agg(delay.alias("crawl_delay"), F.max(place)["last_visit"].alias("last_visit"))
