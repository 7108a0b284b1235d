"""PageRank after more links and pages came in, from the ranks published last.

Ranks solve one equation per linked URL: base value plus shares of the ranks that link to it. Published ranks
solve those of the old graph, so in the new graph only URLs that a changed source links to are off. What they
are off by is their residual. A URL adds its residual to its rank and passes shares of it on; this goes on
with those whose residual is above a bound, until there are none. A sweep costs the links of the blocks that
hold such URLs (``link_blocks``), not those of the graph. Ranks are per page, so more pages scale all of them down, which the old ranks follow
exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.link_blocks import LinkBlocks, numbered
from webloom.plans.lineage import discard, materialize, shuffles_removed
from webloom.plans.skew import HotKeys, count_keys, skew_join

# Sweeps planned together between two stored states.
_SWEEPS_PER_CUT = 4


@dataclass
class Updated:
    """New ranks (url, page_rank), stored, and how many shares the first sweep of each few passed on."""

    ranks: DataFrame
    shares: list[int]


def update_ranks(
    ranks: DataFrame,
    n_docs_before: int,
    pages: DataFrame,
    n_docs: int,
    edges: DataFrame,
    added: DataFrame,
    d: float = 0.85,
    bound: float = 1e-13,
    sweeps: int = 400,
) -> Updated:
    """Ranks of all pages and link targets after links were added.

    ``ranks`` (url, page_rank) are those of the old graph, run until they change no more; ``edges`` and
    ``added`` are old and new links (source_url, target_url), parallel ones counted, and ``pages`` (url) all
    pages now. No residual above ``bound`` is left. All rules are those of ``rank.pagerank``.
    """
    start, scale = 1.0 / n_docs, n_docs_before / n_docs
    with shuffles_removed(pages.sparkSession):
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        rows = edges.select("source_url", "target_url", one.alias("n_old"), none.alias("n_new")).unionByName(
            added.select("source_url", "target_url", none.alias("n_old"), one.alias("n_new"))
        )
        counted = rows.groupBy("source_url", "target_url").agg(F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"))
        links = materialize(counted, "links")
        started = _started(ranks, scale, pages, links.filter("n_old > 0"), links.filter("n_new > 0"), start)
        nodes, n = numbered(started)
        moving = _moving(links, nodes, d)
        graph = LinkBlocks(moving.select("src", "dst", (F.col("w") * d).alias("w")), n)
        fans = materialize(graph.packed(moving.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "n"), "fans")

        residuals = graph.packed(_residuals(nodes, moving, d, start), "residual")
        ranked = graph.packed(nodes.filter("rank IS NOT NULL"), "rank")
        state = materialize(_state(graph, graph.summed(ranked), residuals, bound), "state")
        shares, done = [], 0
        while done < sweeps:
            n_active, n_shares = _active(graph, state, fans, bound)
            if not n_active:
                break
            shares.append(n_shares)
            before = state
            for _ in range(min(_SWEEPS_PER_CUT, sweeps - done)):
                parts = graph.shares(state).union(graph.states(state))
                state = graph.summed(parts, _swept(bound))
                done += 1
            state = materialize(state, "state")
            discard(before)
        graph.release()
        found = nodes.filter("rank IS NOT NULL").select("id", "url").join(graph.unpacked(state, "state", "page_rank"), "id")
        final = materialize(found.select("url", "page_rank"), "ranks")
        discard(links, moving, fans, nodes, state)
    return Updated(final, shares)


def _swept(bound: float) -> Callable:
    """State of a block, its ranks and then their residuals, after the parts that came in; sends residuals above the bound.

    A residual is part of the rank as soon as it is known. What was above the bound has been passed on.
    """

    def finish(state: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        size = len(parts)
        ranks, left = state[:size], state[size:]
        left = np.where(np.abs(left) > bound, 0.0, left) + parts
        sent = np.where(np.abs(left) > bound, left, 0.0)
        return (sent if sent.any() else None), np.concatenate([ranks + parts, left])

    return finish


def _state(graph: LinkBlocks, ranks: DataFrame, residuals: DataFrame, bound: float) -> DataFrame:
    """The first state: nothing has been passed on, so the residuals come in as parts of a sum on what the ranks are."""

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v.as_py() + bytes(len(v.as_py())) for v in batch.column("values")]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(values, pa.binary())], ["block", "state"])

    old = graph.states(ranks.select("block", "values").mapInArrow(laid, "block INT, state BINARY"))
    return graph.summed(old.union(residuals), _swept(bound))


def _active(graph: LinkBlocks, state: DataFrame, fans: DataFrame, bound: float) -> tuple[int, int]:
    """How many URLs have a residual above the bound, and how many links they have."""
    size = graph.shape.size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for state, places, values in zip(batch.column("state"), batch.column("places"), batch.column("values")):
                above = np.abs(np.frombuffer(state.as_buffer(), "<f8")[size:]) > bound
                links = 0.0
                if places.is_valid:
                    links = np.frombuffer(values.as_buffer(), "<f8")[above[np.frombuffer(places.as_buffer(), "<u2")]].sum()
                found.append((int(above.sum()), int(links)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["urls", "links"])

    joined = state.select("block", "state").join(fans.select("block", "places", "values"), "block", "left")
    counted = joined.select("state", "places", "values").mapInArrow(count, "urls LONG, links LONG")
    return tuple(x or 0 for x in counted.agg(F.sum("urls"), F.sum("links")).first())


def _started(ranks: DataFrame, scale: float, pages: DataFrame, old: DataFrame, new: DataFrame, start: float) -> DataFrame:
    """Every URL with the rank it had, scaled (``had``), the one it starts with (``rank``), and whether it is linked now.

    A page that nothing links to has the start value in both graphs; one that is linked for the first time
    goes on from it, and a linked URL that is new and no page from nothing.
    """
    seen = pages.select("url", F.lit(True).alias("is_page"), F.lit(False).alias("was_linked"), F.lit(False).alias("is_linked"))
    for links, before in ((old, True), (new, False)):
        targets = links.select(F.col("target_url").alias("url")).distinct()
        seen = seen.unionByName(targets.select("url", F.lit(False).alias("is_page"), F.lit(before).alias("was_linked"), F.lit(True).alias("is_linked")))
        sources = links.select(F.col("source_url").alias("url")).distinct()
        none = F.lit(False)
        seen = seen.unionByName(sources.select("url", none.alias("is_page"), none.alias("was_linked"), none.alias("is_linked")))
    flags = [F.max(name).alias(name) for name in ("is_page", "was_linked", "is_linked")]
    nodes = seen.groupBy("url").agg(*flags).join(ranks.select("url", F.col("page_rank").alias("had")), "url", "left")
    # what a page that nothing linked to had is the start value, which scaling would give up to rounding only
    had = F.when(F.col("had").isNull(), 0.0).when(F.col("was_linked"), F.col("had") * scale).otherwise(start)
    fresh = F.when(F.col("is_page"), start).when(F.col("is_linked"), 0.0)
    return nodes.select("url", "is_linked", "was_linked", had.alias("had"), F.when(F.col("was_linked"), had).otherwise(fresh).alias("rank"))


def _moving(links: DataFrame, nodes: DataFrame, d: float) -> DataFrame:
    """Links between numbers (src, dst, w) with what they bring to their target's residual (off), stored.

    Sources that carry the same shares of the same rank as before change nothing. A source without any
    rank (no page and not linked) carries none.
    """
    n_all = F.col("n_old") + F.col("n_new")
    degrees = links.groupBy("source_url").agg(F.sum("n_old").alias("d_old"), F.sum(n_all).alias("d_new"), F.count("*").alias("n"))
    degrees = materialize(degrees, "out_degrees")
    in_links = materialize(count_keys(links, "target_url"), "in_degrees")
    sources = nodes.select(F.col("url").alias("source_url"), F.col("id").alias("src"), F.coalesce("rank", F.lit(0.0)).alias("rank"), "had")
    sources = sources.join(degrees.drop("n"), "source_url")
    targets = nodes.select(F.col("url").alias("target_url"), F.col("id").alias("dst"))
    from_source = skew_join(links, sources, "source_url", ["target_url"], HotKeys(degrees, "source_url", "n")).drop("source_url")
    both = skew_join(from_source, targets, "target_url", ["src"], HotKeys(in_links, "target_url", "n"))
    w, changed = n_all / F.col("d_new"), (F.col("d_new") > F.col("d_old")) | (F.col("rank") != F.col("had"))
    w_old = F.when(F.col("d_old") > 0, F.col("n_old") / F.col("d_old")).otherwise(0.0)
    off = F.when(changed, d * (F.col("rank") * w - F.col("had") * w_old))
    moving = materialize(both.select("src", "dst", w.alias("w"), off.alias("off")), "moving")
    discard(degrees, in_links)
    return moving


def _residuals(nodes: DataFrame, moving: DataFrame, d: float, start: float) -> DataFrame:
    """(id, residual): by how much the ranks fail their equations in the new graph, where they do."""
    off = moving.filter("off IS NOT NULL").select(F.col("dst").alias("id"), F.col("off").alias("part"))
    # what a URL that is linked for the first time starts with is not part of any equation
    first = nodes.filter("is_linked AND NOT was_linked")
    own = first.select("id", (F.lit((1 - d) * start) - F.coalesce("rank", F.lit(0.0))).alias("part"))
    return off.unionByName(own).groupBy("id").agg(F.sum("part").alias("residual"))
