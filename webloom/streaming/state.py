"""Visit state of domains as a keyed state of a stream, with a timer for the end of each delay.

Spark's state store keeps one row per hash bucket of domains, with the states of its domains as Arrow
columns, so Python is called once per bucket and not once per domain. A micro-batch sends a domain the
visits of each task as one row, so a domain that a third of all visits go to costs a row per task. What a
visit changes does not depend on the order in which visits come, and a visit that comes again changes
nothing.

Every batch publishes the domains it changed as a version of a keyed snapshot (``sources.snapshots``), so
other jobs read the state as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.operators.robots import DEFAULT_CRAWL_DELAY
from webloom.plans.lineage import discard, materialize
from webloom.sources import snapshots

VISITS = "domain STRING, crawl_delay DOUBLE, last_visit TIMESTAMP, seq BIGINT"
#: State of a domain: its first visit's delay, and delay, time and number of the last one; whether it may be visited again.
DOMAINS = "domain STRING, first_delay DOUBLE, crawl_delay DOUBLE, last_visit TIMESTAMP, seq BIGINT, ready BOOLEAN"

#: Hash buckets of domains in the state store. They must not change under a stream.
STATE_BUCKETS = 512

# A visit inside the job: number, time in microseconds, delay. The place of a visit orders it among others.
_COMBINED = "domain STRING, seq LONG, visit LONG, delay DOUBLE, last_seq LONG, last_visit LONG, last_delay DOUBLE, seen LONG"
_STATE = "domains BINARY"
_CHANGE = "domain STRING, first_delay DOUBLE, crawl_delay DOUBLE, visit LONG, seq LONG, ready BOOLEAN"
_MICROS = 1_000_000
_PLACE = ["seq", "visit", "delay"]


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last visit of each domain among the rows of a task's batches.

    One more row without a domain carries the latest time of a batch. The others carry none, so that visits
    which come late, behind the stream's time, are not left out by it.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [("domain", "ascending"), *[(name, "ascending") for name in _PLACE]]
        ordered = pa.Table.from_batches([batch]).take(pc.sort_indices(batch, sort_keys=keys, null_placement="at_start")).combine_chunks()
        domains = ordered["domain"].combine_chunks()
        new = np.flatnonzero(pc.not_equal(domains[1:], domains[:-1]).to_numpy(zero_copy_only=False))
        first, last = np.concatenate([[0], new + 1]), np.concatenate([new, [len(domains) - 1]])
        columns = [domains.take(pa.array(first))]
        columns += [ordered[name].combine_chunks().take(pa.array(at)) for at in (first, last) for name in _PLACE]
        names = ["domain", *_PLACE, "last_seq", "last_visit", "last_delay"]
        rows = pa.Table.from_arrays([*columns, pa.nulls(len(first), pa.int64())], [*names, "seen"])
        clock = {name: pa.nulls(1, rows.schema.field(name).type) for name in names} | {"seen": pa.array([pc.max(batch.column("visit")).as_py()], pa.int64())}
        yield from pa.concat_tables([rows, pa.table(clock)]).combine_chunks().to_batches()


_KNOWN = [("domain", pa.string()), ("seq", pa.int64()), ("visit", pa.int64()), ("delay", pa.float64()), ("last_seq", pa.int64())]
_KNOWN = pa.schema([*_KNOWN, ("last_visit", pa.int64()), ("last_delay", pa.float64()), ("ready", pa.bool_())])
_WHOLE = ["seq", "visit", "last_seq", "last_visit"]
_ENDS = {"first": _PLACE, "last": ["last_seq", "last_visit", "last_delay"]}


def _packed(known: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(known, schema=_KNOWN, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _KNOWN) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(packed: bytes | None) -> pd.DataFrame:
    table = _KNOWN.empty_table() if packed is None else pa.ipc.open_stream(packed).read_all()
    return table.to_pandas()


def _ends(rows: pd.DataFrame, names: list[str], keep: str) -> pd.DataFrame:
    """The first or the last visit of each domain, as Spark orders structs: a missing delay comes first."""
    seq, visit, delay = names
    order = [rows[delay].fillna(0.0), rows[delay].notna(), rows[visit], rows[seq], rows["domain"]]
    ordered = rows.iloc[np.lexsort([column.to_numpy() for column in order])]
    return ordered.drop_duplicates("domain", keep=keep)[["domain", *names]].reset_index(drop=True)


def _joined(known: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
    """First and last visits of the domains of both, in the order of domains."""
    rows = pd.concat([x for x in (known, part) if len(x)] or [known], ignore_index=True)
    firsts, lasts = _ends(rows, _ENDS["first"], "first"), _ends(rows, _ENDS["last"], "last")
    return pd.concat([firsts, lasts.drop(columns="domain")], axis=1)


def _follow(unit: float):
    """Keep the state of a bucket's domains, set the timer of the first delay that ends, and tell of every change."""
    names = [name for name in _KNOWN.names if name != "ready"]

    def each(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):  # these rows only tell the time
            return
        known = _unpacked(*(state.getOption or (None,)))
        now, new, touched = state.getCurrentWatermarkMs(), known[names], []
        if not state.hasTimedOut:
            for part in parts:
                new = _joined(new, part[names].astype(dict.fromkeys(_WHOLE, "int64")))
                touched.append(part["domain"])
        visited = new["domain"].isin(pd.concat(touched).unique() if touched else [])
        over = (new["last_visit"] + (new["last_delay"].fillna(0.0) * unit * _MICROS).astype("int64")) // 1000
        was = new[["domain"]].merge(known, "left", "domain")
        # what a timer told holds until the next visit, whatever the time
        new = new.assign(ready=np.where(visited, over < now, (was["ready"] == True) | (over < now)).astype(bool))  # noqa: E712
        same = pd.concat([(was[name] == new[name]) | (was[name].isna() & new[name].isna()) for name in [*names, "ready"]], axis=1).all(axis=1)
        state.update((_packed(new),))
        waiting = over[~new["ready"]]
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting.min()), now + 1))
        changed = new[~same]  # none if the same visits come again
        if len(changed):
            yield pd.DataFrame(
                {"domain": changed["domain"], "first_delay": changed["delay"], "crawl_delay": changed["last_delay"]}
                | {"visit": changed["last_visit"], "seq": changed["last_seq"], "ready": changed["ready"]}
            )

    return each


def domain_changes(visits: DataFrame, unit: float = DEFAULT_CRAWL_DELAY, lateness: str = "0 seconds") -> DataFrame:
    """Changes of domain state (see ``DOMAINS``) from a stream of visits (see ``VISITS``).

    A visit that changes a domain's state gives a row with ``ready`` false, or true if its delay is over by
    the stream's time. When the stream's time (the latest visit less ``lateness``) passes the end of the
    delay, in milliseconds, a row with ``ready`` true follows. Visits without domain, time or number are left
    out; late ones count like others.
    """
    given = visits.select("domain", F.col("crawl_delay").cast("double").alias("delay"), F.col("last_visit").cast("timestamp"), F.col("seq").cast("long"))
    given = given.filter("domain IS NOT NULL AND last_visit IS NOT NULL AND seq IS NOT NULL")
    combined = given.select("domain", "seq", F.unix_micros("last_visit").alias("visit"), "delay").mapInArrow(_combined, _COMBINED)
    combined = combined.withColumn("seen", F.timestamp_micros("seen")).withWatermark("seen", lateness)
    bucket = F.when(F.col("domain").isNotNull(), snapshots.bucket_of("domain", STATE_BUCKETS))
    changes = combined.withColumn("state_bucket", bucket).groupBy("state_bucket").applyInPandasWithState(_follow(unit), _CHANGE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return changes.select("domain", "first_delay", "crawl_delay", F.timestamp_micros("visit").alias("last_visit"), "seq", "ready")


def _replaced(old: DataFrame, changes: DataFrame) -> DataFrame:
    """A batch has one row at most for a domain, and it holds all of its state."""
    return old.join(changes.select("domain"), "domain", "left_anti").unionByName(changes.select(old.columns))


def stream_domain_state(
    visits: DataFrame, path: str, checkpoint: str, unit: float = DEFAULT_CRAWL_DELAY, lateness: str = "0 seconds", buckets: int = snapshots.BUCKETS
) -> StreamingQuery:
    """Follow visits, and publish the state of domains as a snapshot under ``path``, a version a micro-batch.

    Only the buckets of domains that a batch changed are written. A batch that runs again after a failure
    finds its version there and writes nothing.
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = materialize(batch, "domain_changes")
        if not changed.isEmpty():
            snapshots.upsert(spark, path, DOMAINS, "domain", changed, _replaced, batch_id, buckets)
            snapshots.expire(spark, path)
        discard(changed)

    writer = domain_changes(visits, unit, lateness).writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def domain_state(spark: SparkSession, path: str, keep_delay: bool = False) -> DataFrame:
    """The published state (domain, crawl_delay, last_visit, ready), as ``frontier.domain_state_upsert`` gives it."""
    rows = snapshots.read_snapshot(spark, path, DOMAINS)
    delay = F.col("first_delay" if keep_delay else "crawl_delay")
    return rows.select("domain", delay.alias("crawl_delay"), "last_visit", "ready")


def ready_domains(spark: SparkSession, path: str) -> DataFrame:
    """Domains whose delay is over by the stream's time: (domain)."""
    return snapshots.read_snapshot(spark, path, DOMAINS).filter("ready").select("domain")
