"""Keyed lifecycle of clusters as a stream: state, timers and expiry."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from zlib import crc32

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsgraph.registry import Tables, query
from newsgraph.streaming.jobs import LATE, posts, run_to_end

#: States after one, two and three articles.
STEPS = ("new", "developing", "confirmed")
RESOLVED = "resolved"
HOUR = 3_600_000
#: Slugs in a list of the state.
GROUP = 128
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _hash(slug: str) -> int:
    return crc32(slug.encode("utf-8", "surrogatepass"))


class Lifecycle(StatefulProcessor):
    """Rows (key, slug, ms) to (key, state, ms): each step of a cluster once, in order of event time.

    Kept for a key: how many articles it has and when it was last active (a value), and which slugs
    have been counted (a map: lists of about GROUP by their hash, so a batch reads and writes a few lists
    and not an entry an article). A slug that comes again, however late, is
    ignored. A key without an article for `idle` milliseconds of event time is resolved by its timer
    and its state goes; an article after that founds it anew. The rows of a key in one
    micro-batch are ordered, so a gap within a batch resolves the key as its timer would have, and
    what begins and ends within a batch is never stored.
    """

    def __init__(self, key: str, idle: int):
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "n long, latest long, groups int")
        self.slugs = handle.getMapState("slugs", "number int", "slugs array<string>")

    def _step(self, key, state: str, at: int) -> Row:
        return Row(**{self.key: key, "state": state, "ms": at})

    def _stored(self, number: int) -> set[str]:
        found = self.slugs.getValue((number,))
        return set(found[0]) if found else set()

    def _store(self, known: dict[int, set[str]], changed: set[int], groups: int, wanted: int, kept: bool) -> None:
        """Write the changed groups; if more are wanted, all groups, each split into those it becomes."""
        if wanted == groups:
            for number in changed:
                self.slugs.updateValue((number,), (list(known[number]),))
            return
        for number in range(groups):
            parts = {i: [] for i in range(number, wanted, groups)}
            for slug in known[number] if number in known else self._stored(number) if kept else ():
                parts[_hash(slug) % wanted].append(slug)
            for i, part in parts.items():
                self.slugs.updateValue((i,), (part,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, latest, groups = self.active.get() or (0, None, 1)
        due = None if latest is None else latest + self.idle
        kept, known, changed = latest is not None, {}, set()  # kept: the slugs of this life are stored
        for at, slug in sorted((r["ms"], r["slug"]) for r in rows):
            if latest is not None and at >= latest + self.idle:
                yield self._step(key[0], RESOLVED, latest + self.idle)
                if kept:
                    self.slugs.clear()
                n, latest, groups = 0, None, 1
                kept, known, changed = False, {}, set()
            number = _hash(slug) % groups
            if number not in known:
                known[number] = self._stored(number) if kept else set()
            if slug in known[number]:
                continue
            known[number].add(slug)
            changed.add(number)
            n, latest = n + 1, at if latest is None else max(at, latest)
            if n <= len(STEPS):
                yield self._step(key[0], STEPS[n - 1], at)
        if changed:
            wanted = groups
            while n > wanted * GROUP:
                wanted *= 2
            self._store(known, changed, groups, wanted, kept)
            self.active.update((n, latest, wanted))
            if due != latest + self.idle:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(latest + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        active = self.active.get()
        if active and active[1] + self.idle <= expiredTimerInfo.getExpiryTimeInMs():
            self.active.clear()
            self.slugs.clear()
            yield self._step(key[0], RESOLVED, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """Processors with timers need the RocksDB store, which keeps state on disk; the session's own is set again."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def lifecycle_steps(stream: DataFrame, key: str, idle_hours: float, late: str = LATE) -> DataFrame:
    """A stream of (key, state, at) from one of (key, slug, at); rows later than `late` are dropped. Null
    keys are one cluster; rows without slug or time are left out. Start it within state_store()."""
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col("slug").cast("string").alias("slug"), "at", F.floor(F.unix_micros("at") / 1000).alias("ms"))
    rows = rows.filter("slug is not null and at is not null").withWatermark("at", late)
    steps = rows.groupBy(key).transformWithState(Lifecycle(key, round(idle_hours * HOUR)), f"{key} {kind}, state string, ms long", "append", "eventTime")
    return steps.select(key, "state", F.timestamp_millis("ms").alias("at"))


def _steps(t: Tables, idle_hours: float) -> DataFrame:
    with state_store(t.spark):
        return run_to_end(lifecycle_steps(posts(t).withColumnRenamed("published_at", "at"), "source_name", idle_hours), "append")


@query("Z5_lifecycle", "with n as (select user_id as source_name, count(*) as n from events group by 1) select source_name, ['new', 'developing', 'confirmed'][i::int] as state from n, range(1, 4) r(i) where i <= n")
def _(t: Tables) -> DataFrame:
    """No source is idle for longer than the table is."""
    return _steps(t, 24 * 365).select("source_name", "state")


@query(
    "Z5_expiry",
    """with e as (select event_id, user_id as source_name, epoch_us(ts) // 1000 as ms from events), b as (select *, lag(ms) over (partition by source_name order by ms, event_id) as before from e),
    s as (select *, sum(case when before is null or ms - before >= 6 * 3600000 then 1 else 0 end) over (partition by source_name order by ms, event_id) as run from b),
    r as (select *, row_number() over (partition by source_name, run order by ms, event_id) as i from s), m as (select max(ms) - 2 * 86400000 as mark from e),
    o as (select source_name, run, max(ms) + 6 * 3600000 as due from s group by 1, 2)
    select source_name, ['new', 'developing', 'confirmed'][i::int] as state, count(*) as n, sum(ms)::bigint as total_ms from r where i <= 3 group by 1, 2
    union all select source_name, 'resolved', count(*), sum(due)::bigint from o, m where due <= mark or exists (select 1 from o p where p.source_name = o.source_name and p.run > o.run) group by 1""",
)
def _(t: Tables) -> DataFrame:
    """Sources are resolved six hours after their last event, by timer or by the next event, and start anew."""
    return _steps(t, 6).groupBy("source_name", "state").agg(F.count("*").alias("n"), F.sum(F.unix_millis("at")).alias("total_ms"))
