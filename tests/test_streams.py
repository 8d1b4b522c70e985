"""Streams across restarts: lifecycle with timers, and ingest of several tables at once."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from newsgraph.streaming import jobs, lifecycle

DAY0 = datetime(2024, 1, 1)


def test_lifecycle_across_restarts(spark, tmp_path):
    """Each step once, late copies ignored, idle clusters resolved by their timers, and state kept between runs."""
    schema = "id string, slug string, at timestamp"
    land = lambda rows: spark.createDataFrame([(k, s, DAY0 + timedelta(hours=h)) for k, s, h in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        out = []
        with lifecycle.state_store(spark):
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            steps = lifecycle.lifecycle_steps(stream, "id", idle_hours=10, late="1 hours")
            job = steps.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            job.awaitTermination()
        return sorted((k, s, (at - DAY0).total_seconds() / 3600) for k, s, at in out)

    land([("x", "1", 0), ("x", "1", 0.5), ("y", "1", 1), ("x", None, 1)])
    assert run() == [("x", "new", 0), ("y", "new", 1)]
    land([("x", "1", 2), ("x", "2", 3)])  # a copy that comes late does not count
    assert run() == [("x", "developing", 3)]
    assert run() == []
    land([("x", "3", 5), ("x", "4", 6), ("z", "1", 13)])  # y is idle since 1: its timer fires at 11
    assert run() == [("x", "confirmed", 5), ("y", "resolved", 11), ("z", "new", 13)]
    land([("y", "1", 14), ("x", "5", 15.5)])  # y begins anew, with a slug that it had before; x was not idle for ten hours
    assert run() == [("y", "new", 14)]
    land([("x", "6", 40), ("z", "2", 40)])  # gaps within a batch
    assert run() == [("x", "new", 40), ("x", "resolved", 25.5), ("y", "resolved", 24), ("z", "new", 40), ("z", "resolved", 23)]


@pytest.mark.parametrize("files", [1, 3])
def test_landed_file_or_folder(spark, sf, tmp_path, files):
    """A table that is a folder of files lands as a whole, as one that is a file does; other tables stay out."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    if files > 1:
        events.repartition(files).write.parquet(f"{tmp_path}/events.parquet")
        events.limit(5).write.parquet(f"{tmp_path}/more_events.parquet")
    out = jobs.run_to_end(jobs.landed(spark, str(tmp_path) if files > 1 else sf, "events").select("event_id"), "append")
    assert sorted(r.event_id for r in out.collect()) == sorted(r.event_id for r in events.select("event_id").collect())


def test_lifecycle_keeps_slugs_in_lists(monkeypatch):
    """Few reads and writes of the state for many articles; copies are known in any batch, as lists split and lives end."""
    from types import SimpleNamespace

    calls, stored, timers = [], {}, set()

    class Map:
        getValue = lambda self, k: calls.append("read") or stored.get(k)
        updateValue = lambda self, k, v: calls.append("write") or stored.__setitem__(k, v)
        containsKey = lambda self, k: calls.append("read") or k in stored
        clear = lambda self: stored.clear()

    class Value:
        now = None
        get = lambda self: self.now
        exists = lambda self: self.now is not None
        update = lambda self, v: setattr(self, "now", v)
        clear = lambda self: setattr(self, "now", None)

    steps = lifecycle.Lifecycle("id", 10_000)
    steps.init(SimpleNamespace(getValueState=lambda *_: Value(), getMapState=lambda *_: Map(), registerTimer=timers.add, deleteTimer=timers.discard))
    run = lambda rows: [(r["state"], r["ms"]) for r in steps.handleInputRows(("x",), iter([{"ms": ms, "slug": s} for ms, s in rows]), None)]
    assert run([(i, f"s{i % 3000}") for i in range(6000)]) == [("new", 0), ("developing", 1), ("confirmed", 2)]
    assert len(calls) < 100 and timers == {12_999}
    assert sorted(s for v in stored.values() for s in v[0]) == sorted({f"s{i}" for i in range(3000)})
    for i in range(3000, 6000, 500):  # copies of all, and 500 that are new: some lists split again
        assert run([(i, f"s{j}") for j in range(i + 500)]) == []
    assert steps.active.now[0] == 6000
    calls.clear()
    assert run([(5500, "s7"), (5500, "t")]) == [] and len(calls) <= 3
    assert run([(30_000, "s7"), (50_000, "s7")]) == [("resolved", 15_500), ("new", 30_000), ("resolved", 40_000), ("new", 50_000)]
    assert [v[0] for v in stored.values()] == [["s7"]] and timers == {60_000}
