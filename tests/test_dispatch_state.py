"""The dispatch state stays small: what it keeps of an entry, what a micro-batch reads and writes of it, and the slices of a replay."""

import random
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluicelog.operators import folds
from sluicelog.streaming import live

from .test_log import fold_of_acks


def filled(state, n):
    for c in (1, 2, 3):
        state.event("join", c, None, 0, f"c{c}", c)
        state.event("flow", c, None, 10**9, None, c)
    for o in range(n):
        state.event("publish", None, o, o * 7919 % 65536, None, o)
    return state


@pytest.mark.parametrize("mode, leaves, most", [("Shared", False, 10), ("Shared", True, 10), ("KeyShared", True, 100)])
def test_an_entry_takes_a_few_bytes(mode, leaves, most):
    """Delivered and not acked yet, or waiting for redelivery, of 200 keys."""
    n = 60_000
    tracemalloc.start()
    state = filled(folds.Subscription(mode), 0)
    for o in range(n):
        state.event("publish", None, o, o % 200 * 327, None, o)
    if leaves:
        assert len(state.event("leave", 2, None, None, None, n)) == folds.BATCH
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < most * n


def test_pages_live_elsewhere_and_deliveries_go_on():
    from sluicelog.operators.entries import Entries

    kept: dict[int, bytes] = {}
    paged = lambda: Entries(kept.__getitem__, kept.__setitem__, 3)
    state, plain = filled(folds.Subscription("Shared", paged()), 30_000), filled(folds.Subscription("Shared"), 30_000)
    assert len(state.entries.pages) <= 3
    state.entries.put_away()
    again = folds.Subscription("Shared", paged())
    assert len(state.head()) < 3000
    again.resume(state.head())
    for e in [("ack", 1, 0, None, None), ("leave", 2, None, None, None), *[("flow", 1, None, 1, None)] * 300, ("redeliver", 3, None, None, None), ("publish", None, 30_000, 7, None)]:
        assert again.event(*e, 10**6) == plain.event(*e, 10**6)


class Handle:
    """State in memory that counts calls."""

    def __init__(self):
        self.calls, self.value, self.cells = 0, None, {}

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def counted(self, result=None):
        self.calls += 1
        return result

    def exists(self):
        return self.counted(self.value is not None)

    def get(self):
        return self.counted(self.value)

    def update(self, value):
        self.value = self.counted(value)

    def containsKey(self, key):
        return self.counted(key in self.cells)

    def getValue(self, key):
        return self.counted(self.cells.get(key))

    def updateValue(self, key, value):
        self.cells[key] = self.counted(value)

    def removeKey(self, key):
        self.counted(self.cells.pop(key))


def test_a_batch_of_acks_asks_state_a_few_times():
    rng, n = random.Random(7), 100_000
    acks = [o for o in range(n) if o != 70_000 and rng.random() < 0.99 or o < 40_000] + [n + 5, 3, 3]
    rng.shuffle(acks)
    handle, processor = Handle(), live.AckFrontier()
    processor.init(handle)
    for start in range(0, len(acks), 35_000):
        part = acks[start : start + 35_000]
        frames = iter([pd.DataFrame({"ord": part[i : i + 10_000]}) for i in range(0, len(part), 10_000)])
        got = [tuple(r) for f in processor.handleInputRows(("t", "s"), frames, None) for r in f.itertuples(index=False)]
        assert got == [("t", "s", *fold_of_acks(n, acks[: start + 35_000]))]
    assert handle.calls < 100


def test_large_slices_of_a_replay_are_several_files_and_stay_in_order(spark, monkeypatch):
    monkeypatch.setattr(live, "SPLIT", 10, raising=False)
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("seq"))
    got = live.drained(live.replayed(rows, "seq", most=250)).groupBy("batch").agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(i, 250 * i, 250 * i + 249, 250) for i in range(4)]


def test_large_keys_of_a_fold_keep_tasks_of_their_own(spark):
    """Small partitions aren't put together: which task a key is in depends on its hash only."""
    events = spark.range(4000).select(F.concat(F.lit("t"), (F.col("id") % 40).cast("string")).alias("topic"), F.col("id").alias("seq"))
    seen = folds.fold(events, ["topic"], ["seq"], lambda _: None, lambda s, e: [(e[1],)], "topic string, seq long")
    assert seen.groupBy(F.spark_partition_id()).count().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_no_arrays_go_to_python(spark):
    """A batch with a column of arrays takes time by the square of its rows on the way to Python; given ranges arrive all the same."""
    names = "topic string, subscription string, seq long, kind string, consumer_id long, ord long, n long, name string, ranges array<int>"
    told = [("join", 1, None, 0, "a", [0, 9]), ("join", 2, None, 0, "b", [20, 29, 10, 19]), ("flow", 1, None, 9, None, None), ("flow", 2, None, 9, None, None)]
    events = spark.createDataFrame([("t", "s", i, *e) for i, e in enumerate([*told, *[("publish", None, o, 10 * o, None, None) for o in range(3)]])], names)
    sent = folds.dispatched(events, "KeyShared")
    assert sorted((r.ord, r.consumer_id) for r in sent.collect()) == [(0, 1), (1, 2), (2, 2)]
    plan = sent._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "array_join" in plan
