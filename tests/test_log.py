"""Rollover, cursors, routing and folds on small scenarios with known outcomes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluicelog.functions import hashing, names
from sluicelog.operators import cursors, folds, redelivery, routing, stats
from sluicelog.sources import catalog, log
from sluicelog.streaming import live


def entries(spark, topics, start=datetime(2024, 1, 1)):
    rows = [(t, i, start + timedelta(minutes=i), f"m{i}") for t, n in topics.items() for i in range(n)]
    df = spark.createDataFrame(rows, "topic string, event_id long, ts timestamp, payload string").withColumns({"partition": F.lit(-1), "publish_time": F.unix_millis("ts")})
    return log.numbered(df, "ord", ["topic"], log.hours(F.col("ts")), ["ts", "event_id"])


def test_rollover(spark):
    rows = log.rolled_over(entries(spark, {"t": 3}), 2)
    assert [tuple(r) for r in rows.orderBy("ord").select("ledger", "entry").collect()] == [(0, 0), (0, 1), (1, 0)]
    held = log.ledgers(rows, 2).orderBy("ledger").select("entries", "closed").collect()
    assert [tuple(r) for r in held] == [(2, True), (1, False)]


def test_full_ledger_opens_an_empty_one_and_ids_are_global(spark):
    rows = log.rolled_over(entries(spark, {"a": 2, "b": 1}), 1)
    held = log.ledgers(rows, 1).collect()
    assert sorted(r.ledger_id for r in held) == list(range(5))
    assert {(r.topic, r.ledger): r.entries for r in held} == {("a", 0): 1, ("a", 1): 1, ("a", 2): 0, ("b", 0): 1, ("b", 1): 0}


def test_previous_position(spark):
    rows = log.rolled_over(entries(spark, {"t": 3}), 2)
    got = {(r.ledger, r.entry): (r.prev_ledger, r.prev_entry) for r in log.neighbours(rows, 2).collect()}
    assert got == {(0, 0): (None, None), (0, 1): (0, 0), (1, 0): (0, 1)}


def test_empty_log(spark):
    rows = log.rolled_over(entries(spark, {"t": 1}).limit(0), 2)
    assert rows.count() == 0 and log.ledgers(rows, 2).count() == 0 and log.last_positions(rows).count() == 0


def fold_of_acks(n, acked):
    frontier, holes = -1, set()
    for o in acked:
        if o > frontier:
            holes.add(o)
        while frontier + 1 in holes:
            frontier += 1
            holes.discard(frontier)
    return frontier, len(holes)


def test_frontier_equals_fold_on_random_acks(spark):
    rng = random.Random(5)
    sizes = {f"t{i}": rng.randrange(1, 40) for i in range(25)}
    acked = {t: [o for o in range(n) if rng.random() < 0.8] for t, n in sizes.items()}
    rows = entries(spark, sizes)
    acks = spark.createDataFrame([(t, "s", o) for t, os in acked.items() for o in rng.sample(os, len(os))], "topic string, subscription string, ord long")
    base = rows.select("topic").distinct().select("topic", F.lit("s").alias("subscription"), F.lit(None).cast("long").alias("mark_delete_ord"))
    got = {r.topic: (r.mark_delete_ord, r.holes) for r in cursors.frontiers(rows, acks, base).collect()}
    assert got == {t: fold_of_acks(n, acked[t]) for t, n in sizes.items()}


def test_seek_by_time_is_a_prefix_scan(spark):
    times = [100, 200, 300, 150, None, 400]
    rows = spark.createDataFrame([("t", i, t) for i, t in enumerate(times)], "topic string, ord long, publish_time long")
    asked = spark.createDataFrame([("t", t) for t in (50, 200, 250, 1000)], "topic string, publish_time long")
    assert {r.publish_time: r.ord for r in cursors.seek_by_time(rows, asked).collect()} == {50: 0, 200: 1, 250: 2, 1000: None}


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "hello", "key-123", "ключ"])
def test_murmur(spark, duck, text):
    got = spark.createDataFrame([(text,)], "k string").select(hashing.murmur3_32(F.encode("k", "UTF-8"))).first()[0]
    assert got == duck.execute(f"SELECT {hashing.murmur3_sql(chr(39) + text + chr(39))}").fetchone()[0]
    assert text != "hello" or got == 0x248BFA47


def test_names(spark):
    got = spark.createDataFrame([("persistent://public/default/metadata-partition-sub-partition-2",), ("t-partition--3",), ("x",)], "n string").select(
        names.logical_topic(F.col("n")), names.partition_of(F.col("n"))
    )
    assert [tuple(r) for r in got.collect()] == [("persistent://public/default/metadata-partition-sub", 2), ("t-partition--3", -3), ("x", -1)]


def test_split_owner_equals_ranges(spark):
    members = spark.range(1, 8).select(F.lit("t").alias("topic"), F.lit("s").alias("subscription"), F.col("id").alias("consumer_id"))
    messages = spark.range(0, 65536, 97).select(F.lit("t").alias("topic"), F.col("id").cast("int").alias("sticky_hash"))
    ranges = {r.consumer_id: (r.start, r.end) for r in routing.split_ranges(members).collect()}
    for r in routing.split_owner(messages, members).collect():
        assert ranges[r.consumer_id][0] <= r.sticky_hash <= ranges[r.consumer_id][1]


def history(*events):
    state, out = folds.Subscription(events[0]), []
    for seq, e in enumerate(events[1:]):
        kind, consumer, o, n, name = (*e, None, None, None, None)[:5]
        out += state.event(kind, consumer, o, n, name, seq)
    return out


def test_shared_prefers_the_smaller_priority_number():
    got = history("Shared", ("join", 1, None, 5, "a"), ("join", 2, None, 0, "b"), ("flow", 1, None, 1), ("flow", 2, None, 1), ("publish", None, 0, 0), ("publish", None, 1, 0))
    assert got == [(2, 0, 0), (1, 1, 0)]


def test_shared_recovery_raises_the_count_and_skips_acked():
    got = history("Shared", ("join", 1, None, 0, "a"), ("flow", 1, None, 3), *[("publish", None, i, 0) for i in range(3)], ("ack", 1, 0), ("ack", 1, 2), ("join", 2, None, 0, "b"), ("leave", 1), ("flow", 2, None, 5))
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 1, 1)]


def test_key_shared_blocks_a_key_until_its_redelivery_is_acked():
    start = [("join", 1, None, 0, "a"), ("flow", 1, None, 1), ("publish", None, 0, 7), ("redeliver", 1)]
    got = history("KeyShared", *start, ("publish", None, 1, 7), ("publish", None, 2, 9), ("flow", 1, None, 9))
    assert got == [(1, 0, 0), (1, 0, 1), (1, 2, 0)]
    assert history("KeyShared", *start, ("publish", None, 1, 7), ("publish", None, 2, 9), ("flow", 1, None, 9), ("ack", 1, 0), ("flow", 1, None, 1))[-1] == (1, 1, 0)


def test_failover_takes_the_largest_number_and_reads_again_after_takeover():
    got = history("Failover", ("join", 1, None, 1, "a"), ("join", 3, None, 5, "a"), ("flow", 1, None, 9), ("flow", 3, None, 2), ("publish", None, 0, 0), ("publish", None, 1, 0), ("ack", 3, 0), ("leave", 3))
    assert got == [(3, 0, 0), (3, 1, 0), (1, 1, 0)]


def test_exclusive_takes_one_consumer_and_cumulative_acks_may_go_back():
    state = folds.Subscription("Exclusive")
    assert state.join(1, 0, "a", 0) and not state.join(2, 0, "b", 1)
    state.ack(1, 5, True)
    state.ack(1, 2, True)
    assert state.frontier == 2


def test_batch_limit():
    got = history("Shared", *[("publish", None, i, 0) for i in range(30)], ("join", 1, None, 0, "a"), ("flow", 1, None, 100))
    assert len(got) == folds.BATCH


def test_transient_shared_drops_without_permits():
    state = folds.Transient("Shared", [(1, 0), (2, 0)])
    state.event("flow", 2, 1)
    assert [state.event("publish", None, 0) for _ in range(3)] == [2, None, None]


def test_rate_limit_restarts_lazily():
    limit = folds.RateLimit(1, 0, 10)
    assert [limit.allow(t, 1) for t in (0, 9, 10, 19, 25, 26)] == [True, False, True, False, True, False]
    assert folds.RateLimit(0, 0).allow(0, 10**9)


def test_merged_queue(spark):
    queue = spark.createDataFrame([("t", "s", 1, 2, None, 0), ("t", "s", 1, 1, 9, 1), ("t", "s", 1, 0, 5, 2)], "topic string, subscription string, ord long, redelivery_count long, sticky_hash int, seq long")
    assert [tuple(r) for r in redelivery.merged(queue).select("ord", "redelivery_count", "sticky_hash").collect()] == [(1, 2, 9)]


def test_document_round_trip(spark, tmp_path):
    topics = spark.createDataFrame([("persistent://a/b/c", True, 3), ("persistent://a/b/d/e", False, 0)], "topic string, partitioned boolean, partitions long")
    subs = spark.createDataFrame([("persistent://a/b/c", "s1"), ("persistent://a/b/c", "s2")], "topic string, subscription string")
    path = f"file://{tmp_path}/doc"
    catalog.write_document(spark, catalog.upserted(topics), subs, "metadata", path)
    read = catalog.checked(catalog.read_documents(spark, path + "/part-*")).where("refused is null")
    assert sorted(r.topic for r in catalog.topics(read).collect()) == ["persistent://a/b/c", "persistent://a/b/d/e"]
    assert sorted(r.subscription for r in catalog.subscriptions(read).collect()) == ["s1", "s2"]
    assert {r.topic: r.partition_count for r in catalog.topics(read).collect()}["persistent://a/b/c"] == 3


def test_unsubscribe_forgets_the_cursor():
    got = history("Shared", ("join", 1, None, 0, "a"), ("flow", 1, None, 9), ("publish", None, 0, 0), ("ack", 1, 0), ("publish", None, 1, 0), ("unsubscribe",), ("join", 2, None, 0, "b"), ("flow", 2, None, 9))
    assert got == [(1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 1, 0)]


def test_seek_replays_acked_messages():
    got = history("Exclusive", ("join", 1, None, 0, "a"), ("flow", 1, None, 9), *[("publish", None, i, 0) for i in range(3)], *[("ack", 1, i) for i in range(3)], ("seek", None, 1), ("flow", 1, None, 1))
    assert got[3:] == [(1, 1, 0), (1, 2, 0)]


def test_fenced_subscription_drops():
    state = folds.Transient("Exclusive", [(1, 0)])
    state.event("flow", 1, 5)
    assert state.event("publish", None, 0) == 1
    state.event("fence", None, None)
    assert state.event("publish", None, 0) is None


def test_members(spark):
    rows = spark.createDataFrame([("t", 1, "register", "a", 0), ("t", 1, "register", "b", 1), ("t", 2, "register", "c", 2), ("t", 2, "remove", "c", 3)], "topic string, producer_id long, kind string, name string, seq long")
    live = stats.live_members(rows)
    assert [tuple(r) for r in live.collect()] == [("t", 1, "b")]
    found = stats.find_members(spark.createDataFrame([(1,), (2,)], "producer_id long"), live, "producer_id")
    assert {r.producer_id: r.topic for r in found.collect()} == {1: "t", 2: None}


def test_turns_are_repaired_on_leave_and_kept_on_join():
    start = [e for c in (1, 2, 3) for e in (("join", c, None, 0, "a"), ("flow", c, None, 99))]
    sent = lambda n: [("publish", None, i, 0) for i in range(n)]
    assert history("Shared", *start, *sent(3), ("join", 4, None, 0, "a"), ("flow", 4, None, 99), ("publish", None, 3, 0))[-1] == (1, 3, 0)
    assert history("Shared", *start, *sent(2), ("ack", 1, 0), ("leave", 1), ("publish", None, 2, 0))[-1] == (3, 2, 0)


def test_ring_hash_equals_the_column_hash(spark):
    from sluicelog.functions import hashing
    from pyspark.sql import functions as F

    texts = ["", "a", "ab", "abc", "abcd", "failover-a17", "persistent://public/default/é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.murmur3_32(F.encode("t", "UTF-8")).alias("h")).collect()
    assert {r.t: r.h for r in rows} == {t: folds.ring_hash(t) for t in texts}


def test_transient_ignores_strangers_and_permits_after_a_fence():
    state = folds.Transient("Failover", [], "t-partition-1")
    state.event("flow", 7, 5)
    for c in (1, 2):
        state.event("join", c, 0, f"c{c}")
        state.event("flow", c, 5)
    assert state.event("publish", None, 0) == 2
    state.event("leave", 2, None)
    assert state.event("publish", None, 0) == 1
    state.event("fence", None, None)
    state.event("flow", 1, 9)
    assert state.event("publish", None, 0) is None


def test_queue_equals_a_plain_dictionary():
    import random

    rng, queue, plain = random.Random(3), folds.Queue(), {}
    for _ in range(5000):
        o = rng.randrange(60)
        if rng.random() < 0.55:
            queue.put(o, rng.randrange(5), o % 7)
            plain[o] = max(plain.get(o, 0), queue.counts[o])
        else:
            assert queue.take(o) == plain.pop(o, 0)
        ready = rng.sample(range(7), 3)
        assert queue.first() == min(plain, default=None) and set(queue.keys) == {p % 7 for p in plain}
        assert queue.first_of(lambda key: key in ready) == min((p for p in plain if p % 7 in ready), default=None)


def test_streams_go_on_from_their_state_after_a_restart(spark, tmp_path):
    """Acks and permits of the first run count in the second one, which reads only what came since."""
    acks = lambda ords: spark.createDataFrame([("t", "s", o) for o in ords], "topic string, subscription string, ord long")
    paths = {n: f"file://{tmp_path}/{n}" for n in ("acks", "frontiers", "events", "deliveries")}
    for ords in ((0, 1, 2, 5, 6), (3, 4, 9)):
        found = live.drained(live.ack_frontiers(live.replayed(acks(ords), "ord", 1, paths["acks"])), paths["frontiers"])
    assert [tuple(r) for r in live.latest(found, "topic", "subscription").collect()] == [("t", "s", 6, 1)]
    assert found.count() == 2

    names = "topic string, subscription string, seq long, kind string, consumer_id long, ord long, n long, name string"
    first = [("join", 1, None, 0, "a"), ("flow", 1, None, 2, None), *[("publish", None, i, 0, None) for i in range(4)], ("ack", 1, 0, None, None)]
    second = [("join", 2, None, 0, "b"), ("leave", 1, None, None, None), ("flow", 2, None, 2, None)]
    numbered = [("t", "s", i, *e) for i, e in enumerate(first + second)]
    for part in (numbered[: len(first)], numbered[len(first) :]):
        events = live.replayed(spark.createDataFrame(part, names), "seq", 1, paths["events"])
        sent = live.drained(live.dispatches(events, "Shared"), paths["deliveries"])
    # what the consumer that left held comes first, with its count raised
    assert sorted((r.seq, r.consumer_id, r.ord, r.redelivery_count) for r in sent.collect()) == [(2, 1, 0, 0), (3, 1, 1, 0), (9, 2, 1, 1), (9, 2, 2, 0)]
