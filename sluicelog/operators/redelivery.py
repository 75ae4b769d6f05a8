"""Redelivery: what is queued again, in which order and with which count, and who owns an ack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["topic", "subscription"]
BATCH = 20


def merged(queue: DataFrame) -> DataFrame:
    """One entry per place of a queue with repeats: the larger count, and the first key hash that any of them has."""
    first_hash = F.min_by("sticky_hash", F.when(F.col("sticky_hash").isNotNull(), F.col("seq")))
    return queue.groupBy(*KEYS, "ord").agg(F.max("redelivery_count").alias("redelivery_count"), first_hash.alias("sticky_hash"))


def dispatchable(queue: DataFrame, log: DataFrame, acks: DataFrame) -> DataFrame:
    """Queued entries that the log still has and that aren't acknowledged."""
    held = queue.join(log.select("topic", "ord"), ["topic", "ord"], "left_semi")
    return held.join(acks.select(*KEYS, "ord"), [*KEYS, "ord"], "left_anti")


def candidates(log: DataFrame, acks: DataFrame, in_flight: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """New entries to deliver: neither acknowledged nor in flight at any consumer."""
    rows = log.join(subscriptions.select(*KEYS), "topic")
    rows = rows.join(acks.select(*KEYS, "ord"), [*KEYS, "ord"], "left_anti")
    return rows.join(in_flight.select(*KEYS, "ord"), [*KEYS, "ord"], "left_anti")


def next_batch(queue: DataFrame, new: DataFrame, permits: DataFrame, batch: int = BATCH) -> DataFrame:
    """What one trigger delivers: queued entries by place, then new ones, ``min(permits, batch)`` per subscription.

    ``permits`` has topic, subscription and total. The rank is cut at ``batch`` before rows are gathered, so a long log stays where it is.
    """
    again = queue.select(*KEYS, "ord", "redelivery_count", F.lit(0).alias("is_new"))
    first = new.join(queue.select(*KEYS, "ord"), [*KEYS, "ord"], "left_anti").select(*KEYS, "ord", F.lit(0).cast("long").alias("redelivery_count"), F.lit(1).alias("is_new"))
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy("is_new", "ord"))
    rows = again.unionByName(first).withColumn("place", rank).where(F.col("place") <= batch)
    return rows.join(permits, KEYS).where(F.col("place") <= F.col("total")).drop("total")


def requested(requests: DataFrame, in_flight: DataFrame, acks: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Entries that go back to the queue on request, with their count raised.

    A request names places, or none for all that its consumer holds. Exclusive and Failover ignore requests, and so do transient
    subscriptions; what the consumer doesn't hold, or is acknowledged, is passed over.
    """
    live = subscriptions.where("sub_type in ('Shared', 'KeyShared') and mode = 'Persistent'").select(*KEYS)
    own = requests.join(live, KEYS).select(*KEYS, "consumer_id", F.explode_outer("ords").alias("asked"))
    held = in_flight.join(own, [*KEYS, "consumer_id"]).where("asked is null or asked = ord").select(*KEYS, "ord", "consumer_id", "redelivery_count", "sticky_hash").distinct()
    held = held.join(acks.select(*KEYS, "ord"), [*KEYS, "ord"], "left_anti")
    return held.select(*KEYS, "ord", (F.col("redelivery_count") + 1).alias("redelivery_count"), "sticky_hash")


def recovered(gone: DataFrame, in_flight: DataFrame, acks: DataFrame) -> DataFrame:
    """Entries of consumers that left, back in the queue with their count raised and their key hash kept."""
    held = in_flight.join(gone.select(*KEYS, "consumer_id"), [*KEYS, "consumer_id"], "left_semi")
    held = held.join(acks.select(*KEYS, "ord"), [*KEYS, "ord"], "left_anti")
    return held.select(*KEYS, "ord", (F.col("redelivery_count") + 1).alias("redelivery_count"), "sticky_hash")


def blocked_hashes(queue: DataFrame, in_flight_again: DataFrame) -> DataFrame:
    """Per subscription and key hash how many entries block it: queued ones and redelivered ones without an ack."""
    rows = queue.select(*KEYS, "sticky_hash").unionByName(in_flight_again.select(*KEYS, "sticky_hash"))
    return rows.where("sticky_hash is not null").groupBy(*KEYS, "sticky_hash").agg(F.count(F.lit(1)).alias("blockers"))


def ack_owners(acks: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Whose in-flight entry each ack settles: the acking consumer's own exact id, its own position, another's exact id, another's position."""
    held = in_flight.select(*KEYS, F.col("consumer_id").alias("owner"), "ledger", "entry", F.col("partition").alias("held_partition"))
    met = acks.join(held, [*KEYS, "ledger", "entry"])
    own, exact = F.col("owner") == F.col("consumer_id"), F.col("held_partition") == F.col("partition")
    level = F.when(own & exact, 0).when(own, 1).when(exact, 2).otherwise(3)
    return met.groupBy(*KEYS, "seq").agg(F.min(F.struct(level.alias("level"), "owner")).alias("best")).select(*KEYS, "seq", "best.owner", "best.level")


def valid_acks(acks: DataFrame, in_flight: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Acks that count: no cumulative ones on Shared and KeyShared, and individual ones only for entries in flight.

    On Exclusive and Failover the acking consumer itself must hold the entry; on the others any consumer may.
    """
    rows = acks.join(subscriptions.select(*KEYS, "sub_type"), KEYS)
    single = F.col("sub_type").isin("Exclusive", "Failover")
    cumulative = rows.where((F.col("ack_type") == "Cumulative") & single)
    individual = rows.where("ack_type = 'Individual'")
    own = individual.where(single).join(in_flight.select(*KEYS, "consumer_id", "ord").distinct(), [*KEYS, "consumer_id", "ord"], "left_semi")
    any_ = individual.where(~single).join(in_flight.select(*KEYS, "ord").distinct(), [*KEYS, "ord"], "left_semi")
    return cumulative.unionByName(own).unionByName(any_)
