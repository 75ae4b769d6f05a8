"""Which consumer gets a message: key ranges, failover election, round robin and fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import HASH_RANGE, murmur3_32

RING_POINTS = 100


def split_ranges(consumers: DataFrame) -> DataFrame:
    """Equal hash ranges, first and last hash included, for the consumers of each subscription in the order of their ids."""
    rows = consumers.withColumns({
        "i": F.row_number().over(W.partitionBy("topic", "subscription").orderBy("consumer_id")) - 1,
        "n": F.count(F.lit(1)).over(W.partitionBy("topic", "subscription")),
    })
    bound = lambda i: F.floor(i * HASH_RANGE / F.col("n")).cast("int")
    return rows.select("topic", "subscription", "consumer_id", bound(F.col("i")).alias("start"), (bound(F.col("i") + 1) - 1).alias("end"))


def split_owner(messages: DataFrame, consumers: DataFrame) -> DataFrame:
    """The owner of each message's ``sticky_hash`` among equal ranges, from the closed form of the range's number: an equi-join, no range join."""
    order = F.row_number().over(W.partitionBy("topic", "subscription").orderBy("consumer_id")) - 1
    ranked = consumers.select("topic", "subscription", "consumer_id", order.alias("slot"))
    counts = ranked.groupBy("topic", "subscription").agg(F.count(F.lit(1)).alias("n"))
    rows = messages.join(counts, "topic")
    slot = F.floor((F.col("sticky_hash") * F.col("n") + F.col("n") - 1) / HASH_RANGE).cast("int")
    return rows.withColumn("slot", slot).join(ranked, ["topic", "subscription", "slot"]).drop("slot", "n")


def range_owner(messages: DataFrame, ranges: DataFrame) -> DataFrame:
    """The owner by given ranges, which may overlap or leave gaps: the first by start, end and consumer among those with permits.

    Ranges come as rows of topic, subscription, consumer_id, start, end and permits. The hash space is cut at all bounds into pieces
    with one owner each; a piece is found by the hashes themselves (65536 at most a subscription), so messages meet it in an equi-join.
    A hash in a gap has a null owner.
    """
    usable = ranges.where(F.col("permits") > 0)
    covered = usable.select("topic", "subscription", "consumer_id", "start", "end", F.explode(F.sequence("start", "end")).alias("sticky_hash"))
    first = F.min(F.struct("start", "end", "consumer_id")).alias("best")
    owners = covered.groupBy("topic", "subscription", "sticky_hash").agg(first).select("topic", "subscription", "sticky_hash", F.col("best.consumer_id").alias("consumer_id"))
    subs = ranges.select("topic", "subscription").distinct()
    return messages.join(subs, "topic").join(owners, ["topic", "subscription", "sticky_hash"], "left")


def failover_active(consumers: DataFrame, highest_first: bool = True) -> DataFrame:
    """The active consumer of each durable failover subscription: by priority (the larger number first), name and id."""
    priority = F.desc("priority") if highest_first else F.asc("priority")
    place = F.row_number().over(W.partitionBy("topic", "subscription").orderBy(priority, "consumer_name", "consumer_id"))
    return consumers.withColumn("place", place).where("place = 1").select("topic", "subscription", "consumer_id")


def _top(consumers: DataFrame) -> DataFrame:
    keys = ["topic", "subscription"]
    best = consumers.groupBy(*keys).agg(F.min("priority").alias("priority"))
    top = consumers.join(best, [*keys, "priority"])
    return top.withColumn("slot", F.row_number().over(W.partitionBy(*keys).orderBy("consumer_name", "consumer_id")) - 1)


def transient_failover_active(consumers: DataFrame) -> DataFrame:
    """The active consumer of each transient failover subscription, among those of the smallest priority number.

    A partition takes them in turn; another topic takes the successor of its own hash on a ring with ``RING_POINTS`` points a consumer.
    ``consumers`` has topic, partition, subscription, consumer_id, consumer_name and priority.
    """
    keys, top = ["topic", "subscription"], _top(consumers)
    counts = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    turn = top.where("partition >= 0").join(counts, keys).where("slot = partition % n").select(*keys, "consumer_id")
    points = top.where("partition < 0").select(*keys, "consumer_id", "slot", F.explode(F.sequence(F.lit(0), F.lit(RING_POINTS - 1))).alias("replica"), "consumer_name")
    points = points.withColumns({"point": murmur3_32(F.encode(F.concat("consumer_name", F.col("replica").cast("string")), "UTF-8")), "own": murmur3_32(F.encode("topic", "UTF-8"))})
    # the successor on the ring: points at or after the topic's hash come first, then the ring starts over
    chosen = points.groupBy(*keys).agg(F.min_by("consumer_id", F.struct((F.col("point") < F.col("own")).alias("wrapped"), "point", "slot", "replica")).alias("consumer_id"))
    return turn.unionByName(chosen)


def round_robin(log: DataFrame, consumers: DataFrame) -> DataFrame:
    """Shared delivery among consumers of equal priority with ample permits: entry ``ord`` goes to consumer ``ord mod n``."""
    order = F.row_number().over(W.partitionBy("topic", "subscription").orderBy("priority", "joined", "consumer_id")) - 1
    ranked = consumers.select("topic", "subscription", "consumer_id", order.cast("long").alias("slot"))
    counts = ranked.groupBy("topic", "subscription").agg(F.count(F.lit(1)).alias("n"))
    return log.join(counts, "topic").withColumn("slot", F.col("ord") % F.col("n")).join(ranked, ["topic", "subscription", "slot"]).drop("slot", "n")


def fanned_out(log: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every message to every subscription of its topic."""
    return log.join(subscriptions.select("topic", "subscription"), "topic")


def compatible(policies: DataFrame) -> DataFrame:
    """Per subscription whether all consumers' key modes agree; only the mode counts, and no policy is AutoSplit."""
    mode = F.coalesce("key_mode", F.lit("AutoSplit"))
    return policies.groupBy("topic", "subscription").agg((F.min(mode) == F.max(mode)).alias("agrees"))
