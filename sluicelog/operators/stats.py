"""Statistics of producers, consumers, subscriptions, topics and connections. All are grouped sums that combine before their shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import is_partition, logical_topic


def _count(name: str):
    return F.count(F.lit(1)).alias(name)


def producers(log: DataFrame) -> DataFrame:
    """Messages, bytes and average size of each producer on a topic."""
    size = F.octet_length("payload")
    rows = log.groupBy("topic", "producer_name").agg(_count("messages"), F.sum(size).cast("long").alias("bytes"))
    return rows.withColumn("average_size", F.col("bytes") / F.col("messages"))


def consumers(dispatched: DataFrame, acks: DataFrame, flow: DataFrame) -> DataFrame:
    """Messages, bytes, acks and permits left of each consumer."""
    keys = ["topic", "subscription", "consumer_id"]
    sent = dispatched.groupBy(*keys).agg(_count("messages"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))
    acked = acks.groupBy(*keys).agg(_count("acked"))
    granted = flow.groupBy(*keys).agg(F.sum("permits").alias("granted"))
    rows = granted.join(sent, keys, "left").join(acked, keys, "left").na.fill(0, ["messages", "bytes", "acked"])
    return rows.withColumn("permits", F.greatest(F.col("granted") - F.col("messages"), F.lit(0))).drop("granted")


def subscriptions(members: DataFrame, deliveries: DataFrame, flow: DataFrame, modes: DataFrame) -> DataFrame:
    """Consumers, permits, and for transient subscriptions received, dispatched and dropped messages (0 for durable ones)."""
    keys = ["topic", "subscription"]
    heads = members.groupBy(*keys).agg(_count("consumers"))
    permits = flow.groupBy(*keys).agg(F.sum("permits").alias("permits"))
    moved = deliveries.groupBy(*keys).agg(_count("received"), F.count_if(F.col("dispatched")).alias("dispatched"), F.count_if(~F.col("dispatched")).alias("dropped"))
    rows = modes.select(*keys, "mode").join(heads, keys, "left").join(permits, keys, "left").join(moved, keys, "left").na.fill(0, ["consumers", "permits", "received", "dispatched", "dropped"])
    for name in ("received", "dispatched", "dropped"):
        rows = rows.withColumn(name, F.when(F.col("mode") == "NonPersistent", F.col(name)).otherwise(0))
    return rows


def topics(registered: DataFrame, producing: DataFrame, subscribed: DataFrame, consuming: DataFrame) -> DataFrame:
    """Producers, subscriptions and consumers of each topic, with its subscriptions in order as an array."""
    made = producing.groupBy("topic").agg(F.count_distinct("producer_name").alias("producers"))
    subs = subscribed.groupBy("topic").agg(F.count_distinct("subscription").alias("subscriptions"), F.array_sort(F.collect_set("subscription")).alias("names"))
    used = consuming.groupBy("topic").agg(_count("consumers"))
    rows = registered.select("topic").join(made, "topic", "left").join(subs, "topic", "left").join(used, "topic", "left")
    return rows.na.fill(0, ["producers", "subscriptions", "consumers"]).withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def unpartitioned(topic_stats: DataFrame) -> DataFrame:
    """Topic statistics without the partitions of partitioned topics."""
    return topic_stats.where(~is_partition(F.col("topic")))


def partitioned(topic_stats: DataFrame) -> DataFrame:
    """A row per partition and one with the sums of its base topic (whose partition is null)."""
    rows = topic_stats.where(is_partition(F.col("topic"))).withColumns({"base": logical_topic(F.col("topic")), "part": F.regexp_extract("topic", r"(\d+)$", 1).cast("int")})
    sums = [F.sum(c).alias(c) for c in ("producers", "subscriptions", "consumers")]
    return rows.rollup("base", "part").agg(*sums).where("base is not null")


def total_permits(flow: DataFrame) -> DataFrame:
    return flow.groupBy("topic", "subscription").agg(F.sum("permits").alias("permits"))


def drop_rates(deliveries: DataFrame) -> DataFrame:
    """Received, dispatched and dropped messages, and the share dropped."""
    rows = deliveries.groupBy("topic", "subscription").agg(_count("received"), F.count_if(F.col("dispatched")).alias("dispatched"), F.count_if(~F.col("dispatched")).alias("dropped"))
    return rows.withColumn("drop_rate", F.col("dropped") / F.col("received"))


def broker(log: DataFrame, deliveries: DataFrame, uptime_s: float) -> DataFrame:
    """Counters of the whole broker, and rates since its start (0 without uptime)."""
    published = log.agg(_count("published"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("long").alias("bytes"))
    delivered = deliveries.agg(F.count_if(F.col("dispatched")).alias("delivered"))
    rate = lambda c: (F.col(c) / uptime_s if uptime_s else F.lit(0.0)).alias(f"{c}_rate")
    return published.join(F.broadcast(delivered)).select("published", "bytes", "delivered", rate("published"), rate("delivered"))


def connections(opened: DataFrame, most: int, most_per_ip: int) -> DataFrame:
    """Which connections are let in, by arrival, under a total and a per-address limit (0: none), and the counts that they meet.

    A refused connection takes no place. The address limit keeps each address's first ones; of these the total limit keeps the first.
    """
    own = F.row_number().over(W.partitionBy("ip").orderBy("seq"))
    fits = opened.withColumn("nth_of_ip", own).withColumn("ip_ok", F.lit(most_per_ip == 0) | (F.col("nth_of_ip") <= most_per_ip))
    first = fits.where("ip_ok").orderBy("seq").limit(most).select("seq", F.lit(True).alias("in_total")) if most else fits.where("ip_ok").select("seq", F.lit(True).alias("in_total"))
    return fits.join(first, "seq", "left").select("seq", "ip", "nth_of_ip", F.coalesce("in_total", F.lit(False)).alias("accepted"))


def idle_topics(registered: DataFrame, producing: DataFrame, consuming: DataFrame) -> DataFrame:
    """Topics without a producer and a consumer."""
    used = producing.select("topic").unionByName(consuming.select("topic")).distinct()
    return registered.select("topic").join(used, "topic", "left_anti")


def find_members(asked: DataFrame, members: DataFrame, key: str = "consumer_id") -> DataFrame:
    """Where each asked consumer or producer is registered; one that isn't anywhere has nulls."""
    return asked.select(key).join(members, key, "left")


def live_members(registrations: DataFrame, key: str = "producer_id") -> DataFrame:
    """Who is registered after a history of ``register`` and ``remove`` events: the last event of an id on a topic counts, and a new
    registration takes the place of an older one with the same id."""
    last = registrations.groupBy("topic", key).agg(F.max_by(F.struct("kind", "name"), "seq").alias("last"))
    return last.where("last.kind = 'register'").select("topic", key, F.col("last.name").alias("name"))
