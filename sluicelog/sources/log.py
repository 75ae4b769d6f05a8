"""The message log: entry ids, ledger rollover, scans and positions.

A log row has topic, partition, ledger, entry and ord, the 0-based place in its topic; positions compare by (ledger, entry) only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import runtime_mode

MAX_ENTRIES = 50_000
TOPIC_PREFIX = "persistent://public/default/"


def numbered(df: DataFrame, out: str, partition: Sequence[str], slot: Column, order: Sequence[str]) -> DataFrame:
    """``df`` with the 0-based place of each row in its partition, by ``slot`` (which must not decrease in that order), then ``order``.

    Only rows of one slot are sorted together; what comes before a slot is summed from counts per slot. A topic that holds most of the log is
    thus spread over as many tasks as it has slots.
    """
    rows = df.withColumn("_slot", slot)
    counts = rows.groupBy(*partition, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*partition).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*partition, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy(*partition, "_slot").orderBy(*order))
    return rows.withColumn("_place", place).join(starts, [*partition, "_slot"]).withColumn(out, F.col("_start") + F.col("_place") - 1).drop("_slot", "_n", "_start", "_place")


def hours(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / 3600)


def event_log(events: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The log of an event table: a topic per event type, in the order of time and event id."""
    rows = events.select(
        F.concat(F.lit(TOPIC_PREFIX), "event_type").alias("topic"), F.lit(-1).alias("partition"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("producer_name"), F.col("event_id").alias("sequence_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("publish_time"), F.col("user_id").cast("string").alias("partition_key"), F.col("props").alias("payload"),
    )
    return rolled_over(numbered(rows, "ord", ["topic"], hours(F.col("ts")), ["ts", "event_id"]), max_entries)


def rolled_over(log: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Ledger (counted per topic) and entry of each row from its place; a ledger holds ``max_entries``, at least 1."""
    size = max(1, max_entries)
    return log.withColumns({"ledger": F.floor(F.col("ord") / size), "entry": F.col("ord") % size})


def ledgers(log: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """A row per ledger: entries, bytes, whether it is closed, and its id, which is unique over all topics.

    A ledger opens when its topic's first entry arrives or when the one before it is full, so after a full ledger there is an empty one.
    Ids follow the order of opening.
    """
    size = max(1, max_entries)
    own = log.groupBy("topic", "ledger").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("payload")).alias("bytes"), F.min(F.struct("ts", "event_id")).alias("first"), F.max(F.struct("ts", "event_id")).alias("last"))
    full = F.col("entries") == size
    after = own.where(full).select("topic", (F.col("ledger") + 1).alias("ledger"), F.col("last").alias("opened"))
    rows = own.join(after, ["topic", "ledger"], "full").select(
        "topic", "ledger", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("opened", "first").alias("opened"), F.coalesce(full, F.lit(False)).alias("closed")
    )
    rows = rows.withColumns({"opened_ts": F.col("opened.ts"), "opened_event": F.col("opened.event_id"), "_all": F.lit(0)})
    return numbered(rows, "ledger_id", ["_all"], hours(F.col("opened_ts")), ["opened_ts", "opened_event", "topic"]).drop("_all", "opened", "opened_event")


def write_log(log: DataFrame, path: str, mode: str = "append", most_records: int = 1_000_000) -> None:
    """Append to a log folder, a sub-folder per topic, in files of at most ``most_records``; scans of one topic then read nothing else."""
    log.withColumn("topic_key", F.col("topic")).write.mode(mode).partitionBy("topic_key").option("maxRecordsPerFile", most_records).parquet(path)


def scan(spark: SparkSession, path: str, topic: str, columns: Sequence[str] = ("ledger", "entry", "payload")) -> DataFrame:
    """A topic's entries; only its folder and the named columns are read."""
    return spark.read.parquet(path).where(F.col("topic_key") == topic).select(*columns)


def at_or_after(ledger: int, entry: int) -> Column:
    return (F.col("ledger") > ledger) | ((F.col("ledger") == ledger) & (F.col("entry") >= entry))


def read_from(log: DataFrame, topic: str, ledger: int, entry: int, limit: int) -> DataFrame:
    """The first ``limit`` entries of a topic at or after a position."""
    return log.where((F.col("topic") == topic) & at_or_after(ledger, entry)).orderBy("ledger", "entry").limit(limit)


def point(log: DataFrame, topic: str, ledger: int, entry: int, partition: int = -1) -> DataFrame:
    return log.where((F.col("topic") == topic) & (F.col("ledger") == ledger) & (F.col("entry") == entry) & (F.col("partition") == partition))


def last_positions(log: DataFrame) -> DataFrame:
    """Each topic's last position; a topic without entries has no row."""
    return log.groupBy("topic").agg(F.max(F.struct("ledger", "entry")).alias("p")).select("topic", "p.ledger", "p.entry")


def last_message_ids(asked: DataFrame, log: DataFrame) -> DataFrame:
    """The last position of each asked topic, or why there is none."""
    rows = asked.select("topic").join(last_positions(log), "topic", "left")
    transient = runtime_mode(F.col("topic")) == "NonPersistent"
    error = F.when(transient, "non-persistent topic").when(F.col("ledger").isNull(), "Topic has no messages")
    return rows.select("topic", F.when(~transient, F.col("ledger")).alias("ledger"), F.when(~transient, F.col("entry")).alias("entry"), error.alias("error"))


def neighbours(log: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Previous and next position of every entry, over the bounds of ledgers; null at a topic's ends.

    Both follow from how many entries the ledgers hold, so no row has to meet the next one.
    """
    size = max(1, max_entries)
    ends = log.groupBy("topic").agg((F.max("ord")).alias("last"))
    rows = log.join(ends, "topic")
    before, after = F.when(F.col("ord") > 0, F.col("ord") - 1), F.when(F.col("ord") < F.col("last"), F.col("ord") + 1)
    pair = lambda o, name: [F.floor(o / size).alias(f"{name}_ledger"), (o % size).alias(f"{name}_entry")]
    return rows.select("topic", "ledger", "entry", *pair(before, "prev"), *pair(after, "next"))


def accepted_sizes(log: DataFrame, most_bytes: int) -> DataFrame:
    """Messages whose payload isn't over the limit; the others are refused."""
    return log.where(F.octet_length("payload") <= most_bytes)
