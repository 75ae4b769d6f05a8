"""Subscription cursors: acknowledged messages as a frontier and holes, backlogs, initial positions and seeks.

Acknowledged is what lies at or before the mark-delete frontier or is a hole. The frontier of individual acks is the place before the first
entry that isn't acknowledged, so it needs an anti-join and a minimum, never an ordered pass over the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.log import numbered
from ..sources.shared import stored

PLACES_PER_SLOT = 100_000


def unacked(log: DataFrame, acks: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Entries of the log, per subscription, that no ack and no base frontier covers.

    ``acks`` has topic, subscription and ord; ``base`` topic, subscription and mark_delete_ord, and names the subscriptions.
    """
    rows = log.join(base, "topic") if base is not None else log.join(acks.select("topic", "subscription").distinct(), "topic")
    if base is not None:
        rows = rows.where(F.col("ord") > F.coalesce("mark_delete_ord", F.lit(-1)))
    return rows.join(acks.select("topic", "subscription", "ord"), ["topic", "subscription", "ord"], "left_anti")


def frontiers(log: DataFrame, acks: DataFrame, base: DataFrame) -> DataFrame:
    """Per subscription the frontier (-1: none), the number of holes beyond it and the number of entries that aren't acknowledged."""
    ends = log.groupBy("topic").agg(F.max("ord").alias("last"))
    open_rows = unacked(log, acks, base).groupBy("topic", "subscription").agg(F.min("ord").alias("first_open"), F.count(F.lit(1)).alias("backlog"))
    marks = base.join(ends, "topic").join(open_rows, ["topic", "subscription"], "left")
    marks = marks.select("topic", "subscription", (F.coalesce("first_open", F.col("last") + 1) - 1).alias("mark_delete_ord"), F.coalesce("backlog", F.lit(0)).alias("backlog"))
    held = acks.select("topic", "subscription", "ord").distinct().join(marks, ["topic", "subscription"]).where(F.col("ord") > F.col("mark_delete_ord"))
    # an ack of an entry that the log doesn't have is no hole
    held = held.join(log.select("topic", "ord"), ["topic", "ord"], "left_semi")
    holes = held.groupBy("topic", "subscription").agg(F.count(F.lit(1)).alias("holes"))
    return marks.join(holes, ["topic", "subscription"], "left").withColumn("holes", F.coalesce("holes", F.lit(0)))


def hole_ranges(log: DataFrame, acks: DataFrame, base: DataFrame) -> DataFrame:
    """The runs of neighbouring holes: where each starts and ends. A run ends where the next place isn't acknowledged."""
    marks = frontiers(log, acks, base).select("topic", "subscription", "mark_delete_ord")
    keys = ["topic", "subscription"]
    held = acks.select(*keys, "ord").distinct().join(marks, keys).where(F.col("ord") > F.col("mark_delete_ord")).select(*keys, "ord")
    held = stored(held, "holes")
    starts = held.join(held.select(*keys, (F.col("ord") + 1).alias("ord")), [*keys, "ord"], "left_anti")
    ends = held.join(held.select(*keys, (F.col("ord") - 1).alias("ord")), [*keys, "ord"], "left_anti")
    # runs don't overlap, so the n-th start and the n-th end are one run; both are numbered in slots, not in one task
    slot = F.floor(F.col("ord") / PLACES_PER_SLOT)
    starts = numbered(starts, "nth", keys, slot, ["ord"]).withColumnRenamed("ord", "start_ord")
    ends = numbered(ends, "nth", keys, slot, ["ord"]).withColumnRenamed("ord", "end_ord")
    return starts.join(ends, [*keys, "nth"]).select(*keys, "start_ord", "end_ord")


def first_unacked(log: DataFrame, acks: DataFrame, base: DataFrame) -> DataFrame:
    """The first position of each subscription that isn't acknowledged; no row if all are."""
    rows = unacked(log, acks, base).groupBy("topic", "subscription").agg(F.min(F.struct("ledger", "entry")).alias("p"))
    return rows.select("topic", "subscription", "p.ledger", "p.entry")


def is_acknowledged(ord_: Column, mark_delete: Column, holes: Column) -> Column:
    return (ord_ <= F.coalesce(mark_delete, F.lit(-1))) | F.coalesce(F.array_contains(holes, ord_), F.lit(False))


def opened(log: DataFrame, subscriptions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The frontier at which each subscription begins.

    A known cursor wins over everything; else a start position leaves what is before it acknowledged; else ``Latest`` leaves
    everything acknowledged and ``Earliest`` nothing. ``subscriptions`` has topic, subscription, start_ord (or null) and initial.
    """
    ends = log.groupBy("topic").agg(F.max("ord").alias("last"))
    rows = subscriptions.join(ends, "topic", "left")
    fresh = F.when(F.col("start_ord").isNotNull(), F.col("start_ord") - 1).when(F.col("initial") == "Latest", F.coalesce("last", F.lit(-1))).otherwise(-1)
    if existing is None:
        return rows.select("topic", "subscription", fresh.cast("long").alias("mark_delete_ord"), F.lit(False).alias("reused"))
    known = existing.select("topic", "subscription", F.col("mark_delete_ord").alias("known"), F.lit(True).alias("_known"))
    rows = rows.join(known, ["topic", "subscription"], "left")
    return rows.select("topic", "subscription", F.when(F.col("_known"), F.col("known")).otherwise(fresh).cast("long").alias("mark_delete_ord"), F.coalesce("_known", F.lit(False)).alias("reused"))


def seek_by_time(log: DataFrame, times: DataFrame) -> DataFrame:
    """Where each ``(topic, publish_time)`` of ``times`` seeks to: the entry after the leading run of earlier ones.

    The run ends at the first entry that isn't earlier; an entry without a time neither ends nor extends it. With no earlier entry that
    is the first entry, with only earlier ones there is none (null).
    """
    asked = times.select("topic", F.col("publish_time").alias("asked"))
    rows = log.select("topic", "ord", "publish_time").join(asked, "topic")
    stops = rows.where("publish_time >= asked").groupBy("topic", "asked").agg(F.min("ord").alias("stop"))
    ends = log.groupBy("topic").agg(F.max("ord").alias("last"))
    run = rows.join(stops, ["topic", "asked"], "left").where("publish_time < asked and (stop is null or ord < stop)")
    run = run.groupBy("topic", "asked").agg(F.max("ord").alias("earlier"))
    found = asked.join(ends, "topic").join(run, ["topic", "asked"], "left")
    target = F.when(F.col("earlier").isNull(), F.lit(0)).when(F.col("earlier") < F.col("last"), F.col("earlier") + 1)
    return found.select("topic", F.col("asked").alias("publish_time"), target.cast("long").alias("ord"))


def sought(log: DataFrame, targets: DataFrame) -> DataFrame:
    """The entries that each subscription gets after a seek to ``ord``: all from there on, with earlier acks forgotten."""
    return log.join(targets.withColumnRenamed("ord", "target"), "topic").where(F.col("ord") >= F.col("target"))


def rewind(open_first: DataFrame, pending: DataFrame) -> DataFrame:
    """Where a takeover reads on: the smaller of the first unacknowledged and the first pending place."""
    first = pending.groupBy("topic", "subscription").agg(F.min("ord").alias("first_pending"))
    rows = open_first.join(first, ["topic", "subscription"], "full")
    return rows.select("topic", "subscription", F.least("first_open", "first_pending").alias("ord"))


def cumulative(acks: DataFrame) -> DataFrame:
    """The frontier after cumulative acks: the last one's place, even if it lies before an earlier one's."""
    return acks.groupBy("topic", "subscription").agg(F.max_by("ord", "seq").alias("mark_delete_ord"))
