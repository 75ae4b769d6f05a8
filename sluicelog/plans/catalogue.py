"""The registered queries of the log engine, each with the SQL that gives the same rows.

The log is the event table: a topic per event type, ledgers of ``LEDGER`` entries. Acknowledged is what ``event_id % 7 <> 3`` says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, names
from ..operators import cursors, folds, redelivery, routing, stats
from ..sources import catalog, log
from ..sources.shared import stored
from ..streaming import live

LEDGER = 500
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOG = f"""log AS (SELECT *, ord // {LEDGER} AS ledger, ord % {LEDGER} AS entry FROM (
  SELECT 'persistent://public/default/' || event_type AS topic, event_id, ts, user_id, 'p' || (user_id % 4) AS producer_name,
    user_id::VARCHAR AS partition_key, props AS payload, epoch_us(ts) // 1000 AS publish_time,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS ord FROM events))"""
ACKS = "acks AS (SELECT topic, ord, event_id FROM log WHERE event_id % 7 <> 3)"
OPEN = "opened AS (SELECT topic, ord, ledger, entry FROM log WHERE event_id % 7 = 3)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def with_log(rest: str, *ctes: str) -> str:
    return "WITH " + ", ".join([LOG, *ctes]) + " " + rest


def the_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.event_log(spark.read.parquet(f"{sf_dir}/events.parquet"), LEDGER)


def kept_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a written table, for queries that read it more than once."""
    return stored(the_log(spark, sf_dir), "log")


def the_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics alone, for queries that need no entries."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit(log.TOPIC_PREFIX), "event_type").alias("topic")).distinct()


def the_acks(rows: DataFrame) -> DataFrame:
    return rows.where("event_id % 7 <> 3").select("topic", F.lit("sub-a").alias("subscription"), "ord")


def the_base(rows: DataFrame, mark: int | None = None) -> DataFrame:
    return rows.select("topic").distinct().select("topic", F.lit("sub-a").alias("subscription"), F.lit(mark).cast("long").alias("mark_delete_ord"))


TOPICS = ["click", "error", "purchase", "signup", "view"]


def consumers(spark: SparkSession, rows: DataFrame, members: list[tuple], subscription: str = "sub-a") -> DataFrame:
    """The same consumers on every topic: (consumer_id, consumer_name, priority)."""
    made = spark.createDataFrame(members, "consumer_id long, consumer_name string, priority int").withColumn("joined", F.col("consumer_id"))
    return rows.select("topic").distinct().join(F.broadcast(made)).withColumn("subscription", F.lit(subscription))


# the log


@query("log_append", with_log("SELECT topic, event_id, ord, ledger, entry, publish_time, producer_name, partition_key FROM log"))
def log_append(spark, sf_dir):
    return the_log(spark, sf_dir).select("topic", "event_id", "ord", "ledger", "entry", "publish_time", "producer_name", "partition_key")


LEDGERS = f"""own AS (SELECT topic, ledger, count(*) AS entries, sum(strlen(payload))::BIGINT AS bytes, min((ts, event_id)) AS first, max((ts, event_id)) AS last FROM log GROUP BY ALL),
nxt AS (SELECT topic, ledger + 1 AS ledger, last AS opened FROM own WHERE entries = {LEDGER}),
led AS (SELECT topic, ledger, coalesce(entries, 0) AS entries, coalesce(bytes, 0) AS bytes, coalesce(entries = {LEDGER}, false) AS closed, coalesce(opened, first) AS o
  FROM own FULL JOIN nxt USING (topic, ledger))"""


@query("ledger_counters", with_log("SELECT topic, ledger, entries, bytes, closed, row_number() OVER (ORDER BY o, topic) - 1 AS ledger_id FROM led", LEDGERS))
def ledger_counters(spark, sf_dir):
    return log.ledgers(the_log(spark, sf_dir), LEDGER).select("topic", "ledger", "entries", "bytes", "closed", "ledger_id")


@query("scan_from_limit", with_log("SELECT topic, ledger, entry, payload FROM log WHERE topic LIKE '%/click' AND (ledger > 2 OR (ledger = 2 AND entry >= 100)) ORDER BY ledger, entry LIMIT 50"))
def scan_from_limit(spark, sf_dir):
    """A positional read; its limit is the operator's own."""
    return log.read_from(the_log(spark, sf_dir), log.TOPIC_PREFIX + "click", 2, 100, 50).select("topic", "ledger", "entry", "payload")


@query("point_lookup", with_log("SELECT topic, ledger, entry, event_id, payload FROM log WHERE topic LIKE '%/view' AND ledger = 1 AND entry = 7"))
def point_lookup(spark, sf_dir):
    return log.point(the_log(spark, sf_dir), log.TOPIC_PREFIX + "view", 1, 7).select("topic", "ledger", "entry", "event_id", "payload")


@query("last_position", with_log("SELECT topic, max(ord) // 500 AS ledger, max(ord) % 500 AS entry FROM log GROUP BY topic"))
def last_position(spark, sf_dir):
    return log.last_positions(the_log(spark, sf_dir))


@query("neighbour_positions", with_log("""SELECT topic, ledger, entry, lag(ledger) OVER w AS prev_ledger, lag(entry) OVER w AS prev_entry, lead(ledger) OVER w AS next_ledger, lead(entry) OVER w AS next_entry
FROM log WINDOW w AS (PARTITION BY topic ORDER BY ord)"""))  # fmt: skip
def neighbour_positions(spark, sf_dir):
    return log.neighbours(the_log(spark, sf_dir), LEDGER)


@query("size_limit", with_log("SELECT topic, count(*) AS n, sum(strlen(payload))::BIGINT AS bytes FROM log WHERE strlen(payload) <= 8 GROUP BY topic"))
def size_limit(spark, sf_dir):
    return log.accepted_sizes(the_log(spark, sf_dir), 8).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))


@query("topic_scan", with_log("SELECT ledger, entry, payload FROM log WHERE topic LIKE '%/purchase'"))
def topic_scan(spark, sf_dir):
    """Write the log as a folder of topics and scan one: only its folder is read."""
    path = live.scratch_path(spark, "log")
    log.write_log(the_log(spark, sf_dir), path)
    return log.scan(spark, path, log.TOPIC_PREFIX + "purchase")


# names, keys and codes

_NAMES = """n AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN 'non-persistent://t' || c_nationkey || '/ns/' || c_name
  WHEN 2 THEN 'persistent://t' || c_nationkey || '/ns/a/' || c_name || '-partition-' || (c_custkey % 4) WHEN 3 THEN 'persistent://t/ns/' || c_name || '-partition-x'
  ELSE 'persistent://t/' || c_name END AS topic FROM customer)"""
_VALID = "regexp_matches(topic, '^(persistent|non-persistent)://([^/]+)/([^/]+)/(.+)$')"


def _part(i: int) -> str:
    return f"CASE WHEN {_VALID} THEN regexp_extract(topic, '^(persistent|non-persistent)://([^/]+)/([^/]+)/(.+)$', {i}) END"


@query("topic_parse", f"""WITH {_NAMES} SELECT c_custkey, topic, {_part(1)} AS domain, {_part(2)} AS tenant, {_part(3)} AS namespace, {_part(4)} AS local,
  regexp_replace(topic, '-partition-[0-9]+$', '') AS logical, coalesce(try_cast(nullif(regexp_extract(topic, '-partition-([+-]?[0-9]+)$', 1), '') AS INTEGER), -1) AS part,
  regexp_replace(topic, '^([^:]+)://([^/]+)/([^/]+)/(.+)$', '\\2/\\3/\\1/\\4') AS ledger_name, CASE WHEN {_VALID} AND topic LIKE 'non-%' THEN 'NonPersistent' ELSE 'Persistent' END AS mode FROM n""")  # fmt: skip
def topic_parse(spark, sf_dir):
    key, name = F.col("c_custkey"), F.col("c_name")
    tenant = F.concat(F.lit("t"), F.col("c_nationkey").cast("string"))
    topic = (
        F.when(key % 5 == 0, name).when(key % 5 == 1, F.concat(F.lit("non-persistent://"), tenant, F.lit("/ns/"), name))
        .when(key % 5 == 2, F.concat(F.lit("persistent://"), tenant, F.lit("/ns/a/"), name, F.lit("-partition-"), (key % 4).cast("string")))
        .when(key % 5 == 3, F.concat(F.lit("persistent://t/ns/"), name, F.lit("-partition-x"))).otherwise(F.concat(F.lit("persistent://t/"), name))
    )
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", topic.alias("topic"))
    t = F.col("topic")
    return rows.select("c_custkey", "topic", names.topic_parts(t).alias("p"), names.logical_topic(t).alias("logical"), names.partition_of(t).alias("part"), names.ledger_name(t).alias("ledger_name"), names.runtime_mode(t).alias("mode")).select(
        "c_custkey", "topic", "p.*", "logical", "part", "ledger_name", "mode"
    )


@query("cursor_name_encode", """SELECT p_partkey, array_to_string(list_transform(range(0, strlen(s)), lambda i: CASE WHEN regexp_matches(chr(('0x' || substr(hex(s), 2 * i + 1, 2))::INTEGER), '^[A-Za-z0-9._~-]$')
  AND ('0x' || substr(hex(s), 2 * i + 1, 2))::INTEGER < 128 THEN chr(('0x' || substr(hex(s), 2 * i + 1, 2))::INTEGER) ELSE '%' || substr(hex(s), 2 * i + 1, 2) END), '') AS encoded
FROM (SELECT p_partkey, p_name || '/é ' || p_type || '~' AS s FROM part)""")  # fmt: skip
def cursor_name_encode(spark, sf_dir):
    raw = F.concat(F.col("p_name"), F.lit("/é "), F.col("p_type"), F.lit("~"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", names.cursor_name(raw).alias("encoded"))


HASHED = f"hashed AS (SELECT *, {hashing.murmur3_sql('partition_key')} % 65536 AS sticky_hash FROM (SELECT DISTINCT partition_key FROM log))"


@query("sticky_key_hash", with_log("SELECT event_id, sticky_hash FROM log JOIN hashed USING (partition_key)", HASHED))
def sticky_key_hash(spark, sf_dir):
    return keyed(the_log(spark, sf_dir)).select("event_id", F.col("sticky_hash").cast("long").alias("sticky_hash"))


def keyed(rows: DataFrame) -> DataFrame:
    key = hashing.sticky_key(F.lit(None).cast("binary"), F.col("partition_key"), F.col("producer_name"), F.col("sequence_id"))
    return rows.withColumn("sticky_hash", hashing.sticky_hash(key))


@query("payload_checksum", "SELECT event_id, list_sum([('0x' || substr(hex(props), 2 * i + 1, 2))::BIGINT FOR i IN range(0, strlen(props))])::BIGINT AS checksum FROM events")
def payload_checksum(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", hashing.byte_sum(F.encode("props", "UTF-8")).alias("checksum"))


@query("protocol_codes", """SELECT n_nationkey, CASE n_nationkey % 6 WHEN 1 THEN 'Shared' WHEN 2 THEN 'Failover' WHEN 3 THEN 'KeyShared' ELSE 'Exclusive' END AS sub_type,
  CASE WHEN n_nationkey % 3 = 1 THEN 'Cumulative' ELSE 'Individual' END AS ack_type, CASE WHEN n_nationkey % 3 = 1 THEN 'Earliest' ELSE 'Latest' END AS initial FROM nation""")  # fmt: skip
def protocol_codes(spark, sf_dir):
    n = F.col("n_nationkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", names.subscription_type(n % 6).alias("sub_type"), names.ack_type(n % 3).alias("ack_type"), names.initial_position(n % 3).alias("initial"))


# cursors

MARKS = """marks AS (SELECT topic, coalesce(min(o.ord), max(l.ord) + 1) - 1 AS mark_delete_ord, count(o.ord) AS backlog, min(o.ord) AS first_open
  FROM log l LEFT JOIN opened o USING (topic, ord) GROUP BY topic)"""
_BACKLOG = """SELECT topic, 'sub-a' AS subscription, mark_delete_ord, backlog, (SELECT count(*) FROM acks a WHERE a.topic = m.topic AND a.ord > m.mark_delete_ord) AS holes,
  first_open // 500 AS ledger, first_open % 500 AS entry FROM marks m"""


@query("subscription_backlog", with_log(_BACKLOG, ACKS, OPEN, MARKS))
def subscription_backlog(spark, sf_dir):
    """Frontier, holes, backlog and first unacknowledged position of a subscription on every topic."""
    rows = kept_log(spark, sf_dir)
    acks, base = the_acks(rows), the_base(rows)
    return cursors.frontiers(rows, acks, base).join(cursors.first_unacked(rows, acks, base), ["topic", "subscription"], "left")


@query("mark_delete_frontier", with_log("SELECT topic, 'sub-a' AS subscription, mark_delete_ord, backlog FROM marks", OPEN.replace("= 3", "= 3 AND ord >= 100"), MARKS))
def mark_delete_frontier(spark, sf_dir):
    """Individual acks on top of a base frontier."""
    rows = kept_log(spark, sf_dir)
    return cursors.frontiers(rows, the_acks(rows), the_base(rows, 99)).select("topic", "subscription", "mark_delete_ord", "backlog")


@query("hole_ranges", with_log("""SELECT topic, 'sub-a' AS subscription, min(ord) AS start_ord, max(ord) AS end_ord FROM (
  SELECT a.topic, a.ord, a.ord - row_number() OVER (PARTITION BY a.topic ORDER BY a.ord) AS island FROM acks a JOIN marks m USING (topic) WHERE a.ord > m.mark_delete_ord) GROUP BY topic, island""", ACKS, OPEN, MARKS))  # fmt: skip
def hole_ranges(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    return cursors.hole_ranges(rows, the_acks(rows), the_base(rows))


@query("first_unacked", with_log("SELECT topic, 'sub-a' AS subscription, min(ord) // 500 AS ledger, min(ord) % 500 AS entry FROM opened GROUP BY topic", OPEN))
def first_unacked(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    return cursors.first_unacked(rows, the_acks(rows), the_base(rows))


@query("cursor_open", with_log("""SELECT topic, subscription, CASE subscription WHEN 'latest' THEN last WHEN 'earliest' THEN -1 WHEN 'start' THEN 41 ELSE 7 END AS mark_delete_ord, subscription = 'known' AS reused
FROM (SELECT topic, max(ord) AS last FROM log GROUP BY topic), (VALUES ('latest'), ('earliest'), ('start'), ('known')) s(subscription)"""))  # fmt: skip
def cursor_open(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    kinds = spark.createDataFrame([("latest", None, "Latest"), ("earliest", None, "Earliest"), ("start", 42, "Latest"), ("known", None, "Latest")], "subscription string, start_ord long, initial string")
    subs = rows.select("topic").distinct().join(F.broadcast(kinds))
    existing = rows.select("topic").distinct().select("topic", F.lit("known").alias("subscription"), F.lit(7).cast("long").alias("mark_delete_ord"))
    return cursors.opened(rows, subs, existing)


@query("seek_message_id", with_log("SELECT topic, 'sub-a' AS subscription, count(*) AS n, min(ord) AS first_ord FROM log WHERE ord >= 1250 GROUP BY topic"))
def seek_message_id(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    targets = the_base(rows).select("topic", "subscription", F.lit(1250).alias("ord"))
    return cursors.sought(rows, targets).groupBy("topic", "subscription").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


_TIMES = [1704067200000, 1705000000000, 1706000000000, 1799999999000]


@query("seek_publish_time", with_log(f"""SELECT topic, t AS publish_time, CASE WHEN n = 0 THEN 0 WHEN n <= last THEN n END::BIGINT AS ord FROM (
  SELECT topic, t, (SELECT count(*) FROM log x WHERE x.topic = e.topic AND x.publish_time < t) AS n, last
  FROM (SELECT topic, max(ord) AS last FROM log GROUP BY topic) e, (VALUES {', '.join(f'({t})' for t in _TIMES)}) v(t))"""))  # fmt: skip
def seek_publish_time(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    times = rows.select("topic").distinct().join(F.broadcast(spark.createDataFrame([(t,) for t in _TIMES], "publish_time long")))
    return cursors.seek_by_time(rows, times)


@query("cumulative_ack", with_log("SELECT topic, 'sub-a' AS subscription, max_by(ord, user_id * 1000000 + event_id) AS mark_delete_ord FROM log WHERE event_id % 11 = 0 GROUP BY topic"))
def cumulative_ack(spark, sf_dir):
    acks = the_log(spark, sf_dir).where("event_id % 11 = 0").select("topic", F.lit("sub-a").alias("subscription"), "ord", (F.col("user_id") * 1000000 + F.col("event_id")).alias("seq"))
    return cursors.cumulative(acks)


@query("failover_takeover", with_log("SELECT topic, 'sub-a' AS subscription, least(min(ord) FILTER (event_id % 7 = 3), min(ord) FILTER (event_id % 13 = 1)) AS ord FROM log GROUP BY topic"))
def failover_takeover(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    first = cursors.unacked(rows, the_acks(rows), the_base(rows)).groupBy("topic", "subscription").agg(F.min("ord").alias("first_open"))
    pending = rows.where("event_id % 13 = 1").select("topic", F.lit("sub-a").alias("subscription"), "ord")
    return cursors.rewind(first, pending)


# routing

_FOUR = [(1, "consumer-a", 0), (2, "consumer-b", 0), (3, "consumer-c", 0), (4, "consumer-d", 5)]


@query("key_shared_autosplit", with_log("SELECT topic, ['1', '2', '3', '4'][1 + ((sticky_hash * 4 + 3) // 65536)]::BIGINT AS consumer_id, count(*) AS n, sum(ord)::BIGINT AS places FROM log JOIN hashed USING (partition_key) GROUP BY ALL", HASHED))
def key_shared_autosplit(spark, sf_dir):
    rows = keyed(the_log(spark, sf_dir))
    owned = routing.split_owner(rows, consumers(spark, rows, _FOUR))
    return owned.groupBy("topic", "consumer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("places"))


@query("split_ranges", "SELECT n AS subscription, i AS consumer_id, ((i - 1) * 65536 // n)::INTEGER AS start, (i * 65536 // n - 1)::INTEGER AS \"end\" FROM (SELECT unnest(range(1, 9)) AS n), LATERAL (SELECT unnest(range(1, n + 1)) AS i)")
def split_ranges(spark, sf_dir):
    rows = spark.range(1, 9).select(F.lit("t").alias("topic"), F.col("id").alias("subscription"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("id"))).alias("consumer_id"))
    return routing.split_ranges(rows).drop("topic")


_RANGES = [(1, 0, 20000, 5), (2, 10000, 40000, 1), (3, 0, 5000, 0), (4, 45000, 65535, 2)]


@query("key_shared_sticky", with_log("""SELECT topic, CASE WHEN sticky_hash <= 20000 THEN 1 WHEN sticky_hash <= 40000 THEN 2 WHEN sticky_hash >= 45000 THEN 4 END::BIGINT AS consumer_id, count(*) AS n
FROM log JOIN hashed USING (partition_key) GROUP BY ALL""", HASHED))  # fmt: skip
def key_shared_sticky(spark, sf_dir):
    """Given ranges that overlap and leave a gap; one consumer has no permits."""
    rows = keyed(the_log(spark, sf_dir))
    ranges = rows.select("topic").distinct().join(F.broadcast(spark.createDataFrame(_RANGES, "consumer_id long, start int, end int, permits long"))).withColumn("subscription", F.lit("sub-a"))
    return routing.range_owner(rows, ranges).groupBy("topic", "consumer_id").agg(F.count(F.lit(1)).alias("n"))


_MEMBERS = [(1, "consumer-a", 1), (3, "consumer-a", 5), (2, "consumer-b", 5), (4, "consumer-c", 1)]


@query("failover_active_persistent", with_log("SELECT DISTINCT topic, 'sub-a' AS subscription, 3::BIGINT AS consumer_id FROM log"))
def failover_active_persistent(spark, sf_dir):
    rows = the_topics(spark, sf_dir)
    return routing.failover_active(consumers(spark, rows, _MEMBERS))


_RING = f"""pts AS (SELECT topic, id, {hashing.murmur3_sql("nm || r")} AS point, {hashing.murmur3_sql("topic")} AS own, slot, r FROM (SELECT DISTINCT topic FROM log),
  (VALUES (1, 'failover-a', 0), (2, 'failover-b', 1)) c(id, nm, slot), (SELECT unnest(range(0, 100)) AS r))"""


@query("failover_active_ring", with_log("SELECT topic, 'sub-a' AS subscription, min_by(id, (point < own, point, slot, r))::BIGINT AS consumer_id FROM pts GROUP BY topic", _RING))
def failover_active_ring(spark, sf_dir):
    rows = the_topics(spark, sf_dir)
    members = consumers(spark, rows, [(1, "failover-a", 0), (2, "failover-b", 0), (3, "failover-0", 5)]).withColumn("partition", F.lit(-1))
    return routing.transient_failover_active(members)


def _partition_owners(part: DataFrame) -> DataFrame:
    parts = part.select(F.concat(F.lit("t-partition-"), F.col("p_partkey").cast("string")).alias("topic"), F.col("p_partkey").alias("partition"))
    members = consumers(part.sparkSession, parts, [(1, "a", 0), (2, "b", 0), (3, "c", 0), (4, "d", 9)]).join(parts, "topic")
    return routing.transient_failover_active(members).join(parts, "topic").select("partition", "consumer_id")


@query("failover_partition_mod", "SELECT p_partkey AS partition, [1, 2, 3][1 + p_partkey % 3]::BIGINT AS consumer_id FROM part")
@query("failover_partition_mod_all", "SELECT p_partkey AS partition, [1, 2, 3][1 + p_partkey % 3]::BIGINT AS consumer_id FROM part")
def failover_partition_mod(spark, sf_dir):
    """Every partition elects; the second name is kept for those who use it."""
    return _partition_owners(spark.read.parquet(f"{sf_dir}/part.parquet"))


@query("shared_round_robin", with_log("SELECT topic, ord, 1 + ord % 3 AS consumer_id FROM log"))
def shared_round_robin(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    return routing.round_robin(rows, consumers(spark, rows, _FOUR[:3])).select("topic", "ord", "consumer_id")


@query("fanout_counts", with_log("SELECT topic, s AS subscription, count(*) AS n, sum(strlen(payload))::BIGINT AS bytes FROM log, (VALUES ('sub-a'), ('sub-b'), ('sub-c')) v(s) GROUP BY ALL"))
def fanout_counts(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    subs = rows.select("topic").distinct().select("topic", F.explode(F.array(*map(F.lit, ("sub-a", "sub-b", "sub-c")))).alias("subscription"))
    return routing.fanned_out(rows, subs).groupBy("topic", "subscription").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))


# redelivery


def _flight(rows: DataFrame) -> DataFrame:
    """What is in flight: every thirteenth event, at consumer 1 to 3, delivered a few times."""
    return rows.where("event_id % 13 = 1").select(
        "topic", F.lit("sub-a").alias("subscription"), "ord", "ledger", "entry", "partition", (F.col("event_id") % 3 + 1).alias("consumer_id"), (F.col("event_id") % 4).alias("redelivery_count"), (F.col("user_id") % 8).cast("int").alias("sticky_hash")
    )


@query("in_flight_exclusion", with_log("SELECT topic, count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord FROM log WHERE event_id % 7 = 3 AND event_id % 13 <> 1 GROUP BY topic"))
def in_flight_exclusion(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    found = redelivery.candidates(rows, the_acks(rows), _flight(rows), the_base(rows))
    return found.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query("redelivery_union", with_log("""SELECT topic, ord, redelivery_count, place FROM (SELECT topic, ord, CASE WHEN event_id % 13 = 1 THEN event_id % 4 ELSE 0 END AS redelivery_count,
  row_number() OVER (PARTITION BY topic ORDER BY event_id % 13 <> 1, ord) AS place FROM log WHERE event_id % 7 = 3) WHERE place <= 17"""))  # fmt: skip
def redelivery_union(spark, sf_dir):
    """What one trigger with 17 permits delivers: queued entries first."""
    rows = kept_log(spark, sf_dir)
    acks = the_acks(rows)
    queue = redelivery.dispatchable(_flight(rows).select("topic", "subscription", "ord", "redelivery_count"), rows, acks)
    new = redelivery.candidates(rows, acks, _flight(rows), the_base(rows))
    permits = the_base(rows).select("topic", "subscription", F.lit(17).alias("total"))
    return redelivery.next_batch(queue, new, permits).select("topic", "ord", "redelivery_count", "place")


@query("redelivery_count_merge", with_log("""SELECT topic, ord % 97 AS ord, max(event_id % 9) AS redelivery_count, min_by(user_id % 8, event_id) FILTER (user_id % 3 > 0)::INTEGER AS sticky_hash FROM log GROUP BY topic, ord % 97"""))
def redelivery_count_merge(spark, sf_dir):
    key = F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 8).cast("int")
    queue = the_log(spark, sf_dir).select("topic", F.lit("sub-a").alias("subscription"), (F.col("ord") % 97).alias("ord"), (F.col("event_id") % 9).alias("redelivery_count"), key.alias("sticky_hash"), F.col("event_id").alias("seq"))
    return redelivery.merged(queue).select("topic", "ord", "redelivery_count", "sticky_hash")


@query("redelivery_request", with_log("SELECT topic, ord, event_id % 4 + 1 AS redelivery_count, (user_id % 8)::INTEGER AS sticky_hash FROM log WHERE event_id % 13 = 1 AND event_id % 7 = 3 AND (event_id % 3 = 0 OR (event_id % 3 = 1 AND ord IN (5, 10, 33)))"))
def redelivery_request(spark, sf_dir):
    """Consumer 1 asks for all that it holds, consumer 2 for three entries."""
    rows = kept_log(spark, sf_dir)
    subs = the_base(rows).select("topic", "subscription", F.lit("KeyShared").alias("sub_type"), F.lit("Persistent").alias("mode"))
    asks = spark.createDataFrame([(1, None), (2, [5, 10, 33])], "consumer_id long, ords array<long>")
    requests = the_base(rows).select("topic", "subscription").join(F.broadcast(asks))
    return redelivery.requested(requests, _flight(rows), the_acks(rows), subs).select("topic", "ord", "redelivery_count", "sticky_hash")


@query("shared_recovery", with_log("SELECT topic, ord, event_id % 4 + 1 AS redelivery_count, (user_id % 8)::INTEGER AS sticky_hash FROM log WHERE event_id % 13 = 1 AND event_id % 7 = 3 AND event_id % 3 = 1"))
def shared_recovery(spark, sf_dir):
    """Consumer 2 leaves."""
    rows = kept_log(spark, sf_dir)
    gone = the_base(rows).select("topic", "subscription", F.lit(2).cast("long").alias("consumer_id"))
    return redelivery.recovered(gone, _flight(rows), the_acks(rows)).select("topic", "ord", "redelivery_count", "sticky_hash")


@query("blocked_hashes", with_log("SELECT topic, (user_id % 8)::INTEGER AS sticky_hash, count(*) AS blockers FROM log WHERE event_id % 13 = 1 AND event_id % 4 IN (1, 3) GROUP BY ALL"))
def blocked_hashes(spark, sf_dir):
    flight = _flight(the_log(spark, sf_dir))
    return redelivery.blocked_hashes(flight.where("redelivery_count = 1"), flight.where("redelivery_count = 3")).select("topic", "sticky_hash", "blockers")


@query("ack_owner", with_log("""SELECT topic, event_id AS seq, event_id % 3 + 1 AS owner, CASE WHEN event_id % 3 = user_id % 3 THEN CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END ELSE CASE WHEN event_id % 2 = 0 THEN 2 ELSE 3 END END AS level
FROM log WHERE event_id % 13 = 1"""))  # fmt: skip
def ack_owner(spark, sf_dir):
    """Acks by consumers that mostly don't hold the entry, half of them with another partition in the id."""
    rows = kept_log(spark, sf_dir)
    acks = rows.select("topic", F.lit("sub-a").alias("subscription"), F.col("event_id").alias("seq"), (F.col("user_id") % 3 + 1).alias("consumer_id"), "ledger", "entry", F.when(F.col("event_id") % 2 == 0, -1).otherwise(7).alias("partition"))
    return redelivery.ack_owners(acks, _flight(rows)).select("topic", "seq", "owner", "level")


@query("valid_acks", with_log("""SELECT topic, s AS sub_type, count(*) AS n FROM log, (VALUES ('Exclusive'), ('Shared')) v(s)
WHERE CASE WHEN event_id % 5 = 0 THEN s = 'Exclusive' WHEN s = 'Exclusive' THEN event_id % 13 = 1 AND event_id % 3 = user_id % 3 ELSE event_id % 13 = 1 END GROUP BY ALL"""))  # fmt: skip
def valid_acks(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    kinds = spark.createDataFrame([("sub-x", "Exclusive"), ("sub-s", "Shared")], "subscription string, sub_type string")
    subs = rows.select("topic").distinct().join(F.broadcast(kinds))
    acks = rows.select("topic", "ord", (F.col("user_id") % 3 + 1).alias("consumer_id"), F.when(F.col("event_id") % 5 == 0, "Cumulative").otherwise("Individual").alias("ack_type")).join(F.broadcast(kinds.select("subscription")))
    flight = _flight(rows).drop("subscription").join(F.broadcast(kinds.select("subscription")))
    return redelivery.valid_acks(acks, flight, subs).groupBy("topic", "sub_type").agg(F.count(F.lit(1)).alias("n"))


# statistics


@query("producer_stats", with_log("SELECT topic, producer_name, count(*) AS messages, sum(strlen(payload))::BIGINT AS bytes, sum(strlen(payload))::DOUBLE / count(*) AS average_size FROM log GROUP BY ALL"))
def producer_stats(spark, sf_dir):
    return stats.producers(the_log(spark, sf_dir))


@query("consumer_stats", with_log("""SELECT topic, 1 + ord % 3 AS consumer_id, count(*) AS messages, sum(strlen(payload))::BIGINT AS bytes, count(*) FILTER (event_id % 7 <> 3) AS acked, greatest(1000 - count(*), 0) AS permits FROM log GROUP BY ALL"""))
def consumer_stats(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    members = consumers(spark, rows, _FOUR[:3])
    sent = routing.round_robin(rows, members)
    flow = members.select("topic", "subscription", "consumer_id", F.lit(1000).alias("permits"))
    return stats.consumers(sent, sent.where("event_id % 7 <> 3"), flow).drop("subscription")


@query("subscription_stats", with_log("""SELECT topic, s AS subscription, CASE s WHEN 'np' THEN 'NonPersistent' ELSE 'Persistent' END AS mode, 4 AS consumers, 40 AS permits, CASE s WHEN 'np' THEN count(*) ELSE 0 END AS received,
  CASE s WHEN 'np' THEN count(*) FILTER (event_id % 5 <> 0) ELSE 0 END AS dispatched, CASE s WHEN 'np' THEN count(*) FILTER (event_id % 5 = 0) ELSE 0 END AS dropped FROM log, (VALUES ('np'), ('p')) v(s) GROUP BY topic, s"""))  # fmt: skip
def subscription_stats(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    both = spark.createDataFrame([("np", "NonPersistent"), ("p", "Persistent")], "subscription string, mode string")
    members = consumers(spark, rows, _FOUR).drop("subscription").join(F.broadcast(both))
    moved = rows.select("topic", (F.col("event_id") % 5 != 0).alias("dispatched")).join(F.broadcast(both.select("subscription")))
    flow = members.select("topic", "subscription", F.lit(10).alias("permits"))
    return stats.subscriptions(members, moved, flow, rows.select("topic").distinct().join(F.broadcast(both)))


@query("drop_rate", with_log("SELECT topic, 'sub-a' AS subscription, count(*) AS received, count(*) FILTER (event_id % 8 <> 0) AS dispatched, count(*) FILTER (event_id % 8 = 0) AS dropped, (count(*) FILTER (event_id % 8 = 0))::DOUBLE / count(*) AS drop_rate FROM log GROUP BY topic"))
def drop_rate(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    return stats.drop_rates(rows.select("topic", F.lit("sub-a").alias("subscription"), (F.col("event_id") % 8 != 0).alias("dispatched")))


_PARTS = "parted AS (SELECT 'persistent://t/n/' || o_orderpriority || '-partition-' || (o_orderkey % 3) AS topic, o_custkey % 5 AS p, o_orderstatus AS s, o_orderkey FROM orders)"


def _partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    topic = F.concat(F.lit("persistent://t/n/"), "o_orderpriority", F.lit("-partition-"), (F.col("o_orderkey") % 3).cast("string"))
    rows = orders.select(topic.alias("topic"), (F.col("o_custkey") % 5).alias("producer_name"), F.col("o_orderstatus").alias("subscription"), "o_orderkey")
    return stats.topics(rows.select("topic").distinct(), rows, rows, rows.where("o_orderkey % 4 = 0"))


@query("topic_stats", f"WITH {_PARTS} SELECT topic, count(DISTINCT p) AS producers, count(DISTINCT s) AS subscriptions, count(*) FILTER (o_orderkey % 4 = 0) AS consumers, array_to_string(list_sort(list_distinct(list(s))), ',') AS names FROM parted GROUP BY topic")
def topic_stats(spark, sf_dir):
    return _partition_stats(spark, sf_dir).withColumn("names", F.array_join("names", ","))


@query("partitioned_stats", f"""WITH {_PARTS}, t AS (SELECT regexp_replace(topic, '-partition-[0-9]+$', '') AS base, regexp_extract(topic, '([0-9]+)$', 1)::INTEGER AS part, count(DISTINCT p) AS producers, count(DISTINCT s) AS subscriptions,
  count(*) FILTER (o_orderkey % 4 = 0) AS consumers FROM parted GROUP BY ALL)
SELECT base, part, sum(producers)::BIGINT AS producers, sum(subscriptions)::BIGINT AS subscriptions, sum(consumers)::BIGINT AS consumers FROM t GROUP BY ROLLUP (base, part) HAVING base IS NOT NULL""")  # fmt: skip
def partitioned_stats(spark, sf_dir):
    return stats.partitioned(_partition_stats(spark, sf_dir))


@query("broker_counters", with_log("SELECT count(*) AS published, sum(strlen(payload))::BIGINT AS bytes, count(*) FILTER (event_id % 8 <> 0) AS delivered, count(*) / 100.0::DOUBLE AS published_rate, (count(*) FILTER (event_id % 8 <> 0)) / 100.0::DOUBLE AS delivered_rate FROM log"))
def broker_counters(spark, sf_dir):
    rows = kept_log(spark, sf_dir)
    return stats.broker(rows, rows.select((F.col("event_id") % 8 != 0).alias("dispatched")), 100.0)


@query("connection_limits", """SELECT seq, ip, nth_of_ip, nth_of_ip <= 20 AND sum((nth_of_ip <= 20)::INTEGER) OVER (ORDER BY seq) <= 800 AS accepted FROM (
  SELECT event_id AS seq, '10.0.0.' || user_id AS ip, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS nth_of_ip FROM events)""")  # fmt: skip
def connection_limits(spark, sf_dir):
    opened = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip"))
    return stats.connections(opened, 800, 20)


@query("idle_topics", "SELECT 'c' || c_custkey AS topic FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P') AND c_custkey % 3 <> 0")
def idle_topics(spark, sf_dir):
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("topic")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus <> 'P'").select(name("o_custkey"))
    return stats.idle_topics(customers.select(name("c_custkey")), orders, customers.where("c_custkey % 3 = 0").select(name("c_custkey")))


# the catalogue

_DOCUMENT = (
    '{"version": 2, "metadata": {"public": {"default": {"persistent": {"a": {"subscriptions": {"s1": {}, "s2": {}}}, "b/c": {"subscriptions": {}}}, "non-persistent": {"n": {"subscriptions": {"s1": {}}}}}}, '
    '"acme": {"eu": {"persistent": {"orders": {"subscriptions": {"billing": {}}}}}}}, "partitioned_topics": {"persistent://public/default/p": {"partitions": 4}, "persistent://public/default/a": {"partitions": 0}}}'
)
_DOCUMENTS = [("good", _DOCUMENT), ("old", '{"topics": []}'), ("broken", "{"), ("next", '{"version": 3}')]


@query("catalog_topics", """SELECT * FROM (VALUES ('persistent://public/default/a', 'persistent', 'public', 'default', 'a', true, 1), ('persistent://public/default/b/c', 'persistent', 'public', 'default', 'b/c', false, 0),
  ('non-persistent://public/default/n', 'non-persistent', 'public', 'default', 'n', false, 0), ('persistent://acme/eu/orders', 'persistent', 'acme', 'eu', 'orders', false, 0),
  ('persistent://public/default/p', 'persistent', 'public', 'default', 'p', true, 4)) v(topic, domain, tenant, namespace, local, partitioned, partition_count)""")  # fmt: skip
def catalog_topics(spark, sf_dir):
    documents = catalog.checked(spark.createDataFrame(_DOCUMENTS, "source string, body string")).where("refused is null")
    return catalog.topics(documents).drop("source")


@query("catalog_subscriptions", """SELECT * FROM (VALUES ('persistent://public/default/a', 's1'), ('persistent://public/default/a', 's2'), ('non-persistent://public/default/n', 's1'), ('persistent://acme/eu/orders', 'billing')) v(topic, subscription)""")
def catalog_subscriptions(spark, sf_dir):
    documents = catalog.checked(spark.createDataFrame(_DOCUMENTS, "source string, body string")).where("refused is null")
    return catalog.subscriptions(documents).drop("source")


@query("catalog_checked", "SELECT * FROM (VALUES ('good', NULL), ('old', 'legacy layout'), ('broken', 'not JSON'), ('next', 'unknown version')) v(source, refused)")
def catalog_checked(spark, sf_dir):
    return catalog.checked(spark.createDataFrame(_DOCUMENTS, "source string, body string")).select("source", "refused")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = nations.select(F.concat(F.lit("persistent://t/n/"), "n_name").alias("topic"), (F.col("n_nationkey") % 3 == 0).alias("partitioned"), F.col("n_regionkey").cast("long").alias("partitions"))
    return catalog.upserted(rows)


@query("partition_metadata", "SELECT 'persistent://t/n/' || n_name AS topic, CASE WHEN n_nationkey % 3 = 0 THEN greatest(n_regionkey, 1) ELSE 2 END::BIGINT AS partitions FROM nation")
def partition_metadata(spark, sf_dir):
    known = _known(spark, sf_dir)
    return catalog.partition_counts(known, known, 2)


@query("topic_resolution", """SELECT b || x AS topic, b AS base, x <> '' AS is_partition, CASE WHEN k % 3 = 0 THEN greatest(r, 1) WHEN x <> '' THEN 0 ELSE 2 END::BIGINT AS partitions, x = '' AS becomes_partitioned
FROM (SELECT 'persistent://t/n/' || n_name AS b, n_nationkey AS k, n_regionkey AS r FROM nation), (VALUES (''), ('-partition-1')) v(x)""")  # fmt: skip
def topic_resolution(spark, sf_dir):
    known = _known(spark, sf_dir)
    asked = known.select(F.explode(F.array("topic", F.concat("topic", F.lit("-partition-1")))).alias("topic"))
    return catalog.resolved(asked, known, 2)


@query("subscription_types", "SELECT 't' || (event_id % 50) AS topic, 's' || (user_id % 7) AS subscription, min_by(event_type, event_id) AS sub_type FROM events GROUP BY ALL")
def subscription_types(spark, sf_dir):
    """The first registration's type wins."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return catalog.first_wins(rows.select(F.concat(F.lit("t"), (F.col("event_id") % 50).cast("string")).alias("topic"), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("subscription"), F.col("event_type").alias("sub_type"), F.col("event_id").alias("seq")))


# folds

_HOUR_US = 3_600_000_000


@query("publish_rate_limit", f"""WITH RECURSIVE {LOG}, f AS (
  SELECT topic, ord, event_id, epoch_us(ts) AS began, 1 AS n, true AS accepted FROM log WHERE ord = 0
  UNION ALL SELECT l.topic, l.ord, l.event_id, CASE WHEN epoch_us(l.ts) - f.began >= {_HOUR_US} THEN epoch_us(l.ts) ELSE f.began END,
    CASE WHEN epoch_us(l.ts) - f.began >= {_HOUR_US} THEN 1 WHEN f.n < 2 THEN f.n + 1 ELSE f.n END, epoch_us(l.ts) - f.began >= {_HOUR_US} OR f.n < 2 FROM f JOIN log l ON l.topic = f.topic AND l.ord = f.ord + 1)
SELECT topic, event_id, accepted FROM f""")  # fmt: skip
def publish_rate_limit(spark, sf_dir):
    """Two publishes an hour, in windows that start with the first publish after the last window."""
    rows = the_log(spark, sf_dir).select("topic", "event_id", F.unix_micros("ts").alias("at_us"), F.octet_length("payload").alias("bytes"))
    return folds.rate_limited(rows, messages=2, width_us=_HOUR_US)


def _published(rows: DataFrame, grants: list[tuple[int, int]]) -> DataFrame:
    """Grants of permits, then all publishes, as events."""
    flow = rows.select("topic").distinct().join(F.broadcast(rows.sparkSession.createDataFrame([(i - len(grants), c, n) for i, (c, n) in enumerate(grants)], "seq long, consumer_id long, n long")))
    flow = flow.select("topic", "seq", F.lit("flow").alias("kind"), "consumer_id", "n")
    return flow.unionByName(rows.select("topic", F.col("ord").alias("seq"), F.lit("publish").alias("kind"), F.lit(None).cast("long").alias("consumer_id"), F.col("sticky_hash").cast("long").alias("n")))


@query("np_exclusive_drop", with_log("SELECT topic, ord AS seq, CASE WHEN ord < 300 THEN 1 END::BIGINT AS consumer_id FROM log"))
def np_exclusive_drop(spark, sf_dir):
    return folds.transient(_published(keyed(the_log(spark, sf_dir)), [(1, 100), (1, 200)]), "Exclusive", [(1, 0)])


_PROBING = f"""WITH RECURSIVE {LOG}, f AS (
  SELECT topic, -1::BIGINT AS seq, NULL::BIGINT AS consumer_id, 100 AS a, 200 AS b, 200 AS c, 0::BIGINT AS turn FROM log WHERE ord = 0
  UNION ALL SELECT topic, seq, to_, a - (to_ IS NOT DISTINCT FROM 1)::INTEGER, b - (to_ IS NOT DISTINCT FROM 2)::INTEGER, c - (to_ IS NOT DISTINCT FROM 3)::INTEGER, turn + (a + b + c > 0)::INTEGER FROM (
    SELECT l.topic, l.ord AS seq, f.a, f.b, f.c, f.turn,
      CASE f.turn % 3 WHEN 0 THEN CASE WHEN a > 0 THEN 1 WHEN b > 0 THEN 2 WHEN c > 0 THEN 3 END
        WHEN 1 THEN CASE WHEN b > 0 THEN 2 WHEN c > 0 THEN 3 WHEN a > 0 THEN 1 END
        ELSE CASE WHEN c > 0 THEN 3 WHEN a > 0 THEN 1 WHEN b > 0 THEN 2 END END::BIGINT AS to_
    FROM f JOIN log l ON l.topic = f.topic AND l.ord = f.seq + 1))
SELECT topic, seq, consumer_id FROM f WHERE seq >= 0"""


@query("np_shared_drop", _PROBING)
@query("np_shared_drop_probing", with_log("SELECT topic, ord AS seq, CASE WHEN ord < 300 THEN 1 + ord % 3 WHEN ord < 450 THEN CASE WHEN ord % 3 = 2 THEN 3 ELSE 2 END WHEN ord < 500 THEN 3 END::BIGINT AS consumer_id FROM log"))
def np_shared_drop(spark, sf_dir):
    """Every turn of three consumers: from 300 on the first one's go to the second, from 450 on all go to the third, from 500 on all drop.

    Held against two statements of the same rows: one walks the turns, the other is their closed form.
    """
    return folds.transient(_published(keyed(the_log(spark, sf_dir)), [(1, 100), (2, 200), (3, 200)]), "Shared", [(1, 0), (2, 0), (3, 5)])


@query("np_key_shared_drop", with_log("SELECT topic, ord AS seq, CASE WHEN nth <= 400 THEN 1 + slot END::BIGINT AS consumer_id FROM (SELECT *, row_number() OVER (PARTITION BY topic, slot ORDER BY ord) AS nth FROM (SELECT *, (sticky_hash * 3 + 2) // 65536 AS slot FROM log JOIN hashed USING (partition_key)))", HASHED))
def np_key_shared_drop(spark, sf_dir):
    return folds.transient(_published(keyed(the_log(spark, sf_dir)), [(1, 400), (2, 400), (3, 400)]), "KeyShared", [(1, 0), (2, 0), (3, 0)])


def _history(rows: DataFrame, members: list[tuple[int, int, int]]) -> DataFrame:
    """Consumers (id, priority, permits) join and are granted permits, then all is published; every fifth entry is acked by its consumer in turn."""
    spark, n = rows.sparkSession, len(members)
    start = [(2 * i - 2 * n, "join", c, p, f"c{c}") for i, (c, p, _) in enumerate(members)] + [(2 * i + 1 - 2 * n, "flow", c, k, None) for i, (c, _, k) in enumerate(members)]
    first = rows.select("topic").distinct().join(F.broadcast(spark.createDataFrame(start, "seq long, kind string, consumer_id long, n long, name string")))
    none = lambda kind: F.lit(None).cast(kind)
    first = first.select("topic", "seq", "kind", "consumer_id", none("long").alias("ord"), "n", "name")
    published = rows.select("topic", (F.col("ord") * 2).alias("seq"), F.lit("publish").alias("kind"), none("long").alias("consumer_id"), "ord", F.col("sticky_hash").cast("long").alias("n"), none("string").alias("name"))
    acked = rows.where("ord % 5 = 0").select("topic", (F.col("ord") * 2 + 1).alias("seq"), F.lit("ack").alias("kind"), F.lit(1).cast("long").alias("consumer_id"), "ord", none("long").alias("n"), none("string").alias("name"))
    return first.unionByName(published).unionByName(acked).withColumn("subscription", F.lit("sub-a"))


_ALL_SHARED = with_log("SELECT topic, 'sub-a' AS subscription, ord * 2 AS seq, 1 + ord % 3 AS consumer_id, ord, 0::BIGINT AS redelivery_count FROM log")
_AMPLE = [(1, 0, 10**9), (2, 0, 10**9), (3, 0, 10**9)]


@query("shared_dispatch", _ALL_SHARED)
def shared_dispatch(spark, sf_dir):
    """The dispatch history of three equal consumers with ample permits, event by event."""
    return folds.dispatched(_history(keyed(the_log(spark, sf_dir)), _AMPLE), "Shared")


@query("shared_priority_permits", with_log("SELECT topic, ord, CASE WHEN ord < 50 THEN 1 WHEN ord < 150 THEN 2 + ord % 2 END::BIGINT AS consumer_id FROM log WHERE ord < 150"))
def shared_priority_permits(spark, sf_dir):
    """The consumer of the smaller priority number gets all until its permits are used up; two others then share."""
    return folds.dispatched(_history(keyed(the_log(spark, sf_dir)), [(1, 0, 50), (2, 1, 50), (3, 1, 50)]), "Shared").select("topic", "ord", "consumer_id")


@query("key_shared_dispatch", with_log("SELECT topic, ord, 1 + (sticky_hash * 3 + 2) // 65536 AS consumer_id FROM log JOIN hashed USING (partition_key)", HASHED))
def key_shared_dispatch(spark, sf_dir):
    return folds.dispatched(_history(keyed(the_log(spark, sf_dir)), _AMPLE), "KeyShared").select("topic", "ord", "consumer_id")


@query("failover_dispatch", with_log("SELECT topic, ord, 2::BIGINT AS consumer_id FROM log WHERE ord < 120"))
def failover_dispatch(spark, sf_dir):
    """Only the active consumer, that of the largest priority number, gets messages, as long as it has permits."""
    return folds.dispatched(_history(keyed(the_log(spark, sf_dir)), [(1, 1, 1000), (2, 7, 120)]), "Failover").select("topic", "ord", "consumer_id")


@query("stream_ack_frontier", with_log("SELECT topic, 'sub-a' AS subscription, mark_delete_ord, (SELECT count(*) FROM acks a WHERE a.topic = m.topic AND a.ord > m.mark_delete_ord) AS holes FROM marks m", ACKS, OPEN, MARKS))
def stream_ack_frontier(spark, sf_dir):
    stream = live.replayed(the_acks(the_log(spark, sf_dir)), "ord")
    return live.latest(live.drained(live.ack_frontiers(stream)), "topic", "subscription")


@query("stream_shared_dispatch", _ALL_SHARED)
def stream_shared_dispatch(spark, sf_dir):
    stream = live.replayed(_history(keyed(the_log(spark, sf_dir)), _AMPLE), "seq")
    return live.drained(live.dispatches(stream, "Shared")).drop("batch", "part")


# histories with consumers that come and go

_EVENT = "seq long, kind string, consumer_id long, ord long, n long, name string, ranges array<int>"


def _with_events(rows: DataFrame, events: list[tuple], acked: str | None = None) -> DataFrame:
    """All publishes at ``seq = 4 * ord``, the acks by consumer 1 of those that ``acked`` holds for right after, and the same other events on every topic.

    An event is ``(seq, kind, consumer, ord, n, name, ranges)``; one whose seq is over 10**9 comes after all publishes.
    """
    made = rows.sparkSession.createDataFrame([(*e, *[None] * 7)[:7] for e in events], _EVENT)
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["topic", "seq", "kind", "consumer_id", "ord", "n", "name", "ranges"]
    told = rows.select("topic").distinct().join(F.broadcast(made)).select(*columns)
    event = lambda kind, at, consumer, n: [(F.col("ord") * 4 + at).alias("seq"), F.lit(kind).alias("kind"), consumer.alias("consumer_id"), F.col("ord"), n.alias("n"), none("string").alias("name"), none("array<int>").alias("ranges")]
    out = told.unionByName(rows.select("topic", *event("publish", 0, none("long"), F.col("sticky_hash").cast("long"))))
    if acked:
        out = out.unionByName(rows.where(acked).select("topic", *event("ack", 1, F.lit(1).cast("long"), none("long"))))
    return out.withColumn("subscription", F.lit("sub-a"))


def _joined(consumer: int, permits: int = 10**9, at: int = -100, priority: int = 0, name: str | None = None, ranges: list[int] | None = None) -> list[tuple]:
    return [(at + 2 * consumer, "join", consumer, None, priority, name or f"c{consumer}", ranges), (at + 2 * consumer + 1, "flow", consumer, None, permits)]


_END = 2 * 10**9


@query("shared_leave_join", f"""WITH RECURSIVE {LOG}, f AS (
  SELECT topic, -1::BIGINT AS ord, NULL::BIGINT AS consumer_id, 0::BIGINT AS turn FROM log WHERE ord = 0
  UNION ALL SELECT topic, ord, order_[1 + turn % len(order_)]::BIGINT, (turn % len(order_) + 1) % len(order_) FROM (
    SELECT l.topic, l.ord, CASE WHEN l.ord < 40 THEN [1, 2, 3] WHEN l.ord < 75 THEN [1, 2, 3, 4] ELSE [2, 3, 4] END AS order_,
      CASE WHEN l.ord = 75 THEN CASE WHEN f.turn > 0 THEN f.turn - 1 ELSE f.turn % 3 END ELSE f.turn END AS turn FROM f JOIN log l ON l.topic = f.topic AND l.ord = f.ord + 1))
SELECT topic, ord, consumer_id FROM f WHERE ord >= 0""")  # fmt: skip
def shared_leave_join(spark, sf_dir):
    """A fourth consumer joins before entry 40, the first one leaves before entry 75: turns go on with whom they would have come to."""
    events = [e for c in (1, 2, 3) for e in _joined(c)] + _joined(4, at=4 * 39 - 6) + [(4 * 74 + 2, "leave", 1)]
    return folds.dispatched(_with_events(keyed(the_log(spark, sf_dir)), events, "ord >= 0"), "Shared").select("topic", "ord", "consumer_id")


@query("shared_redelivery", with_log("""SELECT topic, ord, 1 + ord % 3 AS consumer_id, 0::BIGINT AS redelivery_count FROM log UNION ALL
SELECT topic, ord, [1, 3][1 + (t + k) % 2]::BIGINT, 1::BIGINT FROM (SELECT topic, ord, (ord - 1) // 3 AS k, CASE (max(ord) OVER (PARTITION BY topic) + 1) % 3 WHEN 2 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS t FROM log) WHERE ord % 3 = 1 AND k < 20"""))  # fmt: skip
def shared_redelivery(spark, sf_dir):
    """The second of three consumers leaves at the end with all that it holds; one trigger delivers twenty of these again, counted."""
    events = [e for c in (1, 2, 3) for e in _joined(c)] + [(_END, "leave", 2)]
    return folds.dispatched(_with_events(keyed(the_log(spark, sf_dir)), events), "Shared").select("topic", "ord", "consumer_id", "redelivery_count")


@query("shared_negative_ack", with_log("""SELECT topic, ord, 1::BIGINT AS consumer_id, 0::BIGINT AS redelivery_count FROM log UNION ALL
SELECT topic, ord, 1::BIGINT, 1::BIGINT FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ord) AS nth FROM log WHERE event_id % 7 = 3) WHERE nth <= 20"""))  # fmt: skip
def shared_negative_ack(spark, sf_dir):
    """A consumer acks most entries and asks for the rest again: what is acked stays away."""
    rows = keyed(the_log(spark, sf_dir))
    return folds.dispatched(_with_events(rows, [*_joined(1), (_END, "redeliver", 1)], "event_id % 7 <> 3"), "Shared").select("topic", "ord", "consumer_id", "redelivery_count")


@query("key_shared_redelivery", with_log("""SELECT topic, ord, 1 + (sticky_hash * 2 + 1) // 65536 AS consumer_id, 0::BIGINT AS redelivery_count FROM log JOIN hashed USING (partition_key) UNION ALL
SELECT topic, ord, 1::BIGINT, 1::BIGINT FROM (SELECT topic, ord, row_number() OVER (PARTITION BY topic ORDER BY ord) AS nth FROM (
  SELECT topic, min(ord) AS ord FROM log JOIN hashed USING (partition_key) WHERE (sticky_hash * 2 + 1) // 65536 = 1 GROUP BY topic, sticky_hash)) WHERE nth <= 20""", HASHED))  # fmt: skip
def key_shared_redelivery(spark, sf_dir):
    """One of two consumers leaves; the first entry of each of its keys goes to the other one, and blocks the rest of its key until it is acked."""
    events = [*_joined(1), *_joined(2), (_END, "leave", 2)]
    return folds.dispatched(_with_events(keyed(the_log(spark, sf_dir)), events), "KeyShared").select("topic", "ord", "consumer_id", "redelivery_count")


@query("key_shared_given_ranges", with_log("SELECT topic, ord, CASE WHEN sticky_hash <= 20000 THEN 1 WHEN sticky_hash <= 40000 THEN 2 ELSE 3 END::BIGINT AS consumer_id FROM log JOIN hashed USING (partition_key)", HASHED))
def key_shared_given_ranges(spark, sf_dir):
    """Consumers choose their hash ranges, which overlap: the first by its bounds has the key."""
    events = _joined(1, ranges=[0, 20000]) + _joined(2, ranges=[10000, 40000]) + _joined(3, ranges=[60000, 65535, 40001, 59999])
    return folds.dispatched(_with_events(keyed(the_log(spark, sf_dir)), events), "KeyShared").select("topic", "ord", "consumer_id")


@query("exclusive_handover", with_log("""SELECT topic, ord, 1::BIGINT AS consumer_id FROM log WHERE ord < 70 UNION ALL SELECT topic, ord, 2::BIGINT FROM (
  SELECT topic, ord, row_number() OVER (PARTITION BY topic ORDER BY ord) AS nth FROM log WHERE ord >= 70 OR event_id % 7 = 3) WHERE nth <= 15"""))  # fmt: skip
def exclusive_handover(spark, sf_dir):
    """A second consumer is refused while the first is there; when it has left, another one reads again from the first entry that isn't acked."""
    events = _joined(1, 70) + _joined(3, 5) + [(_END, "leave", 1), (_END + 1, "join", 2, None, 0, "late"), (_END + 2, "flow", 2, None, 15)]
    return folds.dispatched(_with_events(keyed(the_log(spark, sf_dir)), events, "event_id % 7 <> 3"), "Exclusive").select("topic", "ord", "consumer_id")


@query("unsubscribe_resubscribe", with_log("SELECT topic, ord, 1::BIGINT AS consumer_id FROM log UNION ALL SELECT topic, ord, 2::BIGINT FROM log WHERE ord < 5"))
def unsubscribe_resubscribe(spark, sf_dir):
    """All is acked, then the cursor goes; who subscribes next begins at the start of the log."""
    events = _joined(1) + [(_END, "unsubscribe"), (_END + 1, "join", 2, None, 0, "new"), (_END + 2, "flow", 2, None, 5)]
    return folds.dispatched(_with_events(keyed(the_log(spark, sf_dir)), events, "ord >= 0"), "Shared").select("topic", "ord", "consumer_id")


@query("np_dynamic_consumers", with_log("SELECT topic, 4 * ord AS seq, CASE WHEN ord < 40 THEN [1, 2][1 + ord % 2] WHEN ord < 75 THEN [1, 3, 2][1 + ord % 3] ELSE [3, 2][1 + ord % 2] END::BIGINT AS consumer_id FROM log"))
def np_dynamic_consumers(spark, sf_dir):
    """Transient delivery while consumers come and go; turns are counted on, and order is by priority and id."""
    events = _joined(1) + _joined(2, priority=3) + _joined(3, at=4 * 39 - 5, priority=1) + [(4 * 74 + 1, "leave", 1)]
    return folds.transient(_with_events(keyed(the_log(spark, sf_dir)), events), "Shared")


@query("np_failover_drop", with_log("SELECT topic, 4 * ord AS seq, CASE WHEN ord < 60 THEN (SELECT min_by(id, (point < own, point, slot, r)) FROM pts p WHERE p.topic = log.topic) WHEN ord < 90 THEN 3 END::BIGINT AS consumer_id FROM log", _RING))
def np_failover_drop(spark, sf_dir):
    """The successor of the topic on the ring of the smallest priority number is active; when both have left, the last one is until its permits end."""
    events = _joined(1, name="failover-a") + _joined(2, name="failover-b") + _joined(3, 30, priority=5, name="failover-0") + [(4 * 59 + 1, "leave", 1), (4 * 59 + 2, "leave", 2)]
    return folds.transient(_with_events(keyed(the_log(spark, sf_dir)), events), "Failover")


@query("np_fence", with_log("SELECT topic, 4 * ord AS seq, CASE WHEN ord < 80 THEN 1 + ord % 2 END::BIGINT AS consumer_id FROM log"))
def np_fence(spark, sf_dir):
    """After a fence nobody is served, whatever permits are granted later."""
    events = _joined(1) + _joined(2) + [(4 * 79 + 1, "fence"), (4 * 79 + 2, "flow", 1, None, 99)]
    return folds.transient(_with_events(keyed(the_log(spark, sf_dir)), events), "Shared")


@query("np_key_shared_given_ranges", with_log("SELECT topic, 4 * ord AS seq, CASE WHEN sticky_hash <= 20000 THEN 1 WHEN sticky_hash BETWEEN 45000 AND 65535 THEN 2 END::BIGINT AS consumer_id FROM log JOIN hashed USING (partition_key)", HASHED))
def np_key_shared_given_ranges(spark, sf_dir):
    """Keys in the gap between given ranges are dropped."""
    events = _joined(1, ranges=[0, 20000]) + _joined(2, ranges=[45000, 65535])
    return folds.transient(_with_events(keyed(the_log(spark, sf_dir)), events), "KeyShared")


# predicates, names and statistics that other queries only use inside


@query("acknowledged_positions", with_log("SELECT topic, ord, event_id % 7 <> 3 OR ord < 20 AS acknowledged FROM log"))
def acknowledged_positions(spark, sf_dir):
    """Each position against a frontier at 19 and the hole set above it, as an array per subscription for a hundred entries at a time."""
    rows = kept_log(spark, sf_dir)
    block = F.floor(F.col("ord") / 100)
    holes = rows.where("event_id % 7 <> 3 and ord > 19").groupBy("topic", block.alias("block")).agg(F.collect_set("ord").alias("holes"))
    marked = rows.withColumn("block", block).join(holes, ["topic", "block"], "left")
    return marked.select("topic", "ord", cursors.is_acknowledged(F.col("ord"), F.lit(19), F.col("holes")).alias("acknowledged"))


@query("key_policy_compatible", "SELECT 't' || (o_custkey % 40) AS topic, o_orderpriority AS subscription, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN 'Sticky' ELSE 'AutoSplit' END) = 1 AS agrees FROM orders GROUP BY ALL")
def key_policy_compatible(spark, sf_dir):
    """Consumers without a policy count as AutoSplit."""
    mode = F.when(F.col("o_orderstatus") == "P", "Sticky").when(F.col("o_orderstatus") == "O", "AutoSplit")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return routing.compatible(orders.select(F.concat(F.lit("t"), (F.col("o_custkey") % 40).cast("string")).alias("topic"), F.col("o_orderpriority").alias("subscription"), mode.alias("key_mode")))


@query("wire_size", "SELECT event_id, 18 + strlen(event_type) + 0 + strlen(props) AS bytes, greatest(ceil(length(bin(event_id)) / 7.0), 1)::INTEGER AS varint_bytes FROM events")
def wire_size(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = hashing.wire_size(F.lit(None).cast("binary"), F.encode("props", "UTF-8"), F.encode("event_type", "UTF-8"))
    return rows.select("event_id", size.cast("long").alias("bytes"), hashing.varint_length(F.col("event_id")).alias("varint_bytes"))


@query("default_metadata", with_log("SELECT topic, ord, CASE WHEN event_id % 3 = 0 THEN entry ELSE event_id END AS sequence_id FROM log"))
def default_metadata(spark, sf_dir):
    """Every third message has no metadata of its own."""
    rows = the_log(spark, sf_dir)
    own = F.when(F.col("event_id") % 3 != 0, F.col("event_id"))
    return rows.select("topic", "ord", names.default_sequence(own, F.col("entry")).alias("sequence_id"))


@query("find_consumer", "SELECT c_custkey AS consumer_id, CASE WHEN c_custkey % 4 = 0 THEN 's' || c_nationkey END AS subscription FROM customer")
def find_consumer(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("consumer_id"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("subscription"))
    return stats.find_members(rows, rows.where("consumer_id % 4 = 0"))


@query("unpartitioned_stats", """SELECT topic, count(DISTINCT p) AS producers FROM (SELECT 'persistent://t/n/' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN '-partition-1' ELSE '' END AS topic, o_custkey % 5 AS p FROM orders)
WHERE topic NOT LIKE '%-partition-1' GROUP BY topic""")  # fmt: skip
def unpartitioned_stats(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    topic = F.concat(F.lit("persistent://t/n/"), "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "-partition-1").otherwise(""))
    rows = orders.select(topic.alias("topic"), (F.col("o_custkey") % 5).alias("producer_name"), F.lit("s").alias("subscription"))
    return stats.unpartitioned(stats.topics(rows.select("topic").distinct(), rows, rows, rows)).select("topic", "producers")


@query("total_permits", "SELECT 't' || (l_suppkey % 20) AS topic, l_returnflag AS subscription, sum(l_linenumber)::BIGINT AS permits FROM lineitem GROUP BY ALL")
def total_permits(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return stats.total_permits(rows.select(F.concat(F.lit("t"), (F.col("l_suppkey") % 20).cast("string")).alias("topic"), F.col("l_returnflag").alias("subscription"), F.col("l_linenumber").alias("permits")))


@query("key_builders", "SELECT n_nationkey, n_name || '/' || n_regionkey AS namespace, 'persistent://' || n_name || ':sub' || n_regionkey AS subscription FROM nation")
def key_builders(spark, sf_dir):
    region = F.col("n_regionkey").cast("string")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return rows.select("n_nationkey", names.namespace_key(F.col("n_name"), region).alias("namespace"), names.subscription_key(F.concat(F.lit("persistent://"), "n_name"), F.concat(F.lit("sub"), region)).alias("subscription"))


@query("log_file_numbers", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey WHEN 3 THEN NULL ELSE NULL END AS number FROM part")
def log_file_numbers(spark, sf_dir):
    """``N.log`` has a number; other endings and names have none."""
    key, text = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    name = F.concat(F.when(key == 3, "x").otherwise(""), text, F.when(key == 1, ".txt").when(key == 2, ".log.old").otherwise(".log"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", names.log_file_number(name).alias("number"))


@query("advertised_urls", "SELECT s_suppkey, 'broker://' || CASE WHEN s_suppkey % 3 < 2 THEN '127.0.0.1' ELSE '10.0.0.' || s_nationkey END || ':' || (6000 + s_suppkey) AS url FROM supplier")
def advertised_urls(spark, sf_dir):
    key = F.col("s_suppkey")
    host = F.when(key % 3 == 0, "0.0.0.0").when(key % 3 == 1, "::").otherwise(F.concat(F.lit("10.0.0."), F.col("s_nationkey").cast("string")))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", names.advertised_url(F.lit("broker"), host, key + 6000).alias("url"))


@query("live_producers", """SELECT topic, producer_id, name FROM (SELECT 't' || (user_id % 9) AS topic, event_id % 40 AS producer_id, arg_max(event_type, event_id) AS last, 'p' || max(event_id) AS name FROM events GROUP BY ALL) WHERE last <> 'error'""")
def live_producers(spark, sf_dir):
    """A registration takes the place of an older one with the same id; an error event stands for a removal."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("register")
    named = rows.select(F.concat(F.lit("t"), (F.col("user_id") % 9).cast("string")).alias("topic"), (F.col("event_id") % 40).alias("producer_id"), kind.alias("kind"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("name"), F.col("event_id").alias("seq"))
    return stats.live_members(named)


@query("log_files", with_log("SELECT topic, count(*) AS entries, true AS bounded FROM log GROUP BY topic"))
def log_files(spark, sf_dir):
    """The log written in files of at most 400 entries and read back by file."""
    path = live.scratch_path(spark, "log")
    log.write_log(the_log(spark, sf_dir), path, most_records=400)
    files = spark.read.parquet(path).groupBy("topic", F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy("topic").agg(F.sum("n").alias("entries"), (F.max("n") <= 400).alias("bounded"))


@query("catalog_round_trip", """SELECT 'persistent://t' || c_nationkey || '/n' || (c_custkey % 3) || '/' || c_name AS topic, 't' || c_nationkey AS tenant, 'n' || (c_custkey % 3) AS namespace, c_custkey % 4 = 0 AS partitioned,
  CASE WHEN c_custkey % 4 = 0 THEN 1 + c_custkey % 7 ELSE 0 END AS partition_count FROM customer""")  # fmt: skip
def catalog_round_trip(spark, sf_dir):
    """Flat tables written as a document per tenant and read back."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    topic = F.concat(F.lit("persistent://t"), F.col("c_nationkey").cast("string"), F.lit("/n"), (F.col("c_custkey") % 3).cast("string"), F.lit("/"), "c_name")
    flat = catalog.upserted(rows.select(topic.alias("topic"), (F.col("c_custkey") % 4 == 0).alias("partitioned"), (1 + F.col("c_custkey") % 7).cast("long").alias("partitions")))
    subs = flat.select("topic", F.lit("s").alias("subscription"))
    path = live.scratch_path(spark, "catalogue")
    catalog.write_documents(flat, subs, path)
    back = catalog.topics(catalog.checked(catalog.read_documents(spark, path, lines=True)).where("refused is null"))
    return back.select("topic", "tenant", "namespace", "partitioned", "partition_count")


@query("catalog_parents", "SELECT DISTINCT 't' || c_nationkey AS tenant, 'n' || (c_custkey % 3) AS namespace FROM customer")
def catalog_parents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    topic = F.concat(F.lit("persistent://t"), F.col("c_nationkey").cast("string"), F.lit("/n"), (F.col("c_custkey") % 3).cast("string"), F.lit("/"), "c_name")
    return catalog.parents(rows.select(topic.alias("topic")))


@query("partition_restore", "SELECT 't' || (o_custkey % 300) AS topic, arg_max(o_orderkey % 9, o_orderkey) AS partitions FROM orders GROUP BY ALL")
def partition_restore(spark, sf_dir):
    """Of repeated entries of the partition map the last one stays, even if it is smaller."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return catalog.restored(rows.select(F.concat(F.lit("t"), (F.col("o_custkey") % 300).cast("string")).alias("topic"), (F.col("o_orderkey") % 9).alias("partitions"), F.col("o_orderkey").alias("seq")))


@query("start_positions", f"""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Earliest' WHEN 1 THEN 'Latest' WHEN 2 THEN 'Latest' ELSE 'Earliest' END AS initial, CASE n_nationkey % 4 WHEN 2 THEN n_nationkey END AS start_ledger FROM nation""")
def start_positions(spark, sf_dir):
    """What a subscribe asks for: the earliest or the latest sentinel, an id, or only an initial position."""
    key = F.col("n_nationkey")
    ledger = F.when(key % 4 == 0, F.lit(-1)).when(key % 4 == 1, F.lit(names.LATEST_SENTINEL)).when(key % 4 == 2, key).cast("long")
    code = F.when(key % 4 == 3, 1).otherwise(0)
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", names.start_position(ledger, ledger, code).alias("s")).select("n_nationkey", "s.initial", "s.start_ledger")


@query("last_message_id", with_log("SELECT topic, max(ord) // 500 AS ledger, max(ord) % 500 AS entry, NULL::VARCHAR AS error FROM log GROUP BY topic UNION ALL SELECT 'persistent://public/default/silent', NULL, NULL, 'Topic has no messages' UNION ALL SELECT 'non-persistent://public/default/x', NULL, NULL, 'non-persistent topic'"))
def last_message_id(spark, sf_dir):
    """The last id of each asked topic; an empty or a transient one has an error instead."""
    rows = kept_log(spark, sf_dir)
    more = spark.createDataFrame([("persistent://public/default/silent",), ("non-persistent://public/default/x",)], "topic string")
    return log.last_message_ids(rows.select("topic").distinct().unionByName(more), rows)
