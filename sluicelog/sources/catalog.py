"""The metadata catalogue: nested JSON documents and the flat tables that they stand for."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from ..functions.names import is_partition, logical_topic, topic_parts

VERSION = 2
_SUBS = T.StructType([T.StructField("subscriptions", T.MapType(T.StringType(), T.StringType()))])
#: tenant -> namespace -> domain -> topic -> subscriptions
TREE = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), _SUBS))))
PARTITIONED = T.MapType(T.StringType(), T.StructType([T.StructField("partitions", T.LongType())]))
RESERVED = ("version", "partitioned_topics")


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(source, body)`` of every JSON document in a folder: a file each, or with ``lines`` a line each."""
    if lines:
        return spark.read.text(path).select(F.concat_ws("#", F.input_file_name(), F.monotonically_increasing_id().cast("string")).alias("source"), F.col("value").alias("body"))
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("body"))


def checked(documents: DataFrame) -> DataFrame:
    """``documents`` with the version and a reason why one is refused (null: it is fine): no JSON, an old layout, another version."""
    parsed = F.try_parse_json("body")
    version = F.try_variant_get(parsed, "$.version", "long")
    reason = F.when(parsed.isNull(), "not JSON").when(version.isNull(), "legacy layout").when(version != VERSION, "unknown version")
    return documents.withColumns({"version": version, "refused": reason})


def _trees(documents: DataFrame) -> DataFrame:
    top = F.from_json("body", T.MapType(T.StringType(), T.StringType()))
    return documents.select("source", F.explode(top).alias("root", "tree")).where(~F.col("root").isin(*RESERVED))


def topics(documents: DataFrame) -> DataFrame:
    """``(source, topic, domain, tenant, namespace, local, partitioned, partition_count)`` of every topic in the documents.

    A topic that is listed as partitioned has one partition at least and wins over the same topic that isn't.
    """
    rows = _trees(documents).select("source", F.explode(F.from_json("tree", TREE)).alias("tenant", "a")).select("source", "tenant", F.explode("a").alias("namespace", "b"))
    rows = rows.select("source", "tenant", "namespace", F.explode("b").alias("domain", "c")).select("source", "tenant", "namespace", "domain", F.explode("c").alias("local", "d"))
    name = F.concat(F.col("domain"), F.lit("://"), F.concat_ws("/", "tenant", "namespace", "local"))
    plain = rows.select("source", name.alias("topic"), F.lit(0).cast("long").alias("partitions"), F.lit(False).alias("partitioned"))
    top = F.from_json("body", T.MapType(T.StringType(), T.StringType()))
    listed = documents.select("source", F.explode(F.from_json(F.try_element_at(top, F.lit("partitioned_topics")), PARTITIONED)).alias("topic", "p"))
    listed = listed.select("source", "topic", F.greatest(F.coalesce("p.partitions", F.lit(1)), F.lit(1)).alias("partitions"), F.lit(True).alias("partitioned"))
    return upserted(plain.unionByName(listed), ["source"])


def upserted(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per topic of repeated registrations: partitioned wins, with the largest count; names are taken apart."""
    keys = [*(keys or []), "topic"]
    merged = rows.groupBy(*keys).agg(F.max("partitioned").alias("partitioned"), F.max("partitions").alias("partition_count"))
    parts = topic_parts(F.col("topic"))
    count = F.when(F.col("partitioned"), F.greatest("partition_count", F.lit(1))).otherwise(0)
    return merged.select(*keys, *[parts[p].alias(p) for p in ("domain", "tenant", "namespace", "local")], "partitioned", count.alias("partition_count"))


def restored(entries: DataFrame) -> DataFrame:
    """Partition counts of repeated ``(topic, partitions, seq)``: the last one stays."""
    return entries.groupBy("topic").agg(F.max_by("partitions", "seq").alias("partitions"))


def parents(topic_rows: DataFrame) -> DataFrame:
    """The tenants and namespaces that the topics need; names that aren't valid need none."""
    return topic_rows.select(topic_parts(F.col("topic")).alias("p")).where("p is not null").select("p.tenant", "p.namespace").distinct()


def subscriptions(documents: DataFrame) -> DataFrame:
    """``(source, topic, subscription)`` of every subscription in the documents."""
    rows = _trees(documents).select("source", F.explode(F.from_json("tree", TREE)).alias("tenant", "a")).select("source", "tenant", F.explode("a").alias("namespace", "b"))
    rows = rows.select("source", "tenant", "namespace", F.explode("b").alias("domain", "c")).select("source", "tenant", "namespace", "domain", F.explode("c").alias("local", "d"))
    name = F.concat(F.col("domain"), F.lit("://"), F.concat_ws("/", "tenant", "namespace", "local"))
    return rows.select("source", name.alias("topic"), F.explode(F.map_keys("d.subscriptions")).alias("subscription")).distinct()


def first_wins(registrations: DataFrame) -> DataFrame:
    """One subscription per topic and name: the first registration's type stays, whatever later ones say."""
    return registrations.groupBy("topic", "subscription").agg(F.min_by("sub_type", "seq").alias("sub_type"))


def document(topic_rows: DataFrame, subscription_rows: DataFrame, root: str) -> DataFrame:
    """The nested JSON of flat tables, one ``body``; a document is as large as its catalogue, which one writer has to hold anyway."""
    names = subscription_rows.groupBy("topic").agg(F.array_sort(F.collect_set("subscription")).alias("subs"))
    rows = topic_rows.join(names, "topic", "left")
    leaf = F.struct(F.map_from_entries(F.transform(F.coalesce("subs", F.array().cast("array<string>")), lambda s: F.struct(s, F.create_map().cast("map<string,string>")))).alias("subscriptions"))

    def level(df: DataFrame, keys: list[str], key: str, value: Column) -> DataFrame:
        pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.to_json(value).alias("v")))))
        return df.groupBy(*keys).agg(pairs.alias("node")) if keys else df.agg(pairs.alias("node"))

    nested = level(rows, ["tenant", "namespace", "domain"], "local", leaf)
    raw = F.col("node")
    for keys, key in ((["tenant", "namespace"], "domain"), (["tenant"], "namespace"), ([], "tenant")):
        nested = level(nested, keys, key, raw)
    counts = topic_rows.where("partitioned").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", F.struct(F.col("partition_count").alias("partitions")))))).alias("parts"))
    return nested.select(F.col("node").alias("tree")).join(F.broadcast(counts)).select(F.lit(root).alias("root"), F.to_json("tree").alias("tree"), F.to_json("parts").alias("parts"))


def write_document(spark: SparkSession, topic_rows: DataFrame, subscription_rows: DataFrame, root: str, path: str) -> None:
    """Write the catalogue as one JSON document into a folder, whole or not at all."""
    row = document(topic_rows, subscription_rows, root).first()

    def opened(x):
        if isinstance(x, str) and x[:1] == "{":
            x = json.loads(x)
        return {k: opened(v) for k, v in x.items()} if isinstance(x, dict) else x

    body = json.dumps({"version": VERSION, row["root"]: opened(row["tree"]) or {}, "partitioned_topics": opened(row["parts"]) or {}}, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def documents(topic_rows: DataFrame, subscription_rows: DataFrame, root: str = "metadata") -> DataFrame:
    """A JSON document per tenant, built by grouping; a document is bounded by its tenant's topics.

    Nodes are nested level by level as JSON text, which is joined, not parsed again.
    """
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30)
    key = lambda c: F.regexp_replace(quoted(c), r"\]$", "")

    def node(pairs: Column) -> Column:
        return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat(key(x["k"]), F.lit(": "), x["v"])), ", "), F.lit("}"))

    pair = lambda k, v: F.collect_list(F.struct(F.col(k).alias("k"), F.col(v).alias("v")))
    names = subscription_rows.select("topic", "subscription", F.lit("{}").alias("v")).distinct().groupBy("topic").agg(node(pair("subscription", "v")).alias("subs"))
    rows = topic_rows.join(names, "topic", "left").withColumn("v", F.concat(F.lit('{"subscriptions": '), F.coalesce("subs", F.lit("{}")), F.lit("}")))
    keys = ["tenant", "namespace", "domain", "local"]
    for depth in (3, 2, 1):
        rows = rows.groupBy(*keys[:depth]).agg(node(pair(keys[depth], "v")).alias("v"))
    parts = topic_rows.where("partitioned").select("tenant", "topic", F.format_string('{"partitions": %d}', "partition_count").alias("p"))
    parts = parts.groupBy("tenant").agg(node(pair("topic", "p")).alias("parts"))
    whole = rows.join(parts, "tenant", "left")
    body = F.concat(F.lit(f'{{"version": {VERSION}, "{root}": {{'), key(F.col("tenant")), F.lit(": "), "v", F.lit('}, "partitioned_topics": '), F.coalesce("parts", F.lit("{}")), F.lit("}"))
    return whole.select("tenant", body.alias("body"))


def write_documents(topic_rows: DataFrame, subscription_rows: DataFrame, path: str) -> None:
    """Write the catalogue as lines of JSON, a document per tenant."""
    documents(topic_rows, subscription_rows).select("body").write.text(path)


def partition_counts(asked: DataFrame, known: DataFrame, default_partitions: int) -> DataFrame:
    """The answer to a partition query for each topic: its own count, else the default for any name if that is over 0, else 0."""
    own = known.where("partitioned").select("topic", F.col("partition_count").alias("own"))
    return asked.select("topic").join(own, "topic", "left").select("topic", F.coalesce("own", F.lit(max(default_partitions, 0)).cast("long")).alias("partitions"))


def resolved(asked: DataFrame, known: DataFrame, default_partitions: int) -> DataFrame:
    """How each name is opened: a partition by its base topic's count, a known topic by its own, any other by the default."""
    counts = known.where("partitioned").select(F.col("topic").alias("base"), F.col("partition_count").alias("own"))
    rows = asked.select("topic", logical_topic(F.col("topic")).alias("base"), is_partition(F.col("topic")).alias("is_partition")).join(counts, "base", "left")
    partitions = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("is_partition"), 0).otherwise(max(default_partitions, 0))
    return rows.select("topic", "base", "is_partition", partitions.cast("long").alias("partitions"), (~F.col("is_partition") & (partitions > 0)).alias("becomes_partitioned"))
