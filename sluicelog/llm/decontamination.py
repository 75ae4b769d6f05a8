"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one window). A document contains a window only if
it contains all of its words, so one necessary word, the window's prefix, suffices to find it: the word that is rarest over all
documents. Documents are probed word by word against these few prefix words; the offset of the prefix in its window and the
length of the window bound where it could lie, and the document's words there are compared with the window's own.

Texts are cut at their separators and words are met by 64-bit hashes; a window is confirmed on the words themselves. The document's
words stay in its row while its positions are probed, so no text is shuffled; only confirmed windows are. A benchmark whose prefixes outgrow
a broadcast is met by a shuffle of places instead, and the few that meet are taken back to their texts. A document's hits are
the words inside any occurrence of any window.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. Null and empty texts have none and are hit by nothing;
items without words, or with a null id, have no windows. Rows that share an id and a text are repeated in the result. Empty tables give an
empty result or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, fits_broadcast, small, stored

#: What parts words; A-Z are word characters here and lower-cased word by word.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
MARK = ""


def raw_words(text: Column) -> Column:
    """The words of a text in their own case; cutting at separators leaves an empty word at an end at most."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lowered(word: Column) -> Column:
    """A-Z in lower case; words in ASCII, which are most, take the quick way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(ascii_lower(word))


def windows_of(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """``(item_id, words)``: the windows of all items."""
    rows = items.select(F.col(key).cast("string").alias("item_id"), F.transform(raw_words(F.col(text)), lowered).alias("all_words")).where("item_id is not null and size(all_words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("all_words") - window, F.lit(0)))
    rows = rows.select("item_id", "all_words", F.explode(starts).alias("offset"))
    return rows.select("item_id", F.slice("all_words", F.col("offset") + 1, F.lit(window)).alias("words"))


def word_counts(docs: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """``(hash, n)``: how often each word of ``vocabulary`` (bounded by the benchmark), known by its hash, stands in all documents."""
    found = docs.select(F.explode(raw_words(F.col(text))).alias("word"))
    found = found.join(small(vocabulary), F.xxhash64(lowered(F.col("word"))) == F.col("hash"))
    return found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``(prefix, place, size, words)`` of each distinct window: the hash of its rarest word, where that stands in it, its length, and its words as one text."""
    distinct = windows.select("words").distinct()
    words = distinct.select("words", F.posexplode("words").alias("place", "word")).withColumn("hash", F.xxhash64("word"))
    # a word that no document has can't be found, so its windows are left out here rather than probed for
    rarest = words.join(counts, "hash", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place", "hash")).alias("best"))
    return rarest.where("best.n > 0").select(F.col("best.hash").alias("prefix"), F.col("best.place").alias("place"), F.size("words").alias("size"), _as_text(F.col("words")).alias("words"))


def _as_text(words: Column) -> Column:
    """Words have no blanks, so blanks between them keep different windows apart."""
    return F.array_join(words, " ")


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(key, n_words, n_hit, n_items, items_sha256, contaminated)`` of every row of ``docs``."""
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(text, F.lit("")).alias("doc_text"))
    windows = stored(windows_of(items, item_key, item_text, window), "windows")
    counts = stored(word_counts(rows, "doc_text", windows.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("hash")).distinct()), "word-counts")
    probes = stored(prefixes(windows, counts), "window-prefixes")
    discard(counts)
    held = rows.select("doc", F.xxhash64("doc_text").alias("text_key"), raw_words(F.col("doc_text")).alias("doc_words"))
    found = _met(held, probes) if fits_broadcast(probes) else _met_by_shuffle(held, probes)
    return _summed(found, windows).withColumnRenamed("doc", key)


def _start() -> Column:
    """The word at a place, the prefix of a window, says where the window would have to begin; places count from 1."""
    return F.col("at") - F.col("place")


def _confirmed() -> Column:
    """Whether the window lies inside the document, and its words there are the window's.

    Without a lambda, so that the join stays compiled: else the document's words would be copied for each of them.
    """
    start, size = _start(), F.col("size")
    fits = (start >= 1) & (start + size - 1 <= F.size("doc_words"))
    return F.when(fits, lowered(_as_text(F.slice("doc_words", start, size))) == F.col("words"))


def _met(held: DataFrame, probes: DataFrame) -> DataFrame:
    """``(doc, text_key, n_words, start, words)`` of every occurrence of a window, and a row without a start of every document; prefixes are broadcast."""
    # every document leads with a mark that meets the mark among the prefixes, so it stays in the result without hits
    at = held.select("doc", "text_key", "doc_words", F.posexplode(F.concat(F.array(F.lit(MARK)), "doc_words")).alias("at", "word"))
    mark = held.sparkSession.range(1).select(F.xxhash64(F.lit(MARK)).alias("prefix"), F.lit(0).alias("place"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("words"))
    met = at.join(F.broadcast(probes.unionByName(mark)), F.xxhash64(lowered(F.col("word"))) == F.col("prefix"))
    start = F.when(F.col("words").isNotNull(), _start())
    return met.where(F.col("words").isNull() | _confirmed()).select("doc", "text_key", F.size("doc_words").alias("n_words"), start.alias("start"), "size", "words")


def _met_by_shuffle(held: DataFrame, probes: DataFrame) -> DataFrame:
    """The same for prefixes of any number: places, each a hash and two numbers, meet them in a shuffled join, and what meets returns to its text."""
    at = held.select("text_key", F.posexplode("doc_words").alias("i", "word")).select("text_key", (F.col("i") + 1).alias("at"), F.xxhash64(lowered(F.col("word"))).alias("prefix"))
    met = stored(at.distinct().join(probes, "prefix").select("text_key", "at", "place", "size", "words"), "window-places")
    found = held.join(met, "text_key").where(_confirmed()).select("doc", "text_key", F.size("doc_words").alias("n_words"), _start().alias("start"), "size", "words")
    every = held.select("doc", "text_key", F.size("doc_words").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("words"))
    return every.unionByName(found)


def _summed(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Per document the words inside its windows, each once: by start, a window adds what reaches beyond the furthest stop so far."""
    rows = found.select("doc", "text_key", "n_words", "start", (F.col("start") + F.col("size")).alias("stop"), F.xxhash64("words").alias("w1"), F.xxhash64("words", F.lit(1)).alias("w2"))
    rows = rows.groupBy("doc", "text_key").agg(
        F.sum(F.when(F.col("start").isNull(), 1).otherwise(0)).alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "stop")))).alias("spans"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("w1", "w2"))).alias("own"),
    )
    rows = stored(rows, "window-hits")
    # a window that many items share is one row here; its items are met only by the documents that hold it
    owners = windows.select(_as_text(F.col("words")).alias("words"), "item_id").select(F.xxhash64("words").alias("w1"), F.xxhash64("words", F.lit(1)).alias("w2"), "item_id").distinct()
    named = rows.where("size(own) > 0").select("doc", "text_key", F.explode("own").alias("w")).select("doc", "text_key", "w.*").join(small(owners), ["w1", "w2"])
    named = named.groupBy("doc", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items")).select(F.col("doc").alias("i_doc"), F.col("text_key").alias("i_key"), "items")
    rows = rows.join(small(stored(named, "window-items")), F.col("doc").eqNullSafe(F.col("i_doc")) & (F.col("text_key") == F.col("i_key")), "left")
    rows = rows.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))

    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["stop"] - F.greatest(x["start"], s["reach"]), F.lit(0))).alias("n"), F.greatest(s["reach"], x["stop"]).alias("reach"))
    n_hit = F.aggregate("spans", empty, step)["n"].cast("long")
    # equal rows meet in one group; each gets its own row again
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT item_id, unnest([array_to_string(ws[i:i+9], ' ') FOR i IN range(1, greatest(len(ws) - 9, 1) + 1)]) AS g, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM v),
x AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM d, ks WHERE len(ws) >= k),
m AS (SELECT doc_id, i, x.k, item_id FROM x JOIN v ON array_to_string(ws[i:i+x.k-1], ' ') = g AND x.k = v.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op9_decontamination": op9_decontamination}
SQL = {"op9_decontamination": OP9_SQL}
