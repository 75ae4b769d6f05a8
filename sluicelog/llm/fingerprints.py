"""Document fingerprints: canonical exact digests.

A text's canonical form is its NFKC normalisation, case-folded, normalised again, with runs of white space as single spaces and none at the
ends. Its wide hash is xxh3-128 of the UTF-8 bytes. Rows are grouped by the hash; inside buckets of two rows or more the
canonical bytes themselves are compared, by their smallest and largest value per bucket, so no bucket is gathered anywhere. Should
different bytes share a hash, each gets the hash and its rank in the bucket as its fingerprint.

Equal canonical forms have equal fingerprints, others never. Null and empty texts, and texts of white space only, have the fingerprint of
the empty form. An exact digest knows only likeness 1 and 0. Tables may be empty, keys null or repeated; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, small, stored


def canonical(text: str | None) -> str:
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split())
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split())


def wide_hash(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def _forms(texts: pd.Series) -> pd.Series:
    return pd.Series([canonical(t) for t in texts], dtype=object)


def canonical_of(text: Column) -> Column:
    return F.pandas_udf(_forms, "string")(text)


def hash_of(text: Column, digest: Callable[[str], str] = wide_hash) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(canonical(t)) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def collisions(texts: DataFrame, hash_col: str, text_col: str) -> DataFrame:
    """``(hash, form, rank)`` of every canonical form in buckets that hold several of them; empty unless a wide hash collides.

    The bytes themselves are compared: a bucket is pure if its smallest form is its largest (Spark orders text by its UTF-8 bytes).
    """
    forms = texts.select(F.col(hash_col).alias("hash"), canonical_of(F.col(text_col)).alias("form"))
    mixed = forms.groupBy("hash").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high").select("hash")
    # stored, so that the pure buckets, however large, are not dealt by their hash again
    mixed = stored(mixed, "fingerprint-mixed")
    distinct = forms.join(small(mixed), "hash", "left_semi").distinct()
    return distinct.withColumn("rank", F.row_number().over(W.partitionBy("hash").orderBy("form")))


def fingerprints(rows: DataFrame, text_col: str = "text", digest: Callable[[str], str] = wide_hash) -> DataFrame:
    """``rows`` with a column ``fingerprint`` (an own column of that name is replaced). ``rows`` is read up to three times."""
    hash_col, form = fresh(rows, "wide_hash", "canonical_form")
    hashed = rows.withColumn(hash_col, hash_of(F.col(text_col), digest))
    repeated = stored(hashed.groupBy(hash_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(hash_col), "fingerprint-repeats")
    found = stored(collisions(hashed.join(small(repeated), hash_col, "left_semi"), hash_col, text_col), "fingerprint-collisions")
    if found.isEmpty():
        return hashed.withColumn("fingerprint", F.col(hash_col)).drop(hash_col)
    hashed = hashed.withColumn(form, canonical_of(F.col(text_col)))
    ranks = found.select(F.col("hash").alias(hash_col), F.col("form").alias(form), F.col("rank").alias(form + "_rank"))
    joined = hashed.join(ranks, [hash_col, form], "left")
    return joined.withColumn("fingerprint", F.concat_ws("-", hash_col, F.col(form + "_rank").cast("string"))).drop(hash_col, form, form + "_rank")


#: Rows in a range of ids that is ordered by itself, and the most ranges there are.
RANGE_ROWS, MOST_RANGES = 256, 1 << 16


def with_next(docs: DataFrame, key: str, *carried: str) -> DataFrame:
    """``(key, carried columns, next_key, next_ of each carried column)`` in ascending order of key, then of the carried columns.

    After the last row comes the first one. Keys are cut into about equal ranges by a sample of them, which only evens the ranges.
    Each range is ordered by itself and also gets a copy of the first row of the range after it, so that one shuffle deals every
    row its neighbour and no range waits for another. A row with a null key has no place in the order and nulls as its next row.
    """
    spark, names = docs.sparkSession, [key, *carried]
    placed = docs.select(*names).where(F.col(key).isNotNull())
    total = placed.count()
    ranges = min(MOST_RANGES, max(1, total // RANGE_ROWS))
    sampled = placed.select(F.col(key).cast("long").alias("k")).sample(min(1.0, 30 * ranges / max(total, 1)), 7).toPandas()["k"].to_numpy()
    cuts = np.unique(np.quantile(sampled, np.arange(1, ranges) / ranges, method="lower")) if len(sampled) and ranges > 1 else np.empty(0, dtype=np.int64)

    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(), side="right").astype("int32"))

    ranged = placed.withColumn("_range", F.pandas_udf(place, "int")(F.col(key).cast("long")))
    firsts = {r["_range"]: r["k"] for r in ranged.groupBy("_range").agg(F.min(key).alias("k")).collect()}  # a row per range
    order = sorted(firsts)
    # the first key of a range also closes the range before it; the very first one closes the last range
    closing = [(firsts[r], order[i - 1]) for i, r in enumerate(order)]
    closes = F.broadcast(spark.createDataFrame(closing, "_first long, _closes int"))
    own = ranged.withColumn("_guest", F.lit(0))
    guests = placed.join(closes, F.col(key) == F.col("_first")).select(*names, F.col("_closes").alias("_range"), F.lit(1).alias("_guest"))
    window = W.partitionBy("_range").orderBy("_guest", *names)
    leads = {f"next_{n}": F.lead(n).over(window) for n in names}
    ordered = own.unionByName(guests).withColumns(leads).where("_guest = 0").drop("_guest", "_range")
    unplaced = docs.select(*names).where(F.col(key).isNull())
    return ordered.unionByName(unplaced.withColumns({f"next_{n}": F.lit(None).cast(docs.schema[n].dataType) for n in names}))


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with the last half of its code points replaced by as many first ones (or all) of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(F.coalesce(following, F.lit("")), F.lit(1), half))


def op2_fingerprints(spark: SparkSession, sf_dir: str, digest: Callable[[str], str] = wide_hash) -> DataFrame:
    """The fingerprints of all texts and edited texts, out of one grouping by the wide hash.

    Texts are shuffled once, to meet their neighbours. Hashes are stored; only texts in buckets of two or more are read again.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("hash", hash_of(F.col("text"), digest)), "doc_id", "text", "hash")
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    digests = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "hash", hash_of(F.col("edited"), digest).alias("edited_hash"), "next_doc_id", "next_hash",
    )
    digests = stored(digests, "fingerprints")
    pair = F.array(F.struct(F.lit("text").alias("part"), "hash"), F.struct(F.lit("edited").alias("part"), F.col("edited_hash").alias("hash")))
    parts = digests.select("doc_id", "next_doc_id", F.explode(pair).alias("p")).select("doc_id", "next_doc_id", "p.*")
    repeated = stored(parts.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "fingerprint-repeats")
    suspects = parts.join(small(repeated), "hash", "left_semi")
    texts = suspects.where("part = 'text'").select("doc_id", "hash").distinct()
    plain = docs.join(small(texts), "doc_id").select("doc_id", F.lit("text").alias("part"), "hash", "text")
    edits = stored(suspects.where("part = 'edited'").select("doc_id", "next_doc_id", "hash").distinct(), "fingerprint-edits")
    firsts = docs.join(small(edits), "doc_id").withColumnRenamed("text", "own")
    following = docs.join(small(edits.select("next_doc_id").distinct()), F.col("doc_id") == F.col("next_doc_id"), "left_semi")
    following = following.groupBy(F.col("doc_id").alias("next_doc_id")).agg(F.min("text").alias("following"))
    changed = firsts.join(following, "next_doc_id", "left").select("doc_id", F.lit("edited").alias("part"), "hash", edited_text(F.col("own"), F.col("following")).alias("text"))
    compared = plain.unionByName(changed)
    found = stored(collisions(compared, "hash", "text"), "fingerprint-collisions")
    if not found.isEmpty():
        digests = _ranked(digests, compared, found)
    same = lambda a, b: F.coalesce((F.col(a) == F.col(b)).cast("double"), F.lit(0.0))
    return digests.select(
        "doc_id", "n_chars", "edited_sha256", F.col("hash").alias("fingerprint"), F.col("edited_hash").alias("edited_fingerprint"),
        same("hash", "edited_hash").alias("near_edited"), same("hash", "next_hash").alias("near_next"),
    )


def _ranked(digests: DataFrame, compared: DataFrame, found: DataFrame) -> DataFrame:
    """``digests`` with ranks added to the hashes that several forms share."""
    forms = compared.withColumn("form", canonical_of(F.col("text"))).join(found, ["hash", "form"])
    forms = forms.select("doc_id", "part", "hash", F.concat_ws("-", "hash", F.col("rank").cast("string")).alias("own"))
    of = lambda part: forms.where(F.col("part") == part).groupBy("doc_id", "hash").agg(F.min("own").alias("own"))
    for part, key, column in (("text", "doc_id", "hash"), ("edited", "doc_id", "edited_hash"), ("text", "next_doc_id", "next_hash")):
        ranks = of(part).select(F.col("doc_id").alias("r_id"), F.col("hash").alias("r_hash"), "own")
        joined = digests.join(ranks, (F.col(key) == F.col("r_id")) & (F.col(column) == F.col("r_hash")), "left")
        digests = joined.withColumn(column, F.coalesce("own", column)).drop("r_id", "r_hash", "own")
    return digests


QUERIES = {"op2_fingerprints": op2_fingerprints}
SQL: dict[str, str] = {}
