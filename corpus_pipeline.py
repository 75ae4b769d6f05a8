"""Corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, secret removal, BPE counts.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes every stage's result as Parquet into the folder that
driver and executors share and reads it back for the next one. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicelog.llm import bpe, decontamination, langid, near_dups, secrets
from sluicelog.llm.common import discard, fresh, scratch_scope, small, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Rejected are texts that are null or have no letter, and ambiguous ones.

    The classifier learns from the labelled rows of the input; an input without labels leaves every document undecided, hence rejected.
    """
    (out,) = fresh(docs, "language_prediction")
    predict = langid.predictor(spark, langid.fit(docs.where(~langid.is_held_out(F.col("doc_id")))))
    judged = docs.withColumn(out, predict("text"))
    return judged.where((F.col(f"{out}.lang_pred") != langid.UNKNOWN) & ~F.col(f"{out}.ambiguous")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, likeness 0.8): the one with the smallest id.

    Documents without an id can't be compared and stay; rows that repeat id and text are one document, rows that repeat the id alone aren't.
    """
    digest, number = fresh(docs, "text_digest", "document_number")
    marked = docs.withColumn(digest, F.coalesce(F.sha2("text", 256), F.lit("")))
    identified = marked.where("doc_id is not null")
    if identified.groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").isEmpty():
        numbered = docs.withColumn(number, F.col("doc_id"))
    else:  # numbers in the order of the ids, so that the smallest id is kept
        numbers = identified.select("doc_id", digest).distinct().orderBy("doc_id", digest).withColumn(number, F.monotonically_increasing_id())
        numbers = stored(numbers, "document-numbers")
        numbered = stored(marked.join(small(numbers), ["doc_id", digest], "left"), "documents-numbered")
    found = near_dups.near_duplicates(numbered, key=number, size=5, percent=80)
    gone = found.where("not kept").select(F.col(number).alias("gone_id")).distinct()
    kept = numbered.join(gone, F.col(number) == F.col("gone_id"), "left_anti")
    single = kept.where(F.col(number).isNotNull()).dropDuplicates([number])
    return single.unionByName(kept.where(F.col(number).isNull())).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Those without an id are judged by id and text like all others; a null text holds none and stays."""
    (name,) = fresh(docs, "contamination_key")
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256))
    keyed = docs.withColumn(name, key)
    hits = decontamination.hits(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=name)
    bad = hits.where("contaminated").select(F.col(name).alias("bad_key")).distinct()
    return keyed.join(bad, F.col(name) == F.col("bad_key"), "left_anti").select(*docs.columns)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark and ``n_chars`` counted anew where the text changed."""
    (clean,) = fresh(docs, "redacted_text")
    rows = docs.withColumn(clean, secrets.redacted(F.col("text"), secrets.identifiers(docs)))
    n_chars = F.when(F.col(clean).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(clean).cast(docs.schema["n_chars"].dataType))
    return rows.withColumns({"n_chars": n_chars, "text": F.col(clean)}).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_chars``, ``n_tokens`` and the token ids of every document; null and empty texts have none."""
    (out,) = fresh(docs, "bpe_code")
    coded = docs.withColumn(out, bpe.ids_only(spark, F.col("text"), bpe.default_vocabulary()))
    return coded.select("doc_id", "lang", "source", "n_chars", F.col(f"{out}.n_tokens").alias("n_tokens"), F.col(f"{out}.ids").alias("ids"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("remove_secrets", remove_secrets),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written on its way, and its input, are deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before = docs
        with scratch_scope(spark) as keep:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.add(docs._stored_path)
        if i:
            discard(before)
    return docs


#: Classifiers, an LSH forest and BPE aren't expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
