"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed single words, word pairs and pairs that skip a word of a whole text, in ``2**SPACE_BITS`` places. Every
coordinate has its own rate, and the L1 term keeps all but a few thousand weights at zero, so the weights that are broadcast
are small; their number is bounded by the hash space.

Learning takes a bounded sample, about ``SAMPLE_PER_LABEL`` labelled keys of each label by a hash of the key. It is dealt to learners whose
weights are averaged: to as few as keep a learner's features under ``LEARNER_FEATURES``, usually one, since averaging slows rare words.
Labels weigh so that, against all labelled rows, they stand half way to equality. The last of ``FOLDS`` folds of
the sample isn't learned from; it moves the bias to where its own rows are told apart best at a score of 0.5.

Null and empty texts have no features and get the score of the bias. With no labelled rows, or one label only, the score is 0.5 or
that label's. Repeated label rows weigh as often as they stand; of a key's several texts the smallest is learned from. Columns other than the
named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fold_number, stored

SPACE_BITS = 22
SAMPLE_PER_LABEL = 6000
#: Features (four bytes each) that one learner holds at most, about.
LEARNER_FEATURES = 40_000_000
FOLDS = 5
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 12.0, 0.0
#: ASCII letters in lower case; digits, punctuation and control characters are blanks; other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORDS_HELD = 300_000


class WordHashes(dict):
    """64-bit hashes of words, kept for words met before."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORDS_HELD:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_hashes = WordHashes()


def features(text: str) -> np.ndarray:
    """The distinct places of the text's words, word pairs and skip-grams, as sorted 32-bit numbers."""
    w = _hashes.of(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())
    if not len(w):
        return np.empty(0, dtype=np.int32)
    left = w * np.uint64(0x9E3779B97F4A7C15)
    pair, skip = left[:-1] + w[1:], (left[:-2] ^ np.uint64(0xD6E8FEB86659FD93)) + w[2:]
    every = np.concatenate([w, pair, skip]) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((every >> np.uint64(64 - SPACE_BITS)).astype(np.int32))


class FTRL:
    """Per-coordinate FTRL-proximal with L1 and L2 terms over binary features; the last place is the bias."""

    def __init__(self, places: int):
        self.z, self.n = np.zeros(places), np.zeros(places)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * weight
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w


def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts], dtype=object)


@dataclass
class Weights:
    """Sorted places and their weights; the bias apart."""

    places: np.ndarray
    values: np.ndarray
    bias: float

    def score(self, at: np.ndarray) -> float:
        if len(self.places):
            i = np.minimum(np.searchsorted(self.places, at), len(self.places) - 1)
            total = self.bias + self.values[i][self.places[i] == at].sum()
        else:
            total = self.bias
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def _learn_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """One learner's weights; it passes over its rows in the order of their hashes, ``EPOCHS`` times."""
    rows = rows.sort_values(["place", "label"])
    found = [np.asarray(x, dtype=np.int32) for x in rows["features"]]
    used, inverse = np.unique(np.concatenate([*found, np.empty(0, dtype=np.int32)]), return_inverse=True)
    cuts = np.cumsum([len(x) for x in found])[:-1]
    model, bias = FTRL(len(used) + 1), len(used)
    for _ in range(EPOCHS):
        for at, label, weight in zip(np.split(inverse, cuts), rows["label"], rows["weight"]):
            model.learn(np.append(at, bias), label, weight)
    w = model.weights(np.arange(len(used) + 1))
    keep = np.flatnonzero(w[:-1])
    return pd.DataFrame({"feature": np.append(used[keep], -1).astype("int32"), "weight": np.append(w[keep], w[-1])})


def best_shift(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> float:
    """What added to the logits of a fold gives the best F1 at a score of 0.5, the least move of those; a row stands for ``counts`` labelled rows."""
    if not len(labels) or not labels.any() or labels.all():
        return 0.0
    p = np.clip(scores, 1e-12, 1 - 1e-12)
    logits = np.log(p / (1 - p))
    order = np.argsort(-logits, kind="stable")
    z, toxic = logits[order], (labels * counts)[order]
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(counts[order]) + toxic.sum())
    ends = np.flatnonzero(np.append(np.diff(z) < 0, True))  # where a cut can stand
    cuts = -(z[ends] + np.append(z[ends[:-1] + 1], z[-1] - 1)) / 2
    now = f1[np.count_nonzero(z >= 0) - 1] if z[0] >= 0 else 0.0
    best = f1[ends].max()
    return 0.0 if now >= best else float(min(cuts[f1[ends] == best], key=abs))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", per_label: int = SAMPLE_PER_LABEL) -> Weights:
    """Averaged weights of the learners on a bounded sample of ``labels`` (0 or 1; others are left out), joined to their texts."""
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("label")).where("k is not null and label in (0, 1)")
    rows = rows.groupBy("k", "label").agg(F.count(F.lit(1)).alias("times"))
    sizes = {r["label"]: (r["keys"], r["n"]) for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("keys"), F.sum("times").alias("n")).collect()}
    if len(sizes) < 2:
        return Weights(np.empty(0, dtype=np.int32), np.empty(0), 0.0 if not sizes else 5.0 if 1 in sizes else -5.0)
    by_label = lambda of: F.create_map(*[F.lit(x) for y, (keys, n) in sizes.items() for x in (y, of(y, keys, n))])[F.col("label")]
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("place", place).where(F.col("place") < by_label(lambda y, keys, n: min(1.0, per_label / keys)))
    # as all labelled rows stand, half way to equal labels; the smaller weight is 1
    drawn = {y: n * min(1.0, per_label / keys) for y, (keys, n) in sizes.items()}
    half = {y: n**0.5 / drawn[y] for y, (_, n) in sizes.items()}
    rows = rows.withColumn("weight", by_label(lambda y, keys, n: half[y] / min(half.values())) * F.col("times"))
    # at most about 2 * per_label rows, whatever the input
    texts = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(rows), "k")
    texts = texts.groupBy("k", "label", "place", "weight").agg(F.min("text").alias("text"))
    sample = texts.select("k", "label", "place", "weight", F.pandas_udf(_features, "array<int>")("text").alias("features"), (F.pmod(F.hash("k", F.lit("fold")), F.lit(FOLDS)) == FOLDS - 1).alias("held"))
    sample = stored(sample, "toxic-sample")
    total = sample.agg(F.sum(F.size("features"))).first()[0] or 0
    learners = max(1, -(-total // LEARNER_FEATURES))
    dealt = sample.where("not held").withColumn("shard", F.pmod(F.hash("k", F.lit("shard")), F.lit(learners))).select("label", "place", "weight", "features", "shard")
    learned = dealt.groupBy("shard").applyInPandas(_learn_shard, "feature int, weight double")
    mean = learned.groupBy("feature").agg((F.sum("weight") / learners).alias("weight")).toPandas().sort_values("feature")
    at, w = mean["feature"].to_numpy(), mean["weight"].to_numpy()
    found = Weights(at[at >= 0].astype(np.int32), w[at >= 0], float(w[at < 0].sum()))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("double")
    def judge(found: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(np.asarray(x, dtype=np.int32)) for x in found], dtype="float64")

    fold = sample.where("held").select("label", judge("features").alias("score")).toPandas()
    stands_for = fold["label"].map({y: n / drawn[y] for y, (_, n) in sizes.items()}).to_numpy(dtype=float)
    found.bias += best_shift(fold["score"].to_numpy(dtype=float), fold["label"].to_numpy(dtype=int), stands_for)
    discard(sample)
    return found


def scorer(spark: SparkSession, weights: Weights):
    """A pandas UDF from text to the score, 0 to 1."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weights = shared.value
        return pd.Series([weights.score(features(t or "")) for t in texts], dtype="float64")

    return score


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_number(doc_id, 5) == 0, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = fit(docs, labels.where(~is_held_out(F.col("doc_id"))))
    score = scorer(spark, weights)
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
