"""Language identification by error-correcting output codes.

Each language has a binary codeword. For every bit a binary classifier over hashed character n-grams (1 to 3 letters, with word
edges) tells the languages with a 1 from those with a 0. A text's margins on all bits are decoded by loss: each classifier's logistic loss
against a codeword's bit is weighted by how reliable that classifier was for that language in training, and the codeword of least
loss wins. Where the second one is nearly as close, the text is flagged as ambiguous.

The classifiers are fitted on a bounded sample of the labelled rows, about ``SAMPLE_PER_LANGUAGE`` of each language, taken by a hash of
the row's key. Counting is distributed; what comes to the driver is the model (languages x ``BUCKETS`` counts).

Null texts, and texts without a letter, are ``und`` with score 0. With no labelled row everything is ``und``; with one language every other text
has that language. Rows with a null key are predicted but never learned from. Whole texts are read, long ones in pieces that give the same
grams. Repeated rows are
predicted row by row; columns other than the key, text and (for learning) language are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_number, text_groups

UNKNOWN = "und"
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SAMPLE_PER_LANGUAGE = 4000
AMBIGUOUS_BELOW = 0.55
#: A text's margins grow with its length up to so many letters.
LONGEST = 400


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 per language: all distinct splits for up to 6 languages, else random columns with the rows far apart."""
    if n <= 6:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, dtype=np.int8).reshape(-1, n).T if columns else np.ones((n, 1), dtype=np.int8)
    rng, bits = np.random.default_rng(seed), int(np.ceil(12 * np.log2(n)))
    best, apart = None, -1
    for _ in range(64):
        code = rng.choice(np.array([1, -1], dtype=np.int8), size=(n, bits))
        distance = (bits - code.astype(int) @ code.T.astype(int)) // 2
        nearest = int((distance + np.eye(n, dtype=int) * bits).min())
        if nearest > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, nearest
    return best


def _coded(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that begin at the first ``n`` code points, and where the middle of each stands."""
    letter = letter_table()[points]
    x = np.where(letter, points, 0).astype(np.uint64)
    n2, n3 = min(n, len(x) - 1), max(min(n, len(x) - 2), 0)
    one, mid, right = x * np.uint64(0x9E3779B97F4A7C15), x * np.uint64(0xC2B2AE3D27D4EB4F), x * np.uint64(0x165667B19E3779F9)
    pair = one[:n2] + mid[1 : n2 + 1] + np.uint64(0x27D4EB2F165667C5)
    triple = one[:n3] + mid[1 : n3 + 1] + right[2 : n3 + 2] + np.uint64(0x85EBCA77C2B2AE63)
    shift = np.uint64(64 - BUCKET_BITS)

    def bucket(h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(29))
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int32)

    keep1, keep2, keep3 = letter[:n], letter[:n2] | letter[1 : n2 + 1], letter[1 : n3 + 1]
    codes = np.concatenate([bucket(one[:n])[keep1], bucket(pair)[keep2], bucket(triple)[keep3]])
    return codes, np.concatenate([np.flatnonzero(keep1), np.flatnonzero(keep2), np.flatnonzero(keep3) + 1])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text of each, and each text's number of grams and of letters."""
    low = [t.lower() for t in texts]
    lengths = np.array([len(t) + 2 for t in low])
    points = _points(" " + "  ".join(low) + " ")
    text_of = np.repeat(np.arange(len(texts)), lengths)
    # grams that would span two texts have a word edge on either side of the cut, hence no letter of two texts
    codes, at = _coded(points, len(points))
    owner = text_of[at]
    n_letters = np.bincount(text_of[letter_table()[points]], minlength=len(texts))
    return codes, owner, np.bincount(owner, minlength=len(texts)), n_letters


def long_grams(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of a long text's n-grams and its letters, ``PIECE`` code points at a time: pieces overlap, and each gram counts where it begins."""
    points = _points(f" {text.lower()} ")
    for i in range(0, len(points), PIECE):
        part = points[i : i + PIECE + 2]
        n = min(PIECE, len(points) - i)
        yield _coded(part, n)[0], int(letter_table()[part[:n]].sum())


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # languages x bits

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's mean margin per bit times a root of its length, and its number of letters."""
        sums, counts, letters = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if len(text) > PIECE:
                for codes, n_letters in long_grams(text):
                    sums[i] += self.weights[codes].sum(0, dtype=np.float64)
                    counts[i] += len(codes)
                    letters[i] += n_letters
        short = [i for i, t in enumerate(texts) if 0 < len(t) <= PIECE]
        for first, run in text_groups([texts[i] for i in short], PIECE):
            self._add(run, np.array(short[first : first + len(run)]), sums, counts, letters)
        means = sums / np.maximum(counts, 1)[:, None]
        return means * np.sqrt(np.minimum(letters, LONGEST))[:, None], letters

    def _add(self, texts, rows, sums, counts, letters) -> None:
        codes, owner, n, n_letters = grams(texts)
        for bit in range(self.code.shape[1]):
            sums[rows, bit] += np.bincount(owner, weights=self.weights[:, bit][codes], minlength=len(texts))
        counts[rows] += n
        letters[rows] += n_letters

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest language of each row, and its share of the codewords' loss-based likelihood."""
        agree = margins[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0, -agree) * self.trust[None, :, :]).sum(2)
        share = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        return best, share[np.arange(len(best)), best]


PIECE = 1 << 19


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for text in rows["text"]:
                for codes, _ in long_grams(text):
                    own += np.bincount(codes, minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})


def sample_of(labelled: DataFrame, key: str, lang: str, text: str, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language, by a hash of the key: ``(lang, text)``."""
    rows = labelled.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(lang) != UNKNOWN))
    sizes = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).limit(0)
    shares = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(place < shares[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))


def fit(labelled: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    sample = sample_of(labelled, key, lang, text, per_language)
    counted = sample.mapInPandas(_count_grams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    if not languages:
        return Model([], np.ones((0, 1), dtype=np.int8), np.zeros((BUCKETS, 1), dtype=np.float32), np.ones((0, 1)))
    share = np.zeros((len(languages), BUCKETS))
    share[counted["lang"].map(languages.index).to_numpy(), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    share = (share + 0.5) / (share.sum(1, keepdims=True) + 0.5 * BUCKETS)
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1]):
        ones, zeros = share[code[:, bit] == 1], share[code[:, bit] == -1]
        if len(ones) and len(zeros):
            weights[:, bit] = np.log(ones.mean(0)) - np.log(zeros.mean(0))
    model = Model(languages, code, weights, np.full(code.shape, 1 / code.shape[1]))
    return Model(languages, code, weights, _trust(sample, model))


def _trust(sample: DataFrame, model: Model) -> np.ndarray:
    """How often each bit's classifier was right on each language's sample, in shares that sum to 1 for a language."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            margins, letters = model.margins(list(batch["text"]))
            code = model.code[batch["lang"].map(model.languages.index).to_numpy()]
            hit = pd.DataFrame((margins * code > 0).astype(int)).assign(lang=batch["lang"].to_numpy())[letters > 0]
            long = hit.melt("lang", var_name="bit", value_name="hit").groupby(["lang", "bit"], as_index=False)["hit"].agg(hits="sum", n="count")
            yield long[["lang", "bit", "hits", "n"]]

    rows = sample.mapInPandas(right, "lang string, bit int, hits long, n long").groupBy("lang", "bit").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    trust = np.full(model.code.shape, 0.5)
    for r in rows.collect():
        trust[model.languages.index(r["lang"]), r["bit"]] = (r["hits"] + 1) / (r["n"] + 2)
    return trust / trust.sum(1, keepdims=True)


PREDICTION = "lang_pred string, score double, ambiguous boolean"


def predictor(spark: SparkSession, model: Model):
    """A pandas UDF from text to the predicted language, its score and whether the next language is nearly as close."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def predict(texts: pd.Series) -> pd.DataFrame:
        model, texts = shared.value, [t or "" for t in texts]
        margins, letters = model.margins(texts)
        out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "ambiguous": False}, index=range(len(texts)))
        if model.languages:
            best, share = model.decode(margins)
            known = letters > 0
            out.loc[known, "lang_pred"] = np.array(model.languages, dtype=object)[best[known]]
            out.loc[known, "score"] = np.clip(share[known], 0, 1)
            out.loc[known, "ambiguous"] = share[known] < AMBIGUOUS_BELOW
        return out

    return predict


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_number(doc_id, 3) == 1, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    predict = predictor(spark, model)
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.*")


QUERIES = {"op1_language": op1_language}
SQL: dict[str, str] = {}
