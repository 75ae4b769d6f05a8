"""BPE encoding and decoding with contiguous rank arrays.

A short word is held as two parallel arrays: its parts, and the rank of the merge of each part with the next one. The
smallest rank is sought by a plain scan, its boundary deleted and the neighbouring ranks looked up anew. All words of one length
that a batch brings for the first time are merged together, a row each of these arrays. The scan is quadratic in a word's length,
so words of over ``LONG_WORD`` symbols go to a heap over linked parts instead, which gives the same merges. A worker keeps the codes of
up to ``CACHED_CHUNKS`` chunks of at most ``CACHED_LENGTH`` characters, so its memory is bounded whatever the texts hold.

Null and empty texts have no ids and decode to the empty text. Special tokens that occur in a text are one id each, as in the
tokenizers library. Repeated rows and ties are encoded row by row; columns other than the key and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_groups

LONG_WORD = 96
CACHED_CHUNKS = 300_000
NO_RANK, NO_PAIR = 2**31 - 1, 2**62
#: Chunks of more characters are encoded each time, not kept.
CACHED_LENGTH = 64
#: Python's split() takes U+001C to U+001F for white space, the tokenizer doesn't: texts that hold one are cut by expression.
UNITS = re.compile("[\x1c-\x1f]")
NOT_WHITE = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall
#: Capitals that got a small letter after the Unicode version of Python's tables: first, last, and the small letter of the first.
NEWER_CASES = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
SMALL = {first + i: small + i for first, last, small in NEWER_CASES for i in range(last - first + 1)}
HAS_NEWER_CASE = re.compile("[" + "".join(f"{chr(first)}-{chr(last)}" for first, last, _ in NEWER_CASES) + "]").search
#: Letters and numbers that were assigned after the Unicode version of the tokenizers library's expressions.
NEWER_LETTERS = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d "
    "\U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb \U00011df1 "
    "\U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 \U00016ff2-\U00016ff3 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 "
    "\U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 "
    "\U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 "
    "\U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead "
    "\U000323b0-\U00033479 \U0003d000-\U0003fc3f"
).replace(" ", "")
NEWER_NUMBERS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"


CODES = "n_tokens long, ids binary, decoded string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBPE:
    """A word-end BPE vocabulary file of the tokenizers library, read by this engine's own encoder."""

    def __init__(self, spec: str):
        import regex

        data = json.loads(spec)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], NO_PAIR), np.append(order, NO_RANK).astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], dtype=np.int32)
        self.final = np.array([vocab[c + end] for c in symbols], dtype=np.int32)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token_list = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in (vocab | self.special).items():
            self.token_list[i] = token

        pattern = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.has_newer = regex.compile(f"[{NEWER_LETTERS}{NEWER_NUMBERS}]").search
        strict = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\s@L@N]").replace(r"[\p{L}]", "@L").replace(r"[\p{N}]", "@N")
        strict = strict.replace("@L", rf"[\p{{L}}--[{NEWER_LETTERS}]]").replace("@N", rf"[\p{{N}}--[{NEWER_NUMBERS}]]")
        self.strict_words = regex.compile(strict, regex.V1).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.passing: list[str] = []

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each left part with its right one, or NO_RANK."""
        keys = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def merge_short(self, parts: np.ndarray):
        """Merge words of one length together, a row each: yields (row numbers, their parts) as rows get done.

        ``parts`` and ``ranks`` are the words' contiguous arrays. A round finds each row's smallest rank, deletes that boundary by
        closing the gap, and looks up the ranks on both sides of the new part.
        """
        rows, ranks = np.arange(len(parts)), self.ranks(parts[:, :-1], parts[:, 1:])
        while len(rows) and parts.shape[1] > 1:
            at = ranks.argmin(1)
            low = ranks[np.arange(len(rows)), at]
            going = low < NO_RANK
            if not going.all():
                yield rows[~going], parts[~going]
                rows, parts, ranks, at, low = rows[going], parts[going], ranks[going], at[going], low[going]
                if not len(rows):
                    return
            each = np.arange(len(rows))
            parts[each, at] = self.merged[low]
            column = np.arange(parts.shape[1] - 1)
            parts = np.where(column <= at[:, None], parts[:, :-1], parts[:, 1:])
            ranks = np.where(column[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            after, before = at < parts.shape[1] - 1, at > 0
            ranks[each[after], at[after]] = self.ranks(parts[each[after], at[after]], parts[each[after], at[after] + 1])
            ranks[each[before], at[before] - 1] = self.ranks(parts[each[before], at[before] - 1], parts[each[before], at[before]])
        if len(rows):
            yield rows, parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for one long word, by a heap of ranks over linked parts."""
        at = np.array(parts, dtype=np.int64)
        first = self.ranks(at[:-1], at[1:]).tolist()
        alive: list[int | None] = list(parts)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, alive[i], alive[i + 1]) for i, r in enumerate(first) if r < NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if alive[i] != left or j >= len(alive) or alive[j] != right:
                continue
            alive[i], alive[j], after[i] = int(self.merged[rank]), None, after[j]
            if after[i] < len(alive):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(alive):
                    pair = alive[k], alive[after[k]]
                    r = int(self.ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if r < NO_RANK:
                        heapq.heappush(heap, (r, k, *pair))
        return [p for p in alive if p is not None]

    def code(self, ids: list[int]) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit numbers, and their tokens with spaces between."""
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.token_list[i] for i in ids])

    def word_codes(self, words: list[str]) -> dict[str, tuple[bytes, str]]:
        """The codes of distinct words."""
        out, by_length = {}, {}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            n = len(raw)
            if n in by_length:
                by_length[n][0].append(word)
                by_length[n][1].append(raw)
            else:
                by_length[n] = [word], [raw]
        token = self.token_list.__getitem__
        for n, (same, raws) in by_length.items():
            if n > LONG_WORD:
                for word, raw in zip(same, raws):
                    out[word] = self.code(self.merge_long([*self.inner[list(raw[:-1])].tolist(), int(self.final[raw[-1]])]))
                continue
            raw = np.frombuffer(b"".join(raws), dtype=np.uint8).reshape(-1, n)
            parts = np.concatenate([self.inner[raw[:, :-1]], self.final[raw[:, -1:]]], axis=1)
            for rows, done in self.merge_short(parts):
                width, data = done.shape[1] * 4, done.astype("<u4").tobytes()
                if width == 4:
                    shown = map(token, done[:, 0].tolist())
                else:
                    shown = [" ".join(map(token, ids)) for ids in done.tolist()]
                codes = [data[i : i + width] for i in range(0, len(data), width)]
                out.update(zip([same[i] for i in rows.tolist()], zip(codes, shown)))
        return out

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
            if HAS_NEWER_CASE(text):
                text = text.translate(SMALL)
        return text.lower()

    def split_chunks(self, text: str) -> list[str]:
        """Runs without white space, after normalisation; a word never spans two of them."""
        return NOT_WHITE(text) if UNITS.search(text) else text.split()

    def chunk_words(self, chunk: str) -> list[str]:
        return (self.strict_words if not chunk.isascii() and self.has_newer(chunk) else self.words)(chunk)

    def learn(self, chunks: set[str]) -> None:
        """Fill the cache with the codes of chunks that it lacks. Most are one word, all letters."""
        mixed = {c: self.chunk_words(c) for c in chunks if not c.isalpha()}
        words = chunks.difference(mixed)
        inside = {w for ws in mixed.values() for w in ws}
        codes = self.word_codes([w for w in words | inside if w not in self.chunks])
        known = self.chunks
        for chunk, ws in mixed.items():
            own = [codes[w] if w in codes else known[w] for w in ws]
            known[chunk] = own[0] if len(own) == 1 else (b"".join([x[0] for x in own]), " ".join([x[1] for x in own]))
        known.update(codes)
        self.passing += [x for xs in (mixed, codes) for x in xs if len(x) > CACHED_LENGTH]

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each whole text; decoding joins tokens with spaces, as a vocabulary without decoder does."""
        split = []
        for text in texts:
            pieces = self.split_special(text) if self.split_special else [text]
            split.append([p if i % 2 else self.split_chunks(self.normal(p)) for i, p in enumerate(pieces)])
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks.clear()
        unknown = set()
        for pieces in split:
            for piece in pieces[::2]:
                unknown.update(piece)
        unknown.difference_update(self.chunks)
        self.learn(unknown)
        known, out = self.chunks.__getitem__, []
        for pieces in split:
            ids, shown = [], []
            for i, piece in enumerate(pieces):
                if i % 2:
                    ids.append(struct.pack("<I", self.special[piece]))
                    shown.append(piece)
                elif piece:
                    a, b = zip(*map(known, piece))
                    ids += a
                    shown += b
            out.append((b"".join(ids), " ".join(shown)))
        for chunk in self.passing:
            self.chunks.pop(chunk, None)
        self.passing.clear()
        return out


@lru_cache(maxsize=2)
def _loaded(spec: str) -> WordBPE:
    return WordBPE(spec)


def encoder(spark: SparkSession, vocabulary: str, finish, returns: str):
    """A pandas UDF that encodes texts and turns each ``(ids, decoded)`` into a row by ``finish``. The file's text goes along as a broadcast of its own size (some MB)."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def rows(texts):
        bpe = _loaded(spec.value)
        codes = [finish(*x) for _, run in text_groups(texts) for x in bpe.encode_batch(run)]
        return pd.DataFrame(codes, columns=[c.split()[0] for c in returns.split(", ")])

    @F.pandas_udf(returns)
    def run(texts: pd.Series) -> pd.DataFrame:
        return rows(texts)

    return run


def _codes(ids: bytes, decoded: str):
    return len(ids) // 4, ids, decoded


def _digests(ids: bytes, decoded: str):
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def encoded(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """A struct of n_tokens, ids (little-endian unsigned 32-bit) and decoded text."""
    return encoder(spark, vocabulary, _codes, CODES)(text)


def _ids(ids: bytes, decoded: str):
    return len(ids) // 4, ids


def ids_only(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """A struct of n_tokens and ids (little-endian unsigned 32-bit)."""
    return encoder(spark, vocabulary, _ids, "n_tokens long, ids binary")(text)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    run = encoder(spark, vocabulary or default_vocabulary(), _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", run("text").alias("code")).select("doc_id", "code.*")


QUERIES = {"op4_bpe": op4_bpe}
SQL: dict[str, str] = {}
