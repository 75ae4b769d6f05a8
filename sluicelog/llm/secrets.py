"""Secret scan: fixed expressions, and zstandard novelty for strings that no expression names.

Novelty measures how many bytes a candidate adds, where it stands, to the zstandard frame of the text around it, with a dictionary in front: common
identifiers, and those that ``identifiers`` counts over the texts with sensitive context of all documents. What the surroundings or the
dictionary know costs a few bytes; a random string costs nearly its own entropy. A candidate is a run of ``LEAST`` or more characters of base 64, or
of hexadecimal digits, that has a digit or whose letters change case as often as random ones do (``CASE_CHANGES``); camel-case names don't. One with a
sensitive word shortly before or after it is reported if its marginal bytes are at least ``NOVELTY`` of its length. Candidates that only white
space or punctuation parts, such as the lines of a key block or the parts of a signed token, are a run and share their context; so do all
inside a private key block. Beside a base span the rest of a candidate is judged.

Spans are ``kind:start:end`` in code points, the end exclusive. Null and empty texts have none. Repeated rows are scanned row by
row; columns other than the key and text are ignored. Tables may be empty; without sensitive texts the dictionary is the common one.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SENSITIVE = re.compile(r"passw|secret|token|api[\x20_-]?key|credential|authori[sz]ation|bearer|private[\x20_-]?key|access[\x20_-]?key|signature|client[\x20_-]?id", re.I | re.A)
#: What parts two candidates of a run; a private key block's header; its last line, if too short for a candidate.
GAP = re.compile(r"(?:\\[nrt]|[\W_])*")
BLOCK = re.compile(r"-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY(?: BLOCK)?-----")
LAST_LINE = re.compile(r"(?:\s|\\[nrt]){1,64}([A-Za-z0-9+/_=-]{1,19}?)(?:\s|\\[nrt]){0,64}-----END")
CONTEXT, SURROUNDING, NOVELTY = 64, 256, 0.55
#: A candidate's least characters, and the share of neighbouring characters between which the case has to change if it has no digit.
LEAST, CASE_CHANGES = 20, 0.3
#: Identifiers of the corpus in the dictionary, at most, by how many texts have them; those of one text only are left out.
DICTIONARY_WORDS = 4096
#: The dictionary in front of every frame, unless the caller gives another one.
IDENTIFIERS = (
    "password passwd secret token apikey api_key access_key private_key client_id client_secret authorization bearer credential signature "
    "username user_id account config settings environment production development localhost database connection request response "
    "header content length version public static final return import export function class const string integer boolean null true false "
    "default example sample placeholder changeme your_token_here insert_key_here abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "0123456789abcdef 0123456789ABCDEF 1234567890 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX 0000000000000000 ----------------"
)
#: Bytes of a candidate's alphabet become ``c``, of these those that are also lower-case hexadecimal digits ``h``; others a space.
_CAND = bytes(ord("c") if chr(b).isalnum() and b < 128 or chr(b) in "+/_=-" else 32 for b in range(256))
_HEX = bytes(ord("h") if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def plausible(candidate: str) -> bool:
    """Whether it has a digit, or letters that change case as those of random strings do."""
    changes = sum(a.isalpha() and b.isalpha() and a.isupper() != b.isupper() for a, b in zip(candidate, candidate[1:]))
    return any(map(str.isdigit, candidate)) or changes >= CASE_CHANGES * (len(candidate) - 1)


class Scanner:
    def __init__(self, identifiers: str = IDENTIFIERS, novelty: float = NOVELTY):
        import zstandard

        words = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.frame = zstandard.ZstdCompressor(level=6, dict_data=words, write_content_size=False).compress
        self.novelty = novelty

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, kind number, end)`` of what the fixed expressions find."""
        found, raw = [], text.encode("utf-8", "surrogatepass")
        low = raw.lower()
        if any(w.encode() in low for w in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        if b"h" * 24 in raw.translate(_HEX):
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return found

    def marginal(self, before: str, candidate: str, after: str) -> float:
        """Bytes that the candidate adds where it stands, per byte of its own."""
        around, whole = (before + after).encode("utf-8", "replace"), (before + candidate + after).encode("utf-8", "replace")
        return (len(self.frame(whole)) - len(self.frame(around))) / len(candidate)

    def runs(self, text: str) -> list[list[tuple[int, int]]]:
        """Runs of adjacent candidates, in sensitive context."""
        runs: list[list[tuple[int, int]]] = []
        for m in CANDIDATE.finditer(text):
            if runs and m.start() - runs[-1][-1][1] <= CONTEXT and GAP.fullmatch(text, runs[-1][-1][1], m.start()):
                runs[-1].append(m.span())
            else:
                runs.append([m.span()])
        blocks: list[tuple[int, int]] = []
        for m in BLOCK.finditer(text):
            if not blocks or blocks[-1][1] < m.end():
                blocks.append((m.end(), text.find("-----END", m.end())))
            if blocks[-1][1] < 0:
                blocks.pop()
                break
        found, at = [], 0
        for run in runs:
            (first, first_end), (last, last_end) = run[0], run[-1]
            while at < len(blocks) and blocks[at][1] <= first:
                at += 1
            in_block = at < len(blocks) and blocks[at][0] <= last_end
            if in_block or SENSITIVE.search(text, max(0, first - CONTEXT), last) or SENSITIVE.search(text, first_end, last_end + CONTEXT):
                found.append(run)
        return found

    def novel(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates, or what the spans in ``taken`` leave of them, in sensitive context and novel."""
        if b"c" * 20 not in text.encode("utf-8", "surrogatepass").translate(_CAND):
            return []
        found, at = [], 0
        for start, end in (span for run in self.runs(text) for span in run):
            while at < len(taken) and taken[at][2] <= start:
                at += 1
            parts, left, i = [], start, at
            while i < len(taken) and taken[i][0] < end:
                s, kind, e = taken[i]
                # what stands before an assignment is part of its name, unless it is a candidate by itself
                if s - left >= (20 if kind == 0 else 1):
                    parts.append((left, s))
                left, i = e, i + 1
            if left < end:
                parts.append((left, end))
            for s, e in parts:
                if plausible(text[s:e]) and self.marginal(text[max(0, s - SURROUNDING) : s], text[s:e], text[e : e + SURROUNDING]) >= self.novelty:
                    found.append((s, 3, e))
            if parts and found and found[-1][2] == end and (m := LAST_LINE.match(text, end)):
                found.append((m.start(1), 3, m.end(1)))
        return found

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The base spans and all spans, each by start, then kind."""
        base = sorted(self.base(text))
        longest: list[tuple[int, int, int]] = []
        for s, k, e in base:  # disjoint cover, so that candidates meet each at most once
            if longest and s < longest[-1][2]:
                longest[-1] = (longest[-1][0], longest[-1][1], max(e, longest[-1][2]))
            else:
                longest.append((s, k, e))
        return base, sorted(base + self.novel(text, longest))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, or run of overlapping ones, replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def identifiers(docs: DataFrame, text: str = "text", most: int = DICTIONARY_WORDS) -> str:
    """The dictionary: common identifiers after those of the corpus, the most frequent last, where zstandard finds them cheapest.

    Counted are words of 3 to 19 letters, once a text, over all texts with a sensitive word beside something to judge; what
    could itself be a secret, every run of a candidate's characters and length, is blotted out first. At most ``most`` words come to the driver.
    """
    texts = docs.select(F.col(text).alias("t")).where(F.col("t").rlike(CANDIDATE.pattern) & F.col("t").rlike("(?i)" + SENSITIVE.pattern))
    words = texts.select(F.explode(F.array_distinct(F.split(F.regexp_replace("t", CANDIDATE.pattern, " "), "[^A-Za-z_]+"))).alias("word"))
    counted = words.where(F.length("word").between(3, LEAST - 1)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]
    return " ".join([*reversed(found), IDENTIFIERS])


def scanned(text: Column, dictionary: str = IDENTIFIERS) -> Column:
    """A struct of the counts of the base kinds, the digest of the base spans, and all spans."""

    def run(texts: pd.Series) -> pd.DataFrame:
        scanner, rows = Scanner(dictionary), []
        for text in texts:
            base, spans = scanner.scan(text or "")
            counts = [sum(k == i for _, k, _ in base) for i in range(3)]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCAN.split(", ")])

    return F.pandas_udf(run, SCAN)(text)


def redacted(text: Column, dictionary: str = IDENTIFIERS) -> Column:
    """The text with all spans replaced by ``[SECRET]``; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        scanner = Scanner(dictionary)
        return pd.Series([None if t is None else redact(t, scanner.scan(t)[1]) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", scanned(F.col("text"), identifiers(docs)).alias("scan")).select("doc_id", "scan.*")


QUERIES = {"op7_secrets": op7_secrets}
SQL: dict[str, str] = {}
