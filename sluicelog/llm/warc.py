"""WARC archives written and read through Spark, with an external merge of their capture index.

Writing: payloads are grouped by SHA-1, size and SHA-256; the smallest key of a group is its response and the others are revisits that
refer to it. Each task writes its records, gzipped, by Spark's own writer, so the archives can lie in any store that Spark reaches and a
lost task is written again. A file is one gzip member. Records of like size share files, the fewer the larger they are, so a file has
about ``ARCHIVE_BYTES`` at most, or one record.

Reading: every archive is parsed by its Content-Length headers into capture rows, sorted by URL key, time and record key. Each archive
is thus a locally sorted run. Runs are dealt out by ranges of that order. In a range every run comes in blocks of ``BLOCK`` captures, which
arrive by their first capture: a loser tree opens a block only when the merge has come to it, so it holds one block of each run that
spans the place, however many captures the range has. More than ``FAN_IN`` runs are first merged in groups to longer runs. The
ranges follow each other, so the rows of the result stand in global capture order.

A null payload is an empty one; null and empty payloads are one group. Rows with a null key are never a response if the group has a
key; a group of null keys only has responses only. Repeated rows of the smallest key are all responses. A null URL has an empty URL
key. Line breaks in a URL are percent-encoded. Empty tables give empty archives and no captures; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch_path, small, stored

#: About the most bytes of an archive, unpacked, and its most records.
ARCHIVE_BYTES, RECORDS_PER_FILE = 256 << 20, 4096
#: Captures in a block of a run, and runs that are merged at once.
BLOCK, FAN_IN = 64, 512
EPOCH = 1704067200  # 2024-01-01, the capture time of key 0; a key's capture is as many seconds later
CAPTURES = (
    "url_key string, captured string, page_id long, uri string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, archive string, offset long, length long"
)
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexadecimal: Column) -> Column:
    """RFC 4648 base 32 of 40 hexadecimal digits, five of which make four characters."""
    groups = [F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    places = [F.shiftright(g, s).bitwiseAND(31) + 1 for g in groups for s in (15, 10, 5, 0)]
    return F.concat(*[F.substr(F.lit(BASE32), p, F.lit(1)) for p in places])


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    parts = [x for name, value in pairs for x in (F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))]
    return F.concat(*parts)


def decided(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Key, URL, payload, its size and digest, and the key that a revisit refers to (null for a response)."""
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), F.coalesce(payload, F.lit("")).alias("p"))
    same = ["hex", "bytes", "strong"]
    rows = rows.withColumns({"bytes": F.octet_length("p").cast("long"), "hex": F.sha1("p"), "strong": F.unhex(F.sha2("p", 256))})
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy(*same).agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = stored(groups.where("n > 1").select(*same, "first"), "warc-copies")
    rows = rows.join(small(copies), same, "left")
    return rows.withColumn("refers", F.when((F.col("first") != F.col("k")) | F.col("k").isNull(), F.col("first")))


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    rows = decided(pages, **columns)
    id_text = F.coalesce(F.col("k").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("bytes").cast("string"))), F.lit("\r\n"))
    block = F.when(F.col("refers").isNull(), F.concat(http, F.col("p"))).otherwise(F.lit(""))
    uuid = F.regexp_replace(F.substring(F.sha2(F.concat_ws("|", id_text, "u", "hex"), 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    rows = rows.withColumn("block", block)
    common = _lines(
        ("WARC-Target-URI", F.replace(F.replace(F.coalesce("u", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        ("WARC-Date", F.date_format(F.timestamp_seconds(F.coalesce("k", F.lit(0)) + EPOCH), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("hex")))),
        ("X-Record-Key", id_text),
        ("X-Payload-Length", F.col("bytes").cast("string")),
        ("Content-Length", F.octet_length("block").cast("string")),
    )
    response = _lines(("WARC-Type", "response"), ("Content-Type", "application/http; msgtype=response"))
    revisit = _lines(
        ("WARC-Type", "revisit"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("X-Refers-To-Key", F.coalesce(F.col("refers").cast("string"), F.lit(""))),
    )
    kind = F.when(F.col("refers").isNull(), response).otherwise(revisit)
    record = F.concat(F.lit("WARC/1.1\r\n"), kind, common, F.lit("\r\n"), F.col("block"))
    largest = pages.agg(F.max(F.octet_length(columns.get("payload", "html")))).first()[0] or 0
    # of each size class, the largest of which is four times the one below, as many records to a file as the bytes of an archive allow
    low, per_file = -1, RECORDS_PER_FILE
    while low < largest:
        high = ARCHIVE_BYTES // per_file if per_file > 1 else largest
        own = rows.where(F.col("bytes").between(low + 1, high)) if largest > ARCHIVE_BYTES // RECORDS_PER_FILE else rows
        writer = own.select(record.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip")
        writer.option("maxRecordsPerFile", per_file).text(path)
        low, per_file = high, max(per_file // 4, 1)


def url_key(uri: str) -> str:
    """A sortable key: host labels from the top level down, then the path and query."""
    rest = uri.partition("://")[2]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, path = rest[:end].lower(), rest[end:].partition("#")[0]
    return ",".join(reversed(host.split("."))) + ")" + (path or "/") if rest else ""


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an unpacked archive, found by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        stop = end + 4 + int(headers["Content-Length"])
        yield at, stop - at, headers, data[end + 4 : stop]
        at = stop + 4


def _captures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CAPTURES.split(", ")]
    for batch in batches:
        for archive, content in zip(batch["path"], batch["content"]):
            rows = []
            for offset, length, head, block in records(zlib.decompress(content, 47)):
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].partition(":")[2]
                number = lambda name: int(head[name]) if head.get(name) else None  # noqa: B023, E731
                size = number("X-Payload-Length")
                if kind == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                uri = head.get("WARC-Target-URI", "")
                rows.append((url_key(uri), head["WARC-Date"], number("X-Record-Key"), uri, size, digest, kind, number("X-Refers-To-Key"), archive, offset, length))
            rows.sort(key=_order)
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "offset": "int64", "length": "int64"})


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """A locally sorted run of captures per archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInPandas(_captures, CAPTURES)


class LoserTree:
    """Merges sorted runs; each inner node keeps the winner and the loser of its match, so a new head plays only the matches on its way up.

    Runs may be opened at any time; the tree grows by doubling, and the place of an exhausted run is taken again.
    """

    def __init__(self, runs: Iterable[Iterable[tuple]] = (), key=lambda row: row):
        self.key, self.free = key, []
        self.runs: list[Iterator[tuple]] = []
        self.heads: list[tuple | None] = []
        self.keys: list = []
        self._grow(1)
        for run in runs:
            self.open(run)

    def _grow(self, places: int) -> None:
        more = places - len(self.runs)
        self.free += range(len(self.runs), places)  # in order, which is a heap
        self.runs += [iter(())] * more
        self.heads += [None] * more
        self.keys += [None] * more
        self.winners, self.losers = [0] * places + list(range(places)), [0] * places
        for node in range(places - 1, 0, -1):
            self._play(node)

    def _play(self, node: int) -> None:
        a, b = self.winners[2 * node], self.winners[2 * node + 1]
        first = self.keys[b] is None or (self.keys[a] is not None and (self.keys[a], a) < (self.keys[b], b))
        self.winners[node], self.losers[node] = (a, b) if first else (b, a)

    @property
    def best(self) -> int:
        return self.winners[1]

    def open(self, run: Iterable[tuple]) -> None:
        if not self.free:
            self._grow(2 * len(self.runs))
        place = heapq.heappop(self.free)
        self.runs[place] = iter(run)
        self._advance(place)

    def _advance(self, place: int) -> None:
        head = self.heads[place] = next(self.runs[place], None)
        self.keys[place] = None if head is None else self.key(head)
        if head is None:
            heapq.heappush(self.free, place)
        node = (place + len(self.runs)) // 2
        while node:
            self._play(node)
            node //= 2

    def least(self):
        """The key of the row that comes next, None if there is none."""
        return self.keys[self.best]

    def take(self) -> tuple:
        place = self.best
        row = self.heads[place]
        self._advance(place)
        return row

    def __iter__(self) -> Iterator[tuple]:
        while self.least() is not None:
            yield self.take()


BLOCKS = "group int, url_key string, captured string, page_id long, archive string, offset long, rows binary"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cuts rows that are sorted by group, run and order into blocks, each with its first row's order."""
    names, held = [c.split()[0] for c in BLOCKS.split(", ")], []

    def block(rows: list[tuple]) -> tuple:
        first = rows[0]
        return first[-2], first[0], first[1], first[2], first[8], first[9], pickle.dumps([r[:-2] for r in rows])

    for batch in batches:
        found = []
        for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
            if held and (row[-2:] != held[-1][-2:] or len(held) >= BLOCK):
                found.append(block(held))
                held = []
            held.append(row)
        yield pd.DataFrame(found, columns=names).astype({"page_id": "Int64"})
    if held:
        yield pd.DataFrame([block(held)], columns=names).astype({"page_id": "Int64"})


MERGED = CAPTURES + ", run long"


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges the blocks of each group, which arrive by their first rows; a block is opened when the merge has come to its first row."""
    names = [c.split()[0] for c in MERGED.split(", ")]
    tree, group, out = LoserTree(key=_order), None, []
    frame = lambda: pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    for batch in batches:
        for own, content in zip(batch["group"].tolist(), batch["rows"]):
            rows = pickle.loads(content)
            first = _order(rows[0])
            while (least := tree.least()) is not None and (own != group or least < first):
                out.append((*tree.take(), group))
                if len(out) >= 4096:
                    yield frame()
                    out = []
            tree.open(rows)
            group = own
    for row in tree:
        out.append((*row, group))
        if len(out) >= 4096:
            yield frame()
            out = []
    if out:
        yield frame()


def merged_index(runs: DataFrame) -> DataFrame:
    """All captures in global order of URL key, time and record key, by k-way merges over ranges of that order."""
    order = ["url_key", "captured", "page_id", "archive", "offset"]
    held = stored(runs.withColumn("run", F.xxhash64("archive")), "capture-runs")
    n = held.select("run").distinct().count()
    while True:
        groups = -(-n // FAN_IN) if n > FAN_IN else 1
        ranges = held.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int")).select(*[c.split()[0] for c in CAPTURES.split(", ")], "group", "run")
        ranges = ranges.repartitionByRange("group", *order).sortWithinPartitions("group", "run", *order)
        blocks = ranges.mapInPandas(_blocks, BLOCKS).sortWithinPartitions("group", *order)
        merged = blocks.mapInPandas(_merge, MERGED)
        if groups == 1:
            return merged.drop("run")
        before, held, n = held, stored(merged, "capture-runs"), groups
        discard(before)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    index = merged_index(capture_runs(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_GROUP = "('0x' || substr(h, {at}, 5))::INTEGER"
_CHARS = " || ".join(
    f"substr('{BASE32}', (({_GROUP.format(at=5 * g + 1)} >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0)
)
OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY sha1(t)) AS f FROM p)
SELECT page_id, payload_bytes, {_CHARS} AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to FROM q
"""

QUERIES = {"op10_warc": op10_warc}
SQL = {"op10_warc": OP10_SQL}
