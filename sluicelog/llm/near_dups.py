"""Near-duplicate documents by an LSH forest of MinHash signatures.

Every distinct shingle set gets a signature per tree: ``LEVELS`` min-hashes in the tree's order. Signatures are sorted, all trees in one
order over all tasks, and every set is compared with its neighbours there by the length of their longest common prefix. A run whose neighbours
share ``LEAST_DEPTH`` levels or more is a region, and its members are candidates. Regions of up to ``REGION`` sets are compared whole. In
larger ones the depth adapts: walking along the order, a block of neighbours ends where, of its last half, the common prefix is shortest, so
that sets with long common prefixes stay together whatever the depth it takes. Blocks overlap by ``OVERLAP`` neighbours, and every block
also holds the same ``PIVOTS`` sets of its region. Regions of the same members, which true duplicates give in most trees, are
compared once.

What the blocks of crowded regions leave unlinked is joined exactly: two sets of the threshold share a shingle among the rarest
of both (prefix filter, with bounds of length and position). Only pairs of different components are joined, on keys that are
salted where a shingle is common. Their members meet in cells, which are checked like regions, so again only stars leave.

Inside a region all pairs are checked on their full shingle sets, and only a star for each group of linked members leaves
the task, never the pairs. Stars become components by alternating large-star and small-star rounds.

Equal shingle sets are one class from the start, held by the smallest id. A link at the threshold itself is missed with a chance of
``(1 - s**LEAST_DEPTH)**TREES`` (7e-6 at 0.85, 2e-4 at 0.8); inside a region, crowded or not, none is missed.

Null and empty texts, and texts without words, have no shingles and link with nothing. A row with a null id is returned with a null
component, is linked with nothing and is kept. Rows that share an id are one document: they share a component, and what any of their texts is
linked with belongs to it. Tables may be empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, small, stored

TREES, LEVELS, LEAST_DEPTH = 16, 12, 4
REGION, OVERLAP, PIVOTS = 256, 32, 32
#: A shingle's members of two components are paired in salted parts of about this many.
POSTINGS = 1024
WORDS_HELD = 300_000
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


_words = _Words()


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of ``size`` words; all words as one if there are fewer; A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > WORDS_HELD:
        _words.clear()
    w = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = (h ^ (h >> np.uint64(31))) * _MIX + w[i : len(w) - size + 1 + i]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(32)))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    a, b = rng.integers(0, 2**63, size=(2, TREES * LEVELS), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def signature(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per tree three 64-bit numbers that hold ``LEVELS`` 16-bit min-hashes, first levels first; the first number differs between trees."""
    low = np.full(TREES * LEVELS, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(points), 1024):
        np.minimum(low, (points[i : i + 1024, None] * a + b).min(0), out=low)
    low = ((low ^ (low >> np.uint64(31))) * _MIX) >> np.uint64(48)
    packed = low.reshape(TREES, LEVELS // 4, 4) @ np.array([1 << 48, 1 << 32, 1 << 16, 1], dtype=np.uint64)
    packed[:, 0] ^= np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return packed


SKETCH = "id long, n long, d1 long, d2 long, keys array<long>, deep array<long>"


def _sketcher(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations()
        for batch in batches:
            n, digests, packed = [], [], []
            for text in batch.column(1):
                points = shingles(text.as_py(), size)
                n.append(len(points))
                digests.append(xxhash.xxh3_128_digest(points.tobytes()))
                packed.append(signature(points, a, b) if len(points) else np.zeros((TREES, LEVELS // 4), dtype=np.uint64))
            d = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2) if digests else np.empty((0, 2), dtype="<i8")
            p = np.array(packed, dtype=np.uint64).reshape(-1, TREES, LEVELS // 4).view(np.int64)
            lists = lambda x, k: pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(x).ravel()))  # noqa: B023, E731
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists(p[:, :, 0], TREES), lists(p[:, :, 1:], TREES * 2)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "d1", "d2", "keys", "deep"])

    return run


def links_of(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The component (its first member) of each set, where sets with ``100 * intersection >= percent * union`` are linked; all pairs."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    if m == 2:
        both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
        both[1] = both[0][::-1]
    else:
        points, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = np.cumsum(counts > 1) - 1
        shared = counts[place] > 1
        owner, place = np.repeat(np.arange(m), sizes)[shared], common[place[shared]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        both, step = np.zeros((m, m), dtype=np.float64), 4096
        for first in range(0, int(place[-1]) + 1 if len(place) else 0, step):
            lo, hi = np.searchsorted(place, (first, first + step))
            block = np.zeros((m, step), dtype=np.float32)
            block[owner[lo:hi], place[lo:hi] - first] = 1
            both += block @ block.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = (100 * both >= percent * union) & (both > 0)
    root = np.arange(m)
    while True:
        lowest = np.where(linked, root[None, :], m).min(1)
        new = np.minimum(root, lowest)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _star_edges(size: int, percent: int):
    def edges(ids: list[int], texts: list[str]) -> list[tuple[int, int]]:
        rows = sorted(dict(sorted(zip(ids, texts), reverse=True)).items())
        if len(rows) < 2:
            return []
        root = links_of([shingles(t, size) for _, t in rows], percent)
        return [(rows[r][0], rows[i][0]) for i, r in enumerate(root.tolist()) if r != i]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        region, ids, texts = None, [], []
        for batch in batches:
            found = []
            for r, i, t in zip(batch["region"].tolist(), batch["id"].tolist(), batch["text"]):
                if r != region:
                    found += edges(ids, texts)
                    region, ids, texts = r, [], []
                ids.append(i)
                texts.append(t)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(edges(ids, texts), columns=["a", "b"], dtype="int64")

    return run


def common_levels(l1: np.ndarray, l2: np.ndarray, l3: np.ndarray) -> np.ndarray:
    """How many levels each row of a sorted order shares with the row before it (-1 for the first one); fewer than 4 count as 0."""
    at = np.full(len(l1), -1, dtype=np.int64)
    if len(l1) > 1:
        levels = lambda x: (x[:, None] < np.array([1 << 48, 1 << 32, 1 << 16, 1], dtype=np.uint64)).sum(1)
        first, second, third = (x[1:].view(np.uint64) ^ x[:-1].view(np.uint64) for x in (l1, l2, l3))
        at[1:] = np.where(first == 0, 4 + levels(second) + np.where(second == 0, levels(third), 0), 0)
    return at


def blocks_of(common: np.ndarray, size: int, overlap: int, whole: bool = True) -> list[tuple[int, int]]:
    """Bounds of blocks of at most ``size`` neighbours; one ends where, in its last half, the common prefix is shortest, and the next begins ``overlap`` before.

    Without ``whole`` the last block, which rows to come may still belong to, is left out.
    """
    found, start, at, n = [], 0, 0, len(common)
    while n - at > size - (at - start):
        low, high = max(at + 1, start + size // 2), start + size
        at = high - int(common[low : high + 1][::-1].argmin())
        found.append((start, at))
        start = max(at - overlap, start)
    if whole and n > at:
        found.append((start, n))
    return found


def _walker(size: int, overlap: int):
    """Deals a part of the sorted order to regions: rows are key, l2, l3, id and the size of the key's run over all parts."""

    def mix(key: np.ndarray, x) -> np.ndarray:
        h = key.view(np.uint64) ^ x
        return ((h * _MIX) ^ (h >> np.uint64(29))).view(np.int64)

    def deal(rows: np.ndarray, whole: bool):
        """The blocks of a crowded run's rows, and what of them is left for rows to come."""
        bounds = blocks_of(common_levels(*rows[:3]), size, overlap, whole)
        parts = [(rows[0, i:j], mix(rows[0, i:j], mix(rows[3, i : i + 1], np.uint64(1)).view(np.uint64)), rows[3, i:j]) for i, j in bounds]
        return parts, rows[:, max(bounds[-1][1] - overlap, 0) if bounds else 0 :]

    def batch_of(parts, crowded: bool) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate([p[i] for p in parts])) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), crowded))], names=["key", "region", "id", "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4, 0), dtype=np.int64)
        for batch in batches:
            rows = np.array([batch.column(i).to_numpy() for i in range(5)])
            wide = rows[4] > size
            if not wide.all():
                key, ids = rows[0][~wide], rows[3][~wide]
                yield batch_of([(key, mix(key, np.uint64(0)), ids)], False)
            rows = np.concatenate([held, rows[:4, wide]], axis=1)
            found, runs = [], np.split(rows, np.flatnonzero(np.diff(rows[0])) + 1, axis=1)
            for whole in runs[:-1]:
                found += deal(whole, True)[0]
            parts, held = deal(runs[-1], False)
            if found + parts:
                yield batch_of(found + parts, True)
        if held.shape[1]:
            yield batch_of(deal(held, True)[0], True)

    return run


def regions(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(region, id)``: which sets are compared with each other, and ``(key, id)`` of the crowded regions, None if there are none.

    ``reps`` has id, keys and deep of distinct shingle sets.
    """
    members = reps.select("id", "deep", F.posexplode("keys").alias("tree", "key"))
    h1, h2 = F.xxhash64("id"), F.xxhash64("id", F.lit(1))
    sized = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(h1).alias("x1"), F.bit_xor(h2).alias("x2")).where("c > 1")
    sized = stored(sized, "forest-regions")
    # who has a neighbour at the least depth at all, and of regions with the same members only one
    kept = sized.where(F.col("c") <= REGION).groupBy("c", "x1", "x2").agg(F.min("key").alias("key")).select("key", "c")
    kept = stored(kept.unionByName(sized.where(F.col("c") > REGION).select("key", "c")), "forest-kept")
    order = ["key", "l2", "l3", "id"]
    forest = members.join(small(kept), "key").select("key", F.get("deep", F.col("tree") * 2).alias("l2"), F.get("deep", F.col("tree") * 2 + 1).alias("l3"), "id", "c")
    walked = forest.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walker(REGION, min(OVERLAP, REGION // 4)), "key long, region long, id long, crowded boolean")
    walked = stored(walked, "forest-order")
    crowded = kept.where(F.col("c") > REGION)
    if crowded.isEmpty():
        return walked.select("region", "id"), None
    wide = walked.where("crowded")
    blocks = wide.select("key", "region").distinct()
    is_pivot = F.pmod(F.xxhash64("id", "key"), F.lit(1 << 30)) < F.lit(float(PIVOTS << 30)) / F.col("c")
    pivots = wide.join(small(crowded), "key").where(is_pivot).select("key", "id").distinct()
    return walked.select("region", "id").unionByName(blocks.join(small(pivots), "key").select("region", "id")), wide.select("key", "id").distinct()


def _poster(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, component, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                points = shingles(text.as_py(), size).view(np.int64)
                same = lambda x: pa.array(np.full(len(points), x, dtype=np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(i), same(component), same(len(points)), pa.array(points)], names=["id", "component", "n", "point"])

    return run


def unlinked(crowded: DataFrame, found: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """``(region, id)``: cells that hold every pair of crowded regions' members which may be linked and is in different components.

    ``crowded`` is ``(key, id)``, ``found`` the components ``(rep, component)`` up to now, ``rows`` ``(id, text)``.
    """
    component = F.coalesce("component", F.col("id"))
    members = crowded.join(small(found), F.col("id") == F.col("rep"), "left").select("key", "id", component.alias("component"))
    split = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    members = stored(members.join(small(split), "key", "left_semi").select("id", "component").distinct(), "forest-unlinked")
    texts = rows.join(small(members), "id").groupBy("id", "component").agg(F.min("text").alias("text"))
    postings = stored(texts.mapInArrow(_poster(size), "id long, component long, n long, point long"), "forest-postings")
    by_point = postings.groupBy("point", "component").agg(F.count(F.lit(1)).alias("c"))
    by_point = by_point.groupBy("point").agg(F.sum("c").alias("df"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("c", "component")).alias("major"))
    # a shingle that only one set has comes first in the order and pairs nothing: it counts, but isn't carried on
    held = postings.join(by_point.where("df > 1"), "point")
    by_id = Window.partitionBy("id")
    place = F.col("n") - F.count(F.lit(1)).over(by_id) + F.row_number().over(by_id.orderBy("df", "point")) - 1
    ranked = held.withColumn("rest", F.col("n") - place).where(F.col("parts") > 1).where(F.col("rest") * 100 >= F.col("n") * percent)
    ranked = stored(ranked.select("point", "id", "component", "n", "rest", "major", F.ceil(F.col("df") / POSTINGS).cast("int").alias("salts")), "forest-prefixes")
    # every pair of components has a side that isn't the shingle's largest component; that side is a
    salt, every = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    a = ranked.where("component <> major").select("point", salt.alias("i"), every.alias("j"), *[F.col(x).alias(f"a_{x}") for x in ("id", "component", "n", "rest")])
    b = ranked.select("point", every.alias("i"), salt.alias("j"), (F.col("component") == F.col("major")).alias("largest"), *[F.col(x).alias(f"b_{x}") for x in ("id", "component", "n", "rest")])
    bound = (F.least("a_rest", "b_rest") * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent) & (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
    pairs = a.join(b, ["point", "i", "j"]).where(bound & (F.col("a_component") != F.col("b_component")) & (F.col("largest") | (F.col("a_id") < F.col("b_id"))))
    chunks = max(1, -(-members.count() // REGION))
    chunk = [F.pmod(F.xxhash64(x, F.lit(2)), F.lit(chunks)) for x in ("a_id", "b_id")]
    cells = pairs.select(F.xxhash64(F.least(*chunk), F.greatest(*chunk), F.lit(3)).alias("region"), F.explode(F.array("a_id", "b_id")).alias("id"))
    return stored(cells.distinct(), "forest-cells")


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every node of ``edges(a, b)``; a component is its smallest node. Rounds are stored, so lineage stays short."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    held, before = stored(edges, "star"), None
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the centres' minima are stored: a join with a stored side can be split where one centre has very many members
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-least")
        large = both.join(small(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "star-large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "star-low")
        joined = large.join(small(low), "u")
        next_edges = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = stored(next_edges, "star")
        mark = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        for old in (held, least, large, low):
            discard(old)
        held = new
        if before == mark:
            break
        before = mark
    return held.select(F.col("u").alias("id"), F.col("v").alias("component")).groupBy("id").agg(F.min("component").alias("component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` of every row; documents whose sets have a Jaccard likeness of ``percent`` or more are linked."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketch = stored(rows.mapInArrow(_sketcher(size), SKETCH), "forest-sketch")
    sets = sketch.where("id is not null").groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi"))
    if sets.where("lo <> hi").isEmpty():
        found = _near_duplicates(rows, sketch, size, percent)
    else:
        found = _with_repeated_ids(rows, size, percent)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _with_repeated_ids(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """``(id, n, component)`` where an id may have several texts: each text is searched under a number of its own, then an id's numbers are linked."""
    marked = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    numbers = marked.where("id is not null").select("id", "digest").distinct().orderBy("id", "digest").withColumn("number", F.monotonically_increasing_id())
    numbers = stored(numbers, "forest-numbers")  # in the order of the ids
    numbered = stored(marked.join(small(numbers), ["id", "digest"], "left").select("id", "number", "text"), "forest-numbered")
    own = numbered.select(F.col("number").alias("id"), "text")
    found = stored(_near_duplicates(own, stored(own.mapInArrow(_sketcher(size), SKETCH), "forest-sketch"), size, percent).distinct(), "forest-found")
    firsts = numbers.groupBy("id").agg(F.min("number").alias("first"))
    same = numbers.join(small(firsts), "id").select(F.col("first").alias("a"), F.col("number").alias("b"))
    linked = found.where("id is not null").select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(same)
    joined = stored(components(linked).select(F.col("id").alias("number"), F.col("component").alias("lowest")), "forest-components")
    lowest = numbers.select(F.col("number").alias("lowest"), F.col("id").alias("component"))
    joined = joined.join(small(lowest), "lowest").select("number", "component")
    counts = found.where("id is not null").select(F.col("id").alias("number"), "n")
    known = numbered.where("number is not null").select("id", "number").join(small(counts), "number").join(small(joined), "number", "left")
    known = known.select("id", "n", F.coalesce("component", "id").alias("component"))
    # rows without an id aren't compared: only their sets are counted
    unknown = rows.where("id is null").mapInArrow(_sketcher(size), SKETCH).select("id", "n", F.lit(None).cast("long").alias("component"))
    return known.unionByName(unknown)


def _near_duplicates(rows: DataFrame, sketch: DataFrame, size: int, percent: int) -> DataFrame:
    """``(id, n, component)`` of every row of ``sketch``; an id has one shingle set."""
    known = sketch.where("n > 0 and id is not null")
    copies = known.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("d1", "d2", "first")
    copies = stored(copies, "forest-copies")
    classed = sketch.join(small(copies), ["d1", "d2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("first", "id")).otherwise(F.col("id")))
    reps = classed.where("n > 0 and id = rep").dropDuplicates(["id"]).select("id", "keys", "deep")
    compared, crowded = regions(reps)

    def linked(compared: DataFrame) -> DataFrame:
        texts = small(compared).join(rows, "id").select("region", "id", "text")
        dealt = texts.repartition("region").sortWithinPartitions("region", "id")
        return stored(dealt.mapInPandas(_star_edges(size, percent), "a long, b long").distinct(), "forest-edges")

    edges = linked(stored(compared.distinct(), "forest-members"))
    found = stored(components(edges).select(F.col("id").alias("rep"), "component"), "forest-components")
    if crowded is not None:
        more = linked(unlinked(crowded, found, rows, size, percent))
        if not more.isEmpty():
            both = found.select(F.col("component").alias("a"), F.col("rep").alias("b")).unionByName(more)
            found = stored(components(both).select(F.col("id").alias("rep"), "component"), "forest-components")
    joined = classed.select("id", "n", "rep").join(small(found), "rep", "left")
    return joined.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")).alias("component"))


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([array_to_string(ws[i:i+2], ' ') FOR i IN range(1, len(ws) - 1)]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 85 * (na.n_shingles + nb.n_shingles - common)),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

QUERIES = {"op5_near_dups": op5_near_dups}
SQL = {"op5_near_dups": OP5_SQL}
