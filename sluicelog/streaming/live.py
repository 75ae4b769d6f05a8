"""The same folds over streams, with keyed state that Spark checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.entries import Entries
from ..operators.folds import DISPATCH, Subscription, ranges_of, with_ranges
from ..sources.shared import scratch_path, stored

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRONTIER = "topic string, subscription string, mark_delete_ord long, holes long"


HOLES = 1 << 15  # places of a page of holes
ACKS = 1_000_000  # acks that are taken into the pages together
ROWS = 4_000_000  # rows of a replayed slice at most, if the order spreads them evenly
FILES = 8  # of a replayed slice of at least SPLIT rows
SPLIT = 100_000
EMITTED = 10_000
KINDS = ["publish", "ack", "ack_cumulative", "join", "leave", "flow", "redeliver", "seek", "unsubscribe"]
NULL = np.iinfo(np.int64).min


class AckFrontier(StatefulProcessor):
    """Mark-delete frontier and holes of a subscription. Holes are pages of bits, keyed state of their own, so a batch touches only pages that it acks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frontier = handle.getValueState("frontier", "ord long, holes long")
        self.held = handle.getMapState("hole_pages", "page long", "bits binary")

    def page(self, p: int) -> np.ndarray | None:
        body = self.held.getValue((p,)) if self.held.containsKey((p,)) else None
        return None if body is None else np.unpackbits(np.frombuffer(bytes(body[0]), np.uint8))

    def keep(self, p: int, bits: np.ndarray) -> None:
        self.held.updateValue((p,), (np.packbits(bits).tobytes(),))

    def take(self, ords: np.ndarray, at: int) -> int:
        """Note acks after the frontier; how many of them are new."""
        ords = np.unique(ords[ords > at])
        pages, starts = np.unique(ords // HOLES, return_index=True)
        new = 0
        for p, own in zip(pages.tolist(), np.split(ords, starts[1:])):
            bits = self.page(p)
            bits = np.zeros(HOLES, np.uint8) if bits is None else bits
            new += len(own) - int(bits[own % HOLES].sum())
            bits[own % HOLES] = 1
            self.keep(p, bits)
        return new

    def run(self, at: int) -> int:
        """The end of the run of holes right after the frontier. Pages that lie before it go."""
        while (bits := self.page((at + 1) // HOLES)) is not None:
            left = bits[(at + 1) % HOLES :]
            n = len(left) if left.all() else int(left.argmin())
            at += n
            if n < len(left):
                break
            self.held.removeKey((at // HOLES,))
        return at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, holes = self.frontier.get() if self.frontier.exists() else (-1, 0)
        waiting: list[np.ndarray] = []
        for batch in rows:
            waiting.append(batch["ord"].dropna().to_numpy(np.int64))
            if sum(map(len, waiting)) >= ACKS:
                holes += self.take(np.concatenate(waiting), at)
                waiting = []
        if waiting:
            holes += self.take(np.concatenate(waiting), at)
        end = self.run(at)
        at, holes = end, holes - (end - at)
        self.frontier.update((at, holes))
        yield pd.DataFrame([(*key, at, holes)], columns=[c.split()[0] for c in FRONTIER.split(", ")])

    def close(self) -> None:
        pass


class Batch:
    """The events of a key in a micro-batch, in the order of their sequence; numbers are held in columns, since all must be there to be sorted."""

    def __init__(self, rows: Iterator[pd.DataFrame]):
        self.named: dict[int, tuple] = {}  # names and ranges, which few events have, by their place
        parts: list[list[np.ndarray]] = []
        n = 0
        for rows_ in rows:
            whole = [np.where(rows_[c].isna(), NULL, rows_[c].fillna(0).astype(np.int64)) for c in ("seq", "consumer_id", "ord", "n")]
            parts.append([*whole, np.array([KINDS.index(k) for k in rows_["kind"]], np.uint8)])
            ranges = rows_["ranges"] if "ranges" in rows_.columns else None
            has = rows_["name"].notna() if ranges is None else rows_["name"].notna() | ranges.notna()
            for i in np.flatnonzero(has.to_numpy()).tolist():
                name, own = rows_["name"].iloc[i], None if ranges is None else ranges.iloc[i]
                self.named[n + i] = (None if pd.isna(name) else name, ranges_of(None if own is None or pd.isna(own) else own))
            n += len(rows_)
        self.columns = []
        for i in range(5):
            self.columns.append(np.concatenate([p[i] for p in parts]))
            for p in parts:
                p[i] = None
        self.order = np.argsort(self.columns[0], kind="stable")

    def __iter__(self) -> Iterator[tuple]:
        for start in range(0, len(self.order), EMITTED):
            places = self.order[start : start + EMITTED]
            seqs, *whole, kinds = (c[places].tolist() for c in self.columns)
            consumers, ords, ns = ([None if x == NULL else x for x in column] for column in whole)
            for place, seq, kind, consumer, o, n in zip(places.tolist(), seqs, kinds, consumers, ords, ns):
                name, ranges = self.named.get(place, (None, None))
                yield KINDS[kind], consumer, o, n, name, seq, ranges


class Dispatch(StatefulProcessor):
    """The dispatch state of a subscription: a small head, and pages of its entries, of which a micro-batch reads and writes those that it touches.

    A micro-batch's events are applied in the order of their sequence.
    """

    def __init__(self, mode: str):
        self.mode = mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "body binary")
        self.pages = handle.getMapState("entry_pages", "page long", "body binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        load = lambda p: bytes(self.pages.getValue((p,))[0])
        state = Subscription(self.mode, Entries(load, lambda p, body: self.pages.updateValue((p,), (body,))))
        if self.head.exists():
            state.resume(bytes(self.head.get()[0]))
        names = [c.split()[0] for c in DISPATCH.split(", ")]
        out: list[tuple] = []
        for e in Batch(rows):
            out += [(*key, e[5], *d) for d in state.event(*e)]
            if len(out) >= EMITTED:
                yield pd.DataFrame(out, columns=names)
                out = []
        state.entries.put_away()
        self.head.update((state.head(),))
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def ack_frontiers(acks: DataFrame) -> DataFrame:
    """The stream of frontiers of a stream of individual acks (topic, subscription, ord)."""
    return _stateful(acks, AckFrontier(), FRONTIER)


def dispatches(events: DataFrame, mode: str) -> DataFrame:
    """The stream of deliveries of a stream of events as ``operators.folds.dispatched`` takes them."""
    return _stateful(with_ranges(events) if "ranges" in events.columns else events, Dispatch(mode), DISPATCH)


def _stateful(df: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    keyed = df.groupBy("topic", "subscription")
    return keyed.transformWithStateInPandas(statefulProcessor=processor, outputStructType=StructType.fromDDL(schema), outputMode="Update", timeMode="None")


def replayed(df: DataFrame, order: str, slices: int = 3, path: str | None = None, most: int = ROWS) -> DataFrame:
    """A stream of a table's rows: slices in ascending ``order``, each a micro-batch. They are added to what ``path`` holds, if that is given.

    There are at least ``slices``, and so many that one has about ``most`` rows. The table is computed once and kept in that order, so a slice reads little
    else than itself. A slice is one file; in a folder of its own, large ones are ``FILES`` each, empty ones added, as micro-batches are told apart by their number.
    """
    spark = df.sparkSession
    rows = stored(df.repartitionByRange(order).sortWithinPartitions(order), "replayed")
    low, high, n = rows.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    slices = max(slices, -(-n // most))
    step = max(1, -(-((high or 0) - (low or 0) + 1) // slices))
    each = FILES if path is None and n // slices >= SPLIT else 1
    path = path or scratch_path(spark, "replay")
    for i in range(slices):
        start = (low or 0) + i * step
        part = rows.where(F.col(order).between(start, start + step - 1))
        (part.repartition(each) if each > 1 else part.coalesce(1)).write.mode("append").parquet(path)
        if each > 1:
            missing = each * (i + 1) - len(spark.read.schema(df.schema).parquet(path).inputFiles())
            for _ in range(missing):
                rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def drained(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Run a stream over all that is there now; its output rows with the number of their micro-batch, as a table.

    With the ``path`` of an earlier run it goes on from that run's state and reads only what has come since; the table holds the rows of all runs.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/part={number}")

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)
    return spark.read.schema(StructType.fromDDL(", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema), "batch int"]))).parquet(f"{path}/out")


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """The last update of each key."""
    others = [c for c in updates.columns if c not in (*keys, "batch", "part")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*")
