"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Rows and bytes up to which a side counts as small enough to broadcast; beyond either the operators shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 128 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, as in tests, gets one of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sluicelog-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Paths that ``stored`` has written, by open ``scratch_scope``.
_scopes: list[list[str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and the rows survive lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    for scope in _scopes:
        scope.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote; nothing may read it afterwards."""
    delete(df.sparkSession, df._stored_path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[set[str]]:
    """Deletes, at its end, all that ``stored`` wrote inside it, but for the paths in the set that it yields."""
    scope, keep = [], set()
    _scopes.append(scope)
    try:
        yield keep
    finally:
        _scopes.remove(scope)
        for path in scope:
            if path not in keep:
                delete(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names, derived from ``names``, that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _bytes_of(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in a broadcast table."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, StructType):
        return reduce(add, [_bytes_of(value[f.name], f.dataType) for f in kind.fields], F.lit(16).cast("long"))
    if isinstance(kind, ArrayType):
        each = kind.elementType
        if isinstance(each, StringType):
            return F.coalesce(F.octet_length(F.array_join(value, "", "")) + 16 * F.size(value), F.lit(0)).cast("long") + 16
        return F.greatest(F.size(value), F.lit(0)).cast("long") * (64 if isinstance(each, (ArrayType, MapType, StructType, BinaryType)) else 8) + 16
    if isinstance(kind, MapType):
        return F.greatest(F.size(value), F.lit(0)).cast("long") * 64 + 16
    return F.lit(8).cast("long")


def fits_broadcast(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether ``df`` has at most ``rows`` rows and about ``size`` bytes, by one job over it."""
    weight = reduce(add, [_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(32).cast("long"))
    n, held = df.select(weight.alias("w")).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return n <= (BROADCAST_ROWS if rows is None else rows) and held <= (BROADCAST_BYTES if size is None else size)


def small(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes, counted, are within the bounds, else as it is, for a shuffled join."""
    return F.broadcast(df) if fits_broadcast(df, rows, size) else df


def fold_number(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, mod ``k``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_groups(texts: Iterable[str | None], chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``chars`` code points in sum, with the first one's index, so that array work on a batch stays within a bound."""
    first, run, held = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if run and held + len(text) > chars:
            yield first, run
            first, run, held = i, [], 0
        run.append(text)
        held += len(text)
    if run:
        yield first, run
