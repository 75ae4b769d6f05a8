"""The 32-bit murmur3 hash of keys, and what is derived from it, in column expressions.

Spark's own ``hash`` treats the tail of a value differently and can't stand in for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 65536
_MASK = 0xFFFFFFFF
_C1, _C2 = 0xCC9E2D51, 0x1B873593


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed, and standing in the plan, once: written out, the steps below would double the expression each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _times(a: Column, c: int) -> Column:
    """``a * c`` mod 2**32 in two halves, so that no product leaves 63 bits."""
    low = lambda x: x.bitwiseAND(0xFFFF) * F.lit(c)
    high = lambda x: (F.shiftright(x, 16) * F.lit(c)).bitwiseAND(0xFFFF)
    return _with(a, lambda x: (low(x) + F.shiftleft(high(x), 16)).bitwiseAND(_MASK))


def _turned(a: Column, r: int) -> Column:
    return _with(a, lambda x: F.shiftleft(x, r).bitwiseOR(F.shiftright(x, 32 - r)).bitwiseAND(_MASK))


def _folded(a: Column, r: int) -> Column:
    return _with(a, lambda x: x.bitwiseXOR(F.shiftright(x, r)))


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def murmur3_32(data: Column) -> Column:
    """MurmurHash3 x86-32 with seed 0 of a binary column, as an unsigned number; null for null."""
    h, n = F.hex(data), F.octet_length(data)
    at = lambda i: F.substr(h, (i * 2 + 1).cast("int"), F.lit(2))
    word = lambda i: _number(F.concat(at(i * 4 + 3), at(i * 4 + 2), at(i * 4 + 1), at(i * 4)))
    mixed = lambda k: _times(_turned(_times(k, _C1), 15), _C2)
    blocks = F.when(n >= 4, F.sequence(F.lit(0), (n / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    step = lambda acc, i: (_times(_turned(acc.bitwiseXOR(mixed(word(i))), 13), 5) + F.lit(0xE6546B64)).bitwiseAND(_MASK)
    acc = F.aggregate(blocks, F.lit(0).cast("long"), step)
    body = (n / 4).cast("int") * 4
    rest = F.when(n % 4 == 0, F.lit(0).cast("long")).otherwise(
        _number(F.concat(F.when(n % 4 == 3, at(body + 2)).otherwise(""), F.when(n % 4 >= 2, at(body + 1)).otherwise(""), at(body)))
    )
    acc = acc.bitwiseXOR(mixed(rest)).bitwiseXOR(n.cast("long"))
    return _folded(_times(_folded(_times(_folded(acc, 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)


def sticky_key(ordering_key: Column, partition_key: Column, producer: Column, sequence: Column) -> Column:
    """The key that orders a message: its ordering key, else its partition key, else producer and sequence number, else empty bytes."""
    named = F.when(F.length(producer) > 0, F.encode(F.concat_ws("-", producer, F.coalesce(sequence, F.lit(0)).cast("string")), "UTF-8"))
    return F.coalesce(ordering_key, F.encode(partition_key, "UTF-8"), named, F.lit(b""))


def sticky_hash(key: Column) -> Column:
    return (murmur3_32(key) % HASH_RANGE).cast("int")


def byte_sum(data: Column) -> Column:
    """The additive checksum of stored entries: the sum of all bytes."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, h: s + _number(h))


def varint_length(n: Column) -> Column:
    """Bytes that a number takes as a base-128 varint."""
    return F.greatest(F.ceil(F.length(F.bin(n)) / 7), F.lit(1)).cast("int")


def wire_size(metadata: Column, payload: Column, command: Column) -> Column:
    """Estimated bytes of a delivered message: both length words, the magic, the checksum and the three parts."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return F.lit(4 + 4 + 2 + 4 + 4) + size(command) + size(metadata) + size(payload)


def murmur3_sql(text: str) -> str:
    """The same hash of a text expression in DuckDB's SQL, for comparison."""
    h, n = f"hex({text})", f"strlen({text})"
    byte = lambda i: f"substr({h}, 2 * ({i}) + 1, 2)"
    word = f"('0x' || {byte('4 * i + 3')} || {byte('4 * i + 2')} || {byte('4 * i + 1')} || {byte('4 * i')})::HUGEINT"
    k1 = lambda k: f"(((({k}) * 3432918353) % 4294967296 * 32768) % 4294967296 + (({k}) * 3432918353) % 4294967296 // 131072) * 461845907 % 4294967296"
    blocks = f"[{k1(word)} FOR i IN range(0, {n} // 4)]"
    turn = "((xor(a, k) * 8192) % 4294967296 + xor(a, k) // 524288)"
    folded = f"list_reduce({blocks}, lambda a, k: ({turn} * 5 + 3864292196) % 4294967296, 0::HUGEINT)"
    body = f"{n} // 4 * 4"
    tail = f"('0x0' || CASE WHEN {n} % 4 = 3 THEN {byte(body + ' + 2')} ELSE '' END || CASE WHEN {n} % 4 >= 2 THEN {byte(body + ' + 1')} ELSE '' END || CASE WHEN {n} % 4 >= 1 THEN {byte(body)} ELSE '' END)::HUGEINT"
    start = f"xor(xor({folded}, {k1(tail)}), {n}::HUGEINT)"
    steps = "list_reduce([2246822507::HUGEINT, 3266489909, 1], lambda a, c: (xor(a, a // CASE c WHEN 3266489909 THEN 8192 ELSE 65536 END) * c) % 4294967296, {0})"
    return f"({steps.format(start)})::BIGINT"
