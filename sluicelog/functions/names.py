"""Topic, ledger and cursor names, and the codes of the protocol, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the protocol.
TOPIC = r"^(persistent|non-persistent)://([^/]+)/([^/]+)/(.+)$"
SUBSCRIPTION_TYPES = ("Exclusive", "Shared", "Failover", "KeyShared")
CUMULATIVE_ACK = 1
EARLIEST_SENTINEL, LATEST_SENTINEL = -1, 2**63 - 1


def topic_parts(name: Column) -> Column:
    """A struct of domain, tenant, namespace and local name; null for a name that isn't valid. The local name may hold slashes."""
    parts = F.struct(*[F.regexp_extract(name, TOPIC, i).alias(p) for i, p in enumerate(("domain", "tenant", "namespace", "local"), 1)])
    return F.when(name.rlike(TOPIC), parts)


def logical_topic(name: Column) -> Column:
    """The name without a numeric ``-partition-N`` at its end."""
    return F.regexp_replace(name, r"-partition-\d+$", "")


def partition_of(name: Column) -> Column:
    """The number after the last ``-partition-``, as a 32-bit integer, else -1."""
    number = F.nullif(F.regexp_extract(name, r"-partition-([+-]?\d+)$", 1), F.lit(""))
    return F.coalesce(number.try_cast("int"), F.lit(-1))


def is_partition(name: Column) -> Column:
    return name.rlike(r"-partition-\d+$")


def runtime_mode(name: Column) -> Column:
    """``NonPersistent`` for that domain; any other name, valid or not, is ``Persistent``."""
    return F.when(topic_parts(name)["domain"] == "non-persistent", "NonPersistent").otherwise("Persistent")


def ledger_name(name: Column) -> Column:
    """``domain://t/n/l`` as ``t/n/domain/l``; other names as they are."""
    return F.regexp_replace(name, r"^([^:]+)://([^/]+)/([^/]+)/(.+)$", "$2/$3/$1/$4")


def cursor_name(name: Column) -> Column:
    """Percent-encoded, byte by byte, but for letters, digits and ``-._~``; upper-case hexadecimal."""
    pairs = F.regexp_extract_all(F.hex(F.encode(name, "UTF-8")), F.lit("(..)"), F.lit(1))
    plain = lambda h: F.decode(F.unhex(h), "US-ASCII")
    keep = lambda h: h.rlike("^(2D|2E|3[0-9]|4[1-9A-F]|5[0-9A]|5F|6[1-9A-F]|7[0-9A]|7E)$")
    return F.array_join(F.transform(pairs, lambda h: F.when(keep(h), plain(h)).otherwise(F.concat(F.lit("%"), h))), "")


def namespace_key(tenant: Column, namespace: Column) -> Column:
    return F.concat_ws("/", tenant, namespace)


def subscription_key(topic: Column, subscription: Column) -> Column:
    return F.concat_ws(":", topic, subscription)


def subscription_type(code: Column) -> Column:
    """The name of a subscription type; unknown codes are Exclusive."""
    return F.coalesce(F.get(F.array(*map(F.lit, SUBSCRIPTION_TYPES)), code.cast("int")), F.lit(SUBSCRIPTION_TYPES[0]))


def ack_type(code: Column) -> Column:
    return F.when(code == CUMULATIVE_ACK, "Cumulative").otherwise("Individual")


def initial_position(code: Column) -> Column:
    """0 is Latest, 1 is Earliest; others count as Latest."""
    return F.when(code == 1, "Earliest").otherwise("Latest")


def start_position(ledger: Column, entry: Column, code: Column) -> Column:
    """A struct of the initial position and the start id of a subscribe: an id of two equal sentinels sets the position and is no id."""
    earliest, latest = ((ledger == s) & (entry == s) for s in (EARLIEST_SENTINEL, LATEST_SENTINEL))
    initial = F.when(earliest, "Earliest").when(latest, "Latest").otherwise(initial_position(code))
    own = F.when(~F.coalesce(earliest | latest, F.lit(False)), ledger)
    return F.struct(initial.alias("initial"), own.alias("start_ledger"), F.when(own.isNotNull(), entry).alias("start_entry"))


def log_file_number(name: Column) -> Column:
    """The number in ``N.log``, else null."""
    return F.nullif(F.regexp_extract(name, r"^(\d{1,18})\.log$", 1), F.lit("")).cast("long")


def advertised_url(scheme: Column, host: Column, port: Column) -> Column:
    """The broker URL that clients get: an unspecified address becomes the loopback one."""
    shown = F.when(host.isin("0.0.0.0", "::", "[::]"), "127.0.0.1").otherwise(host)
    return F.concat(scheme, F.lit("://"), shown, F.lit(":"), port.cast("string"))


def default_sequence(sequence: Column, entry: Column) -> Column:
    """The sequence number of a message without metadata is its entry number."""
    return F.coalesce(sequence, entry)
