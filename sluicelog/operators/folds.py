"""What depends on the order of events: rate limits, transient delivery and dispatch histories.

A fold reads the events of a key in order, one at a time, and keeps only its state. Keys are spread over tasks; a partition is sorted by key and
sequence and streamed through, so no key's history is gathered in memory. One key's fold is serial by nature.
"""

from __future__ import annotations

import pickle
import re
import struct
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HASH_RANGE
from .entries import ACKED, AGAIN, BITS, FLYING, MASK, NONE, PAGE, PLAIN, QUEUED, Entries, Queue, held_by

BATCH = 20


def plain_values(column: pa.Array) -> list:
    """A column's values as whole numbers, texts and lists, None for nulls."""
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_integer(column.type):
        values = column.fill_null(0).to_numpy(zero_copy_only=False).tolist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()
        if column.null_count:
            for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
                values[i] = None
        return values
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        texts = [*coded.dictionary.to_pylist(), None]
        return [texts[i] for i in coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).tolist()]
    return column.to_pylist()


ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def fold(events: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[tuple], object], step: Callable[[object, tuple], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``step(state, event)`` returns for every event, in ``order``; ``start(key)`` makes a key's state. Events are tuples of the columns."""
    fields = [(c.split()[0], ARROW[c.split()[1]]) for c in schema.split(", ")]
    at = [events.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in zip(*map(plain_values, batch.columns)):
                own = tuple([row[i] for i in at])
                if own != key:
                    key, state = own, start(own)
                out += [(*own, *x) for x in step(state, row)]
            columns = zip(*out) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])

    # a given number of partitions isn't coalesced: large keys would share a task while others idle
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class RateLimit:
    """A window of one second that starts anew with the first publish after its end; 0 is no limit; a refused publish counts for nothing."""

    def __init__(self, messages: int, size: int, width_us: int = 1_000_000):
        self.most, self.most_bytes, self.width = messages, size, width_us
        self.began, self.n, self.bytes = None, 0, 0

    def allow(self, at_us: int, size: int) -> bool:
        if not (self.most or self.most_bytes):
            return True
        if self.began is None or at_us - self.began >= self.width:
            self.began, self.n, self.bytes = at_us, 0, 0
        ok = (not self.most or self.n + 1 <= self.most) and (not self.most_bytes or self.bytes + size <= self.most_bytes)
        if ok:
            self.n, self.bytes = self.n + 1, self.bytes + size
        return ok


def rate_limited(log: DataFrame, messages: int = 0, size: int = 0, width_us: int = 1_000_000) -> DataFrame:
    """``(topic, event_id, accepted)``; ``log`` has topic, event_id, at_us and bytes."""
    rows = log.select("topic", "event_id", "at_us", "bytes")
    return fold(rows, ["topic"], ["at_us", "event_id"], lambda _: RateLimit(messages, size, width_us), lambda s, e: [(e[1], s.allow(e[2], e[3]))], "topic string, event_id long, accepted boolean")


def ring_hash(text: str) -> int:
    """MurmurHash3 x86-32 with seed 0, as ``functions.hashing.murmur3_32`` computes it on columns."""
    data, mask, h = text.encode(), 0xFFFFFFFF, 0
    turned = lambda x, r: (x << r | x >> (32 - r)) & mask
    mixed = lambda k: turned(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    whole = len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h = (turned(h ^ mixed(k), 13) * 5 + 0xE6546B64) & mask
    h ^= mixed(int.from_bytes(data[whole:], "little")) ^ len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def key_owners(ranges: dict[int, list[int]], ids: list[int], key: int) -> list[int]:
    """The consumers whose hash range has the key, in the order of choice: by given ranges (bounds in pairs) if there are any, else by equal ones."""
    if any(ranges.get(c) for c in ids):
        held = sorted((*pair, c) for c in ids for pair in zip(ranges[c][::2], ranges[c][1::2]))
        return [c for start, end, c in held if start <= key <= end]
    ids = sorted(ids)
    return [ids[(key * len(ids) + len(ids) - 1) // HASH_RANGE]] if ids else []


class Subscription:
    """The dispatch state of one durable subscription. Every trigger (publish, flow, redeliver, leave) delivers up to ``BATCH`` messages.

    ``mode`` is Exclusive, Failover, Shared or KeyShared. Messages are ``(ord, key hash)`` in order; deliveries are ``(consumer, ord, count)``.
    What is known of an entry stands in the pages of ``entries``; the rest of the state is small.
    """

    def __init__(self, mode: str, entries: Entries | None = None):
        self.mode, self.read, self.frontier = mode, 0, -1
        self.entries = Entries() if entries is None else entries
        self.consumers: dict[int, dict] = {}
        self.slots: dict[int, int] = {}  # the consumers by the number that their entries bear
        self.queue = Queue(self.entries, mode == "KeyShared")
        self.turn = 0
        self.held_keys: dict[int, int] = {}  # how many entries delivered again and not acked yet a key has
        self.arranged()

    def head(self) -> bytes:
        """The state without its pages."""
        kept = {k: getattr(self, k) for k in ("read", "frontier", "consumers", "slots", "turn", "held_keys")}
        return pickle.dumps((kept, self.entries.epoch, self.entries.known, self.queue.pages, self.queue.low))

    def resume(self, head: bytes) -> None:
        kept, self.entries.epoch, self.entries.known, self.queue.pages, self.queue.low = pickle.loads(head)
        self.__dict__.update(kept)
        if self.queue.pages:
            self.queue.runs = None  # found again in the pages when they are asked for
        self.arranged()

    # membership

    def arranged(self) -> None:
        """Consumers in the order of choice: by priority number, except that durable failover takes the largest first, then names."""
        if self.mode == "Failover":
            self.ordered = sorted(self.consumers, key=lambda c: (-self.consumers[c]["priority"], self.consumers[c]["name"], c))
        else:
            self.ordered = sorted(self.consumers, key=lambda c: (self.consumers[c]["priority"], self.consumers[c]["joined"]))
        self.levels = [self.consumers[c]["priority"] for c in self.ordered]
        self.permits = sum(c["permits"] for c in self.consumers.values())
        self.ranges = {c: x["ranges"] for c, x in self.consumers.items()}
        self.ids = None if any(self.ranges.values()) else sorted(self.consumers)

    def order(self) -> list[int]:
        return self.ordered

    def join(self, consumer: int, priority: int, name: str, seq: int, ranges: list[int] | None = None) -> bool:
        if self.mode == "Exclusive" and self.consumers or consumer in self.consumers:
            return False
        slot = next(i for i in range(len(self.slots) + 1) if i not in self.slots)
        self.slots[slot] = consumer
        # pages: how many entries of each page are in flight here
        self.consumers[consumer] = {"priority": priority, "name": name, "joined": seq, "permits": 0, "slot": slot, "pages": {}, "ranges": ranges or []}
        self.arranged()
        return True

    def leave(self, consumer: int) -> None:
        if consumer not in self.consumers:
            return
        place, left = self.order().index(consumer), len(self.consumers) - 1
        # the turn goes on with whom it would have come to next
        if not left:
            self.turn = 0
        elif self.turn > place:
            self.turn -= 1
        elif self.turn >= left:
            self.turn %= left
        if self.mode in ("Shared", "KeyShared"):
            self.give_back(consumer)
        else:
            own, first = self.consumers[consumer], self.first_open()
            for p, page, at in held_by(self.entries, sorted(own["pages"]), own["slot"]):
                page.view("state")[at] = PLAIN
                first = min([first, *(at + p * PAGE)[at + p * PAGE > self.frontier][:1].tolist()])
            self.read = first
        del self.slots[self.consumers.pop(consumer)["slot"]]
        self.arranged()

    # acknowledgement

    def is_acked(self, o: int) -> bool:
        return o <= self.frontier or self.entries.state(o) == ACKED

    def first_open(self) -> int:
        o = self.frontier + 1
        while self.entries.state(o) == ACKED:
            o += 1
        return o

    def ack(self, consumer: int, o: int, cumulative: bool) -> None:
        shared = self.mode in ("Shared", "KeyShared")
        if cumulative:
            if not shared:
                self.frontier = o  # as it says, even backwards; holes and what is in flight stay
            return
        p, i = o >> BITS, o & MASK
        page = self.entries.page(p)
        state = page.state[i]
        if state < FLYING or not shared and self.slots[page.holder[i]] != consumer:
            return
        pages = self.consumers[self.slots[page.holder[i]]]["pages"]
        pages[p] -= 1
        if not pages[p]:
            del pages[p]
        if state == AGAIN:
            self.settle(page.key[i])
        page.state[i] = PLAIN if o <= self.frontier else ACKED
        while self.entries.state(self.frontier + 1) == ACKED:
            self.frontier += 1
            self.entries.page(self.frontier >> BITS).state[self.frontier & MASK] = PLAIN

    # redelivery

    def settle(self, key: int) -> None:
        """An entry delivered again no longer blocks its key."""
        self.held_keys[key] -= 1
        if not self.held_keys[key]:
            del self.held_keys[key]

    def give_back(self, consumer: int) -> None:
        """All that a consumer holds waits for redelivery, counted once more."""
        own = self.consumers[consumer]
        for p, page, at in held_by(self.entries, sorted(own["pages"]), own["slot"]):
            state = page.view("state")
            for key in page.view("key")[at[state[at] == AGAIN]].tolist():
                self.settle(key)
            state[at] = PLAIN
            at = at[at + p * PAGE > self.frontier]
            if not len(at):
                continue
            if page.view("count")[at].max() == 255 and page.count.typecode == "B":
                page.count = array("q", page.count)
            page.view("count")[at] += 1
            state[at] = QUEUED
            self.queue.noted(p, (at + p * PAGE).tolist(), page.view("key")[at].tolist())
        own["pages"].clear()

    def redeliver(self, consumer: int, ords: list[int]) -> None:
        own = self.consumers.get(consumer)
        if own is None or self.mode not in ("Shared", "KeyShared"):
            return
        if not ords:
            self.give_back(consumer)
        for o in ords:
            page, i = self.entries.page(o >> BITS), o & MASK
            if page.state[i] < FLYING or page.holder[i] != own["slot"]:
                continue
            own["pages"][o >> BITS] -= 1
            if not own["pages"][o >> BITS]:
                del own["pages"][o >> BITS]
            if page.state[i] == AGAIN:
                self.settle(page.key[i])
            page.state[i] = PLAIN
            if o > self.frontier:
                self.queue.put(o, page.count[i] + 1, page.key[i])

    def forget(self) -> None:
        """Of all entries only that they were published, and their keys, stays."""
        self.entries.forget()
        self.queue = Queue(self.entries, self.mode == "KeyShared")
        self.held_keys.clear()

    def seek(self, o: int) -> None:
        self.frontier, self.read = o - 1, o
        self.forget()
        for c in self.consumers.values():
            c["pages"].clear()

    # dispatch

    def next_new(self) -> int | None:
        while True:
            state = self.entries.page(self.read >> BITS).state[self.read & MASK]
            if state == NONE:
                return None
            if state == PLAIN and self.read > self.frontier:
                return self.read
            self.read += 1

    def pick(self) -> int | None:
        """Shared: in turn within a priority; a smaller priority number with permits comes first, a larger one if nobody else has any."""
        order, levels = self.ordered, self.levels
        at = self.turn % len(order)
        own = levels[at]
        if own in (0, levels[0]) and self.consumers[order[at]]["permits"] > 0:
            chosen = [at]
        else:
            able = [i for i, c in enumerate(order) if self.consumers[c]["permits"] > 0]
            # nobody is looked for before priority 0
            before = [i for i in able if levels[i] < own] if own != 0 else []
            peers = [i for i in able if levels[i] == own]
            after = [i for i in able if levels[i] > own]
            chosen = before or [i for i in peers if i >= at] or peers or after
        if not chosen:
            return None
        self.turn = (chosen[0] + 1) % len(order)
        return order[chosen[0]]

    def key_owner(self, key: int) -> int | None:
        if self.ids:
            n = len(self.ids)
            owners = [self.ids[(key * n + n - 1) // HASH_RANGE]]
        else:
            owners = key_owners(self.ranges, self.ordered, key)
        return next((c for c in owners if self.consumers[c]["permits"] > 0), None)

    def send(self, consumer: int, o: int, count: int, state: int = FLYING) -> tuple[int, int, int]:
        own, p, i = self.consumers[consumer], o >> BITS, o & MASK
        own["permits"] -= 1
        self.permits -= 1
        own["pages"][p] = own["pages"].get(p, 0) + 1
        page = self.entries.page(p)
        page.state[i] = state
        if page.holder[i] != own["slot"]:
            page.put("holder", i, own["slot"])
        if page.count[i] != count:
            page.put("count", i, count)
        return consumer, o, count

    def trigger(self) -> list[tuple[int, int, int]]:
        if self.mode == "Shared":
            return self.trigger_shared()
        return self.trigger_keys() if self.mode == "KeyShared" else self.trigger_single()

    def trigger_single(self) -> list[tuple[int, int, int]]:
        order, out = self.ordered, []
        for _ in range(min(BATCH, self.consumers[order[0]]["permits"]) if order else 0):
            if (o := self.next_new()) is None:
                break
            self.read = o + 1
            out.append(self.send(order[0], o, 0))
        return out

    def first_queued(self, ready: Callable[[int], bool] | None = None) -> int | None:
        """The first queued entry, of those whose key is ready; acked ones are dropped on the way."""
        while self.queue.pages and (o := self.queue.first() if ready is None else self.queue.first_of(ready)) is not None:
            if o > self.frontier:
                return o
            self.queue.take(o)
        return None

    def trigger_shared(self) -> list[tuple[int, int, int]]:
        out = []
        for _ in range(min(BATCH, self.permits)):
            queued = self.first_queued() if self.queue.pages else None
            o = self.next_new() if queued is None else queued
            if o is None or (consumer := self.pick()) is None:
                break
            count = 0 if queued is None else self.queue.take(o)
            self.read = max(self.read, o + 1) if queued is None else self.read
            out.append(self.send(consumer, o, count))
        return out

    def blocked(self, key: int) -> bool:
        return key in self.held_keys or bool(self.queue.pages) and key in self.queue.keys

    def trigger_keys(self) -> list[tuple[int, int, int]]:
        """Queued messages whose key's owner has permits come first. A new message with a blocked key joins the queue; one without an owner stops the pass."""
        out, left = [], min(BATCH, self.permits)
        while left > 0:
            ready = self.first_queued(lambda key: key not in self.held_keys and self.key_owner(key) is not None)
            if ready is not None:
                count, key = self.queue.take(ready), self.entries.key(ready)
                self.held_keys[key] = self.held_keys.get(key, 0) + 1
                out.append(self.send(self.key_owner(key), ready, count, AGAIN))
                left -= 1
                continue
            if (o := self.next_new()) is None:
                break
            key = self.entries.key(o)
            if self.blocked(key):
                self.queue.put(o, 0, key)
                self.read = o + 1
                continue
            if (owner := self.key_owner(key)) is None:
                break
            self.read = o + 1
            out.append(self.send(owner, o, 0))
            left -= 1
        return out

    def event(self, kind: str, consumer: int | None, o: int | None, n: int | None, name: str | None, seq: int, ranges: list[int] | None = None) -> list[tuple[int, int, int]]:
        """Apply one event; only publishing, flow, redelivery requests and leaving deliver. Acks don't."""
        if kind == "publish":
            self.entries.publish(o, n or 0)
        elif kind in ("ack", "ack_cumulative"):
            self.ack(consumer, o, kind == "ack_cumulative")
            return []
        elif kind == "join":
            self.join(consumer, n or 0, name or "", seq, ranges)
            return []
        elif kind == "leave":
            self.leave(consumer)
        elif kind == "flow":
            if consumer in self.consumers:
                self.consumers[consumer]["permits"] += n
                self.permits += n
        elif kind == "redeliver":
            self.redeliver(consumer, [] if o is None else [o])
        elif kind == "seek":
            self.seek(o)
            return []
        elif kind == "unsubscribe":
            # the cursor goes with all consumers and queues; who subscribes next begins at the start of the log
            self.entries.forget()
            self.__init__(self.mode, self.entries)
            return []
        return self.trigger()


DISPATCH = "topic string, subscription string, seq long, consumer_id long, ord long, redelivery_count long"


def with_ranges(events: DataFrame) -> DataFrame:
    """Ranges as text: Spark measures a batch for Python at every row, and for a column of arrays that takes as long as the batch has rows."""
    text = F.array_join(F.col("ranges").cast("array<string>"), ",") if "ranges" in events.columns else F.lit(None).cast("string")
    return events.withColumn("ranges", text)


def ranges_of(text: str | None) -> list[int] | None:
    return None if text is None else [int(x) for x in text.split(",") if x]


def dispatched(events: DataFrame, mode: str) -> DataFrame:
    """Deliveries of an ordered event history: ``events`` has topic, subscription, seq, kind, consumer_id, ord, n, name and, if consumers choose them, ranges.

    ``n`` is the key hash of a publish, the permits of a flow, the priority of a join; ``ranges`` of a join are the bounds of its hash ranges in pairs.
    """
    rows = with_ranges(events).select("topic", "subscription", "seq", "kind", "consumer_id", "ord", "n", "name", "ranges")
    step = lambda s, e: [(e[2], *d) for d in s.event(e[3], e[4], e[5], e[6], e[7], e[2], ranges_of(e[8]))]
    return fold(rows, ["topic", "subscription"], ["seq"], lambda _: Subscription(mode), step, DISPATCH)


class Transient:
    """Delivery without storage: a message goes to a consumer that has permits, or is dropped.

    ``Shared`` tries the consumers from the next in turn on (priority only orders them); ``KeyShared`` knows the key's owners only; ``Exclusive`` and
    ``Failover`` the active consumer only. Consumers come and go by ``join`` and ``leave``; those given at the start have no names.
    """

    def __init__(self, mode: str, consumers: list[tuple[int, int]], topic: str = ""):
        self.mode, self.topic, self.turn = mode, topic, 0
        self.permits: dict[int, int] = {}
        self.members: dict[int, tuple[int, str]] = {}
        self.ranges: dict[int, list[int]] = {}
        for c, priority in consumers:
            self.join(c, priority, "", None)

    def join(self, consumer: int, priority: int, name: str, ranges: list[int] | None) -> None:
        if consumer in self.members or self.mode == "Exclusive" and self.members:
            return
        self.members[consumer], self.permits[consumer], self.ranges[consumer] = (priority, name), 0, ranges or []
        self.arranged()

    def arranged(self) -> None:
        """The order of consumers, and the active one, after a change of membership."""
        if self.mode in ("Exclusive", "Failover"):
            self.order = self.elected()
        else:
            self.order = sorted(self.members, key=lambda c: (self.members[c][0], c))

    def elected(self) -> list[int]:
        """The active consumer: of those of the smallest priority number, by names, a partition takes them in turn and another topic the successor on a ring."""
        least = min((p for p, _ in self.members.values()), default=0)
        top = sorted((c for c in self.members if self.members[c][0] == least), key=lambda c: self.members[c][1])
        partition = re.search(r"-partition-(\d+)$", self.topic)
        if len(top) < 2:
            return top
        if partition:
            return [top[int(partition[1]) % len(top)]]
        own = ring_hash(self.topic)
        points = [(ring_hash(f"{self.members[c][1]}{r}"), i, r) for i, c in enumerate(top) for r in range(100)]
        return [top[min(points, key=lambda p: (p[0] < own, *p))[1]]]

    def event(self, kind: str, consumer: int | None, n: int | None, name: str | None = None, ranges: list[int] | None = None) -> int | None:
        """The consumer of a publish (null: dropped). A fenced subscription has no consumers any more; permits of strangers count for nothing."""
        if kind == "join":
            self.join(consumer, n or 0, name or "", ranges)
        elif kind == "leave" and consumer in self.members:
            for held in (self.members, self.permits, self.ranges):
                del held[consumer]
            self.arranged()
        elif kind == "flow" and consumer in self.permits:
            self.permits[consumer] += n
        elif kind == "fence":
            self.members, self.permits, self.ranges, self.order = {}, {}, {}, []
        if kind != "publish":
            return None
        tried: list[int] = []
        if self.mode == "Shared":
            if self.order and sum(self.permits.values()):
                start = self.turn % len(self.order)
                self.turn += 1
                tried = self.order[start:] + self.order[:start]
        elif self.mode == "KeyShared":
            tried = key_owners(self.ranges, self.order, n or 0)
        else:
            tried = self.order[:1]
        found = next((c for c in tried if self.permits[c] > 0), None)
        if found is not None:
            self.permits[found] -= 1
        return found


def transient(events: DataFrame, mode: str, consumers: list[tuple[int, int]] | None = None) -> DataFrame:
    """``(topic, seq, consumer_id)`` of every publish; a null consumer is a drop. ``consumers`` are ids with priorities that are there from the start.

    ``events`` has topic, seq, kind, consumer_id and n, and for those who join a name and ranges.
    """
    named = events if "name" in events.columns else events.withColumn("name", F.lit(None).cast("string"))
    rows = with_ranges(named).select("topic", "seq", "kind", "consumer_id", "n", "name", "ranges")

    def step(state: Transient, e: tuple) -> list[tuple]:
        got = state.event(e[2], e[3], e[4], e[5], ranges_of(e[6]))
        return [(e[1], got)] if e[2] == "publish" else []

    return fold(rows, ["topic"], ["seq"], lambda key: Transient(mode, consumers or [], key[0]), step, "topic string, seq long, consumer_id long")
