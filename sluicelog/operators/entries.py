"""What a subscription knows of each entry of its topic, in pages of a few bytes an entry, and the queue of entries that wait for redelivery.

``ord`` is an entry's place in its topic, so pages are dense. They may live elsewhere: with ``load`` and ``save``, only a few are held at a time.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np

BITS = 12
PAGE = 1 << BITS
MASK = PAGE - 1
NONE, PLAIN, QUEUED, ACKED, FLYING, AGAIN = range(6)  # AGAIN: in flight for another time, so its key is blocked


class Page:
    """Key, state, holder and redelivery count of ``PAGE`` entries; columns start narrow and widen when a value asks for it."""

    __slots__ = ("epoch", "key", "state", "holder", "count")

    def __init__(self, epoch: int = 0):
        self.epoch, self.state = epoch, bytearray(PAGE)
        self.key, self.holder, self.count = array("H", bytes(2 * PAGE)), array("B", bytes(PAGE)), array("B", bytes(PAGE))

    def put(self, column: str, i: int, value: int) -> None:
        try:
            getattr(self, column)[i] = value
        except OverflowError:
            setattr(self, column, array("q", getattr(self, column)))
            getattr(self, column)[i] = value

    def view(self, column: str) -> np.ndarray:
        cells = getattr(self, column)
        return np.frombuffer(cells, dtype=np.uint8 if column == "state" else cells.typecode)

    def forget(self, epoch: int) -> None:
        """After a seek all is as if it had just been published."""
        state = self.view("state")
        state[state > PLAIN] = PLAIN
        self.epoch, self.count = epoch, array("B", bytes(PAGE))

    def packed(self) -> bytes:
        return zlib.compress(pickle.dumps((self.epoch, self.key, self.state, self.holder, self.count)), 1)

    @staticmethod
    def unpacked(body: bytes) -> Page:
        page = Page.__new__(Page)
        page.epoch, page.key, page.state, page.holder, page.count = pickle.loads(zlib.decompress(body))
        return page


class Entries:
    """The pages of a topic. A page is good until the next one is asked for: it may be put away then."""

    def __init__(self, load: Callable[[int], bytes] | None = None, save: Callable[[int, bytes], None] | None = None, most: int = 512):
        self.load, self.save, self.most = load, save, most
        self.pages: dict[int, Page] = {}
        self.known: set[int] = set()
        self.epoch = 0
        self.at, self.now = None, None

    def page(self, p: int, make: bool = False) -> Page:
        if p == self.at:
            return self.now
        page = self.pages.get(p)
        if page is None:
            if p in self.known:
                page = Page.unpacked(self.load(p))
            elif make:
                page = Page(self.epoch)
                self.known.add(p)
            else:
                return NOTHING
            if self.save and len(self.pages) >= self.most:
                old = next(iter(self.pages))
                self.save(old, self.pages.pop(old).packed())
            self.pages[p] = page
        if page.epoch != self.epoch:
            page.forget(self.epoch)
        self.at, self.now = p, page
        return page

    def publish(self, o: int, key: int) -> None:
        """An entry keeps the key of its first publish."""
        page, i = self.page(o >> BITS, True), o & MASK
        if page.state[i] == NONE:
            page.state[i] = PLAIN
            if key:
                page.put("key", i, key)

    def state(self, o: int) -> int:
        return self.page(o >> BITS).state[o & MASK]

    def key(self, o: int) -> int:
        return self.page(o >> BITS).key[o & MASK]

    def forget(self) -> None:
        self.epoch += 1
        self.at = None

    def put_away(self) -> None:
        for p, page in self.pages.items():
            self.save(p, page.packed())
        self.pages.clear()
        self.at = None


NOTHING = Page()


class Run:
    """Places in ascending order; the first goes and comes cheaply."""

    __slots__ = ("items", "head")

    def __init__(self):
        self.items, self.head = array("q"), 0

    def first(self) -> int:
        return self.items[self.head]

    def add(self, o: int) -> None:
        a = self.items
        if self.head == len(a) or o > a[-1]:
            a.append(o)
        elif self.head and o < a[self.head]:
            self.head -= 1
            a[self.head] = o
        else:
            insort(a, o, self.head)

    def remove(self, o: int) -> bool:
        """Whether the run is empty then."""
        if self.items[self.head] != o:
            del self.items[bisect_left(self.items, o, self.head)]
        else:
            self.head += 1
            if self.head > 1024 and self.head * 2 > len(self.items):
                del self.items[: self.head]
                self.head = 0
        return self.head == len(self.items)


class Counts:
    """The redelivery counts of queued entries."""

    def __init__(self, entries: Entries):
        self.entries = entries

    def __contains__(self, o: int) -> bool:
        return self.entries.state(o) == QUEUED

    def __getitem__(self, o: int) -> int:
        if o not in self:
            raise KeyError(o)
        return self.entries.page(o >> BITS).count[o & MASK]


class Queue:
    """Entries that wait for redelivery, with their counts: the first of all, the first of each key, and whether a key has any, without a scan.

    State and count stand in the pages; the queue adds how many a page has and, if it is ``keyed``, the places of each key.
    """

    def __init__(self, entries: Entries | None = None, keyed: bool = True):
        self.entries = Entries() if entries is None else entries
        self.counts = Counts(self.entries)
        self.pages: dict[int, int] = {}
        self.low = 0  # nothing before it is queued
        self.runs: dict[int, Run] | None = {} if keyed else None
        self.keyed = keyed

    @property
    def keys(self) -> dict[int, Run]:
        if self.runs is None and self.keyed:
            self.runs = {}
            for p in sorted(self.pages):
                page = self.entries.page(p)
                at = np.flatnonzero(page.view("state") == QUEUED)
                for o, key in zip((at + p * PAGE).tolist(), page.view("key")[at].tolist()):
                    self.runs.setdefault(key, Run()).add(o)
        return self.runs or {}

    def put(self, o: int, count: int, key: int) -> None:
        page, i = self.entries.page(o >> BITS, True), o & MASK
        if page.state[i] == QUEUED:
            page.put("count", i, max(page.count[i], count))
            return
        page.state[i] = QUEUED
        page.put("key", i, key)
        page.put("count", i, count)
        self.noted(o >> BITS, [o], [key])

    def noted(self, p: int, ords: list[int], keys: list[int]) -> None:
        """Entries of a page, in order, whose state and count are set already."""
        self.low = min(self.low, ords[0]) if self.pages else ords[0]
        self.pages[p] = self.pages.get(p, 0) + len(ords)
        if self.runs is not None:
            for o, key in zip(ords, keys):
                if key not in self.runs:
                    self.runs[key] = Run()
                self.runs[key].add(o)

    def take(self, o: int) -> int:
        """Remove an entry; its count, 0 if it isn't there."""
        p, i = o >> BITS, o & MASK
        page = self.entries.page(p)
        if page.state[i] != QUEUED:
            return 0
        page.state[i] = PLAIN
        key, count = page.key[i], page.count[i]
        self.pages[p] -= 1
        if not self.pages[p]:
            del self.pages[p]
        if self.runs is not None and self.runs[key].remove(o):
            del self.runs[key]
        return count

    def first(self) -> int | None:
        if not self.pages:
            return None
        p = self.low >> BITS
        if p not in self.pages:
            p = min(q for q in self.pages if q > p)
            self.low = p * PAGE
        self.low = p * PAGE + (i := self.entries.page(p).state.find(QUEUED, self.low & MASK))
        if i < 0:  # what the page has queued lies before: never, as long as low is a bound
            raise AssertionError("a queued entry before the first one")
        return self.low

    def first_of(self, ready: Callable[[int], bool]) -> int | None:
        """The first entry whose key is ready."""
        return min((run.first() for key, run in self.keys.items() if ready(key)), default=None)

    def __contains__(self, o: int) -> bool:
        return o in self.counts


def held_by(entries: Entries, pages: list[int], slot: int) -> Iterator[tuple[int, Page, np.ndarray]]:
    """The entries in flight at a consumer, page by page: where they stand in it."""
    for p in pages:
        page = entries.page(p)
        yield p, page, np.flatnonzero((page.view("state") >= FLYING) & (page.view("holder") == slot))
