"""Cache simulators over ordered accesses: LRU, LFU, ARC and plain FIFO with expiry.

Each key of the partitioning column is one cache, simulated in one task in
order of the accesses; ``exact_lru`` counts LRU hits by reuse distance instead.
"""

from __future__ import annotations

from collections import OrderedDict
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class LRU:
    """Least recently used by weight; ``evicted`` is called with each key that goes."""

    def __init__(self, capacity: int, evicted=None):
        self.capacity, self.held, self.used, self.evicted = capacity, OrderedDict(), 0, evicted

    def access(self, key, size: int = 1, now: float = 0.0) -> bool:
        if key in self.held:
            self.held.move_to_end(key)
            return True
        self.held[key] = size
        self.used += size
        while self.used > self.capacity and len(self.held) > 1:
            old, n = self.held.popitem(last=False)
            self.used -= n
            if self.evicted:
                self.evicted(old)
        return False


class LFU:
    """Evicts a key of least use; ties: the one put in first.  Stale heap entries are passed over."""

    def __init__(self, capacity: int, evicted=None):
        self.capacity, self.uses, self.sizes, self.used, self.clock, self.heap, self.evicted = capacity, {}, {}, 0, 0, [], evicted

    def access(self, key, size: int = 1, now: float = 0.0) -> bool:
        self.clock += 1
        if key in self.uses:
            n, at = self.uses[key]
            self.uses[key] = (n + 1, at)
            heappush(self.heap, (n + 1, at, key))
            return True
        while self.uses and self.used + size > self.capacity:
            n, at, old = heappop(self.heap)
            if self.uses.get(old) == (n, at):
                del self.uses[old]
                self.used -= self.sizes.pop(old)
                if self.evicted:
                    self.evicted(old)
        self.uses[key] = (1, self.clock)
        self.sizes[key] = size
        self.used += size
        heappush(self.heap, (1, self.clock, key))
        return False


class FIFO:
    """First in, first out, with an optional time to live."""

    def __init__(self, capacity: int, ttl: float | None = None, evicted=None):
        self.capacity, self.ttl, self.held, self.used, self.evicted = capacity, ttl, OrderedDict(), 0, evicted

    def _drop(self, key) -> None:
        self.used -= self.held.pop(key)[1]

    def access(self, key, size: int = 1, now: float = 0.0) -> bool:
        if key in self.held:
            if self.ttl is None or now - self.held[key][0] < self.ttl:
                return True
            self._drop(key)
        while self.held and self.used + size > self.capacity:
            old = next(iter(self.held))
            self._drop(old)
            if self.evicted:
                self.evicted(old)
        self.held[key] = (now, size)
        self.used += size
        return False


class ARC:
    """Adaptive replacement after Megiddo and Modha by weight: recent and frequent lists with ghosts of each."""

    def __init__(self, capacity: int, evicted=None):
        self.c, self.p, self.evicted = capacity, 0, evicted
        self.lists = {n: OrderedDict() for n in ("t1", "t2", "b1", "b2")}
        self.w = dict.fromkeys(self.lists, 0)

    def _put(self, name: str, key, size: int) -> None:
        self.lists[name][key] = size
        self.w[name] += size

    def _take(self, name: str, key=None) -> tuple:
        """Removes a key, or the oldest."""
        held = self.lists[name]
        key = next(iter(held)) if key is None else key
        size = held.pop(key)
        self.w[name] -= size
        return key, size

    def _replace(self, from_b2: bool) -> None:
        t1 = self.w["t1"]
        if self.lists["t1"] and (t1 > self.p or (from_b2 and t1 == self.p) or not self.lists["t2"]):
            key, size = self._take("t1")
            self._put("b1", key, size)
        elif self.lists["t2"]:
            key, size = self._take("t2")
            self._put("b2", key, size)
        else:
            return
        if self.evicted:
            self.evicted(key)

    def _room(self, size: int, from_b2: bool) -> None:
        while (self.lists["t1"] or self.lists["t2"]) and self.w["t1"] + self.w["t2"] + size > self.c:
            self._replace(from_b2)

    def access(self, key, size: int = 1, now: float = 0.0) -> bool:
        for name in ("t1", "t2"):
            if key in self.lists[name]:
                self._put("t2", *self._take(name, key))
                return True
        for name, other, sign in (("b1", "b2", 1), ("b2", "b1", -1)):
            if key in self.lists[name]:
                step = size * max(1, self.w[other] // max(1, self.w[name]))
                self.p = min(self.c, max(0, self.p + sign * step))
                _, held = self._take(name, key)
                self._room(held, name == "b2")
                self._put("t2", key, held)
                return False
        if size <= self.c:
            while self.lists["b1"] and self.w["t1"] + self.w["b1"] + size > self.c:
                self._take("b1")
            if self.w["t1"] + size > self.c and not self.lists["b1"]:
                while self.lists["t1"] and self.w["t1"] + size > self.c:
                    old, _ = self._take("t1")
                    if self.evicted:
                        self.evicted(old)
            while self.lists["b2"] and sum(self.w.values()) + size > 2 * self.c:
                self._take("b2")
            self._room(size, False)
            self._put("t1", key, size)
        return False


class Tiers:
    """Memory before disk: a hit in the second tier is promoted, what the first evicts goes to the second."""

    def __init__(self, capacity: int, share: int = 4):
        self.sizes: dict = {}
        self.second = LRU(capacity, self.sizes.pop)
        self.first = LRU(max(1, capacity // share), lambda k: self.second.access(k, self.sizes.get(k, 1)))
        self.hits = [0, 0]

    def access(self, key, size: int = 1, now: float = 0.0) -> bool:
        tier = 0 if key in self.first.held else 1 if key in self.second.held else None
        if tier == 1:
            self.second.used -= self.second.held.pop(key)
        self.sizes[key] = size
        self.first.access(key, size, now)
        if tier is not None:
            self.hits[tier] += 1
        return tier is not None


POLICIES = {"lru": LRU, "lfu": LFU, "arc": ARC, "fifo": FIFO, "tiers": Tiers}


def simulate(accesses: DataFrame, policy: str, capacity: int, cache: str = "cache", **options) -> DataFrame:
    """Hits and accesses of each cache.  ``accesses``: cache, seq (order), key, and if wanted size (weight; 1) and now (seconds).

    Sequential by definition, so a cache is one task; the rows of a cache come
    in sorted batches, and what the simulator holds is bounded by its capacity.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sim = POLICIES[policy](capacity, **options)
        rows = pdf.sort_values("seq")[["key", "size", "now"]].itertuples(index=False)
        hits = sum(sim.access(k, n, t) for k, n, t in rows)
        return pd.DataFrame({"cache": [str(pdf["cache"].iloc[0])], "hits": [hits], "accesses": [len(pdf)]})

    more = [F.col(c) if c in accesses.columns else F.lit(v).alias(c) for c, v in (("size", 1), ("now", 0.0))]
    rows = accesses.select(F.col(cache).cast("string").alias("cache"), "seq", "key", *more)
    return rows.groupBy("cache").applyInPandas(run, "cache string, hits long, accesses long")


def exact_lru(accesses: DataFrame, capacity: int) -> DataFrame:
    """LRU hits of each cache by reuse distance: an access hits if fewer than ``capacity`` distinct keys came since its key's last.

    Distinct keys since then are the accesses in between that are the last of
    their key so far; a tree of those places counts them in n log n steps a cache.
    """
    import pandas as pd

    by_key = Window.partitionBy("cache", "key").orderBy("seq")
    place = F.row_number().over(Window.partitionBy("cache").orderBy("seq")).cast("long")
    numbered = accesses.select("cache", "seq", "key", place.alias("at"))
    rows = numbered.withColumn("prev", F.lag("at").over(by_key)).select("cache", "at", "prev")
    total = rows.groupBy("cache").agg(F.count("prev").alias("again"), F.count(F.lit(1)).alias("accesses"))

    def hits(pdf: pd.DataFrame) -> pd.DataFrame:
        """A sweep over one cache's pairs with a Fenwick tree of places that are the last of their key."""
        prev = pdf.sort_values("at")["prev"].fillna(0).astype("int64").to_numpy()
        n = len(prev)
        tree = [0] * (n + 1)
        found = live = 0

        def add(i: int, v: int) -> None:
            while i <= n:
                tree[i] += v
                i += i & -i

        for at, last in enumerate(prev.tolist(), 1):
            if last:
                i, upto = last, 0
                while i:
                    upto += tree[i]
                    i -= i & -i
                found += live - upto < capacity
                add(last, -1)
                live -= 1
            add(at, 1)
            live += 1
        return pd.DataFrame({"cache": [str(pdf["cache"].iloc[0])], "hits": [found]})

    found = rows.groupBy("cache").applyInPandas(hits, "cache string, hits long")
    return total.join(found, "cache").select("cache", "hits", "accesses")
