"""Bounded stores: which keys stay, which are evicted, which come back from a colder tier."""

from __future__ import annotations

import heapq
from collections import OrderedDict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.operators.routing import check_policy
from ledgerfold.operators.sequential import in_order

_SCHEMA = "shard int, lsn long, action string, key string, value double"


def touches(accesses: DataFrame) -> DataFrame:
    """``(shard, key, freq, last_seq)``: how often and when last each key was used."""
    return accesses.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("freq"), F.max("lsn").alias("last_seq"))


def ranked(touched: DataFrame, capacity: int, policy: str = "lru") -> DataFrame:
    """``touched`` with ``hot``: whether a key is among the ``capacity`` of its shard that the policy would keep.

    For a trace of accesses alone this is what an LRU store holds after it; for
    LFU it ranks the present counts. A capacity of 0 or less keeps all. The
    window filters before it shuffles what can't be kept.
    """
    check_policy(policy)
    if capacity <= 0:
        return touched.withColumn("hot", F.lit(True))
    best = [F.desc("last_seq")] if policy.lower() == "lru" else [F.desc("freq"), F.desc("last_seq")]
    kept = touched.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy(*best, "key"))).where(F.col("place") <= capacity).select("shard", "key", F.lit(True).alias("hot"))
    return touched.join(kept, ["shard", "key"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


class _Store:
    """One shard: values, expiry, recency and use counts, and what was spilled."""

    def __init__(self, capacity: int, policy: str, spill: bool, mset_keeps_ttl: bool):
        self.capacity, self.lfu, self.spill, self.mset_keeps_ttl = capacity, policy == "lfu", spill, mset_keeps_ttl
        self.values: OrderedDict[str, float] = OrderedDict()
        self.until: dict[str, float] = {}
        self.expiring: list[tuple[float, str]] = []
        self.uses: dict[str, tuple[int, int]] = {}
        self.candidates: list[tuple[int, int, str]] = []
        self.clock = 0
        self.cold: dict[str, tuple[float, float | None]] = {}

    def _touch(self, key: str) -> None:
        self.values.move_to_end(key)
        if self.lfu:
            self.clock += 1
            self.uses[key] = (self.uses.get(key, (0, 0))[0] + 1, self.clock)
            heapq.heappush(self.candidates, (*self.uses[key], key))

    def _drop(self, key: str) -> float:
        self.until.pop(key, None)
        self.uses.pop(key, None)
        return self.values.pop(key)

    def _expire(self, key: str, until: float | None) -> None:
        if until is None:
            self.until.pop(key, None)
        else:
            self.until[key] = until
            heapq.heappush(self.expiring, (until, key))

    def _victim(self) -> str:
        if not self.lfu:
            return next(iter(self.values))
        while True:
            n, seq, key = heapq.heappop(self.candidates)
            if self.uses.get(key) == (n, seq):
                return key

    def step(self, row: tuple) -> list[tuple]:
        shard, lsn, now, op, key, value, ttl = row
        out: list[tuple] = []
        say = lambda action, k=key, v=None: out.append((shard, lsn, action, k, v))
        if op != "delete":
            while self.expiring and self.expiring[0][0] <= now:
                t, k = heapq.heappop(self.expiring)
                if self.until.get(k) == t:
                    self._drop(k)
                    say("expire", k)
        there = key in self.values
        until = None if ttl is None else now + ttl
        if op == "read":
            if not there and self.spill and key in self.cold:
                v, t = self.cold.pop(key)
                if t is None or t > now:
                    self.values[key] = v
                    self._expire(key, t)
                    say("promote", key, v)
                    there = True
                    if self.lfu:
                        self._touch(key)
            if there:
                self._touch(key)
                say("hit", key, self.values[key])
            else:
                say("miss")
        elif op == "delete":
            if there:
                self._drop(key)
                self.cold.pop(key, None)
            say("delete" if there else "refuse")
        elif (op == "create" and there) or (op == "update" and not there):
            say("refuse")
        elif op in ("create", "update", "put", "mset", "incr"):
            self.cold.pop(key, None)
            self.values[key] = self.values.get(key, 0.0) + value if op == "incr" else value
            if until is not None or (op in ("create", "mset") and not (op == "mset" and self.mset_keeps_ttl and there)):
                self._expire(key, until)
            self._touch(key)
            say("write", key, self.values[key])
        while self.capacity > 0 and len(self.values) > self.capacity:
            k = self._victim()
            t = self.until.get(k)
            v = self._drop(k)
            if self.spill and (t is None or t > now):
                self.cold[k] = (v, t)
                say("spill", k, v)
            else:
                say("evict", k, v)
        return out


def replay(ops: DataFrame, capacity: int, policy: str = "lru", spill: bool = False) -> DataFrame:
    """What a bounded store does with a log: ``(shard, lsn, action, key, value)``.

    ``ops`` has ``shard, lsn, now`` (seconds), ``op, key, value, ttl``. Actions:
    hit, miss, promote (read from the cold tier), write, refuse, delete, expire,
    evict, spill (evicted into the cold tier). A batch set without a ttl clears
    expiry under LRU and keeps it under LFU. Spilled keys count as absent for
    every command but read, and a counter restarts at 0. NULL values count as 0. Rows with a NULL key are left out.
    """
    check_policy(policy)
    lower = policy.lower()
    rows = ops.where(F.col("key").isNotNull()).select("shard", "lsn", F.col("now").cast("double").alias("now"), "op", "key", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), F.col("ttl").cast("double").alias("ttl"))
    columns = ["shard", "lsn", "now", "op", "key", "value", "ttl"]
    return in_order(rows, ["shard"], ["lsn"], columns, lambda: _Store(capacity, lower, spill, lower == "lfu").step, _SCHEMA)


def expiring_fold(ops: DataFrame) -> DataFrame:
    """The unbounded store with expiry, key by key: same columns as :func:`replay`. Keys are independent, so groups are keys, not shards."""
    rows = ops.where(F.col("key").isNotNull()).select("shard", "lsn", F.col("now").cast("double").alias("now"), "op", "key", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), F.col("ttl").cast("double").alias("ttl"))
    return in_order(rows, ["key"], ["lsn"], ["shard", "lsn", "now", "op", "key", "value", "ttl"], lambda: _Store(0, "lru", False, False).step, _SCHEMA)


def tiers(touched: DataFrame, capacity: int, policy: str = "lru") -> tuple[DataFrame, DataFrame]:
    """Hot and cold rows of :func:`ranked`."""
    split = ranked(touched, capacity, policy)
    return split.where("hot").drop("hot"), split.where("NOT hot").drop("hot")
