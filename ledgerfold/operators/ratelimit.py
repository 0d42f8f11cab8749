"""Token buckets over a request log."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators.sequential import in_order

_SCHEMA = "route string, client string, request_id long, allowed boolean, retry_after int"


def policies(log: DataFrame, table: DataFrame) -> DataFrame:
    """``log`` with ``rps, burst, per_ip`` of its route, or of the row ``default`` where the route has none.

    ``table`` is a setting of a few routes; its join needs no hint and the optimiser broadcasts it by size.
    """
    own = table.where("route <> 'default'").select(F.col("route").alias("__route"), "rps", "burst", "per_ip")
    rest = table.where("route = 'default'").select("rps", "burst", "per_ip").limit(1).collect()
    rps, burst, per_ip = rest[0] if rest else (0.0, 0, True)
    joined = log.join(own, F.col("route") == F.col("__route"), "left")
    has = F.col("__route").isNotNull()
    pick = lambda c, d: F.when(has, F.col(c)).otherwise(F.lit(d)).alias(c)
    return joined.select(*log.columns, pick("rps", rps), pick("burst", burst), pick("per_ip", per_ip))


class _Bucket:
    def __init__(self):
        self.tokens: float | None = None
        self.at = 0.0

    def step(self, row: tuple) -> list[tuple]:
        route, client, request, now, rps, burst = row
        if self.tokens is None:
            self.tokens, self.at = float(burst), now
        self.tokens = min(float(burst), self.tokens + max(0.0, now - self.at) * rps)
        self.at = max(self.at, now)
        if self.tokens >= 1.0:
            self.tokens -= 1.0
            return [(route, client, request, True, 0)]
        return [(route, client, request, False, max(1, math.ceil((1.0 - self.tokens) / rps)))]


def limit(log: DataFrame, table: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """``(route, client, request_id, allowed, retry_after)`` of each request in order of time.

    ``log`` has ``request_id, ts, route`` and ``client`` (may be NULL). A rate or
    burst of 0 or less is no limit. Buckets are per route and, where the policy
    says so, per client; they start full. Repeated requests count once, at their earliest. Requests
    without a time, and those of ``exempt`` routes, are allowed and leave the bucket as it is.
    """
    once = log.groupBy("request_id").agg(F.min(F.struct(F.col("ts").isNull().alias("late"), "ts", "route", "client")).alias("r")).select("request_id", "r.ts", "r.route", "r.client")
    rows = policies(once, table).withColumn("route", F.coalesce("route", F.lit("")))
    client = F.when(F.coalesce("per_ip", F.lit(True)), F.coalesce("client", F.lit(""))).otherwise("*")
    now = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = rows.select("route", client.alias("client"), F.col("request_id").cast("long").alias("request_id"), now.alias("now"), F.coalesce("rps", F.lit(0.0)).alias("rps"), F.coalesce("burst", F.lit(0)).alias("burst"))
    bound = (F.col("rps") > 0) & (F.col("burst") > 0) & F.col("now").isNotNull() & ~F.col("route").isin(*exempt)
    free = rows.where(~bound).select("route", "client", "request_id", F.lit(True).alias("allowed"), F.lit(0).alias("retry_after"))
    held = in_order(rows.where(bound), ["route", "client"], ["now", "request_id"], ["route", "client", "request_id", "now", "rps", "burst"], lambda: _Bucket().step, _SCHEMA)
    return held.unionByName(free)


def client_ip(forwarded, address):
    """The client: the first name of the forwarding header, else the peer's address."""
    first = F.trim(F.substring_index(forwarded, ",", 1))
    return F.when(F.trim(F.coalesce(forwarded, F.lit(""))) != "", first).otherwise(F.coalesce(address, F.lit("")))
