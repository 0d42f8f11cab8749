"""Reads over the state table ``(key, value, ...)`` with an optional ``expire_at``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(state: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows that have not expired at ``now``: expiry is reached when its time is."""
    if now is None or "expire_at" not in state.columns:
        return state
    return state.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))


def expired(state: DataFrame, now: Column) -> DataFrame:
    """Rows that have expired at ``now``."""
    return state.where(F.col("expire_at") <= now)


def read(state: DataFrame, key: str) -> DataFrame:
    """The row of one key; none if it is not there. The comparison reaches the scan."""
    return state.where(F.col("key") == key)


def mget(state: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """``(key, value)`` of the requested keys that are there, each once."""
    wanted = keys.select(F.col(key).alias("key"))
    return state.join(wanted, "key", "left_semi").select("key", "value")


def exists(state: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """``(hits)``: how many of the requested keys are there, repeated requests counted each."""
    return keys.select(F.col(key).alias("key")).join(state.select("key"), "key", "left_semi").agg(F.count(F.lit(1)).alias("hits"))


def scan(state: DataFrame, prefix: str | None = None, limit: int = 100, start_after: str | None = None) -> DataFrame:
    """``(key)`` in order of code points, from after ``start_after``, with ``prefix``; at most ``limit``, none if that is not positive."""
    rows = state.select("key").where(F.col("key").isNotNull())
    if prefix is not None:
        rows = rows.where(F.col("key").startswith(prefix))
    if start_after is not None:
        rows = rows.where(F.col("key") > start_after)
    return rows.orderBy("key").limit(max(0, limit))


def dbsize(state: DataFrame) -> DataFrame:
    """``(keys)``: number of keys."""
    return state.agg(F.count(F.lit(1)).alias("keys"))


def dump(state: DataFrame, now: Column) -> DataFrame:
    """``(shard, key, value, ttl)`` of live rows with the seconds they still have, NULL for ever."""
    left = F.greatest(F.lit(0.0), (F.unix_micros("expire_at") - F.unix_micros(now)) / 1e6)
    return live(state, now).select("shard", "key", "value", F.when(F.col("expire_at").isNotNull(), left).alias("ttl"))


def load(dumped: DataFrame, now: Column) -> DataFrame:
    """``(shard, key, value, expire_at)`` from a dump: expiry is counted from ``now``."""
    until = F.timestamp_micros((F.unix_micros(now) + F.col("ttl") * 1e6).try_cast("long"))
    return dumped.select("shard", "key", "value", F.when(F.col("ttl").isNotNull(), until).alias("expire_at"))


def create_all(state: DataFrame, rows: DataFrame) -> DataFrame:
    """State after inserting ``rows``: those whose key is there already are refused."""
    return state.unionByName(rows.join(state.select("key"), "key", "left_anti").select(*state.columns))


def update_all(state: DataFrame, rows: DataFrame) -> DataFrame:
    """State after updating from ``rows`` (``key, value, expire_at``, one per key): absent keys are refused, a NULL expiry keeps the old one."""
    new = rows.select("key", F.col("value").alias("__value"), F.col("expire_at").alias("__until"), F.lit(True).alias("__hit"))
    both = state.join(new, "key", "left")
    hit = F.coalesce("__hit", F.lit(False))
    return both.withColumns({"value": F.when(hit, F.col("__value")).otherwise(F.col("value")), "expire_at": F.coalesce("__until", "expire_at")}).select(*state.columns)


def delete_all(state: DataFrame, keys: DataFrame) -> DataFrame:
    """State without ``keys``."""
    return state.join(keys.select("key"), "key", "left_anti")


def merge_sets(writes: DataFrame, order: str = "lsn") -> DataFrame:
    """The last write per key of batch sets; equal keys of one batch collapse."""
    return writes.groupBy("key").agg(F.max_by("value", order).alias("value"), F.max(order).alias(order))


def read_through(hot: DataFrame, cold: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, value, tier)``: from the hot table, else from the cold one; keys in neither are left out."""
    wanted = keys.select("key").distinct()
    near = hot.join(wanted, "key", "left_semi").select("key", "value", F.lit("hot").alias("tier"))
    far = cold.join(wanted.join(hot.select("key"), "key", "left_anti"), "key", "left_semi").select("key", "value", F.lit("cold").alias("tier"))
    return near.unionByName(far)
