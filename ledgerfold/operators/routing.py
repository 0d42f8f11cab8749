"""Which shard a key belongs to: a consistent-hash ring as an interval table."""

from __future__ import annotations

import zlib
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points that each shard has on the ring.
VNODES = 100
#: The hash space is cut into 2**CELL_BITS cells, so that finding the next point is an equality join and a filter.
CELL_BITS = 10
#: Rings are sent to all tasks; a setting with more points than this is refused.
MOST_POINTS = 1_000_000


def key_material(key: Column) -> Column:
    """What of a key is hashed: the text in its first pair of braces if there is any, else the whole key."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.when(tag != "", tag).otherwise(key)


def key_hash(key: Column) -> Column:
    """Place of a key on the ring, 0 to 2**32 - 1."""
    return F.crc32(key_material(key).cast("binary"))


@cache
def ring(shards: int, vnodes: int = VNODES) -> tuple[tuple[int, int], ...]:
    """Points of the ring, rising: (hash, shard)."""
    if shards < 1:
        raise ValueError("there must be a shard")
    if shards * vnodes > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points on the ring")
    return tuple(sorted((zlib.crc32(f"shard_{s}_v_{v}".encode()), s) for s in range(shards) for v in range(vnodes)))


@cache
def intervals(shards: int, vnodes: int = VNODES) -> tuple[tuple[int, int, int], ...]:
    """The ring as (first hash, last hash, shard): a key belongs to the first point at or after it, past the last to the first point."""
    out, lo = [], 0
    points = ring(shards, vnodes)
    for h, s in points:
        if h >= lo:
            out.append((lo, h, s))
            lo = h + 1
    if lo < 1 << 32:
        out.append((lo, (1 << 32) - 1, points[0][1]))
    return tuple(out)


def ring_table(spark: SparkSession, shards: int, vnodes: int = VNODES) -> DataFrame:
    """``(lo, hi, shard)``, the intervals of the ring."""
    return spark.createDataFrame(list(intervals(shards, vnodes)), "lo long, hi long, shard int")


def with_shard(df: DataFrame, shards: int, vnodes: int = VNODES, key: str = "key", name: str = "shard") -> DataFrame:
    """``df`` with the shard of each key (NULL for a NULL key), all else kept.

    The interval table is cut at cell edges and broadcast: its size is set by
    shards and points, not by data. A row meets the few intervals of its cell.
    """
    width = 32 - CELL_BITS
    cut = [(cell, max(lo, cell << width), min(hi, ((cell + 1) << width) - 1), s) for lo, hi, s in intervals(shards, vnodes) for cell in range(lo >> width, (hi >> width) + 1)]
    cells = df.sparkSession.createDataFrame(cut, "`__cell` long, `__lo` long, `__hi` long, `__shard` int")
    hashed = df.drop(name) if name in df.columns and name != key else df
    hashed = hashed.withColumn("__hash", key_hash(F.col(key)))
    joined = hashed.join(F.broadcast(cells), (F.shiftright("__hash", width) == F.col("__cell")) & F.col("__hash").between(F.col("__lo"), F.col("__hi")), "left")
    return joined.withColumn(name, F.col("__shard")).drop("__hash", "__cell", "__lo", "__hi", "__shard")


def shard_of(key: str, shards: int, vnodes: int = VNODES) -> int:
    """Shard of one key, on the driver, so that a query can name the partition it reads."""
    start, end = key.find("{"), key.find("}", key.find("{") + 1)
    material = key[start + 1 : end] if 0 <= start < end - 1 else key
    h = zlib.crc32(material.encode("utf-8", "replace"))
    return next(s for lo, hi, s in intervals(shards, vnodes) if lo <= h <= hi)


def check_policy(policy: str, tier: str = "") -> None:
    """Names of eviction policies and tiers that there are; any other is an error."""
    if policy.lower() not in ("lru", "lfu"):
        raise ValueError(f"unknown eviction policy {policy!r}")
    if tier.lower() not in ("", "none", "file", "http", "s3"):
        raise ValueError(f"unknown tier {tier!r}")
