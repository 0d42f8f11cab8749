"""Command logs from the tables at hand, and dense numbering of any table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.runtime import materialize

#: Event types as store commands.
COMMANDS = {"signup": "create", "view": "read", "click": "incr", "purchase": "update", "error": "delete"}


def from_events(events: DataFrame) -> DataFrame:
    """``(lsn, ts, op, key, value)`` of an event table whose ids follow its time; other event types are dropped."""
    kind = F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv])[F.col("event_type")]
    return events.select((F.col("event_id") + 1).alias("lsn"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("op"), F.col("user_id").cast("string").alias("key"), "value").where("op IS NOT NULL")


def numbered(df: DataFrame, order: list[str], name: str = "lsn", after: int = 0) -> DataFrame:
    """``df`` with dense numbers ``after + 1, ...`` in the given order, as a log gives them to what is appended.

    Rows are range-partitioned once and written; each range then counts on from
    the ranges before it, so no task sees more than its range. Rows equal in
    ``order`` are numbered in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, (inside + F.col("__before") + after).cast("long")).drop("__part", "__before")
