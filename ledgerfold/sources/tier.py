"""The cold tier: spilled keys in a table of objects named by the hash of their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions.text import base64_text
from ledgerfold.runtime import SharedFiles

OBJECT = "object_id STRING, key STRING, stored_at DOUBLE, ttl_remaining DOUBLE, kind STRING, value STRING, part STRING"


def as_objects(rows: DataFrame, now: Column) -> DataFrame:
    """Objects of ``rows`` (``key, value, ttl``; ``value`` text or binary): expired ones make none, bytes travel as base64."""
    binary = dict(rows.dtypes)["value"] == "binary"
    value = base64_text(F.col("value")) if binary else F.col("value")
    kept = rows.where("ttl IS NULL OR ttl > 0")
    made = kept.select(F.sha2("key", 256).alias("object_id"), "key", now.alias("stored_at"), F.col("ttl").alias("ttl_remaining"), F.lit("bytes" if binary else "text").alias("kind"), value.alias("value"))
    return made.withColumn("part", F.substring("object_id", 1, 2))


class ColdTier:
    """Objects in Parquet below one path on any file system (local, ``s3a://`` and the like), partitioned by the first digits of their name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._files = spark, path.rstrip("/"), SharedFiles(spark)

    def put(self, rows: DataFrame, now: Column) -> None:
        """Add objects; a later object of a key replaces an earlier one."""
        as_objects(rows, now).write.mode("append").partitionBy("part").parquet(self.path)

    def delete(self, keys: DataFrame, now: Column) -> None:
        """Forget ``keys``: a mark is added that hides their objects stored up to then. Marks and what they hide go when :meth:`compact` runs."""
        gone = as_objects(keys.select("key", F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("ttl")), now)
        gone.withColumn("kind", F.lit("gone")).write.mode("append").partitionBy("part").parquet(self.path)

    def compact(self, to: str, now: Column) -> ColdTier:
        """A tier at the path ``to`` with the objects that this one holds at ``now``, one of each key."""
        left = F.col("ttl_remaining") - F.greatest(F.lit(0.0), now - F.col("stored_at"))
        kept = self._last(self.spark.read.schema(OBJECT).parquet(self.path)).where(F.col("ttl_remaining").isNull() | (left > 0))
        kept.withColumn("object_id", F.sha2("key", 256)).withColumn("part", F.substring("object_id", 1, 2)).repartition("part").write.partitionBy("part").parquet(to)
        return ColdTier(self.spark, to)

    @staticmethod
    def _last(held: DataFrame) -> DataFrame:
        """The latest object of each key; of those of one moment a deletion wins, then the greatest value."""
        first = F.struct("stored_at", (F.col("kind") == "gone").alias("g"), "value", "kind", "ttl_remaining")
        return held.groupBy("key").agg(F.max(first).alias("o")).select("key", "o.*").where("NOT g").drop("g")

    def get(self, keys: DataFrame, now: Column) -> DataFrame:
        """``(key, value, kind, ttl_remaining)`` of those of ``keys`` that are held and have not expired at ``now``."""
        if not self._files.exists(self.path):
            return self.spark.createDataFrame([], "key STRING, value STRING, kind STRING, ttl_remaining DOUBLE")
        wanted = keys.select("key").distinct().withColumn("part", F.substring(F.sha2("key", 256), 1, 2))
        held = self.spark.read.schema(OBJECT).parquet(self.path).join(wanted, ["part", "key"], "left_semi")
        last = self._last(held)
        left = F.col("ttl_remaining") - F.greatest(F.lit(0.0), now - F.col("stored_at"))
        return last.where(F.col("ttl_remaining").isNull() | (left > 0)).select("key", "value", "kind", left.alias("ttl_remaining"))
