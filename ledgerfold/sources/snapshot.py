"""Snapshots of the state table, as Parquet versions and as a line stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators.routing import with_shard
from ledgerfold.runtime import SharedFiles

STATE = "shard INT, key STRING, value STRING, expire_at TIMESTAMP"


class Snapshots:
    """Versions of the state, each whole: a version is seen once its commit file is there. Rows are stored by shard."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep, self._files = spark, root.rstrip("/"), keep, SharedFiles(spark)

    def _versions(self) -> list[str]:
        return [n for n in self._files.names(self.root) if n.startswith("commit-")]

    def save(self, state: DataFrame, lsn: int) -> None:
        """Write the state as of ``lsn``; older versions beyond those to keep are deleted."""
        n = int(self._versions()[-1][7:-5]) + 1 if self._versions() else 0
        path = f"{self.root}/v{n:09d}"
        self._files.delete(path)
        state.select("shard", "key", "value", F.col("expire_at").cast("timestamp").alias("expire_at")).repartition("shard").sortWithinPartitions("shard", "key").write.partitionBy("shard").parquet(path)
        self._files.commit_json(f"{self.root}/commit-{n:09d}.json", {"path": path, "lsn": lsn})
        for old in self._versions()[: -self.keep]:
            where = self._files.read_json(f"{self.root}/{old}")["path"]
            self._files.delete(f"{self.root}/{old}")
            self._files.delete(where)

    def load(self, shards: int | None = None) -> tuple[int, DataFrame] | None:
        """The latest version and its lsn, or None; with ``shards`` given, keys are routed anew, so none is lost when their number changes."""
        if not self._versions():
            return None
        m = self._files.read_json(f"{self.root}/{self._versions()[-1]}")
        state = self.spark.read.schema(STATE).parquet(m["path"])
        return m["lsn"], with_shard(state, shards) if shards else state


def to_lines(dumped: DataFrame) -> DataFrame:
    """A dump as JSON lines, one per key: ``{"shard":..,"key":..,"value":..,"ttl":..}``; write it with ``.write.text(path, compression="gzip")``."""
    return dumped.select(F.to_json(F.struct("shard", "key", "value", "ttl"), {"ignoreNullFields": "false"}).alias("line"))


def from_lines(lines: DataFrame) -> DataFrame:
    """``(shard, key, value, ttl)`` from such lines; what is no such line is dropped."""
    row = F.from_json(lines.columns[0], "shard INT, key STRING, value STRING, ttl DOUBLE")
    return lines.select(row.alias("r")).where("r.key IS NOT NULL").select("r.*")
