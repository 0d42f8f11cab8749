"""The write-ahead log and what is rebuilt from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.runtime import SharedFiles

ENTRY = "lsn LONG, ts TIMESTAMP, op STRING, key STRING, value STRING, delta DOUBLE, ttl DOUBLE"
#: lsns per segment folder; dropping what a snapshot covers is deleting folders.
SEGMENT_BITS = 20


class Log:
    """An append-only log of JSON lines, in one folder per range of lsn.

    A small file beside the segments holds the lsn that the log begins with.
    Lines that are no entries are passed over. ``ts`` is kept, so replay expires
    keys when they would have expired.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._files = spark, root.rstrip("/"), SharedFiles(spark)

    def append(self, entries: DataFrame) -> None:
        """Add entries that have their lsn (see :func:`ledgerfold.sources.oplog.numbered`)."""
        rows = entries.select("lsn", F.col("ts").cast("timestamp").alias("ts"), "op", "key", "value", "delta", "ttl")
        rows.withColumn("segment", F.shiftright("lsn", SEGMENT_BITS)).write.mode("append").partitionBy("segment").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("timeZone", "UTC").json(f"{self.root}/segments")

    def entries(self, after: int = 0) -> DataFrame:
        """Entries with an lsn above ``after``; segments below are not read. No log, no entries."""
        path = f"{self.root}/segments"
        if not self._files.exists(path):
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(ENTRY + ", segment LONG").option("mode", "PERMISSIVE").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("timeZone", "UTC").json(path)
        low = max(after + 1, self.oldest())
        return rows.where((F.col("segment") >= low >> SEGMENT_BITS) & (F.col("lsn") >= low)).drop("segment")

    def last(self) -> int:
        """The highest lsn; 0 for an empty log."""
        return self.entries().agg(F.max("lsn")).first()[0] or 0

    def oldest(self) -> int:
        """The lsn that the log begins with."""
        bases = [n for n in self._files.names(self.root) if n.startswith("base-")]
        return self._files.read_json(f"{self.root}/{bases[-1]}")["base_lsn"] if bases else 1

    def rotate(self, snapshot_lsn: int) -> None:
        """Let the log begin after a snapshot; whole segments that it covers are deleted."""
        base = max(1, snapshot_lsn + 1)
        if base <= self.oldest():
            return
        self._files.commit_json(f"{self.root}/base-{base:019d}.json", {"base_lsn": base})
        for name in self._files.names(f"{self.root}/segments"):
            if name.startswith("segment=") and (int(name.removeprefix("segment=")) + 1) << SEGMENT_BITS <= base:
                self._files.delete(f"{self.root}/segments/{name}")
