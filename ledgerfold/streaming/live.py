"""The state table kept current by a stream of commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerfold.operators.fold import state
from ledgerfold.runtime import SharedFiles, work_dir
from ledgerfold.sources.oplog import from_events
from ledgerfold.sources.tables import table_stream

_STATE = "key string, value double, lsn long"
#: Hash parts of the state: a micro-batch rewrites only parts that it touches.
PARTS = 64


class LiveState:
    """State after all commands seen, in versions on shared storage.

    A micro-batch folds the rows of the parts that it touches with its commands
    and writes those parts anew; the commit file names the current path of each
    part, so readers see a whole version and a repeated batch changes nothing.
    Commands must come in order of lsn from batch to batch.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root, self.parts, self._files = spark, root.rstrip("/"), parts, SharedFiles(spark)

    def _current(self) -> dict:
        names = [n for n in self._files.names(self.root) if n.startswith("commit-")]
        return self._files.read_json(f"{self.root}/{names[-1]}") if names else {"batch": -1, "paths": {}}

    def _part(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.parts).cast("long")).cast("int")

    def process(self, commands: DataFrame, batch: int) -> None:
        """Fold one micro-batch of ``(lsn, op, key, value)`` in."""
        m = self._current()
        if batch <= m["batch"]:
            return
        folder = f"{self.root}/v{batch:09d}"
        self._files.delete(folder)  # of an attempt that died
        new = commands.where("key IS NOT NULL").select("lsn", "op", "key", F.col("value").cast("double").alias("value"))
        touched = [r[0] for r in new.select(self._part().alias("p")).distinct().collect()]
        held = self._read(commands.sparkSession, [m["paths"][str(p)] for p in touched if str(p) in m["paths"]])
        both = held.select("lsn", F.lit("put").alias("op"), "key", "value").unionByName(new)
        after = state(both).select("key", "value", "lsn", self._part().alias("part"))
        after.write.partitionBy("part").parquet(folder)
        there = {n.removeprefix("part=") for n in self._files.names(folder) if n.startswith("part=")}
        paths = {k: v for k, v in m["paths"].items() if int(k) not in touched} | {str(p): f"{folder}/part={p}" for p in touched if str(p) in there}
        self._files.commit_json(f"{self.root}/commit-{batch:09d}.json", {"batch": batch, "paths": paths})

    def _read(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return spark.read.schema(_STATE).parquet(*paths) if paths else spark.createDataFrame([], _STATE)

    def read(self) -> DataFrame:
        """``(key, value, lsn)`` of the latest version."""
        return self._read(self.spark, list(self._current()["paths"].values()))

    def start(self, commands: DataFrame, every: str | None = None) -> StreamingQuery:
        """Keep the state current from a stream, with a version ``every`` so often (such as ``1 minute``), or until what is there is drained.

        Each version is a snapshot; offsets are kept beside it, so a restart goes on from it.
        """
        writer = commands.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.root}/offsets")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def run(self, commands: DataFrame) -> None:
        """Drain a stream of commands."""
        self.start(commands).awaitTermination()


def drain(spark: SparkSession, folder: str) -> DataFrame:
    """State after the commands of the event table, taken as a stream."""
    live = LiveState(spark, work_dir(spark, "live"))
    live.run(from_events(table_stream(spark, folder, "events")))
    return live.read()
