"""Exactly one copy of messages that were delivered at least once.

A keyed store of seen identifiers is folded forward one micro-batch at a time.
Identifiers newer than the event-time watermark stay in the hot part of the
store; older ones move to an archive that late arrivals are looked up in. The
archive is a few tables sorted by slot, merged as they become many. State
and output of a micro-batch become visible by one rename.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.runtime import SharedFiles

#: Seconds of event time that an identifier stays in the hot part of the store.
WATERMARK_SECONDS = 3600.0
#: Slots of one micro-batch that are looked up by name; where there are more, all between the lowest and the highest are.
MOST_SLOTS = 4096
#: Messages by lsn in a slot: 2**SLOT_BITS.
SLOT_BITS = 14
#: Archive tables of one level that are merged into one of the next.
FAN = 8


class SeenStore:
    """Identifiers seen so far, each with the order number of its first copy.

    ``ids`` are the identifier columns (NULL equals NULL), ``order`` a unique
    number that rises with arrival, ``seconds`` the event time of a row (may be
    NULL), ``slot`` a long by which the archive is sorted: equal for copies
    of one message, and of few values within a micro-batch, so that a lookup
    reads little of a long history.

    The watermark is the median event time of the latest micro-batch less the
    delay, which a few skewed clocks cannot move. An identifier without event
    time goes to the archive at once. Expiry never costs correctness: whatever is
    not hot is looked up.
    """

    def __init__(self, spark: SparkSession, root: str, ids: list[str], order: str, seconds: Column, slot: Column, delay: float = WATERMARK_SECONDS):
        self.spark, self.root, self.ids, self.order = spark, root.rstrip("/"), ids, order
        self.seconds, self.slot, self.delay = seconds, slot, delay
        self._files = SharedFiles(spark)

    def _commits(self) -> list[str]:
        return [n for n in self._files.names(self.root) if n.startswith("commit-")]

    def _manifest(self) -> dict:
        names = self._commits()
        return self._files.read_json(f"{self.root}/{names[-1]}") if names else {"batch": -1, "hot": None, "cold": [], "watermark": None}

    def process(self, rows: DataFrame, batch: int) -> None:
        """Fold one micro-batch in. A batch number that was committed before is skipped, so a restarted stream repeats nothing.

        Its rows are read three times, the hot part once and the slots that it
        touches of the archive once, however many batches came before.
        """
        m = self._manifest()
        if batch <= m["batch"]:
            return
        folder, copies_at = f"{self.root}/v{batch:09d}", f"{self.root}/copies/batch-{batch:09d}"
        for path in (folder, copies_at):
            self._files.delete(path)  # of an attempt that died
        spark = rows.sparkSession
        own = rows.select(*self.ids, F.col(self.order).alias("first"), self.seconds.alias("seconds"), self.slot.alias("slot"))
        wanted, median = self._extent(own)
        if wanted is None:
            self._commit(m | {"batch": batch})
            return
        watermark = m["watermark"] if median is None else max(median - self.delay, m["watermark"] if m["watermark"] is not None else median - self.delay)
        everything = own.select(*self.ids, "slot", "first", "seconds", F.lit(1).alias("fresh"), F.lit(None).cast("long").alias("held"))
        shape = everything.select(*self.ids, "slot", "first", "seconds").schema
        kept = [(m["hot"], None, 1)] * bool(m["hot"]) + [([p for _, p in m["cold"]], wanted, 0)] * bool(m["cold"])
        for paths, only, fresh in kept:
            part = spark.read.schema(shape).parquet(*([paths] if isinstance(paths, str) else paths))
            part = part if only is None else part.where(only)
            everything = everything.unionByName(part.select(*self.ids, "slot", "first", "seconds", F.lit(fresh).alias("fresh"), F.col("first").alias("held")))
        folded = (
            everything.groupBy(*self.ids, "slot")
            .agg(F.min("first").alias("first"), F.max("seconds").alias("seconds"), F.max("fresh").alias("fresh"), F.min("held").alias("held"))
            .where("fresh = 1")
        )
        hot_now = F.coalesce(F.col("seconds") >= F.lit(watermark), F.lit(False)) if watermark is not None else F.lit(False)
        # Files are sorted by slot, so that a lookup skips the pages of other slots without a file for each.
        folded.drop("fresh").withColumn("hot", hot_now).sortWithinPartitions("hot", "slot").write.partitionBy("hot").parquet(folder)
        seen = spark.read.schema(shape.add("held", "long")).parquet(*[f"{folder}/{h}" for h in ("hot=true", "hot=false") if self._files.exists(f"{folder}/{h}")])
        # A copy is every row but the first of its message; where an earlier copy arrives in a later batch, the one held so far becomes the further copy.
        copies = rows.select(F.col(self.order).alias("first")).join(seen.select("first"), "first", "left_anti")
        displaced = seen.where(F.col("held") > F.col("first")).select(F.col("held").alias("first"))
        copies.unionByName(displaced).select(F.col("first").alias(self.order)).write.parquet(copies_at)
        cold = m["cold"] + [[0, f"{folder}/hot=false"]] * self._files.exists(f"{folder}/hot=false")
        now = {"batch": batch, "hot": f"{folder}/hot=true" if self._files.exists(f"{folder}/hot=true") else None, "cold": self._merged(spark, cold, folder), "watermark": watermark}
        self._commit(now)

    def _extent(self, own: DataFrame) -> tuple[Column | None, float | None]:
        """Condition for the slots of a micro-batch (None for one without rows), and its median event time: that of its slots' medians by their rows."""
        per = own.groupBy("slot").agg(F.count("seconds").alias("n"), F.percentile_approx("seconds", 0.5, 100).alias("at")).limit(MOST_SLOTS + 1).collect()
        if not per:
            return None, None
        if len(per) > MOST_SLOTS:
            lo, hi, median = own.agg(F.min("slot"), F.max("slot"), F.percentile_approx("seconds", 0.5, 100)).first()
            return F.col("slot").between(lo, hi), median
        timed = sorted((r["at"], r["n"]) for r in per if r["n"] and r["at"] is not None and r["at"] == r["at"])
        left = sum(n for _, n in timed) / 2
        median = None
        for at, n in timed:
            median, left = at, left - n
            if left <= 0:
                break
        return F.col("slot").isin([r["slot"] for r in per]), median

    def _merged(self, spark: SparkSession, cold: list, folder: str) -> list:
        """Archive tables after merging those of any level that has ``FAN`` of them, so there are few however many batches came, and an identifier is rewritten as often as there are levels."""
        level = 0
        while any(at >= level for at, _ in cold):
            own = [p for at, p in cold if at == level]
            if len(own) >= FAN:
                tables = spark.read.parquet(*own)
                merged = tables.groupBy(*self.ids, "slot").agg(F.min("first").alias("first"), F.max("seconds").alias("seconds"))
                path = f"{folder}/level={level + 1}"
                merged.repartitionByRange("slot", "first").sortWithinPartitions("slot").write.parquet(path)
                cold = [[level + 1, path]] + [x for x in cold if x[0] != level]
            level += 1
        return cold

    def _commit(self, now: dict) -> None:
        self._files.commit_json(f"{self.root}/commit-{now['batch']:09d}.json", now)
        *old, before, _ = ["", "", *self._commits()]  # the one before stays for readers that have it open
        for name in filter(None, old):
            m = self._files.read_json(f"{self.root}/{name}")
            kept = [self._files.read_json(f"{self.root}/{x}") for x in self._commits()[-2:]]
            used = {p for k in kept for p in [k["hot"], *(p for _, p in k["cold"])]}
            for path in [m["hot"], *(p for _, p in m["cold"])]:
                if path and path not in used:
                    self._files.delete(path)
            self._files.delete(f"{self.root}/{name}")

    def run(self, stream: DataFrame) -> None:
        """Drain ``stream`` (a streaming DataFrame) through the store; offsets are kept beside it, so a rerun continues."""
        query = (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.root}/offsets")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def copies(self) -> DataFrame:
        """Order numbers of the rows that are further copies of a message."""
        last = self._manifest()["batch"]
        paths = [f"{self.root}/copies/{n}" for n in self._files.names(f"{self.root}/copies") if int(n.removeprefix("batch-")) <= last]
        shape = f"`{self.order}` long"
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)


def exactly_once(rows: DataFrame, copies: DataFrame, order: str) -> DataFrame:
    """``rows`` without the further copies, all columns kept. ``order`` is unique, so the anti-join cannot be skewed."""
    return rows.join(copies, order, "left_anti")


def message_ids(kind: str) -> tuple[list[str], list[Column]]:
    """Identifier columns of a feed and how to compute them.

    With an lsn above 0, messages are told apart by the lsn (notices also by
    ``op`` and ``key``), else by ``op``, ``key`` and ``ts``. ``op`` counts
    without case and outer blanks. An lsn that is NULL or below 1 counts as 0.
    """
    logged = F.col("lsn") > 0
    op = F.lower(F.trim("op"))
    lsn = F.when(logged, F.col("lsn")).otherwise(F.lit(0).cast("long")).alias("id_lsn")
    if kind == "ops":
        names = [lsn, F.when(logged, None).otherwise(op).alias("id_op"), F.when(logged, None).otherwise(F.col("key")).alias("id_key")]
    else:
        names = [lsn, op.alias("id_op"), F.col("key").alias("id_key")]
    return ["id_lsn", "id_op", "id_key", "id_ts"], [*names, F.when(logged, None).otherwise(event_seconds(kind)).alias("id_ts")]


def event_seconds(kind: str) -> Column:
    """Event time of a row in epoch seconds, as the feed states it."""
    if kind == "ops":
        return F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return F.col("ts")


def message_slot() -> Column:
    """Archive slot of a message: its lsns in runs of 2**SLOT_BITS, or for messages that were never logged, below 0, the day of its ts; a ts that is no day (NaN, infinite, beyond the range) counts as day 0."""
    return F.when(F.col("id_lsn") > 0, F.shiftright("id_lsn", SLOT_BITS)).otherwise(-1 - F.coalesce((F.col("id_ts") / 86400).try_cast("long"), F.lit(0)))
