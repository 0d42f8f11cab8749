"""Processing only what no successful run has processed.

Processed sequence numbers are kept as disjoint intervals per consumer. A run
subtracts them from what is available, takes the gaps (new, late or left by a
failed run), and commits the grown intervals together with its output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.runtime import SharedFiles, materialize, work_dir

#: Interval merging works on aligned blocks of 2**BLOCK_BITS numbers, so that no task ever sorts all intervals of one consumer.
BLOCK_BITS = 12
#: Numbers are looked up in intervals by equality on cells of 2**CELL_BITS numbers; disjoint intervals have at most half as many pieces in a cell.
CELL_BITS = 4
#: Cells that are broadcast at most.
BROADCAST_CELLS = 200_000
#: Runs after which the ledger is written anew as one table; until then it is the last such table and what each run since has added.
COMPACT_EACH = 16


def _names(columns: list[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def _cut(df: DataFrame, keys: list[str], lo: str, hi: str, bits: int, name: str = "block") -> DataFrame:
    """``(keys, name, lo, hi)``: the intervals cut at the edges of aligned blocks. Long ones are cut into large blocks first, so that no row holds a long array."""
    k = _names(keys)
    rows = df.where(f"`{lo}` <= `{hi}`").selectExpr(*k, f"CAST(`{lo}` AS BIGINT) AS lo", f"CAST(`{hi}` AS BIGINT) AS hi")
    for step in (bits + 28, bits + 14, bits):
        rows = rows.selectExpr(*k, "lo", "hi", f"explode(sequence(shiftright(lo, {step}), shiftright(hi, {step}))) AS {name}")
        rows = rows.selectExpr(*k, name, f"greatest(lo, shiftleft({name}, {step})) AS lo", f"least(hi, shiftleft({name}, {step}) + {(1 << step) - 1}L) AS hi")
    return rows


def merge_intervals(df: DataFrame, keys: list[str], lo: str, hi: str, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Union of the intervals ``[lo, hi]`` per ``keys`` as disjoint, non-touching intervals within aligned blocks.

    Intervals are cut at block edges; after keeping the longest interval of each
    start, a window partition holds at most ``2**block_bits`` rows, whatever the
    skew or repetition of the input. Rows with a NULL bound or ``lo > hi`` are empty.
    """
    k = _names(keys)
    w = f"PARTITION BY {', '.join([*k, 'block'])} ORDER BY lo"
    cut = _cut(df, keys, lo, hi, block_bits).groupBy(*keys, "block", "lo").agg(F.expr("max(hi) AS hi"))
    starts = cut.selectExpr("*", f"CASE WHEN lo <= max(hi) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS starts")
    islands = starts.selectExpr("*", f"sum(starts) OVER ({w}) AS island").groupBy(*keys, "block", "island").agg(F.expr("min(lo) AS lo"), F.expr("max(hi) AS hi"))
    return islands.selectExpr(*k, f"lo AS `{lo}`", f"hi AS `{hi}`")


def subtract_intervals(available: DataFrame, processed: DataFrame, keys: list[str], lo: str, hi: str, block_bits: int = BLOCK_BITS, disjoint: bool = False) -> DataFrame:
    """Parts of ``available`` that ``processed`` does not cover, cut at block edges.

    Both sides are merged first, unless each is ``disjoint`` already. Within a block the edges of either side are
    swept in order, so the work per task is bounded as in :func:`merge_intervals`.
    """
    k = _names(keys)
    edges = None
    for side, df in (("1, 0", available), ("0, 1", processed)):
        m = df if disjoint else merge_intervals(df, keys, lo, hi, block_bits)
        a, p = side.split(", ")
        e = _cut(m, keys, lo, hi, block_bits).selectExpr(*k, "block", f"stack(2, lo, {a}, {p}, hi + 1, -{a}, -{p}) AS (at, a, p)")
        edges = e if edges is None else edges.unionByName(e)
    at_once = edges.groupBy(*keys, "block", "at").agg(F.expr("sum(a) AS a"), F.expr("sum(p) AS p"))
    w = f"OVER (PARTITION BY {', '.join([*k, 'block'])} ORDER BY at)"
    swept = at_once.selectExpr(*k, "at", f"sum(a) {w} AS in_a", f"sum(p) {w} AS in_p", f"lead(at) {w} AS until")
    # Both sides being disjoint, no edge lies within a gap, so these are whole.
    return swept.where("in_a > 0 AND in_p = 0 AND until IS NOT NULL").selectExpr(*k, f"at AS `{lo}`", f"until - 1 AS `{hi}`")


def processed_intervals(acks: DataFrame, keys: list[str], lo: str = "batch_from", hi: str = "batch_to", ok: str = "ok") -> DataFrame:
    """Intervals that the successful runs of each consumer cover. Failed runs and runs without an outcome cover nothing."""
    return merge_intervals(acks.where(F.col(ok)), keys, lo, hi)


def within(rows: DataFrame, at: str, intervals: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``rows`` once for each of ``intervals`` that ``at`` lies in, with its ``keys``.

    Disjoint intervals are cut into cells, so this is a join by equality whose
    matches differ in their keys; NULL lies in no interval. The cells are counted
    first: up to ``BROADCAST_CELLS`` they are broadcast, else both sides are shuffled by cell.
    """
    n = intervals.where(f"`{lo}` <= `{hi}`").agg(F.expr(f"sum(shiftright(`{hi}`, {CELL_BITS}) - shiftright(`{lo}`, {CELL_BITS}) + 1)")).first()[0] or 0
    cells = _cut(intervals, keys, lo, hi, CELL_BITS, "__cell").withColumnsRenamed({"lo": "__lo", "hi": "__hi"})
    cells = F.broadcast(cells) if n <= BROADCAST_CELLS else cells.hint("shuffle_hash")
    found = rows.selectExpr("*", f"shiftright(`{at}`, {CELL_BITS}) AS __cell").join(cells, "__cell")
    return found.where(f"`{at}` BETWEEN __lo AND __hi").drop("__cell", "__lo", "__hi")


def due(feed: DataFrame, message: list[str], gaps: DataFrame, processed: DataFrame, keys: list[str], at: str = "batch_id") -> DataFrame:
    """``(keys, message)`` of messages that lie in a gap of a consumer and have no copy in what it has processed.

    ``feed`` has ``at`` and the columns ``message`` that tell messages apart; NULL
    equals NULL there. Only rows in gaps are taken further: they are written, then their messages are
    looked up once among all delivered copies, and copies that the consumer has processed take them out again.
    """
    taken = materialize(within(feed.select(at, *message), at, gaps, keys).select(*keys, *message).distinct(), "taken")
    asked = taken.select(*message).distinct()
    copies = feed.select(at, *message).alias("f").join(asked.alias("a"), F.expr(" AND ".join(f"f.`{c}` <=> a.`{c}`" for c in message)), "left_semi")
    seen = within(copies, at, processed, keys).select(*keys, *message)
    return taken.alias("t").join(seen.alias("s"), F.expr(" AND ".join(f"t.`{c}` <=> s.`{c}`" for c in [*keys, *message])), "left_anti")


class IncrementalJob:
    """Consumers whose runs take only unprocessed sequence numbers and commit exactly once.

    ``root`` (on shared storage) holds run folders and one small ``commit-N.json``
    per successful run. A run's output and the intervals that it adds are written
    first, to a folder of its own; the rename of the commit file, which fails if
    another run has that number, makes both visible at once. A run that dies or
    loses leaves nothing visible, and its numbers are taken again by the next;
    :meth:`clean` deletes such leftovers. ``keys`` are the columns of the ledger that name a
    consumer; none for a single one.
    """

    def __init__(self, spark: SparkSession, root: str, seq: str = "lsn", keys: list[str] | None = None, kinds: str = ""):
        self.spark, self.root, self.seq, self.keys = spark, root.rstrip("/"), seq, list(keys or [])
        self._schema = ", ".join([*([kinds or ", ".join(f"`{k}` string" for k in self.keys)] if self.keys else []), "lo long, hi long"])
        self._files = SharedFiles(spark)

    def _names(self) -> list[str]:
        return [n for n in self._files.names(self.root) if n.startswith("commit-")]

    def _last(self) -> dict:
        names = self._names()
        return self._files.read_json(f"{self.root}/{names[-1]}") if names else {"run": -1, "ledger": []}

    def _ledger(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema)

    def intervals(self) -> DataFrame:
        """Processed sequence numbers as disjoint intervals ``(keys, lo, hi)``, cut at block edges."""
        paths = self._last()["ledger"]
        return self._ledger(paths) if len(paths) < 2 else merge_intervals(self._ledger(paths), self.keys, "lo", "hi")  # each table is merged

    def gaps(self, available: DataFrame) -> DataFrame:
        """Parts of ``available`` (disjoint ``keys, lo, hi``) that no run has processed."""
        return subtract_intervals(available, self.intervals(), self.keys, "lo", "hi", disjoint=True)

    def available(self, feed: DataFrame) -> DataFrame:
        """What is there of ``feed`` as intervals ``(lo, hi)``: its numbers, NULL left out. Only this column is read."""
        numbers = feed.where(F.col(self.seq).isNotNull()).select(F.col(self.seq).cast("long").alias("lo")).distinct()
        return merge_intervals(numbers.withColumn("hi", F.col("lo")), [], "lo", "hi")

    def commit(self, write: Callable[[str], dict], added: DataFrame | None) -> int:
        """One run: ``write`` puts its output below the folder that it is given; then ``added`` intervals and output are committed. The number of the run."""
        last = self._last()
        n = last["run"] + 1
        folder = f"{self.root}/run-{n:09d}-{uuid.uuid4().hex[:12]}"
        more = write(folder)
        ledger = list(last["ledger"])
        if added is not None:
            merge_intervals(added, self.keys, "lo", "hi").select(*self.keys, "lo", "hi").write.parquet(f"{folder}/added")
            ledger.append(f"{folder}/added")
        if len(ledger) > COMPACT_EACH:
            merge_intervals(self._ledger(ledger), self.keys, "lo", "hi").select(*self.keys, "lo", "hi").write.parquet(f"{folder}/ledger")
            ledger = [f"{folder}/ledger"]
        self._files.commit_json(f"{self.root}/commit-{n:09d}.json", {"run": n, "ledger": ledger, "folder": folder} | more)
        return n

    def seed(self, processed: DataFrame) -> int:
        """Take over what was processed elsewhere, as a run without output."""
        return self.commit(lambda folder: {}, processed)

    def run(self, feed: DataFrame, work: Callable[[DataFrame], DataFrame]) -> int:
        """Process the rows of ``feed`` that are pending with ``work`` and commit; the number of the run. For jobs of one consumer."""
        gaps = materialize(self.gaps(self.available(feed)), "gaps")
        lo, hi = gaps.agg(F.min("lo"), F.max("hi")).first()
        rows = feed.where(F.col(self.seq).between(lo, hi)) if lo is not None else feed.where("false")  # reaches the scan

        def write(folder: str) -> dict:
            work(within(rows, self.seq, gaps, [])).write.parquet(f"{folder}/output")
            return {"output": f"{folder}/output"}

        return self.commit(write, gaps)

    def run_messages(self, feed: DataFrame, message: list[str], consumers: DataFrame, ends: tuple[int, int]) -> int:
        """One run of each of ``consumers`` over the messages of ``feed``, whose numbers lie within ``ends``: see :func:`due`.

        Output has the messages that each took, with its ``keys``.
        """
        available = consumers.select(*self.keys).distinct().select(*self.keys, F.lit(ends[0]).cast("long").alias("lo"), F.lit(ends[1]).cast("long").alias("hi"))
        gaps = materialize(self.gaps(available), "gaps")

        def write(folder: str) -> dict:
            due(feed, message, gaps, self.intervals(), self.keys, self.seq).write.parquet(f"{folder}/output")
            return {"output": f"{folder}/output"}

        return self.commit(write, gaps)

    def output(self) -> DataFrame | None:
        """Output of all committed runs; None before the first."""
        runs = (self._files.read_json(f"{self.root}/{n}") for n in self._names())
        paths = [c["output"] for c in runs if "output" in c]
        return self.spark.read.parquet(*paths) if paths else None

    def clean(self) -> None:
        """Delete the folders of runs that never committed. Only while no run is under way."""
        kept = {self._files.read_json(f"{self.root}/{n}")["folder"].rsplit("/", 1)[-1] for n in self._names()}
        for name in self._files.names(self.root):
            if name.startswith("run-") and name not in kept:
                self._files.delete(f"{self.root}/{name}")


def unprocessed(feed: DataFrame, message: list[str], acks: DataFrame, stream: str) -> DataFrame:
    """``(stream, follower, lsn)`` that each consumer's next run has to take: an :class:`IncrementalJob` that takes over the ``acks`` and makes that run.

    ``feed`` has ``batch_id``, ``lsn`` and the columns ``message`` (``lsn`` among
    them) that tell messages apart; NULL equals NULL there. A message is done for
    a consumer if any delivered copy lies in a processed interval, an lsn is due
    if any of its messages is not done. Rows with lsn NULL or below 1 are no
    messages; a NULL ``batch_id`` lies in no run, so it counts as a batch of its own after
    all others. A consumer without a successful run is due everything. Other columns of ``feed`` are ignored.
    """
    spark = feed.sparkSession
    own = acks.where((F.col("stream") == stream) & F.col("follower").isNotNull())
    job = IncrementalJob(spark, work_dir(spark, f"runs-{stream}"), "batch_id", ["follower"])
    job.seed(own.where("ok").select("follower", F.col("batch_from").alias("lo"), F.col("batch_to").alias("hi")))
    ends = own.agg(F.max("batch_to")).first()[0] or 0, *(x or 0 for x in feed.agg(F.min("batch_id"), F.max("batch_id")).first())
    none = max(ends[0], ends[2]) + 1
    rows = feed.where(F.col("lsn") > 0).select(F.coalesce("batch_id", F.lit(none)).cast("long").alias("batch_id"), *message)
    job.run_messages(rows, message, own, (ends[1], none))
    return job.output().select(F.lit(stream).alias("stream"), "follower", "lsn").distinct()
