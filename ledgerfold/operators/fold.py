"""The store's commands as a fold of an ordered log, in windows.

A key's history is cut into blocks of lsn. What holds before a block follows
from summaries of the blocks before it, of which there are few; within a block
plain windows do the rest. No task gets more of one key than a block.

Operations: ``create`` (refused if the key is live), ``update`` and ``delete``
(refused if it is not), ``put`` (create or update), ``incr`` (adds; starts an
absent key at 0), ``read``, ``flush`` with a NULL key (empties the store).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.operators.incremental import within
from ledgerfold.runtime import materialize
from ledgerfold.sources.oplog import numbered

#: lsns per block.
BLOCK_BITS = 16
#: Flushes that are told to the tasks as they are; where there are more, commands find theirs by a join.
MOST_FLUSHES = 1000


def _sets() -> Column:
    """Whether a command leaves its key there, whatever was before; NULL if that depends."""
    return F.when(F.col("op").isin("create", "incr", "put"), True).when(F.col("op") == "delete", False)


def _prepared(ops: DataFrame, block_bits: int, flushes: bool = True) -> tuple[DataFrame, bool]:
    made = ["live", "accepted", "live_after", "value_after", "block", "sets", "resets", "adds"]
    ops = ops.drop(*[c for c in made if c in ops.columns])
    epochs = [r[0] for r in ops.where("op = 'flush'").select("lsn").orderBy("lsn").limit(MOST_FLUSHES + 1).collect()] if flushes else []
    known = ops.where(F.col("key").isNotNull() & F.col("op").isin("create", "update", "put", "delete", "incr", "read")).withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))
    if epochs:  # keys of different epochs have nothing to do with each other
        known = _between_flushes(ops, known, epochs).withColumn("key", F.struct(F.col("__e").alias("e"), F.col("key").alias("k"))).drop("__e")
    return known.withColumn("block", F.shiftright("lsn", block_bits)).withColumn("sets", _sets()), bool(epochs)


def _between_flushes(ops: DataFrame, known: DataFrame, epochs: list[int]) -> DataFrame:
    """``known`` with ``__e``, the number of flushes before a command."""
    if len(epochs) <= MOST_FLUSHES:
        return known.withColumn("__e", F.size(F.filter(F.array(*map(F.lit, epochs)), lambda x: x < F.col("lsn"))).cast("long"))
    lo, hi = ops.agg(F.min("lsn"), F.max("lsn")).first()
    begins = numbered(ops.where("op = 'flush'").select(F.col("lsn").alias("at")).distinct(), ["at"], "__e").selectExpr("__e", "at + 1 AS lo")
    begins = materialize(begins.unionByName(ops.sparkSession.range(1).selectExpr("0L AS __e", f"{lo}L AS lo")), "flushes")
    ends = begins.selectExpr("__e - 1 AS __e", "lo - 1 AS hi")
    return within(known, "lsn", begins.join(ends, "__e", "left").selectExpr("__e", "lo", f"coalesce(hi, {hi}L) AS hi"), ["__e"])


def _in_blocks(known: DataFrame) -> DataFrame:
    """Commands with ``live, accepted``, the ``epoch`` that they are in since the block began, and ``inside``, what the epoch has added up to.

    Whether a key is there when a block begins follows from the last telling
    command of each block before: an aggregate that is combined before its shuffle, then a window over blocks.
    """
    ends = known.groupBy("key", "block").agg(F.max_by("sets", F.when(F.col("sets").isNotNull(), F.col("lsn"))).alias("ends"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "block", F.coalesce(F.last("ends", ignorenulls=True).over(before), F.lit(False)).alias("live_in"))
    order = Window.partitionBy("key", "block").orderBy("lsn")
    was = F.last("sets", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    op, live = F.col("op"), F.col("live")
    rows = known.join(carried.hint("shuffle_hash"), ["key", "block"]).withColumn("live", F.coalesce(was, "live_in"))
    rows = rows.withColumn("accepted", F.when(op == "create", ~live).when(op.isin("put", "incr"), True).otherwise(live))
    resets = F.col("accepted") & (op.isin("create", "update", "put", "delete") | ((op == "incr") & ~live))
    rows = rows.withColumn("epoch", F.sum(resets.cast("int")).over(order))
    adds = F.when(F.col("accepted") & op.isin("create", "update", "put", "incr"), F.col("value")).otherwise(0.0)
    rows = rows.withColumn("inside", F.sum(adds).over(Window.partitionBy("key", "block", "epoch").orderBy("lsn")))
    return rows.withColumn("live_after", F.coalesce("sets", "live"))


def _per_block(rows: DataFrame) -> DataFrame:
    """Per (key, block): ``epochs`` that began in it, what the last ``gives``, whether the key is there then, and its last accepted write; with ``ends_at``, what the key holds."""
    wrote = F.when(F.col("accepted") & (F.col("op") != "read"), F.col("lsn"))
    sums = rows.groupBy("key", "block").agg(F.max("epoch").alias("epochs"), F.max_by("inside", "lsn").alias("gives"), F.max_by("live_after", "lsn").alias("alive"), F.max(wrote).alias("wrote"))
    spans = sums.withColumn("span", F.sum((F.col("epochs") > 0).cast("int")).over(Window.partitionBy("key").orderBy("block")))
    return spans.withColumn("ends_at", F.sum("gives").over(Window.partitionBy("key", "span").orderBy("block")))


def fold(ops: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Each command with what came of it: ``(key, lsn, op, value, live, accepted, live_after, value_after)`` and the other columns of ``ops``.

    ``ops`` has ``lsn`` (unique), ``op``, ``key`` and ``value`` (double). ``live``
    tells whether the key was there before, ``value_after`` what it holds then
    (NULL if nothing). Unknown operations and NULL keys are left out, a flush only acts; a
    NULL value of a write counts as 0. Columns named like results are replaced.
    """
    known, flushed = _prepared(ops, block_bits)
    rows = _in_blocks(known)
    before = F.lag("ends_at").over(Window.partitionBy("key").orderBy("block"))
    spans = _per_block(rows).select("key", "block", F.coalesce(before, F.lit(0.0)).alias("value_in"))
    done = rows.join(spans.hint("shuffle_hash"), ["key", "block"])
    done = done.withColumn("value_after", F.when(F.col("live_after"), F.col("inside") + F.when(F.col("epoch") == 0, F.col("value_in")).otherwise(0.0)))
    done = done.drop("block", "sets", "live_in", "epoch", "inside", "value_in")
    return done.withColumn("key", F.col("key.k")) if flushed else done


def state(ops: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Live keys ``(key, value, lsn)`` after the log; ``lsn`` is that of the key's last accepted write. Same input as :func:`fold`, but commands are read once."""
    last_flush = ops.where("op = 'flush'").agg(F.max("lsn")).first()[0]
    known, _ = _prepared(ops if last_flush is None else ops.where(F.col("lsn") > last_flush), block_bits, flushes=False)
    last = _per_block(_in_blocks(known)).groupBy("key").agg(F.max_by(F.struct("alive", "ends_at"), "block").alias("s"), F.max("wrote").alias("lsn"))
    return last.where("s.alive").select("key", F.col("s.ends_at").alias("value"), "lsn")


def keyspace_events(folded: DataFrame) -> DataFrame:
    """What subscribers are told: ``(op, key, lsn)`` with ``set`` or ``del`` for each accepted write."""
    kind = F.when(F.col("op") == "delete", "del").otherwise("set")
    return folded.where(F.col("accepted") & (F.col("op") != "read")).select(kind.alias("op"), "key", "lsn")


def on_channel(events: DataFrame, channel: str, root: str = "keyspace") -> DataFrame:
    """Events of a channel: ``root`` carries all, ``root:set`` and the like one kind, any other none."""
    if channel == root:
        return events
    kind = channel.removeprefix(f"{root}:") if channel.startswith(f"{root}:") else None
    return events.where(F.col("op") == F.lit(kind))
