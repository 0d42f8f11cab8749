"""Most frequent items with guaranteed count intervals, in bounded memory.

Each input split runs lossy counting: entries carry the most that they may have
been undercounted by, and at each bucket boundary entries that cannot matter are
pruned. Summaries of splits merge by adding counts and undercounts. A split that
holds too much in all hands its summaries on and starts anew, so its memory is
bounded whatever the groups and values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.runtime import materialize

#: Undercount as a share of the rows of a group. A split holds about 1/EPSILON entries per group at most, times a logarithm.
EPSILON = 1 / 20_000
#: Entries and uncounted values that a split holds at most, over all groups.
HELD = 2_000_000
#: Candidates up to this many are broadcast for the exact check; beyond it the check is an ordinary join.
BROADCAST_ROWS = 100_000


class _Lossy:
    """Lossy counter of one group in one split."""

    def __init__(self, width: int):
        self.width, self.n, self.pruned = width, 0, 0
        self.entries: pa.Table | None = None
        self._waiting: list[pa.Array] = []

    def add(self, items: pa.Array) -> None:
        while len(items):
            part = items[: self.width - self.n % self.width]
            items = items[len(part) :]
            self._waiting.append(part)
            self.n += len(part)
            if self.n % self.width == 0:
                self._count(self.n // self.width - 1)
                self.pruned = self.n // self.width
                self.entries = self.entries.filter(pc.greater(pc.add(self.entries["n"], self.entries["under"]), self.pruned))

    def held(self) -> int:
        return self.n % self.width + (self.entries.num_rows if self.entries is not None else 0)

    def _count(self, under: int) -> None:
        counts = pc.value_counts(pa.chunked_array(self._waiting))
        self._waiting = []
        new = pa.table({"item": counts.field("values"), "n": counts.field("counts"), "under": pa.array(np.full(len(counts), under, np.int64))})
        both = new if self.entries is None else pa.concat_tables([self.entries, new])
        merged = both.group_by("item").aggregate([("n", "sum"), ("under", "min")])
        self.entries = merged.select(["item", "n_sum", "under_min"]).rename_columns(["item", "n", "under"])

    def summary(self) -> pa.Table:
        if self._waiting:
            self._count(self.pruned)
        return self.entries


def _flat(col: pa.ChunkedArray) -> pa.Array:
    flat = col.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.cast(pa.string())


def _summaries(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[str | None, _Lossy] = {}
        for b in batches:
            names = b.column("grp").dictionary_encode(null_encoding="encode")
            for i, name in enumerate(names.dictionary.to_pylist()):
                part = b.column("item").filter(pc.equal(names.indices, i)) if len(names.dictionary) > 1 else b.column("item")
                groups.setdefault(name, _Lossy(width)).add(part)
            if sum(g.held() for g in groups.values()) > HELD:
                yield from map(_told, groups.items())
                groups = {}
        yield from map(_told, groups.items())

    return run


def _told(group: tuple[str | None, _Lossy]) -> pa.RecordBatch:
    name, g = group
    e = g.summary()
    none = pa.array([None], pa.string())
    return pa.RecordBatch.from_pydict({
        "grp": pa.array([name] * (e.num_rows + 1), pa.string()),
        "item": pa.concat_arrays([none, _flat(e["item"])]) if e.num_rows else none,
        "n": pa.array(np.concatenate([[0], e["n"].to_numpy()]).astype(np.int64)),
        "gain": pa.array(np.concatenate([[0], g.pruned - e["under"].to_numpy()]).astype(np.int64)),
        "bound": pa.array(np.concatenate([[g.pruned], np.zeros(e.num_rows)]).astype(np.int64)),
    })


def lossy_counts(rows: DataFrame, group: str, item: str, epsilon: float = EPSILON) -> DataFrame:
    """``(grp, item, low, high)`` guaranteed count intervals of the items that survive, per group.

    ``high - low`` is at most ``epsilon`` times the rows of the group. The row
    with a NULL item has ``low`` 0 and as ``high`` the most that any item that is
    not listed can count. NULL items are left out; a NULL group is a group.
    """
    width = max(1, round(1 / epsilon))
    given = _given(rows, group, item).where("item IS NOT NULL")
    merged = materialize(
        given.mapInArrow(_summaries(width), "grp string, item string, n bigint, gain bigint, bound bigint")
        .groupBy("grp", "item")
        .agg(F.sum("n").alias("low"), F.sum("gain").alias("gain"), F.sum("bound").alias("bound")),
        "lossy",
    )
    # An item missed in a split may have counted up to that split's bound; one present there only up to its own undercount.
    totals = merged.where("item IS NULL").select(F.col("grp").alias("g"), F.col("bound").alias("most"))
    return merged.join(totals, F.expr("grp <=> g")).selectExpr("grp", "item", "low", "low + most - gain AS high")


def _given(rows: DataFrame, group: str, item: str) -> DataFrame:
    return rows.select(F.col(group).cast("string").alias("grp"), F.col(item).cast("string").alias("item"))


def _counted(rows: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return rows.where("item IS NOT NULL").join(known, F.expr(on), "left_semi").groupBy("grp", "item").agg(F.count(F.lit(1)).alias("n"))


def top_items(rows: DataFrame, group: str, item: str, k: int = 10, epsilon: float = EPSILON) -> DataFrame:
    """``(grp, item, n, low, high, place)``: the ``k`` most frequent items of each group with exact and guaranteed counts; ties by item.

    One lossy pass names every item that may be among the first ``k``; these
    alone are counted exactly. In a group whose k-th item counts no more than
    unlisted ones might (fewer than ``k`` distinct items don't make it so if nothing
    was pruned), intervals cannot tell: its items are counted by a plain aggregation,
    which spills, and unlisted ones have ``low`` 0. NULL items are left out; a NULL group is a group.
    """
    counted = lossy_counts(rows, group, item, epsilon)
    listed = counted.where("item IS NOT NULL")
    w = Window.partitionBy("grp").orderBy(F.desc("low"), "item")
    kth = listed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).groupBy("grp").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("have"))
    unlisted = counted.where("item IS NULL").select(F.col("grp").alias("g"), F.col("high").alias("missed"))
    need = unlisted.join(kth, F.expr("g <=> grp"), "left").selectExpr("g", "missed", f"CASE WHEN have >= {k} THEN least ELSE 0 END AS least")
    need = materialize(need.selectExpr("*", "missed > 0 AND missed >= least AS open"), "groups")
    sure = materialize(listed.join(need.where("NOT open"), F.expr("grp <=> g")).where("high >= least").select("grp", "item", "low", "high"), "candidates")
    names = sure.select(F.col("grp").alias("c_grp"), F.col("item").alias("c_item"))
    if sure.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    given = _given(rows, group, item)
    both = _counted(given, names, "grp <=> c_grp AND item = c_item").alias("n").join(sure.alias("s"), F.expr("n.grp <=> s.grp AND n.item = s.item")).select("n.*", "low", "high")
    if need.where("open").limit(1).count():
        rest = _counted(given, need.where("open").select("g"), "grp <=> g").alias("n").join(need, F.expr("n.grp <=> g")).join(listed.alias("s"), F.expr("n.grp <=> s.grp AND n.item = s.item"), "left")
        both = both.unionByName(rest.selectExpr("n.*", "coalesce(low, 0) AS low", "coalesce(high, missed) AS high"))
    rank = Window.partitionBy("grp").orderBy(F.desc("n"), "item")
    return both.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)
