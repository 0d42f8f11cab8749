"""Per-key results when a few keys hold most rows.

Keys are dictionary-encoded within equal input splits, each split adds its rows
into dense arrays, and only array blocks travel: a key costs one entry per
split, however many rows it has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dictionary entries a split holds before it hands on its arrays.
ENTRIES = 500_000
#: Input rows per array block of the reduction, so a block never gets more keys than that from a spread of keys.
ROWS_PER_BLOCK = 1_000_000
#: Keys in one batch of results.
OUT = 50_000

_PARTIAL = "block int, keys array<string>, n array<bigint>, first array<double>, last array<double>, shard array<int>"
_RESULT = "key string, shard int, n bigint, first_ts double, last_ts double"


class _Dense:
    """Dense accumulators over a growing dictionary of keys."""

    def __init__(self):
        self.codes: dict[str | None, int] = {}
        self.n = np.zeros(1024, np.int64)
        self.first = np.full(1024, np.inf)
        self.last = np.full(1024, -np.inf)
        self.shard = np.full(1024, -1, np.int64)

    def encode(self, keys: list[str | None]) -> np.ndarray:
        codes = self.codes
        at = np.fromiter((codes.setdefault(k, len(codes)) for k in keys), np.int64, len(keys))
        while len(codes) > len(self.n):
            self.n = np.concatenate([self.n, np.zeros_like(self.n)])
            self.first = np.concatenate([self.first, np.full_like(self.first, np.inf)])
            self.last = np.concatenate([self.last, np.full_like(self.last, -np.inf)])
            self.shard = np.concatenate([self.shard, np.full_like(self.shard, -1)])
        return at

    def add(self, at: np.ndarray, n: np.ndarray, first: np.ndarray, last: np.ndarray, shard: np.ndarray) -> None:
        """Add entries; ``at`` may repeat."""
        size = len(self.codes)
        self.n[:size] += np.bincount(at, weights=n, minlength=size).astype(np.int64)
        np.minimum.at(self.first, at, first)
        np.maximum.at(self.last, at, last)
        np.maximum.at(self.shard, at, shard)


def _numbers(col: pa.ChunkedArray | pa.Array, fill: float, kind) -> np.ndarray:
    return col.fill_null(fill).to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _split(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _Dense()
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column("key").dictionary_encode(null_encoding="encode")
            at = dense.encode(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
            ts = b.column("ts")
            low, high = _numbers(ts, np.nan, float), None
            high = np.where(np.isnan(low), -np.inf, low)
            low = np.where(np.isnan(low), np.inf, low)
            dense.add(at, np.ones(len(at)), low, high, _numbers(b.column("shard"), -1, np.int64))
            if len(dense.codes) >= ENTRIES:
                yield from _hand_on(dense, blocks)
                dense = _Dense()
        yield from _hand_on(dense, blocks)

    return run


def _hand_on(dense: _Dense, blocks: int) -> Iterator[pa.RecordBatch]:
    keys = list(dense.codes)
    if not keys:
        return
    block = np.fromiter((zlib.crc32(k.encode("utf-8", "surrogatepass")) % blocks if k is not None else 0 for k in keys), np.int64, len(keys))
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    names = pa.array(keys, pa.string()).take(pa.array(order))
    starts = np.concatenate([[0], cuts, [len(keys)]]).astype(np.int32)

    def lists(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(starts), values)

    yield pa.RecordBatch.from_arrays(
        [pa.array(block[order][starts[:-1]], pa.int32()), lists(names), *(lists(pa.array(x[: len(keys)][order], kind)) for x, kind in ((dense.n, pa.int64()), (dense.first, pa.float64()), (dense.last, pa.float64()), (dense.shard, pa.int32())))],
        ["block", "keys", "n", "first", "last", "shard"],
    )


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the arrays of one block as they come in; only the sum is held."""
    dense = _Dense()
    for b in batches:
        flat = {c: b.column(c).flatten() for c in ("keys", "n", "first", "last", "shard")}
        if len(flat["keys"]):
            at = dense.encode(flat["keys"].to_pylist())
            dense.add(at, *(flat[c].to_numpy(zero_copy_only=False) for c in ("n", "first", "last", "shard")))
    keys = list(dense.codes)
    for lo in range(0, len(keys), OUT):
        part = slice(lo, min(lo + OUT, len(keys)))
        first, last, shard = dense.first[part], dense.last[part], dense.shard[part].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[part], pa.string()), pa.array(shard, mask=shard < 0), pa.array(dense.n[part]), pa.array(first, mask=np.isinf(first)), pa.array(last, mask=np.isinf(last))],
            ["key", "shard", "n", "first_ts", "last_ts"],
        )


def per_key(rows: DataFrame, total: int | None = None) -> DataFrame:
    """``(key, shard, n, first_ts, last_ts)`` for each key of ``rows``.

    ``rows`` has ``key``, ``shard`` (0 or above, or NULL) and ``ts`` in seconds;
    other columns are ignored. ``shard`` of a key is its one non-NULL value (the
    largest, were there several; NULL if there is none). NULL and NaN ``ts`` count as rows but
    not for the first and last ``ts``. A NULL key is a key of its own. No rows, no result.
    ``total``, the number of rows, is counted where not given.

    A block of keys is a partition of the reduction: keys are spread over blocks
    by a checksum and blocks are not hashed again, so tasks get like amounts. The
    number of blocks follows the number of rows.
    """
    spark = rows.sparkSession
    total = rows.count() if total is None else total
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS_PER_BLOCK))
    partial = rows.select("key", F.col("shard").cast("int").alias("shard"), F.col("ts").cast("double").alias("ts")).mapInArrow(_split(blocks), _PARTIAL)
    return partial.repartitionById(blocks, F.col("block")).mapInArrow(_sum_blocks, _RESULT)


def per_shard(keys: DataFrame) -> DataFrame:
    """``(shard, keys, n, first_ts, last_ts)`` from the result of :func:`per_key`; hot shards hold few rows by then."""
    return keys.groupBy("shard").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def hot_keys(rows: DataFrame, percent: int = 1) -> DataFrame:
    """``(key, shard, n)`` of keys with at least ``percent`` per cent of all rows, from exact counts. A NULL key counts among the rows but is not reported."""
    total = rows.count()
    found = per_key(rows, total)
    return found.where(F.col("key").isNotNull() & (F.col("n") * 100 >= F.lit(total) * percent)).select("key", "shard", "n")
