"""Putting texts into containers of permitted sizes with little space left over.

Variable-capacity best-fit: items go, largest first, into the open bin that they
fill best; where none has room, the permitted size that costs least for what
can go into it is opened; at the end each bin is cut down to the smallest
permitted size that holds its contents. Items are packed where they are read
first; bins that are left part-filled there are emptied and their items packed
again, together.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.runtime import materialize

#: Items that one packing takes in; a longer partition is packed in several, whose part-filled bins meet in the second round.
ITEMS = 200_000
#: Bins filled to less than this share are packed again.
FULL = 0.99
#: Bins of the second round are numbered from here.
SECOND = 1 << 61
#: Most specifications that are sent to the tasks.
MOST_SPECS = 1000

_SCHEMA = "spec_name string, {key}, piece int, pieces int, piece_start bigint, piece_tokens bigint, bin bigint, bin_capacity bigint"


def token_size(text):
    """Tokens of a text under the byte tokenizer without end mark; 0 for NULL."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def best_fit(sizes: list[int], permitted: list[int]) -> tuple[list[int], list[int]]:
    """The bin of each item, and the size of each bin. No item is larger than the largest permitted size."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    rising = [sizes[i] for i in reversed(order)]
    below = [0]
    for s in rising:
        below.append(below[-1] + s)
    room: dict[int, list[int]] = {}  # bins by the space that they have left
    spaces: list[int] = []  # the spaces that there are, rising: as many as sizes can leave, not as bins
    used: list[int] = []
    at = [0] * len(sizes)
    for done, i in enumerate(order):
        s = sizes[i]
        k = bisect_left(spaces, s)
        if k < len(spaces):
            left = spaces[k]
            b = room[left].pop()
            if not room[left]:
                del room[left], spaces[k]
        else:
            rest = len(order) - done - 1  # items not yet placed: the smallest ones

            def cost(c: int, s: int = s, rest: int = rest) -> tuple[float, int]:
                fits = min(rest, bisect_right(rising, c - s))
                return c / max(1, s + min(c - s, below[fits])), -c

            left = min((c for c in permitted if c >= s), key=cost)
            b = len(used)
            used.append(0)
        used[b] += s
        at[i] = b
        if left > s or s == 0:
            if left - s not in room:
                insort(spaces, left - s)
            room.setdefault(left - s, []).append(b)
    return at, [next(c for c in permitted if c >= u) for u in used]


def _pieces(specs: list[tuple[str, int, list[int]]], key: str):
    """First round: texts cut into pieces where they must be, and packed as they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 34
        ids: list[pa.Array] = []
        sizes: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            keys = pa.concat_arrays(ids)
            for name, most, permitted in specs:
                row, piece, of, start, length = [], [], [], [], []
                for i, s in enumerate(sizes):
                    n = max(1, -(-s // most))
                    for p in range(n):
                        row.append(i)
                        piece.append(p)
                        of.append(n)
                        start.append(p * most)
                        length.append(min(most, s - p * most))
                at, capacity = best_fit(length, permitted)
                columns = [pa.array([name] * len(row), pa.string()), keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(of, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
                yield _placed(columns, key, at, capacity, base, length)
                base += len(capacity)
            ids.clear()
            sizes.clear()

        for b in batches:
            ids.append(b.column(0))
            sizes.extend(b.column(1).to_pylist())
            if len(sizes) >= ITEMS:
                yield from flush()
        if sizes:
            yield from flush()

    return run


def _placed(columns: list[pa.Array], key: str, at: list[int], capacity: list[int], base: int, length: list[int]) -> pa.RecordBatch:
    used = [0] * len(capacity)
    for b, s in zip(at, length, strict=True):
        used[b] += s
    own = [pa.array([base + b for b in at], pa.int64()), pa.array([capacity[b] for b in at], pa.int64()), pa.array([used[b] >= FULL * capacity[b] for b in at], pa.bool_())]
    return pa.RecordBatch.from_arrays([*columns, *own], ["spec_name", key, "piece", "pieces", "piece_start", "piece_tokens", "bin", "bin_capacity", "full"])


def _again(specs: list[tuple[str, int, list[int]]], key: str):
    """Second round: pieces as they are, packed anew."""
    permitted = {name: sizes for name, _, sizes in specs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = SECOND + (TaskContext.get().partitionId() << 34)
        held: dict[str, list[pa.RecordBatch]] = {}
        count: dict[str, int] = {}

        def flush(name: str) -> pa.RecordBatch:
            nonlocal base
            rows = pa.Table.from_batches(held.pop(name)).combine_chunks()
            count[name] = 0
            length = rows["piece_tokens"].to_pylist()
            at, capacity = best_fit(length, permitted[name])
            out = _placed([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns[:6]], key, at, capacity, base, length)
            base += len(capacity)
            return out

        for b in batches:
            names = b.column(0).dictionary_encode(null_encoding="encode")
            for i, name in enumerate(names.dictionary.to_pylist()):
                part = b.filter(pc.equal(names.indices, i))
                held.setdefault(name, []).append(part)
                count[name] = count.get(name, 0) + part.num_rows
                if count[name] >= ITEMS:
                    yield flush(name)
        for name in list(held):
            yield flush(name)

    return run


def pack(docs: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Where each text goes, for each specification: ``(spec_name, key, piece, pieces, piece_start, piece_tokens, bin, bin_capacity)``.

    ``specs`` has ``spec_name`` and ``capacity_tokens``. A specification permits
    its own capacity and every smaller one listed, which are opened jointly. A
    text is split only if it is larger than the capacity alone: into full pieces
    and a rest, positions in tokens. Empty and NULL texts are pieces of 0 tokens.
    Repeated rows are items of their own; other columns are ignored; capacities that are NULL or
    below 1 are left out. Bins are unique within a specification.

    Items are packed where they are read, so only ids and sizes are held, and written.
    Pieces of part-filled bins, a few bins of each input split, are spread over as
    many tasks as their number asks for and packed again; only they are shuffled. What
    remains part-filled is a few bins of each of those tasks. Specifications are a
    setting, sent to all tasks; more than ``MOST_SPECS`` are refused.
    """
    rows = specs.where(F.col("capacity_tokens") > 0).select("spec_name", F.col("capacity_tokens").cast("long")).distinct().limit(MOST_SPECS + 1).collect()
    if len(rows) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container specifications")
    plans = [(r[0], r[1], sorted({x[1] for x in rows if x[1] <= r[1]})) for r in sorted(rows, key=lambda r: (r[1], str(r[0])))]
    kind = f"`{key}` {docs.schema[key].dataType.simpleString()}"
    schema = _SCHEMA.format(key=kind) + ", full boolean"
    first = materialize(docs.select(F.col(key), token_size(F.col(text)).alias("size")).mapInArrow(_pieces(plans, key), schema), "packed")
    again = first.where("NOT full").drop("bin", "bin_capacity", "full")
    tasks = max(1, -(-again.count() // (ITEMS * max(1, len(plans)))))
    # spread by what tells pieces apart, so that a repeated packing gives the same bins
    second = again.repartition(tasks, "spec_name", key, "piece").sortWithinPartitions("spec_name", key, "piece") if tasks > 1 else again.coalesce(1)
    return first.where("full").drop("full").unionByName(materialize(second.mapInArrow(_again(plans, key), schema).drop("full"), "repacked"))


def bins(packed: DataFrame) -> DataFrame:
    """``(spec_name, bin, bin_capacity, used, pieces)`` of a packing."""
    return packed.groupBy("spec_name", "bin", "bin_capacity").agg(F.sum("piece_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))


def fill(packed: DataFrame) -> DataFrame:
    """``(spec_name, bins, tokens, space, filled)`` of a packing: ``filled`` is the share of the opened space in use."""
    per = bins(packed).groupBy("spec_name").agg(F.count(F.lit(1)).alias("bins"), F.sum("used").alias("tokens"), F.sum("bin_capacity").alias("space"))
    return per.withColumn("filled", F.round(F.col("tokens") / F.col("space"), 4))


def split_texts(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(spec_name, key)`` of texts whose pieces lie in more than one bin of a packing."""
    spread = packed.groupBy("spec_name", key).agg(F.min("bin").alias("a"), F.max("bin").alias("b"), F.max("pieces").alias("n"))
    return spread.where("n > 1 AND a <> b").select("spec_name", key)


def checks(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(spec_name, texts, tokens, over, broken)`` of a packing: the texts and tokens that it holds, bins beyond their capacity, and texts whose pieces are not whole: each once, one after the other."""
    over = bins(packed).groupBy("spec_name").agg(F.count_if(F.col("used") > F.col("bin_capacity")).alias("over"))
    per = packed.groupBy("spec_name", key).agg(F.count(F.lit(1)).alias("n"), F.max("pieces").alias("pieces"), F.count_distinct("piece").alias("told"), F.sum("piece_tokens").alias("tokens"), F.max(F.col("piece_start") + F.col("piece_tokens")).alias("end"))
    texts = per.groupBy("spec_name").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"), F.count_if(F.expr("n <> pieces OR told <> pieces OR tokens <> end")).alias("broken"))
    return texts.join(over.withColumnRenamed("spec_name", "s"), F.expr("spec_name <=> s")).drop("s")
