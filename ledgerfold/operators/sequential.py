"""Work that must follow the order of rows within a key: sorted partitions, streamed through Python with little state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def in_order(df: DataFrame, by: list[str], order: list[str], columns: list[str], make: Callable[[], Callable[[tuple], list[tuple]]], schema: str) -> DataFrame:
    """Run a stateful step over the rows of each group ``by`` in ``order``.

    ``make`` gives a fresh step for each group; a step takes a row (a tuple of
    ``columns``) and gives rows of ``schema``. Groups are streamed one after the
    other from a sorted partition, so a task holds one group's state and one
    batch of rows, never a group. Parallelism is the number of groups.
    """
    from pyspark.sql.types import StructType

    names = [x.name for x in StructType.fromDDL(schema)]
    need = list(dict.fromkeys([*by, *columns]))
    where = [need.index(c) for c in by]
    take = [need.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, step = object(), None
        for b in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in b.columns[: len(need)]], strict=True):
                own = tuple(row[i] for i in where)
                if own != group:
                    group, step = own, make()
                out += step(tuple(row[i] for i in take))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col, from_pandas=False) if any(v is not None for v in col) else pa.array(col, kinds[i]) for i, col in enumerate(zip(*out, strict=True))], names)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(b.columns, kinds, strict=True)], names)

    rows = df.select(*need, *[c for c in order if c not in need])
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(typed, schema)
