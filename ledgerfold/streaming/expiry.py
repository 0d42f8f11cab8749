"""Expiry as a stateful stream: a key's expire event comes when event time passes it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "op string, key string, at timestamp"
_HELD = "until double"


def _step(key: tuple, rows: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    if held.hasTimedOut:
        until = held.get[0]
        held.remove()
        yield pd.DataFrame({"op": ["expire"], "key": [key[0]], "at": [pd.Timestamp(until, unit="s")]})
        return
    until = held.get[0] if held.exists else None
    gone: list[float] = []
    for part in rows:
        for r in part.sort_values("lsn").itertuples(index=False):
            now = r.at.timestamp()
            if until is not None and until <= now:
                gone.append(until)
                until = None
            if r.op == "delete":
                until = None
            elif pd.notna(r.ttl):
                until = now + float(r.ttl)
            elif r.op in ("create", "mset"):
                until = None
    if until is None:
        if held.exists:
            held.remove()
    else:
        held.update((until,))
        held.setTimeoutTimestamp(max(int(until * 1000), held.getCurrentWatermarkMs() + 1))
    if gone:
        yield pd.DataFrame({"op": ["expire"] * len(gone), "key": [key[0]] * len(gone), "at": [pd.Timestamp(t, unit="s") for t in gone]})


def expire_events(writes: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """A stream of ``(op, key, at)`` from a stream of accepted writes ``(lsn, at, op, key, ttl)``.

    State is one number per key that will expire and is dropped with it. ``at``
    is the event time; rows later than ``delay`` behind the newest are dropped by the watermark.
    """
    rows = writes.select("lsn", F.col("at").cast("timestamp").alias("at"), "op", "key", F.col("ttl").cast("double").alias("ttl")).withWatermark("at", delay)
    return rows.groupBy("key").applyInPandasWithState(_step, _OUT, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def keyspace_stream(changes: DataFrame) -> DataFrame:
    """A stream of ``(op, key, lsn)`` from a stream of accepted changes; stateless."""
    kind = F.when(F.lower(F.trim("op")) == "delete", "del").otherwise("set")
    return changes.where(F.lower(F.trim("op")).isin("create", "update", "delete", "mset", "incr", "put")).select(kind.alias("op"), "key", "lsn")
