"""Leader and follower: pushing, shedding, applying, lag, and where to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Changes in one push at most.
PUSH = 100


def shed(changes: DataFrame, room: int, policy: str = "drop_newest", batch: str = "batch_id", order: str = "delivery_id") -> DataFrame:
    """``changes`` that a queue of ``room`` keeps of each undrained batch: the first of them, or under ``drop_oldest`` the last."""
    by = F.desc(order) if policy == "drop_oldest" else F.asc(order)
    return changes.withColumn("__place", F.row_number().over(Window.partitionBy(batch).orderBy(by))).where(F.col("__place") <= max(0, room)).drop("__place")


def drops(changes: DataFrame, room: int, policy: str = "drop_newest", batch: str = "batch_id") -> DataFrame:
    """``(policy, drops)``; any policy but ``drop_oldest`` counts as ``drop_newest``."""
    name = "drop_oldest" if (policy or "").lower() == "drop_oldest" else "drop_newest"
    over = changes.groupBy(batch).agg(F.greatest(F.count(F.lit(1)) - max(0, room), F.lit(0)).alias("n"))
    return over.agg(F.lit(name).alias("policy"), F.coalesce(F.sum("n"), F.lit(0)).alias("drops"))


def pushes(numbered: DataFrame, size: int = PUSH, number: str = "n") -> DataFrame:
    """``(push, changes, lsn_from, lsn_to)`` of changes numbered from 1 without gaps."""
    push = F.floor((F.col(number) - 1) / size).alias("push")
    return numbered.groupBy(push).agg(F.count(F.lit(1)).alias("changes"), F.min("lsn").alias("lsn_from"), F.max("lsn").alias("lsn_to"))


def to_apply(changes: DataFrame, last_applied: int) -> DataFrame:
    """``(lsn, op, key)``: what a follower applies of the delivered changes, each lsn once, none that it has applied."""
    once = changes.where(F.col("lsn") > last_applied).groupBy("lsn").agg(F.min_by(F.struct(F.lower(F.trim("op")).alias("op"), "key"), "delivery_id").alias("c"))
    return once.select("lsn", "c.op", "c.key")


def log_status(starts: DataFrame, oldest: int) -> DataFrame:
    """``starts`` with ``status``: 410 where the log no longer reaches back to ``start_lsn``, else 200."""
    gone = F.lit(bool(oldest)) & (F.col("start_lsn") < oldest - 1)
    return starts.withColumn("status", F.when(gone, 410).otherwise(200))


def lag(acks: DataFrame) -> DataFrame:
    """``(stream, follower, ack_lsn, lag_lsn, last_ok_at, last_error_at, last_error)`` from the outcome of runs, repeated rows counted once.

    The latest run that ended (by ``ack_id``) tells the ack; lag is never below
    0. ``last_error`` is that run's error, empty after a success. Runs without an outcome don't count.
    """
    ended = acks.where(F.col("ok").isNotNull()).dropDuplicates(["ack_id"])
    last = ended.groupBy("stream", "follower").agg(
        F.max_by(F.struct("ack_lsn", "leader_lsn", "ok", "error"), "ack_id").alias("a"),
        F.max(F.when(F.col("ok"), F.col("finished_at"))).alias("last_ok_at"),
        F.max(F.when(~F.col("ok"), F.col("finished_at"))).alias("last_error_at"),
    )
    ack = F.greatest(F.coalesce("a.ack_lsn", F.lit(0)), F.lit(0))
    return last.select(
        "stream", "follower", ack.alias("ack_lsn"), F.greatest(F.coalesce("a.leader_lsn", F.lit(0)) - ack, F.lit(0)).alias("lag_lsn"),
        "last_ok_at", "last_error_at", F.when(F.col("a.ok"), "").otherwise(F.coalesce("a.error", F.lit(""))).alias("last_error"),
    )


def gauges(acks: DataFrame) -> DataFrame:
    """``(stream, leader_lsn)``: the highest leader position told."""
    return acks.groupBy("stream").agg(F.greatest(F.max("leader_lsn"), F.lit(0)).alias("leader_lsn"))


def staleness(known: Column, applied: Column, applied_at: Column, now: Column) -> list[Column]:
    """``lag_lsn`` and ``last_applied_age_ms``: never below 0; age 0 if nothing was applied."""
    age = F.when(applied_at.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(applied_at)) / 1e3))
    return [F.greatest(F.lit(0), known - applied).alias("lag_lsn"), age.alias("last_applied_age_ms")]


def fresh_enough(lag_lsn: Column, age_ms: Column, max_lag: int, max_age: float) -> Column:
    """Whether a copy is within both limits; a limit of 0 or less is none; what isn't told counts as 0."""
    ok = F.lit(True)
    if max_lag > 0:
        ok = ok & (F.coalesce(lag_lsn, F.lit(0)) <= max_lag)
    if max_age > 0:
        ok = ok & (F.coalesce(age_ms, F.lit(0.0)) <= max_age)
    return ok


def read_from(lags: DataFrame, followers: DataFrame, max_lag: int = 0, max_age: float = 0.0, mode: str = "auto", strategy: str = "least_lag", seed: int | None = None) -> DataFrame:
    """``(stream, follower, lag_lsn, source, fallback)``: the follower that is picked answers reads if it is fresh enough, else the leader.

    ``strategy`` random picks any follower (by ``seed``, if given), any other the
    one with least lag (ties by name). ``mode`` auto, follower or empty tries the
    follower; leader and unknown modes read from the leader and pick none.
    ``fallback`` is ``stale_or_error`` where the follower picked was refused, else
    NULL. ``followers`` are ``(stream, follower)``; one without a known lag has 0.
    ``lags`` may have ``last_applied_age_ms``, else ages count as 0.
    """
    if mode.lower() not in ("", "auto", "follower"):
        return followers.select("stream").distinct().select("stream", F.lit(None).cast("string").alias("follower"), F.lit(None).cast("long").alias("lag_lsn"), F.lit("leader").alias("source"), F.lit(None).cast("string").alias("fallback"))
    age = F.col("last_applied_age_ms") if "last_applied_age_ms" in lags.columns else F.lit(0.0)
    known = followers.select("stream", "follower").distinct().join(lags.select("stream", "follower", "lag_lsn", age.alias("age_ms")), ["stream", "follower"], "left").fillna(0, ["lag_lsn"])
    first = F.rand(seed) if strategy.lower() == "random" else F.col("lag_lsn")
    best = known.withColumn("first", first).groupBy("stream").agg(F.min(F.struct("first", "follower", "lag_lsn", "age_ms")).alias("b")).select("stream", "b.follower", "b.lag_lsn", "b.age_ms")
    fresh = fresh_enough(F.col("lag_lsn"), F.col("age_ms"), max_lag, max_age)
    return best.select("stream", "follower", "lag_lsn", F.when(fresh, "follower").otherwise("leader").alias("source"), F.when(~fresh, "stale_or_error").alias("fallback"))
