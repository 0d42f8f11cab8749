"""Counters, latency histograms and percentiles over a request log, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets in milliseconds; fixed values.
BUCKETS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)


def requests(log: DataFrame) -> DataFrame:
    """``(method, requests, errors)`` per method, spelled in upper case, and in total (``method`` is ``ALL``)."""
    rows = log.select(F.upper(F.trim("method")).alias("method"), F.coalesce(F.col("error"), F.lit(False)).cast("long").alias("e"))
    both = rows.rollup("method").agg(F.count(F.lit(1)).alias("requests"), F.sum("e").alias("errors"), F.grouping("method").alias("g"))
    return both.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("method")).alias("method"), "requests", F.coalesce("errors", F.lit(0)).alias("errors"))


def bucket(ms: Column) -> Column:
    """Name of the bucket of a time: the first bound that it doesn't exceed, or ``inf``; negative times are 0, NULL is in none."""
    out = F.when(ms.isNull(), F.lit(None).cast("string"))
    for b in BUCKETS:
        out = out.when(F.greatest(ms, F.lit(0.0)) <= b, str(b))
    return out.otherwise("inf")


def latency(log: DataFrame) -> DataFrame:
    """``(route, n, sum_ms)`` per route; negative times count as 0, rows without a time or route not at all."""
    rows = log.where("elapsed_ms IS NOT NULL AND route IS NOT NULL")
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.greatest("elapsed_ms", F.lit(0.0))), 6).alias("sum_ms"))


def latency_buckets(log: DataFrame) -> DataFrame:
    """``(route, le, n)``: requests per bucket, each in one bucket."""
    rows = log.where("elapsed_ms IS NOT NULL AND route IS NOT NULL").select("route", bucket(F.col("elapsed_ms")).alias("le"))
    return rows.groupBy("route", "le").agg(F.count(F.lit(1)).alias("n"))


def latency_cumulative(log: DataFrame) -> DataFrame:
    """``(route, le, n)``: requests up to each bound that occurs, and ``+Inf`` always."""
    counts = latency_buckets(log).withColumn("bound", F.when(F.col("le") == "inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double")))
    ends = counts.groupBy("route").agg(F.lit("inf").alias("le"), F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("bound"))
    all_bounds = counts.unionByName(ends).groupBy("route", "le", "bound").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("route").orderBy("bound").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return all_bounds.select("route", F.when(F.col("le") == "inf", "+Inf").otherwise(F.col("le")).alias("le"), F.sum("n").over(upto).alias("n"))


def rank_values(rows: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """``(group, name, value)``: values at 0-based ranks in ascending order; ``ranks`` are expressions of the group's count ``n``.

    A coarse histogram tells which cell holds each rank; only rows of those cells
    are ordered. Cells are 1/64 of a doubling, so they stay small unless values are equal, and
    equal values are counted, not ordered.
    """
    x = F.col(value)
    counted = rows.where(x.isNotNull() & ~F.isnan(x)).groupBy(F.col(group).alias("g"), x.alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("cell", F.when(F.col("v") <= 0, F.lit(-100000)).otherwise(F.floor(F.log2("v") * 64)).cast("int"))
    cells = counted.groupBy("g", "cell").agg(F.sum("c").alias("c"))
    sizes = cells.groupBy("g").agg(F.sum("c").alias("n"))
    wanted = sizes.select("g", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])).alias("r")).select("g", "r.*")
    before = Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
    hit = wanted.join(starts, "g").where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("c"))).select("g", "cell", "name", "rank", "start")
    inside = Window.partitionBy("g", "cell").orderBy("v")
    upto = counted.join(hit.select("g", "cell").distinct(), ["g", "cell"], "left_semi").withColumn("upto", F.sum("c").over(inside))
    found = upto.join(hit, ["g", "cell"]).where((F.col("rank") < F.col("start") + F.col("upto")) & (F.col("rank") >= F.col("start") + F.col("upto") - F.col("c")))
    return found.select(F.col("g").alias(group), "name", F.col("v").alias("value"))


def percentiles(log: DataFrame) -> DataFrame:
    """``(route, p50, p95, p99)``: the median, and the values at rank ``floor(n q)``."""
    n = F.col("n")
    ranks = {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "p95": F.floor(n * 0.95), "p99": F.floor(n * 0.99)}
    v = rank_values(log.where("route IS NOT NULL"), "route", "elapsed_ms", ranks)
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    return v.groupBy("route").agg(((at("low") + at("high")) / 2).alias("p50"), at("p95").alias("p95"), at("p99").alias("p99"))


def throughput(log: DataFrame) -> DataFrame:
    """``(requests, seconds, qps)`` over the span of the log; NULL rate for a span of 0."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return log.agg(F.count(F.lit(1)).alias("requests"), span.alias("seconds")).withColumn("qps", F.round(F.try_divide("requests", "seconds"), 6))


def cache_counts(lookups: DataFrame, stores: DataFrame) -> DataFrame:
    """``(lookups, hits, misses, stores)`` from lookups with a ``hit`` flag and the stored rows."""
    both = lookups.select("hit", F.lit(False).alias("stored")).unionByName(stores.select(F.lit(None).cast("boolean").alias("hit"), F.lit(True).alias("stored")))
    return both.agg(F.count_if(~F.col("stored")).alias("lookups"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_if("stored").alias("stores"))


def label(text: Column) -> Column:
    """A label's value with its quotes escaped."""
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def exposition(log: DataFrame, prefix: str = "kv") -> DataFrame:
    """``(line)``: the metrics of a request log in the text form that scrapers read, in no order; ``prefix`` names the service."""
    total = requests(log)
    one = total.where("method = 'ALL'").select(F.explode(F.array(F.format_string(f"{prefix}_requests_total %d", "requests"), F.format_string(f"{prefix}_errors_total %d", "errors"))).alias("line"))
    methods = total.where("method <> 'ALL'").select(F.format_string(f'{prefix}_requests_by_method_total{{method="%s"}} %d', "method", "requests").alias("line"))
    route = label(F.col("route"))
    cum = latency_cumulative(log).select(F.format_string(f'{prefix}_request_latency_ms_bucket{{route="%s",le="%s"}} %d', route, "le", "n").alias("line"))
    count = latency(log).select(F.format_string(f'{prefix}_request_latency_ms_count{{route="%s"}} %d', route, "n").alias("line"))
    return one.unionByName(methods).unionByName(cum).unionByName(count)
