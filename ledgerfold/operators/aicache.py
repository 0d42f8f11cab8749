"""The cache of model answers: requests, keys, hits and stores as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.codec import cache_key, compress_value, decompress_value, scalar_canonical

#: Where answers are kept among the store's keys.
PREFIX = "ai:cache:"


def keyed(requests: DataFrame, params: dict[str, Column], normalize=None) -> DataFrame:
    """``requests`` (``prompt, model, model_version``) with ``canonical`` and ``cache_key``.

    ``params`` maps parameter names to columns of JSON text; ``normalize`` is any
    function from column to column that is applied to the prompt before the standard
    normaliser. A NULL prompt or model counts as empty.
    """
    prompt = F.coalesce("prompt", F.lit(""))
    canonical = scalar_canonical(normalize(prompt) if normalize else prompt, F.coalesce("model", F.lit("")), F.col("model_version"), params)
    return requests.withColumn("canonical", canonical).withColumn("cache_key", cache_key(F.col("canonical")))


def stores(answers: DataFrame, order: str, compress: bool = False) -> DataFrame:
    """``(key, value)`` of the store after answers (``cache_key, value``) were kept: the last one of each key by ``order``."""
    last = answers.groupBy("cache_key").agg(F.max_by("value", order).alias("value"))
    return last.select(F.concat(F.lit(PREFIX), "cache_key").alias("key"), (compress_value(F.col("value")) if compress else F.col("value")).alias("value"))


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests`` (with ``cache_key``) with ``hit`` and the ``answer``, decompressed; NULL on a miss.

    The cache has each key once, so rows are not multiplied; a request that very many ask is skew on one side only, which adaptive execution splits.
    """
    known = cache.where(F.col("key").startswith(PREFIX)).select(F.substring("key", len(PREFIX) + 1, 64).alias("cache_key"), F.col("value").alias("__value"), F.lit(True).alias("__hit"))
    joined = requests.join(known, "cache_key", "left")
    return joined.withColumn("hit", F.coalesce("__hit", F.lit(False))).withColumn("answer", decompress_value(F.col("__value"))).drop("__value", "__hit")
