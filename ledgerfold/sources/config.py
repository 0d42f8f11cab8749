"""Settings and rate policies as rows: what is set is a table, and so is what changes it.

A setting is a row of ``(layer, name, value)``; the value that holds is the one of
the highest layer that is of the setting's kind. Layer 0 has the defaults, 1 the
environment, and later ones changes made while running, which count only for
settings that are ``live``.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators.routing import check_policy


class Setting(NamedTuple):
    name: str
    kind: str
    default: str
    live: bool = False


#: The settings of this engine and the operators that take them.
SETTINGS = (
    Setting("shards", "int", "4"),  # routing.with_shard
    Setting("capacity", "int", "1000"),  # eviction.ranked, eviction.replay
    Setting("eviction_policy", "string", "lru"),
    Setting("tier", "string", ""),  # sources.tier
    Setting("role", "string", "leader"),  # access.refused_on_follower
    Setting("queue_room", "int", "10000"),  # replication.shed
    Setting("shed_policy", "string", "drop_newest"),
    Setting("read_max_lag", "bigint", "0"),  # replication.read_from
    Setting("read_max_age_ms", "double", "0.0"),
    Setting("snapshot_seconds", "double", "0.0", live=True),  # streaming.live trigger
    Setting("rate_limit", "boolean", "false", live=True),  # ratelimit.limit
)
PREFIX = "KV_"
#: Members of a JSON object that changes rate policies: the row ``default`` in part, and rows of routes in part or ``null`` to drop them.
DEFAULT_POLICY, ROUTE_POLICIES = "default_policy", "route_policies"


def layers(spark: SparkSession, env: Mapping[str, str], changes: list[str] | None = None) -> DataFrame:
    """``(layer, name, value)`` of the defaults, of ``env`` (upper-case names after ``PREFIX``) and of ``changes``, each a JSON object; one that is none changes nothing."""
    rows = [(0, s.name, s.default) for s in SETTINGS]
    rows += [(1, s.name, env[PREFIX + s.name.upper()]) for s in SETTINGS if PREFIX + s.name.upper() in env]
    fixed = spark.createDataFrame(rows, "layer int, name string, value string")
    texts = spark.createDataFrame([(n + 2, t) for n, t in enumerate(changes or [])], "layer int, text string")
    return fixed.unionByName(texts.select("layer", F.explode(F.from_json("text", "map<string, string>")).alias("name", "value")))


def resolve(layered: DataFrame) -> DataFrame:
    """``(name, value, layer)`` of each setting: its value as text, and the layer that it comes from. Unknown names and values of another kind are passed over."""
    spark = layered.sparkSession
    known = spark.createDataFrame([(s.name, s.kind, s.live) for s in SETTINGS], "name string, kind string, live boolean")
    value = F.trim("value")
    typed = F.when(F.col("kind") == "string", F.col("value"))
    for kind in ("int", "bigint", "double", "boolean"):
        typed = F.when(F.col("kind") == kind, value.try_cast(kind).cast("string")).otherwise(typed)
    rows = layered.join(F.broadcast(known), "name").withColumn("typed", typed).where("typed IS NOT NULL AND (layer < 2 OR live)")
    return rows.groupBy("name").agg(F.max_by("typed", "layer").alias("value"), F.max("layer").alias("layer"))


def checked(settings: DataFrame) -> dict[str, str]:
    """The settings (of which there are few) on the driver; an error if there is no shard, or a policy or tier is unknown."""
    out = {r["name"]: r["value"] for r in settings.collect()}
    if int(out["shards"]) < 1:
        raise ValueError("there must be a shard")
    check_policy(out["eviction_policy"], out["tier"])
    return out


def changed_policies(policies: DataFrame, change: str) -> DataFrame:
    """Rate policies ``(route, rps, burst, per_ip)`` after a change given as JSON (see ``ROUTE_POLICIES``).

    What a route's change leaves out, or gives in another kind, comes from the row
    ``default`` as changed; without one that is no limit. Routes not named stay. Text
    that is no such object changes nothing. Objects may themselves be given as JSON text.
    """
    spark = policies.sparkSession
    said = spark.createDataFrame([(change,)], "text string").select(F.from_json("text", "map<string, string>").alias("m"))
    parts = {"rps": "double", "burst": "int", "per_ip": "boolean"}

    def of(text: str, base: str) -> list:
        given = F.from_json(text, "map<string, string>")
        return [F.coalesce(given[c].try_cast(kind), F.col(f"{base}.{c}")).alias(c) for c, kind in parts.items()]

    held = policies.where("route = 'default'").select(F.struct(*[F.col(c).cast(k).alias(c) for c, k in parts.items()]).alias("d"))
    blank = F.struct(F.lit(0.0).alias("rps"), F.lit(0).alias("burst"), F.lit(True).alias("per_ip"))
    base = said.join(held, F.lit(True), "left").limit(1).select("m", F.coalesce("d", blank).alias("d")).withColumn("text", F.col("m")[DEFAULT_POLICY])
    base = base.select("m", F.struct(*of("text", "d")).alias("d"))
    routes = base.select("d", F.explode(F.from_json(F.col("m")[ROUTE_POLICIES], "map<string, string>")).alias("route", "text"))
    new = routes.where("text IS NOT NULL").select("route", *of("text", "d"))
    kept = policies.where("route <> 'default'").join(routes.select("route"), "route", "left_anti").select("route", *[F.col(c).cast(k).alias(c) for c, k in parts.items()])
    return kept.unionByName(new).unionByName(base.select(F.lit("default").alias("route"), "d.*"))
