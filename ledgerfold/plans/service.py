"""Queries of the store's services: metrics, answer cache, replication, durability, access and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerfold.functions import codec, text
from ledgerfold.operators import access, aicache, cdc, metrics, ratelimit, reads, replication, routing
from ledgerfold.plans.problems import _REPLAY
from ledgerfold.plans.store import CRC, FOLD, LOG, NOW, SHARDS, SNAP, _routed, now, snapshot
from ledgerfold.runtime import work_dir
from ledgerfold.sources import config
from ledgerfold.sources.oplog import numbered
from ledgerfold.sources.snapshot import Snapshots, from_lines, to_lines
from ledgerfold.sources.tables import plain_op, table
from ledgerfold.sources.tier import ColdTier, as_objects
from ledgerfold.sources.wal import Log
from ledgerfold.streaming import live

ROOM = 30
LOG_FROM = 3000
ENV = {"KV_SHARDS": str(SHARDS), "KV_CAPACITY": "many"}
CHANGES = ['{"rate_limit": "TRUE", "shards": 3, "snapshot_seconds": "7"}', "no object", '{"snapshot_seconds": "soon"}']
POLICY_CHANGE = '{"default_policy": {"rps": "2.5"}, "route_policies": {"/kv/scan": {"burst": 3}, "/new": {}, "/healthz": null}}'
SECRETS = {"admin": ["Customer#000000003"], "writer": ["Customer#000000002", ""], "reader": ["Customer#000000001"]}


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """The request log with repeated rows counted once."""
    return table(spark, folder, "request_log").distinct()


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", "translated", F.col("applicant").alias("prompt"), F.col("lang").alias("model"), F.lit(None).cast("string").alias("model_version"), F.col("text").alias("value"))
    return aicache.keyed(rows, {"temperature": F.lit("0.5"), "top_k": F.lit("40")})


def _lookups(spark: SparkSession, folder: str) -> DataFrame:
    asked = _asked(spark, folder)
    cache = aicache.stores(asked.where("translated"), "doc_id", compress=True)
    return aicache.lookup(asked.drop("value"), cache)


def _cache_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.cache_counts(_lookups(spark, folder), _asked(spark, folder).where("translated"))


def _codec(spark: SparkSession, folder: str) -> DataFrame:
    """Each text through compression and back: whether it was compressed and came back whole."""
    small = codec.compress_value(F.col("text"))
    rows = table(spark, folder, "documents").select("doc_id", "text", small.alias("small"))
    return rows.select("doc_id", F.coalesce(F.col("small").startswith(codec.MARK), F.lit(False)).alias("compressed"), F.col("text").eqNullSafe(codec.decompress_value(F.col("small"))).alias("whole"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The change feed as the leader logged it: each lsn once, as first delivered."""
    body = F.struct("ts", plain_op(F.col("op")).alias("op"), "key", "value", "delta", "ttl")
    once = table(spark, folder, "ops").where("lsn > 0").groupBy("lsn").agg(F.min_by(body, F.col("delivery_id")).alias("c"))
    return once.select("lsn", "c.*")


def _log(spark: SparkSession, folder: str) -> Log:
    log = Log(spark, work_dir(spark, "wal"))
    log.append(entries(spark, folder))
    return log


def _rotated(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    log.rotate(LOG_FROM)
    return log.entries().select("lsn", "op", "key")


def _log_ends(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    log.rotate(LOG_FROM)
    return spark.createDataFrame([(log.oldest(), log.last())], "oldest_lsn long, last_lsn long")


def _recovered(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot and log written and read again, then folded: what a restart gives."""
    kept = snapshot(spark, folder)
    start = kept.agg(F.max("snapshot_lsn")).first()[0] or 0
    shots = Snapshots(spark, work_dir(spark, "snapshots"))
    shots.save(kept, start)
    lsn, state = shots.load()
    tail = _log(spark, folder).entries(lsn).withColumn("delivery_id", F.col("lsn"))
    return cdc.replay(state.withColumn("snapshot_lsn", F.lit(lsn).cast("long")), tail).select("key", "lsn")


def _saved(spark: SparkSession, folder: str) -> DataFrame:
    shots = Snapshots(spark, work_dir(spark, "snapshots"))
    shots.save(snapshot(spark, folder), 0)
    return shots.load(SHARDS)[1].select("shard", "key", "value", F.unix_millis("expire_at").alias("expire_ms"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    path = work_dir(spark, "lines")
    to_lines(reads.dump(snapshot(spark, folder), now())).write.text(path, compression="gzip")
    return from_lines(spark.read.text(path)).select("shard", "key", "value", F.round("ttl", 3).alias("ttl"))


def _cold(spark: SparkSession, folder: str) -> DataFrame:
    """Every key put into the cold tier with a minute more than it has, and asked for half a minute later."""
    tier = ColdTier(spark, work_dir(spark, "tier"))
    at = F.unix_micros(now()) / 1e6
    left = (F.unix_micros("expire_at") - F.unix_micros(now())) / 1e6 + 60
    rows = snapshot(spark, folder).select("key", "value", F.when(F.col("expire_at").isNotNull(), left).alias("ttl"))
    tier.put(rows, at)
    return tier.get(rows, at + 30).select("key", "value", F.round("ttl_remaining", 3).alias("ttl"))


def _pushes(spark: SparkSession, folder: str) -> DataFrame:
    return replication.pushes(numbered(entries(spark, folder).select("lsn"), ["lsn"], "n"))


def _shed(policy: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return replication.shed(table(spark, folder, "ops"), ROOM, policy).select("delivery_id")

    return query


def _drops(spark: SparkSession, folder: str) -> DataFrame:
    ops = table(spark, folder, "ops")
    return replication.drops(ops, ROOM).unionByName(replication.drops(ops, ROOM, "drop_oldest"))


def _status(spark: SparkSession, folder: str) -> DataFrame:
    starts = table(spark, folder, "follower_ack").where("stream = 'ops'").select(F.col("ack_lsn").alias("start_lsn")).distinct()
    return replication.log_status(starts, LOG_FROM)


def _object_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Checksum and object id of every key of the snapshot, expired or not."""
    keys = table(spark, folder, "state_snapshot").select("key", F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("ttl")).distinct()
    return as_objects(keys, F.lit(0.0)).select("key", routing.key_hash(F.col("key")).alias("crc"), "object_id")


def _source(spark: SparkSession, folder: str) -> DataFrame:
    acks = table(spark, folder, "follower_ack")
    return replication.read_from(replication.lag(acks), acks, 100).drop("fallback")


def _fresh(spark: SparkSession, folder: str) -> DataFrame:
    lag = replication.lag(table(spark, folder, "follower_ack"))
    return lag.select("stream", "follower", replication.fresh_enough(F.col("lag_lsn"), F.lit(0.0), 50, 0.0).alias("fresh"))


def _stale(spark: SparkSession, folder: str) -> DataFrame:
    lag = replication.lag(table(spark, folder, "follower_ack"))
    known = replication.staleness(F.col("ack_lsn") + F.col("lag_lsn"), F.col("ack_lsn"), F.col("last_ok_at").cast("timestamp"), now())
    return lag.select("stream", "follower", *known)


def _expired_events(spark: SparkSession, folder: str) -> DataFrame:
    gone = reads.expired(snapshot(spark, folder), now())
    return gone.select(F.lit("expire").alias("op"), "key", F.col("snapshot_lsn").alias("lsn"), "shard")


def _sse(spark: SparkSession, folder: str) -> DataFrame:
    body = F.to_json(F.struct("op", "key", "lsn", "shard"), {"ignoreNullFields": "false"})
    return table(spark, folder, "keyspace_event").select("delivery_id", F.concat(F.lit("event: keyspace\ndata: "), body, F.lit("\n\n")).alias("chunk"))


def _kinds(spark: SparkSession, folder: str) -> DataFrame:
    """JSON kind of each value, or ``raw`` for a body that is no JSON."""
    kind = F.expr("schema_of_variant(try_parse_json(value))")
    kind = F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind.isNull(), "raw").otherwise("number")
    return table(spark, folder, "ops").where("value IS NOT NULL").select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _policies(spark: SparkSession, folder: str) -> DataFrame:
    return ratelimit.policies(requests(spark, folder), table(spark, folder, "rate_policy")).select("request_id", "ts", "elapsed_ms", "rps", "burst", "per_ip")


def _limited(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as fifty clients would make them, so that buckets per client and per route both run."""
    rows = requests(spark, folder).withColumn("client", F.concat(F.lit("10.0.0."), F.col("request_id") % 50))
    return ratelimit.limit(rows, table(spark, folder, "rate_policy"))


def _auth(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as customers would make them: one in three each with a token, a basic password and a header of its own."""
    name, n = F.col("c_name"), F.col("c_custkey") % 3
    rows = table(spark, folder, "customer").select(
        "c_custkey", F.when(n == 0, F.concat(F.lit("Bearer "), name)).when(n == 1, F.concat(F.lit("Basic "), F.base64(F.concat(F.lit("user:"), name).cast("binary")))).alias("authorization"),
        F.when(n == 2, name).alias("token"), F.lit(None).cast("string").alias("password"), F.lit("writer").alias("required"),
    )
    return access.authorize(rows, SECRETS).select("c_custkey", "role", "status")


def _roles(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("signup", "SET", "view", "GET", "click", "incr", "purchase", "CONFIG", "error", "DEL")])[F.col("event_type")]
    rows = table(spark, folder, "events").select(kind.alias("command"), access.required_role(kind).alias("role"), access.refused_on_follower(kind, True).alias("read_only"))
    return rows.groupBy("command", "role", "read_only").agg(F.count(F.lit(1)).alias("n"))


def _full_sync(spark: SparkSession, folder: str) -> DataFrame:
    """What a follower holds after a full sync by the line stream: expiry counted on from then, keys routed by its own shards."""
    path = work_dir(spark, "sync")
    to_lines(reads.dump(snapshot(spark, folder), now())).write.text(path, compression="gzip")
    state = reads.load(from_lines(spark.read.text(path)), now())
    return routing.with_shard(state, 4).select("key", "value", F.unix_millis("expire_at").alias("expire_ms"))


def _log_replies(spark: SparkSession, folder: str) -> DataFrame:
    """For each position that a follower asks from, the status and how many entries it gets."""
    log = _log(spark, folder)
    log.rotate(LOG_FROM)
    starts = replication.log_status(table(spark, folder, "follower_ack").where("stream = 'ops'").select(F.col("ack_lsn").alias("start_lsn")).distinct(), log.oldest())
    # counts from each position on: sums from the end over positions and entries in blocks of lsn
    both = starts.select(F.col("start_lsn").alias("at"), "status").unionByName(log.entries().select(F.col("lsn").alias("at"), F.lit(None).cast("int").alias("status")))
    block = F.shiftright("at", 16)
    sums = both.groupBy(block.alias("block")).agg(F.count_if(F.col("status").isNull()).alias("n"))
    later = sums.select("block", (F.sum("n").over(Window.orderBy(F.desc("block"))) - F.col("n")).alias("later"))  # one row per block
    inside = F.count_if(F.col("status").isNull()).over(Window.partitionBy("block").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1))
    rows = both.withColumn("block", block).withColumn("inside", inside).where("status IS NOT NULL").join(later, "block")
    return rows.select(F.col("at").alias("start_lsn"), "status", F.when(F.col("status") == 200, F.col("inside") + F.col("later")).otherwise(0).alias("changes"))


def _streamed(spark: SparkSession, folder: str) -> DataFrame:
    return live.drain(spark, folder).select("key", F.round("value", 6).alias("value"), "lsn")


def _info(spark: SparkSession) -> DataFrame:
    held = config.resolve(config.layers(spark, ENV)).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("shards", "role")])
    return held.select(F.lit("ok").alias("status"), F.col("shards").cast("int").alias("shards"), "role")


QUERIES = {
    "mt01_requests": lambda s, f: metrics.requests(requests(s, f)),
    "mt02_latency": lambda s, f: metrics.latency(requests(s, f)),
    "mt02_latency_buckets": lambda s, f: metrics.latency_buckets(requests(s, f)),
    "mt03_ai_cache": _cache_counts,
    "mt04_lag": lambda s, f: replication.lag(table(s, f, "follower_ack")).select("stream", "follower", "ack_lsn", "lag_lsn", "last_error"),
    "mt05_gauges": lambda s, f: replication.gauges(table(s, f, "follower_ack")),
    "mt06_drops": _drops,
    "mt07_cumulative": lambda s, f: metrics.latency_cumulative(requests(s, f)),
    "mt07_exposition": lambda s, f: metrics.exposition(requests(s, f)),
    "mt08_staleness": _stale,
    "mt09_percentiles": lambda s, f: metrics.percentiles(requests(s, f)),
    "mt10_throughput": lambda s, f: metrics.throughput(requests(s, f)),
    "mt11_info": lambda s, f: _info(s),
    "jn02_lookup": lambda s, f: _lookups(s, f).select("doc_id", "hit"),
    "jn05_read_source": _source,
    "jn06_policy": _policies,
    "sc01_normalize": lambda s, f: table(s, f, "documents").select("doc_id", text.normalize_prompt(F.col("applicant")).alias("prompt")),
    "sc02_own_normalizer": lambda s, f: aicache.keyed(table(s, f, "documents").select("doc_id", F.col("applicant").alias("prompt"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("model_version")), {}, lambda c: F.regexp_replace(c, "[.&]", " ")).select("doc_id", "cache_key"),
    "sc03_cache_key": lambda s, f: _asked(s, f).select("doc_id", "cache_key"),
    "sc04_codec": _codec,
    "sc06_object_id": lambda s, f: table(s, f, "nation").select("n_name", F.crc32(F.col("n_name").cast("binary")).alias("crc"), F.sha2("n_name", 256).alias("sha")),
    "sc06_object_keys": _object_keys,
    "sc07_base64": lambda s, f: table(s, f, "documents").select("doc_id", text.base64_text(F.col("text").cast("binary")).alias("b64")),
    "sc08_number": lambda s, f: table(s, f, "ops").select("delivery_id", text.json_as_number(F.col("value")).alias("num")),
    "sc11_ttl": lambda s, f: table(s, f, "part").select("p_partkey", text.ttl_seconds(F.when(F.col("p_size") % 3 == 0, "EX").when(F.col("p_size") % 3 == 1, "px").otherwise("NX"), F.col("p_size").cast("string")).alias("seconds")),
    "sc12_secrets": lambda s, f: table(s, f, "customer").select("c_custkey", text.bearer_token(F.concat(F.lit("bearer  "), "c_name")).alias("token"), text.basic_password(F.concat(F.lit("Basic "), F.base64(F.concat(F.lit("a:b:"), "c_name").cast("binary")))).alias("password")),
    "sc13_role_rank": lambda s, f: table(s, f, "part").select(F.element_at(F.array(*map(F.lit, ("admin", "writer", "reader", "guest"))), (F.col("p_size") % 4 + 1).cast("int")).alias("role")).select("role", text.role_rank(F.col("role")).alias("rank")).distinct(),
    "io01_log_ends": _log_ends,
    "io02_append": lambda s, f: numbered(table(s, f, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "lsn"),
    "io03_entries": lambda s, f: _log(s, f).entries(LOG_FROM).select("lsn", "op", "key", "value", "delta", "ttl", F.unix_micros("ts").alias("ts_us")),
    "io05_rotate": _rotated,
    "io06_recover": _recovered,
    "io07_snapshot": _saved,
    "io10_lines": _lines,
    "io12_cold_tier": _cold,
    "io16_bodies": _kinds,
    "io18_event_stream": _sse,
    "io19_config": lambda s, f: config.resolve(config.layers(s, ENV, CHANGES)),
    "cf01_policies": lambda s, f: config.changed_policies(table(s, f, "rate_policy"), POLICY_CHANGE),
    "st02_shed": _shed("drop_newest"),
    "st02_shed_oldest": _shed("drop_oldest"),
    "st03_pushes": _pushes,
    "st04_catch_up": _streamed,
    "st05_full_sync": _full_sync,
    "st06_apply": lambda s, f: replication.to_apply(table(s, f, "ops"), LOG_FROM),
    "st07_log_status": _status,
    "st10_expirer": _expired_events,
    "st12_fresh": _fresh,
    "st13_read_only": _roles,
    "st15_rate_limit": _limited,
    "ac01_role": lambda s, f: table(s, f, "customer").select("c_custkey", access.role_of(F.col("c_name"), SECRETS).alias("role")),
    "ac02_authorize": _auth,
    "h11_ai_values": lambda s, f: snapshot(s, f).where(F.col("key").startswith(aicache.PREFIX)).select(F.substring("key", len(aicache.PREFIX) + 1, 64).alias("cache_key"), "value"),
    "h14_log": _log_replies,
}

_LAG = """lag AS (SELECT stream, follower, greatest(coalesce(arg_max(ack_lsn, ack_id), 0), 0) AS ack, arg_max(leader_lsn, ack_id) AS leader, arg_max(ok, ack_id) AS ok, arg_max(coalesce(error, ''), ack_id) AS error,
    max(CASE WHEN ok THEN finished_at END) AS ok_at FROM follower_ack WHERE ok IS NOT NULL GROUP BY stream, follower)"""
_REQ = "req AS (SELECT DISTINCT * FROM request_log)"
_LE = "CASE " + " ".join(f"WHEN elapsed_ms <= {b} THEN '{b}'" for b in metrics.BUCKETS) + " ELSE 'inf' END"
_BUCKETS = f"{_REQ}, b AS (SELECT route, {_LE} AS le, count(*) AS n FROM req WHERE elapsed_ms IS NOT NULL AND route IS NOT NULL GROUP BY ALL)"
_CUM = f"""{_BUCKETS}, c AS (SELECT route, le, sum(n) AS n FROM (SELECT * FROM b UNION ALL SELECT DISTINCT route, 'inf', 0 FROM b) GROUP BY ALL),
    cum AS (SELECT route, CASE le WHEN 'inf' THEN '+Inf' ELSE le END AS le, CAST(sum(n) OVER (PARTITION BY route ORDER BY CAST(le AS DOUBLE)) AS BIGINT) AS n FROM c)"""
_NORMAL = r"trim(regexp_replace(lower({c}), '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
_CANON = "concat('{{\"model\": ', to_json(coalesce({m}, '')), ', \"model_version\": null, \"params\": {{{p}}}, \"prompt\": ', to_json({n}), '}}')"
_PROMPT = _NORMAL.format(c="coalesce(applicant, '')")
_KEY = "sha256(" + _CANON.format(m="lang", p='"temperature": 0.5, "top_k": 40', n=_PROMPT) + ")"
_ENTRY = """entry AS (SELECT lsn, arg_min(struct_pack(ts := ts, op := lower(trim(op)), key := key, value := value, delta := delta, ttl := ttl), delivery_id) AS c FROM ops WHERE lsn > 0 GROUP BY lsn)"""
_LEFT = f"(epoch_us(expire_at) - epoch_us(TIMESTAMP '{NOW}')) / 1e6"
_ROLE = "CASE c_name WHEN 'Customer#000000003' THEN 'admin' WHEN 'Customer#000000002' THEN 'writer' WHEN 'Customer#000000001' THEN 'reader' END"

ORACLE = {
    "mt01_requests": f"WITH {_REQ} SELECT CASE WHEN grouping(upper(trim(method))) = 1 THEN 'ALL' ELSE upper(trim(method)) END AS method, count(*) AS requests, CAST(sum(CASE WHEN error THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM req GROUP BY ROLLUP (upper(trim(method)))",
    "mt02_latency": f"WITH {_REQ} SELECT route, count(*) AS n, round(sum(greatest(elapsed_ms, 0)), 6) AS sum_ms FROM req WHERE elapsed_ms IS NOT NULL AND route IS NOT NULL GROUP BY route",
    "mt02_latency_buckets": f"WITH {_BUCKETS} SELECT * FROM b",
    "mt03_ai_cache": f"WITH k AS (SELECT {_KEY} AS k, translated FROM documents), h AS (SELECT k IN (SELECT k FROM k WHERE translated) AS hit FROM k) SELECT count(*) AS lookups, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, (SELECT count(*) FROM k WHERE translated) AS stores FROM h",
    "mt04_lag": f"WITH {_LAG} SELECT stream, follower, ack AS ack_lsn, greatest(coalesce(leader, 0) - ack, 0) AS lag_lsn, CASE WHEN ok THEN '' ELSE error END AS last_error FROM lag",
    "mt05_gauges": "SELECT stream, greatest(max(leader_lsn), 0) AS leader_lsn FROM follower_ack GROUP BY stream",
    "mt06_drops": f"WITH o AS (SELECT CAST(sum(greatest(n - {ROOM}, 0)) AS BIGINT) AS d FROM (SELECT count(*) AS n FROM ops GROUP BY batch_id)) SELECT unnest(['drop_newest', 'drop_oldest']) AS policy, d AS drops FROM o",
    "mt07_cumulative": f"WITH {_CUM} SELECT * FROM cum",
    "mt07_exposition": f"""WITH {_CUM}, m AS (SELECT upper(trim(method)) AS method, count(*) AS n, sum(CASE WHEN error THEN 1 ELSE 0 END) AS e FROM req GROUP BY 1)
        SELECT concat('kv_requests_total ', count(*)) AS line FROM req UNION ALL SELECT concat('kv_errors_total ', CAST(sum(e) AS BIGINT)) FROM m UNION ALL SELECT concat('kv_requests_by_method_total{{method="', method, '"}} ', n) FROM m WHERE method IS NOT NULL
        UNION ALL SELECT concat('kv_request_latency_ms_bucket{{route="', route, '",le="', le, '"}} ', n) FROM cum UNION ALL SELECT concat('kv_request_latency_ms_count{{route="', route, '"}} ', n) FROM cum WHERE le = '+Inf'""".replace("{{", "{").replace("}}", "}"),
    "mt08_staleness": f"WITH {_LAG} SELECT stream, follower, greatest(coalesce(leader, 0) - ack, 0) AS lag_lsn, CASE WHEN ok_at IS NULL THEN 0.0 ELSE greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ok_at)) / 1e3) END AS last_applied_age_ms FROM lag",
    "mt09_percentiles": f"""WITH {_REQ}, s AS (SELECT route, list(elapsed_ms ORDER BY elapsed_ms) AS v, count(*) AS n FROM req WHERE elapsed_ms IS NOT NULL AND route IS NOT NULL GROUP BY route)
        SELECT route, (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2 AS p50, v[CAST(floor(n * 0.95) AS INTEGER) + 1] AS p95, v[CAST(floor(n * 0.99) AS INTEGER) + 1] AS p99 FROM s""",
    "mt10_throughput": f"WITH {_REQ} SELECT count(*) AS requests, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS qps FROM req",
    "mt11_info": f"SELECT 'ok' AS status, {SHARDS} AS shards, 'leader' AS role",
    "jn02_lookup": f"WITH k AS (SELECT doc_id, {_KEY} AS k, translated FROM documents) SELECT doc_id, k IN (SELECT k FROM k WHERE translated) AS hit FROM k",
    "jn05_read_source": f"""WITH {_LAG}, known AS (SELECT f.stream, f.follower, coalesce(greatest(coalesce(leader, 0) - ack, 0), 0) AS lag_lsn FROM (SELECT DISTINCT stream, follower FROM follower_ack) f LEFT JOIN lag USING (stream, follower))
        SELECT stream, follower, lag_lsn, CASE WHEN lag_lsn <= 100 THEN 'follower' ELSE 'leader' END AS source FROM known QUALIFY row_number() OVER (PARTITION BY stream ORDER BY lag_lsn, follower) = 1""",
    "jn06_policy": f"WITH {_REQ} SELECT request_id, ts, elapsed_ms, coalesce(p.rps, d.rps) AS rps, coalesce(p.burst, d.burst) AS burst, coalesce(p.per_ip, d.per_ip) AS per_ip FROM req JOIN (SELECT * FROM rate_policy WHERE route = 'default') d ON true LEFT JOIN rate_policy p ON p.route = req.route AND p.route <> 'default'",
    "sc01_normalize": f"SELECT doc_id, {_NORMAL.format(c='applicant')} AS prompt FROM documents",
    "sc02_own_normalizer": "SELECT doc_id, sha256(" + _CANON.format(m="'m'", p="", n=_NORMAL.format(c="regexp_replace(coalesce(applicant, ''), '[.&]', ' ', 'g')")) + ") AS cache_key FROM documents",
    "sc03_cache_key": f"SELECT doc_id, {_KEY} AS cache_key FROM documents",
    "sc04_codec": "SELECT doc_id, coalesce(length(text) >= 1024, false) AS compressed, true AS whole FROM documents",
    "sc06_object_id": f"WITH hashed AS (SELECT n_name AS k, 0 AS shard FROM nation), {CRC} SELECT k AS n_name, h AS crc, sha256(k) AS sha FROM crc",
    "sc06_object_keys": f"WITH {_routed(1, 'SELECT key FROM state_snapshot')} SELECT a.key, c.h AS crc, sha256(a.key) AS object_id FROM asked a JOIN crc c ON c.k = a.material AND c.shard < 0",
    "sc07_base64": "SELECT doc_id, base64(encode(text)) AS b64 FROM documents",
    "sc08_number": r"""SELECT delivery_id, try_cast(CASE WHEN regexp_full_match(value, '\s*-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*') THEN value WHEN regexp_full_match(value, '"\s*[0-9.eE+_-]+\s*"') THEN trim(value, '" ') END AS DOUBLE) AS num FROM ops""",
    "sc11_ttl": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size / 1000.0 END AS seconds FROM part",
    "sc12_secrets": "SELECT c_custkey, c_name AS token, concat('b:', c_name) AS password FROM customer",
    "sc13_role_rank": "SELECT DISTINCT (['admin', 'writer', 'reader', 'guest'])[p_size % 4 + 1] AS role, ([3, 2, 1, 0])[p_size % 4 + 1] AS rank FROM part",
    "io01_log_ends": f"WITH {_ENTRY} SELECT CAST({LOG_FROM + 1} AS BIGINT) AS oldest_lsn, max(lsn) AS last_lsn FROM entry",
    "io02_append": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS lsn FROM orders",
    "io03_entries": f"WITH {_ENTRY} SELECT lsn, c.op AS op, c.key AS key, c.value AS value, c.delta AS delta, c.ttl AS ttl, epoch_us(c.ts) AS ts_us FROM entry WHERE lsn > {LOG_FROM}",
    "io05_rotate": f"WITH {_ENTRY} SELECT lsn, c.op AS op, c.key AS key FROM entry WHERE lsn > {LOG_FROM}",
    "io06_recover": f"WITH {_REPLAY} SELECT key, lsn FROM live WHERE alive = 1",
    "io07_snapshot": f"WITH {SNAP} SELECT shard, key, value, epoch_ms(expire_at) AS expire_ms FROM snap",
    "io10_lines": f"WITH {SNAP} SELECT shard, key, value, round({_LEFT}, 3) AS ttl FROM snap WHERE expire_at IS NULL OR expire_at > TIMESTAMP '{NOW}'",
    "io12_cold_tier": f"WITH {SNAP} SELECT key, value, round({_LEFT} + 30, 3) AS ttl FROM snap WHERE expire_at IS NULL OR {_LEFT} + 30 > 0",
    "io16_bodies": "SELECT CASE WHEN NOT json_valid(value) THEN 'raw' ELSE CASE json_type(CASE WHEN json_valid(value) THEN value END) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END END AS kind, count(*) AS n FROM ops WHERE value IS NOT NULL GROUP BY 1",
    "io18_event_stream": "SELECT delivery_id, concat('event: keyspace', chr(10), 'data: {\"op\":', to_json(op), ',\"key\":', to_json(key), ',\"lsn\":', lsn, ',\"shard\":', coalesce(CAST(shard AS VARCHAR), 'null'), '}', chr(10), chr(10)) AS chunk FROM keyspace_event",
    "io19_config": f"""SELECT * FROM (VALUES ('shards', '{SHARDS}', 1), ('capacity', '1000', 0), ('eviction_policy', 'lru', 0), ('tier', '', 0), ('role', 'leader', 0), ('queue_room', '10000', 0), ('shed_policy', 'drop_newest', 0),
        ('read_max_lag', '0', 0), ('read_max_age_ms', '0.0', 0), ('snapshot_seconds', '7.0', 2), ('rate_limit', 'true', 2)) x(name, value, layer)""",
    "cf01_policies": """WITH d AS (SELECT * FROM rate_policy WHERE route = 'default') SELECT route, rps, burst, per_ip FROM rate_policy WHERE route NOT IN ('default', '/kv/scan', '/new', '/healthz')
        UNION ALL SELECT '/kv/scan', 2.5, 3, per_ip FROM d UNION ALL SELECT '/new', 2.5, burst, per_ip FROM d UNION ALL SELECT 'default', 2.5, burst, per_ip FROM d""",
    "st02_shed": f"SELECT delivery_id FROM ops QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY delivery_id) <= {ROOM}",
    "st02_shed_oldest": f"SELECT delivery_id FROM ops QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY delivery_id DESC) <= {ROOM}",
    "st03_pushes": "SELECT (n - 1) // 100 AS push, count(*) AS changes, min(lsn) AS lsn_from, max(lsn) AS lsn_to FROM (SELECT lsn, row_number() OVER (ORDER BY lsn) AS n FROM (SELECT DISTINCT lsn FROM ops WHERE lsn > 0)) GROUP BY 1",
    "st04_catch_up": f"WITH {LOG}{FOLD} SELECT key, value, lsn FROM state",
    "st05_full_sync": f"WITH {SNAP} SELECT key, value, epoch_ms(expire_at) AS expire_ms FROM snap WHERE expire_at IS NULL OR expire_at > TIMESTAMP '{NOW}'",
    "st06_apply": f"WITH {_ENTRY} SELECT lsn, c.op AS op, c.key AS key FROM entry WHERE lsn > {LOG_FROM}",
    "st07_log_status": f"SELECT DISTINCT ack_lsn AS start_lsn, CASE WHEN ack_lsn < {LOG_FROM - 1} THEN 410 ELSE 200 END AS status FROM follower_ack WHERE stream = 'ops'",
    "st10_expirer": f"WITH {SNAP} SELECT 'expire' AS op, key, snapshot_lsn AS lsn, shard FROM snap WHERE expire_at <= TIMESTAMP '{NOW}'",
    "st12_fresh": f"WITH {_LAG} SELECT stream, follower, greatest(coalesce(leader, 0) - ack, 0) <= 50 AS fresh FROM lag",
    "st13_read_only": "SELECT c.command, c.role, c.read_only, count(*) AS n FROM events JOIN (VALUES ('signup', 'SET', 'writer', true), ('view', 'GET', 'reader', false), ('click', 'incr', 'writer', true), ('purchase', 'CONFIG', 'admin', false), ('error', 'DEL', 'writer', true)) c(t, command, role, read_only) ON t = event_type GROUP BY ALL",
    "ac01_role": f"SELECT c_custkey, {_ROLE} AS role FROM customer",
    "h11_ai_values": f"WITH {SNAP} SELECT substr(key, 10) AS cache_key, value FROM snap WHERE starts_with(key, 'ai:cache:')",
    "h14_log": f"""WITH {_ENTRY}, s AS (SELECT DISTINCT ack_lsn AS start_lsn FROM follower_ack WHERE stream = 'ops'), n AS (SELECT start_lsn, count(*) AS n FROM s JOIN entry e ON e.lsn > start_lsn AND e.lsn > {LOG_FROM} GROUP BY 1)
        SELECT start_lsn, CASE WHEN start_lsn < {LOG_FROM} THEN 410 ELSE 200 END AS status, CASE WHEN start_lsn < {LOG_FROM} THEN 0 ELSE coalesce(n, 0) END AS changes FROM s LEFT JOIN n USING (start_lsn)""",
    "ac02_authorize": f"SELECT c_custkey, {_ROLE} AS role, CASE WHEN {_ROLE} IS NULL THEN 401 WHEN {_ROLE} = 'reader' THEN 403 ELSE 200 END AS status FROM customer",
}
