"""Queries of the store's own operators: commands, reads, eviction, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import cdc, commands, dedupe, eviction, reads, routing
from ledgerfold.operators.fold import fold, keyspace_events, on_channel, state
from ledgerfold.sources.oplog import from_events, numbered
from ledgerfold.sources.tables import plain_op, table

#: The moment at which expiry is judged.
NOW = "2025-01-10 00:00:00"
SHARDS = 16
CAPACITY = 40
FLUSH_AT = 500
#: Places to which replies show held numbers: sums of doubles differ beyond with the order in which they are added.
DIGITS = 6


def now():
    return F.lit(NOW).cast("timestamp")


def folded(spark: SparkSession, folder: str) -> DataFrame:
    return fold(from_events(table(spark, folder, "events")))


def final(spark: SparkSession, folder: str) -> DataFrame:
    return state(from_events(table(spark, folder, "events"))).withColumn("value", F.round("value", 6))


def rows_of(op: str, *columns: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return folded(spark, folder).where(F.col("op") == op).selectExpr("lsn", "key", *columns)

    return query


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot with repeated rows put together: a copy may lack the expiry."""
    rows = table(spark, folder, "state_snapshot").withColumn("expire_at", F.col("expire_at").cast("timestamp"))
    return rows.groupBy("key").agg(*[f(c).alias(c) for c, f in (("shard", F.max), ("value", F.min), ("expire_at", F.max), ("freq", F.max), ("last_seq", F.max), ("snapshot_lsn", F.max))])


def _mset(spark: SparkSession, folder: str) -> DataFrame:
    sets = cdc.transactions(table(spark, folder, "ops")).where("op = 'mset'")
    return reads.merge_sets(cdc.writes(sets)).select("key", "lsn", "value")


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("key"))


def _loaded(spark: SparkSession, folder: str) -> DataFrame:
    later = now() + F.expr("INTERVAL 1 HOUR")
    back = reads.load(reads.dump(snapshot(spark, folder), now()), later)
    return routing.with_shard(back, SHARDS).select("key", "shard", F.unix_millis("expire_at").alias("expire_ms"))


def _flushed(spark: SparkSession, folder: str) -> DataFrame:
    log = from_events(table(spark, folder, "events"))
    flush = spark.range(1).select((F.lit(FLUSH_AT)).cast("long").alias("lsn"), F.lit("flush").alias("op"))
    # the command takes the place of the one that has its number
    both = log.where(F.col("lsn") != FLUSH_AT).unionByName(flush, allowMissingColumns=True)
    return state(both).select("key", F.round("value", 6).alias("value"))


def _expire(spark: SparkSession, folder: str) -> DataFrame:
    notices = table(spark, folder, "keyspace_event").where(plain_op(F.col("op")) == "expire").select("key").distinct()
    held = snapshot(spark, folder).select("key", "value", "expire_at")
    asked = notices.join(held.select("key", "value"), "key").withColumn("expire_at", now() + F.expr("INTERVAL 60 SECONDS"))
    return reads.update_all(held, asked).select("key", F.unix_millis("expire_at").alias("expire_ms"))


def accesses(spark: SparkSession, folder: str) -> DataFrame:
    """A use per lsn above 0 and key. Notices without an lsn are left out, those of one lsn and key (a set and an expire) are one use."""
    rows = table(spark, folder, "keyspace_event").where("lsn > 0").groupBy("lsn", "key").agg(F.lit(1))
    return routing.with_shard(rows.select("lsn", "key"), SHARDS)


def _all_accesses(spark: SparkSession, folder: str) -> DataFrame:
    """A use per message of the notices, told apart as in p2. One without an lsn has lsn 0: it counts, and is older than all that have one."""
    names, columns = dedupe.message_ids("keyspace_event")
    rows = table(spark, folder, "keyspace_event").select(*columns).groupBy(*names).agg(F.lit(1))
    return routing.with_shard(rows.select(F.col("id_lsn").alias("lsn"), F.col("id_key").alias("key")), SHARDS)


def _ranked(policy: str, used=accesses):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return eviction.ranked(eviction.touches(used(spark, folder)), CAPACITY, policy)

    return query


def _tiers(used):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        hot, cold = eviction.tiers(eviction.touches(used(spark, folder)), CAPACITY)
        return hot.withColumn("tier", F.lit("hot")).unionByName(cold.withColumn("tier", F.lit("cold"))).groupBy("shard", "tier").agg(F.count(F.lit(1)).alias("keys"))

    return query


def _timed(spark: SparkSession, folder: str) -> DataFrame:
    log = routing.with_shard(from_events(table(spark, folder, "events")), SHARDS)
    return log.select("shard", "lsn", (F.unix_micros("ts") / 1e6).alias("now"), "op", "key", "value", F.when(F.col("op") == "create", 21600.0).alias("ttl"))


def _bounded(policy: str, spill: bool):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return eviction.replay(_timed(spark, folder), 8, policy, spill)

    return query


def _index(spark: SparkSession, folder: str) -> DataFrame:
    return numbered(table(spark, folder, "keyspace_event").select("key").distinct(), ["key"], "place").select("key", "place")


def _all_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Every key of the notices, also those whose notices all came without their shard."""
    return table(spark, folder, "keyspace_event").select("key").distinct()


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with a notice that names their shard, for the queries whose SQL reads the shard from the table."""
    return table(spark, folder, "keyspace_event").where("shard IS NOT NULL").select("key").distinct()


def _tagged(keys):
    return lambda spark, folder: keys(spark, folder).select("key", routing.key_material(F.col("key")).alias("material"))


def _sharded(keys):
    return lambda spark, folder: routing.with_shard(keys(spark, folder), SHARDS)


def _by_shard(keys):
    return lambda spark, folder: _sharded(keys)(spark, folder).groupBy("shard").agg(F.count(F.lit(1)).alias("keys"))


def _read_through(used):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        hot, cold = (t.withColumn("value", F.col("freq")) for t in eviction.tiers(eviction.touches(used(spark, folder)), CAPACITY))
        return reads.read_through(hot, cold, table(spark, folder, "ops").select("key")).select("key", "tier")

    return query


def web_log(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("signup", "PUT", "view", "GET", "click", "INCR", "purchase", "PUT", "error", "DELETE")])
    return table(spark, folder, "events").select((F.col("event_id") + 1).alias("lsn"), kind[F.col("event_type")].alias("method"), F.col("user_id").cast("string").alias("key"), "value")


def _wire(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("signup", "SET", "view", "GET", "click", "INCRBY", "purchase", "EXISTS", "error", "DEL")])
    log = table(spark, folder, "events").select((F.col("event_id") + 1).alias("lsn"), kind[F.col("event_type")].alias("command"), F.col("user_id").cast("string").alias("key"), "value")
    return commands.wire_replies(log, DIGITS)


def _feed(spark: SparkSession, folder: str) -> DataFrame:
    return keyspace_events(folded(spark, folder))


def _channels(spark: SparkSession, folder: str) -> DataFrame:
    feed = _feed(spark, folder)
    out = None
    for channel in ("keyspace", "keyspace:set", "keyspace:del", "other"):
        one = on_channel(feed, channel).agg(F.lit(channel).alias("channel"), F.count(F.lit(1)).alias("events"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "kv01_create": rows_of("create", "accepted"),
    "kv02_read": rows_of("read", "accepted AS hit", "round(value_after, 6) AS value"),
    "kv03_update": rows_of("update", "accepted"),
    "kv04_delete": rows_of("delete", "accepted"),
    "kv05_mset": _mset,
    "kv06_mget": lambda spark, folder: reads.mget(final(spark, folder), _customers(spark, folder)),
    "kv07_incr": rows_of("incr", "round(value_after, 6) AS value"),
    "kv_final_state": final,
    "kv08_keys": lambda spark, folder: final(spark, folder).select("key"),
    "kv09_scan": lambda spark, folder: reads.scan(snapshot(spark, folder), "user:{", 50, "user:{2"),
    "kv10_purge": lambda spark, folder: reads.expired(snapshot(spark, folder), now()).select("shard", "key"),
    "kv11_live": lambda spark, folder: reads.live(snapshot(spark, folder), now()).select("key"),
    "kv12_dump": lambda spark, folder: reads.dump(snapshot(spark, folder), now()).withColumn("ttl", F.round("ttl", 3)),
    "kv13_load": _loaded,
    "kv14_flush": _flushed,
    "kv15_dbsize": lambda spark, folder: reads.dbsize(reads.live(snapshot(spark, folder), now())),
    "kv16_exists": lambda spark, folder: reads.exists(final(spark, folder), table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("key"))),
    "kv17_expire": _expire,
    "kv_expiring_fold": lambda spark, folder: eviction.expiring_fold(_timed(spark, folder)),
    "ev01_lru": _ranked("lru"),
    "ev01_lru_all": _ranked("lru", _all_accesses),
    "ev01_lru_replay": _bounded("lru", False),
    "ev02_lfu": _ranked("lfu"),
    "ev02_lfu_all": _ranked("lfu", _all_accesses),
    "ev02_lfu_replay": _bounded("lfu", False),
    "ev03_touch": lambda spark, folder: eviction.touches(accesses(spark, folder)),
    "ev03_touch_all": lambda spark, folder: eviction.touches(_all_accesses(spark, folder)),
    "ev04_spill": _tiers(accesses),
    "ev04_spill_all": _tiers(_all_accesses),
    "ev04_spill_replay": _bounded("lru", True),
    "ev05_index": _index,
    "rt01_hash_tag": _tagged(_keys),
    "rt01_all_keys": _tagged(_all_keys),
    "rt02_ring": lambda spark, folder: routing.ring_table(spark, SHARDS),
    "rt03_shard": _sharded(_keys),
    "rt03_all_keys": _sharded(_all_keys),
    "rt04_by_shard": _by_shard(_keys),
    "rt04_all_keys": _by_shard(_all_keys),
    "jn01_mget": lambda spark, folder: reads.mget(snapshot(spark, folder), table(spark, folder, "ops").select("key")),
    "jn03_ring_lookup": lambda spark, folder: routing.with_shard(_customers(spark, folder), 4),
    "jn04_read_through": _read_through(accesses),
    "jn04_read_through_all": _read_through(_all_accesses),
    "st01_changes": lambda spark, folder: folded(spark, folder).where("accepted AND op <> 'read'").select("lsn", "op", "key"),
    "st08_keyspace": _feed,
    "st09_channels": _channels,
    "h_replies": lambda spark, folder: commands.web_replies(web_log(spark, folder), DIGITS),
    "h_status": lambda spark, folder: commands.web_replies(web_log(spark, folder)).select("lsn", "method", "key", "status"),
    "h03_batch": lambda spark, folder: reads.mget(final(spark, folder), spark.createDataFrame([("1",), ("2",), ("3",), ("2",), ("none",)], "key string")),
    "h04_scan": lambda spark, folder: reads.scan(final(spark, folder), "1", 100).agg(F.to_json(F.struct(F.sort_array(F.collect_list("key")).alias("keys"))).alias("body")),
    "r_replies": _wire,
}

LOG = """
    log AS (SELECT event_id + 1 AS lsn, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'read' WHEN 'click' THEN 'incr' WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'delete' END AS op,
                   CAST(user_id AS VARCHAR) AS key, value FROM events),"""

FOLD = """
    l AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('create', 'incr', 'put') THEN 1 WHEN op = 'delete' THEN 0 END IGNORE NULLS)
                             OVER (PARTITION BY key ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS live FROM log),
    a AS (SELECT *, CASE WHEN op = 'create' THEN live = 0 WHEN op IN ('incr', 'put') THEN true ELSE live = 1 END AS accepted,
                 CASE WHEN op IN ('create', 'incr', 'put') THEN 1 WHEN op = 'delete' THEN 0 ELSE live END AS live_after FROM l),
    e AS (SELECT *, sum(CASE WHEN accepted AND (op IN ('create', 'update', 'put', 'delete') OR (op = 'incr' AND live = 0)) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY lsn) AS epoch FROM a),
    v AS (SELECT *, CASE WHEN live_after = 1 THEN sum(CASE WHEN accepted AND op IN ('create', 'update', 'put', 'incr') THEN value ELSE 0 END) OVER (PARTITION BY key, epoch ORDER BY lsn) END AS value_after FROM e),
    state AS (SELECT key, round(arg_max(value_after, lsn), 6) AS value, max(CASE WHEN accepted AND op <> 'read' THEN lsn END) AS lsn FROM v GROUP BY key HAVING arg_max(live_after, lsn) = 1)"""

SNAP = "snap AS (SELECT key, max(shard) AS shard, min(value) AS value, max(expire_at) AS expire_at, max(snapshot_lsn) AS snapshot_lsn FROM state_snapshot GROUP BY key)"
#: The checksum as SQL: its table by rule, then a reduction over bytes.
CRC = """
    tab AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
    crc AS (SELECT k, shard, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
            FROM (SELECT k, shard, list_transform(range(octet_length(encode(k))), lambda i: ('0x' || substr(hex(encode(k)), 2 * i + 1, 2))::BIGINT) AS bytes FROM hashed), tab)"""


def _with_log(sql: str) -> str:
    return f"WITH {LOG}{FOLD} {sql}"


def _routed(shards: int, keys: str) -> str:
    """CTEs that end in ``spans (lo, hi, shard)`` and ``routed (key, shard)`` for the column ``key`` of the query ``keys``."""
    return rf"""
    asked AS (SELECT key, CASE WHEN regexp_matches(key, '^[^{{]*\{{[^}}]+\}}') THEN regexp_extract(key, '^[^{{]*\{{([^}}]+)\}}', 1) ELSE key END AS material FROM (SELECT DISTINCT key FROM ({keys}))),
    hashed AS (SELECT DISTINCT material AS k, -1 AS shard FROM asked UNION ALL SELECT concat('shard_', s, '_v_', v), s FROM range({shards}) a(s), range(100) b(v)), {CRC},
    points AS (SELECT h, min(shard) AS shard FROM crc WHERE shard >= 0 GROUP BY h),
    spans AS (SELECT coalesce(lag(h) OVER (ORDER BY h) + 1, 0) AS lo, h AS hi, CAST(shard AS INTEGER) AS shard FROM points UNION ALL SELECT max(h) + 1, 4294967295, CAST(arg_min(shard, h) AS INTEGER) FROM points),
    routed AS (SELECT a.key, s.shard FROM asked a JOIN crc c ON c.k = a.material AND c.shard < 0 JOIN spans s ON c.h BETWEEN s.lo AND s.hi)"""


TOUCH = f"""{_routed(SHARDS, 'SELECT key FROM keyspace_event WHERE lsn > 0')},
    t AS (SELECT r.shard, d.key, count(*) AS freq, max(d.lsn) AS last_seq FROM (SELECT DISTINCT lsn, key FROM keyspace_event WHERE lsn > 0) d JOIN routed r USING (key) GROUP BY ALL)"""

TOUCH_ALL = f"""{_routed(SHARDS, 'SELECT key FROM keyspace_event')},
    t AS (SELECT r.shard, d.key, count(*) AS freq, max(d.lsn) AS last_seq
          FROM (SELECT DISTINCT CASE WHEN lsn > 0 THEN lsn ELSE 0 END AS lsn, lower(trim(op)) AS op, key, CASE WHEN lsn > 0 THEN NULL ELSE ts END AS ts FROM keyspace_event) d JOIN routed r USING (key) GROUP BY ALL)"""

#: The log as web and wire commands: creates and updates are puts; on the wire, updates ask whether a key is there.
PUTS = LOG.replace("'create'", "'put'").replace("'update'", "'put'")
WIRE = LOG.replace("'create'", "'put'").replace("'update'", "'read'").replace("SELECT event_id", "SELECT event_type, event_id")
METHOD = "CASE op WHEN 'put' THEN 'PUT' WHEN 'read' THEN 'GET' WHEN 'incr' THEN 'INCR' ELSE 'DELETE' END"
STATUS = "CASE WHEN op = 'put' THEN CASE live WHEN 1 THEN 204 ELSE 201 END WHEN op = 'delete' THEN CASE live WHEN 1 THEN 204 ELSE 404 END WHEN op = 'read' THEN CASE live WHEN 1 THEN 200 ELSE 404 END ELSE 200 END"

ORACLE = {
    "kv01_create": _with_log("SELECT lsn, key, accepted FROM v WHERE op = 'create'"),
    "kv02_read": _with_log("SELECT lsn, key, accepted AS hit, round(value_after, 6) AS value FROM v WHERE op = 'read'"),
    "kv03_update": _with_log("SELECT lsn, key, accepted FROM v WHERE op = 'update'"),
    "kv04_delete": _with_log("SELECT lsn, key, accepted FROM v WHERE op = 'delete'"),
    "kv05_mset": """WITH sets AS (SELECT lsn, arg_min(key, delivery_id)::JSON AS doc FROM ops WHERE lsn > 0 AND lower(trim(op)) = 'mset' GROUP BY lsn),
        items AS (SELECT lsn, u AS key, json_extract(doc, concat('/', replace(replace(u, '~', '~0'), '/', '~1')))::VARCHAR AS value FROM (SELECT lsn, doc, unnest(json_keys(doc)) AS u FROM sets))
        SELECT key, max(lsn) AS lsn, arg_max(value, lsn) AS value FROM items GROUP BY key""",
    "kv06_mget": _with_log("SELECT key, value FROM state WHERE key IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)"),
    "kv07_incr": _with_log("SELECT lsn, key, round(value_after, 6) AS value FROM v WHERE op = 'incr'"),
    "kv_final_state": _with_log("SELECT key, value, lsn FROM state"),
    "kv08_keys": _with_log("SELECT key FROM state"),
    "kv09_scan": f"WITH {SNAP} SELECT key FROM snap WHERE starts_with(key, 'user:{{') AND key > 'user:{{2' ORDER BY key LIMIT 50",
    "kv10_purge": f"WITH {SNAP} SELECT shard, key FROM snap WHERE expire_at <= TIMESTAMP '{NOW}'",
    "kv11_live": f"WITH {SNAP} SELECT key FROM snap WHERE expire_at IS NULL OR expire_at > TIMESTAMP '{NOW}'",
    "kv12_dump": f"WITH {SNAP} SELECT shard, key, value, round((epoch_us(expire_at) - epoch_us(TIMESTAMP '{NOW}')) / 1e6, 3) AS ttl FROM snap WHERE expire_at IS NULL OR expire_at > TIMESTAMP '{NOW}'",
    "kv13_load": f"WITH {SNAP} SELECT key, shard, epoch_ms(expire_at + INTERVAL 1 HOUR) AS expire_ms FROM snap WHERE expire_at IS NULL OR expire_at > TIMESTAMP '{NOW}'",
    "kv14_flush": f"WITH {LOG.replace('FROM events', f'FROM events WHERE event_id >= {FLUSH_AT}')}{FOLD} SELECT key, value FROM state",
    "kv15_dbsize": f"WITH {SNAP} SELECT count(*) AS keys FROM snap WHERE expire_at IS NULL OR expire_at > TIMESTAMP '{NOW}'",
    "kv16_exists": _with_log("SELECT count(*) AS hits FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT key FROM state)"),
    "kv17_expire": f"WITH {SNAP} SELECT key, epoch_ms(CASE WHEN key IN (SELECT key FROM keyspace_event WHERE lower(trim(op)) = 'expire') THEN TIMESTAMP '{NOW}' + INTERVAL 60 SECOND ELSE expire_at END) AS expire_ms FROM snap",
    "ev01_lru": f"WITH {TOUCH} SELECT *, row_number() OVER (PARTITION BY shard ORDER BY last_seq DESC, key) <= {CAPACITY} AS hot FROM t",
    "ev01_lru_all": f"WITH {TOUCH_ALL} SELECT *, row_number() OVER (PARTITION BY shard ORDER BY last_seq DESC, key) <= {CAPACITY} AS hot FROM t",
    "ev02_lfu": f"WITH {TOUCH} SELECT *, row_number() OVER (PARTITION BY shard ORDER BY freq DESC, last_seq DESC, key) <= {CAPACITY} AS hot FROM t",
    "ev02_lfu_all": f"WITH {TOUCH_ALL} SELECT *, row_number() OVER (PARTITION BY shard ORDER BY freq DESC, last_seq DESC, key) <= {CAPACITY} AS hot FROM t",
    "ev03_touch": f"WITH {TOUCH} SELECT * FROM t",
    "ev03_touch_all": f"WITH {TOUCH_ALL} SELECT * FROM t",
    "ev04_spill": f"WITH {TOUCH} SELECT shard, CASE WHEN p <= {CAPACITY} THEN 'hot' ELSE 'cold' END AS tier, count(*) AS keys FROM (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY last_seq DESC, key) AS p FROM t) GROUP BY ALL",
    "ev04_spill_all": f"WITH {TOUCH_ALL} SELECT shard, CASE WHEN p <= {CAPACITY} THEN 'hot' ELSE 'cold' END AS tier, count(*) AS keys FROM (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY last_seq DESC, key) AS p FROM t) GROUP BY ALL",
    "ev05_index": "SELECT key, row_number() OVER (ORDER BY key) AS place FROM (SELECT DISTINCT key FROM keyspace_event)",
    "rt01_hash_tag": r"SELECT DISTINCT key, CASE WHEN regexp_matches(key, '^[^{]*\{[^}]+\}') THEN regexp_extract(key, '^[^{]*\{([^}]+)\}', 1) ELSE key END AS material FROM keyspace_event WHERE shard IS NOT NULL",
    "rt01_all_keys": r"SELECT DISTINCT key, CASE WHEN regexp_matches(key, '^[^{]*\{[^}]+\}') THEN regexp_extract(key, '^[^{]*\{([^}]+)\}', 1) ELSE key END AS material FROM keyspace_event",
    "rt02_ring": f"WITH {_routed(SHARDS, 'SELECT NULL AS key')} SELECT * FROM spans",
    "rt03_shard": "SELECT DISTINCT key, shard FROM keyspace_event WHERE shard IS NOT NULL",
    "rt03_all_keys": f"WITH {_routed(SHARDS, 'SELECT key FROM keyspace_event')} SELECT key, shard FROM asked LEFT JOIN routed USING (key)",
    "rt04_all_keys": f"WITH {_routed(SHARDS, 'SELECT key FROM keyspace_event')} SELECT shard, count(*) AS keys FROM asked LEFT JOIN routed USING (key) GROUP BY shard",
    "rt04_by_shard": "SELECT shard, count(DISTINCT key) AS keys FROM keyspace_event WHERE shard IS NOT NULL GROUP BY shard",
    "jn01_mget": f"WITH {SNAP} SELECT key, value FROM snap WHERE key IN (SELECT key FROM ops)",
    "jn03_ring_lookup": f"WITH {_routed(4, 'SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer')} SELECT key, shard FROM routed",
    "jn04_read_through": f"WITH {TOUCH} SELECT key, CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY last_seq DESC, key) <= {CAPACITY} THEN 'hot' ELSE 'cold' END AS tier FROM t QUALIFY key IN (SELECT key FROM ops)",
    "jn04_read_through_all": f"WITH {TOUCH_ALL} SELECT key, CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY last_seq DESC, key) <= {CAPACITY} THEN 'hot' ELSE 'cold' END AS tier FROM t QUALIFY key IN (SELECT key FROM ops)",
    "st01_changes": _with_log("SELECT lsn, op, key FROM v WHERE accepted AND op <> 'read'"),
    "st08_keyspace": _with_log("SELECT CASE WHEN op = 'delete' THEN 'del' ELSE 'set' END AS op, key, lsn FROM v WHERE accepted AND op <> 'read'"),
    "st09_channels": _with_log("""SELECT * FROM (SELECT 'keyspace' AS channel, count(*) AS events FROM v WHERE accepted AND op <> 'read' UNION ALL SELECT 'keyspace:set', count(*) FROM v WHERE accepted AND op NOT IN ('read', 'delete')
        UNION ALL SELECT 'keyspace:del', count(*) FROM v WHERE accepted AND op = 'delete' UNION ALL SELECT 'other', 0)"""),
    "h_status": f"WITH {PUTS}{FOLD} SELECT lsn, {METHOD} AS method, key, {STATUS} AS status FROM v",
    "h_replies": f"WITH {PUTS}{FOLD} SELECT lsn, method, key, status, CASE WHEN status = 200 THEN concat('{{\"key\": \"', key, '\", \"value\": ', CAST(round(value_after, 6) AS VARCHAR), '}}') END AS body FROM (SELECT *, {METHOD} AS method, {STATUS} AS status FROM v)",
    "h03_batch": _with_log("SELECT key, value FROM state WHERE key IN ('1', '2', '3', 'none')"),
    "h04_scan": _with_log("SELECT concat('{\"keys\":[', string_agg(concat('\"', key, '\"'), ',' ORDER BY key), ']}') AS body FROM (SELECT key FROM state WHERE starts_with(key, '1') ORDER BY key LIMIT 100)"),
    "r_replies": f"WITH {WIRE}{FOLD} SELECT lsn, CASE event_type WHEN 'signup' THEN 'SET' WHEN 'view' THEN 'GET' WHEN 'click' THEN 'INCRBY' WHEN 'purchase' THEN 'EXISTS' ELSE 'DEL' END AS command, key, concat(CASE event_type WHEN 'signup' THEN '+OK' "
    "WHEN 'view' THEN CASE live WHEN 1 THEN concat('$', length(CAST(round(value_after, 6) AS VARCHAR)), chr(13), chr(10), CAST(round(value_after, 6) AS VARCHAR)) ELSE '$-1' END WHEN 'click' THEN concat(':', CAST(trunc(round(value_after, 6)) AS BIGINT)) ELSE concat(':', live) END, chr(13), chr(10)) AS reply FROM v",
}
