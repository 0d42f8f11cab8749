"""Queries of the general data-processing problems, over the whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import cdc, dedupe, hotkeys, incremental
from ledgerfold.runtime import work_dir
from ledgerfold.sources.tables import plain_op, table, table_parts, table_stream


def _due(spark: SparkSession, folder: str) -> DataFrame:
    acks = table(spark, folder, "follower_ack")
    ops = incremental.unprocessed(table(spark, folder, "ops"), ["lsn"], acks, "ops")
    notices = table(spark, folder, "keyspace_event").select("batch_id", "lsn", plain_op(F.col("op")).alias("op"), "key")
    return ops.unionByName(incremental.unprocessed(notices, ["lsn", "op", "key"], acks, "keyspace_event"))


def _intervals(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.processed_intervals(table(spark, folder, "follower_ack"), ["stream", "follower"])


def _copies_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ids, columns = dedupe.message_ids(name)
    told = ["delivery_id", *columns, dedupe.event_seconds(name).alias("seconds")]
    store = dedupe.SeenStore(spark, work_dir(spark, f"seen-{name}"), ids, "delivery_id", F.col("seconds"), dedupe.message_slot())
    parts = table_parts(spark, folder, name, "batch_id")
    for batch, part in enumerate(parts):  # a file stream would hand one file over whole
        store.process(part.select(*told), batch)
    if not parts:
        store.run(table_stream(spark, folder, name).select(*told))
    return store.copies()


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    parts = [_copies_of(spark, folder, name).select(F.lit(name).alias("stream"), "delivery_id") for name in ("ops", "keyspace_event")]
    return parts[0].unionByName(parts[1])


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ops")
    once = dedupe.exactly_once(rows, _copies_of(spark, folder, "ops"), "delivery_id")
    return once.select("delivery_id", "lsn", plain_op(F.col("op")).alias("op"), "key")


def _per_key(spark: SparkSession, folder: str) -> DataFrame:
    return hotkeys.per_key(table(spark, folder, "keyspace_event"))


def _per_shard(spark: SparkSession, folder: str) -> DataFrame:
    return hotkeys.per_shard(_per_key(spark, folder))


def _live(spark: SparkSession, folder: str) -> DataFrame:
    return cdc.replay(table(spark, folder, "state_snapshot"), table(spark, folder, "ops"))


def _held(spark: SparkSession, folder: str) -> DataFrame:
    """State at the contiguous watermark: nothing at or after the first gap that is still waited for shows."""
    snapshot, ops = table(spark, folder, "state_snapshot"), table(spark, folder, "ops")
    start = snapshot.agg(F.max("snapshot_lsn")).first()[0] or 0
    mark = cdc.contiguous_watermark(ops, cdc.settled(ops, start, PATIENCE))
    return cdc.replay(snapshot, ops, upto=mark).select("key", "lsn", F.lit(mark).alias("watermark"))


#: Batches after which a change that hasn't come is declared lost.
PATIENCE = 20

QUERIES = {
    "p1_found": _due,
    "p1_intervals": _intervals,
    "p2_found": _copies,
    "p2_kept_ops": _kept,
    "p3_found": lambda spark, folder: hotkeys.hot_keys(table(spark, folder, "keyspace_event")).select("key", "shard"),
    "p3_per_key": _per_key,
    "p3_per_shard": _per_shard,
    "p5_found": lambda spark, folder: _live(spark, folder).select("key", "lsn"),
    "p5_state": _live,
    "p5_held": _held,
}

_MESSAGES = """
    ops_id AS (SELECT delivery_id, batch_id, lsn, lower(trim(op)) AS op, key,
                      CASE WHEN lsn > 0 THEN concat('l', lsn) ELSE concat('u', lower(trim(op)), chr(1), key, chr(1), ts) END AS id FROM ops),
    notice_id AS (SELECT delivery_id, batch_id, lsn, lower(trim(op)) AS op, key,
                      concat(lsn, chr(1), lower(trim(op)), chr(1), key, CASE WHEN lsn > 0 THEN '' ELSE concat(chr(1), ts) END) AS id FROM keyspace_event)"""

_DUE = """
    SELECT '{t}' AS stream, f.follower, m.lsn
    FROM (SELECT DISTINCT follower FROM follower_ack WHERE stream = '{t}' AND follower IS NOT NULL) f
    CROSS JOIN (SELECT DISTINCT id, lsn FROM {v} WHERE lsn > 0) m
    LEFT JOIN (SELECT DISTINCT a.follower, d.id FROM {v} d
               JOIN (SELECT DISTINCT follower, unnest(range(batch_from, batch_to + 1)) AS b FROM follower_ack WHERE stream = '{t}' AND ok) a ON d.batch_id = a.b WHERE d.lsn > 0) done
      ON done.follower = f.follower AND done.id = m.id
    WHERE done.id IS NULL GROUP BY ALL"""

#: The replay as plain windows over whole keys, for the oracle only.
_REPLAY = r"""
    start AS (SELECT coalesce(max(snapshot_lsn), 0) AS s FROM state_snapshot),
    txn AS (SELECT lsn, arg_min(struct_pack(op := lower(trim(op)), key := key, value := value, delta := delta), delivery_id) AS c FROM ops, start WHERE lsn > s GROUP BY lsn),
    one AS (SELECT c.key AS key, lsn, c.op AS op, CASE WHEN c.op IN ('create', 'update') THEN coalesce(c.value, 'null') ELSE c.value END AS value, coalesce(c.delta, try_cast(c.value AS DOUBLE), 1.0) AS delta FROM txn WHERE c.op <> 'mset'),
    many AS (SELECT u.key AS key, lsn, 'create' AS op, json_extract(doc, concat('/', replace(replace(u.key, '~', '~0'), '/', '~1')))::VARCHAR AS value, 0.0 AS delta
             FROM (SELECT lsn, c.key::JSON AS doc, unnest(json_keys(c.key::JSON)) AS key FROM txn WHERE c.op = 'mset') u),
    snap AS (SELECT key, s AS lsn, 'create' AS op, min(value) AS value, 0.0 AS delta FROM state_snapshot, start GROUP BY key, s),
    w AS (SELECT *, try_cast(CASE WHEN regexp_full_match(value, '-?[0-9.eE+-]+') THEN value WHEN regexp_full_match(value, '"\s*[0-9.eE+_-]+\s*"') THEN trim(value, '" ') END AS DOUBLE) AS num
          FROM (SELECT * FROM snap UNION ALL SELECT * FROM one UNION ALL SELECT * FROM many)),
    l AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('create', 'incr') THEN 1 WHEN op = 'delete' THEN 0 END IGNORE NULLS)
                             OVER (PARTITION BY key ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM w),
    r AS (SELECT *, CASE WHEN op = 'delete' THEN 'a' WHEN op = 'create' OR (op = 'update' AND was = 1) THEN CASE WHEN num IS NULL THEN 'x' ELSE 'n' END END AS reset FROM l),
    k AS (SELECT *, coalesce(last_value(reset IGNORE NULLS) OVER (PARTITION BY key ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'a') AS kind FROM r),
    t AS (SELECT *, (op = 'incr' AND kind <> 'x') AS steps, (reset IS NOT NULL AND op <> 'delete') OR (op = 'incr' AND kind <> 'x') AS taken FROM k),
    live AS (SELECT key, max(CASE WHEN taken THEN lsn END) AS lsn,
                    arg_max(CASE WHEN op IN ('create', 'incr') THEN 1 WHEN op = 'delete' THEN 0 END, CASE WHEN op <> 'update' THEN lsn END) AS alive FROM t GROUP BY key)"""

#: The same, bounded by the last lsn before the first gap that is still waited for.
_HELD = _REPLAY.replace(
    "    txn AS",
    f"""    told AS (SELECT greatest(any_value(s), coalesce(max(lsn), 0)) AS t FROM ops, start WHERE batch_id <= (SELECT max(batch_id) FROM ops) - {PATIENCE}),
    mark AS (SELECT coalesce(max(lsn), any_value(t)) AS m FROM (SELECT lsn, row_number() OVER (ORDER BY lsn) + t AS place, t FROM (SELECT DISTINCT lsn, t FROM ops, told WHERE lsn > t)) WHERE lsn = place),
    txn AS""",
).replace("FROM ops, start WHERE lsn > s GROUP", "FROM ops, start, mark WHERE lsn > s AND lsn <= coalesce(m, (SELECT t FROM told)) GROUP")

ORACLE = {
    "p1_found": f"WITH {_MESSAGES} {_DUE.format(t='ops', v='ops_id')} UNION ALL {_DUE.format(t='keyspace_event', v='notice_id')}",
    "p1_intervals": """
        WITH cut AS (SELECT stream, follower, b, greatest(batch_from, b * 4096) AS lo, least(batch_to, b * 4096 + 4095) AS hi
                     FROM (SELECT *, unnest(range(batch_from // 4096, batch_to // 4096 + 1)) AS b FROM follower_ack WHERE ok)),
             reach AS (SELECT *, max(hi) OVER (PARTITION BY stream, follower, b ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM cut),
             island AS (SELECT *, sum(CASE WHEN lo <= r + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY stream, follower, b ORDER BY lo, hi) AS i FROM reach)
        SELECT stream, follower, min(lo) AS batch_from, max(hi) AS batch_to FROM island GROUP BY stream, follower, b, i""",
    "p2_found": f"""
        WITH {_MESSAGES}
        SELECT stream, delivery_id FROM (
            SELECT 'ops' AS stream, delivery_id, min(delivery_id) OVER (PARTITION BY id) AS first FROM ops_id
            UNION ALL SELECT 'keyspace_event', delivery_id, min(delivery_id) OVER (PARTITION BY id) FROM notice_id)
        WHERE delivery_id > first""",
    "p2_kept_ops": f"WITH {_MESSAGES} SELECT min(delivery_id) AS delivery_id, arg_min(lsn, delivery_id) AS lsn, arg_min(op, delivery_id) AS op, arg_min(key, delivery_id) AS key FROM ops_id GROUP BY id",
    "p3_found": "SELECT key, max(shard) AS shard FROM keyspace_event WHERE key IS NOT NULL GROUP BY key HAVING count(*) * 100 >= (SELECT count(*) FROM keyspace_event)",
    "p3_per_key": "SELECT key, max(shard) AS shard, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM keyspace_event GROUP BY key",
    "p3_per_shard": """SELECT shard, count(*) AS keys, CAST(sum(n) AS BIGINT) AS n, min(first_ts) AS first_ts, max(last_ts) AS last_ts
        FROM (SELECT key, max(shard) AS shard, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM keyspace_event GROUP BY key) GROUP BY shard""",
    "p5_found": f"WITH {_REPLAY} SELECT key, lsn FROM live WHERE alive = 1",
    "p5_state": f"""WITH {_REPLAY}, ep AS (SELECT *, count(reset) OVER (PARTITION BY key ORDER BY lsn) AS e FROM t), fin AS (SELECT * FROM ep QUALIFY e = max(e) OVER (PARTITION BY key)),
        held AS (SELECT key, arg_max(value, lsn) FILTER (reset IS NOT NULL) AS value, coalesce(arg_max(num, lsn) FILTER (reset IS NOT NULL AND reset <> 'a'), 0) AS num, sum(delta) FILTER (steps) AS added FROM fin GROUP BY key)
        SELECT key, CASE WHEN added IS NULL THEN value ELSE CAST(num + added AS VARCHAR) END AS value, lsn FROM live JOIN held USING (key) WHERE alive = 1""",
    "p5_held": f"WITH {_HELD.strip()} SELECT key, lsn, coalesce(m, (SELECT t FROM told)) AS watermark FROM live, mark WHERE alive = 1",
}
