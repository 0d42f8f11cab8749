import hashlib
import json
import random
import statistics
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions import codec, text
from ledgerfold.operators import access, aicache, metrics, ratelimit, replication
from ledgerfold.plans import service
from ledgerfold.sources import config
from ledgerfold.sources.oplog import numbered
from ledgerfold.sources.snapshot import Snapshots, from_lines, to_lines
from ledgerfold.sources.tier import ColdTier
from ledgerfold.sources.wal import Log


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("s", ["  A\tb\n C ", "\xa0x Y\x1c", "İ Straße ΣΑΣ", "", None, "a　b"])
def test_normalize(spark, s):
    assert one(spark, s, text.normalize_prompt) == (None if s is None else " ".join(s.lower().split()))


@pytest.mark.parametrize("s", ["1", " -2.5e3 ", "1_0", "1d", "5f", "abc", "", ".5", "5.", "1__0", "+7", "0x1", None, "1e", "--1"])
def test_numbers(spark, s):
    try:
        want = float(s)
    except (TypeError, ValueError):
        want = None
    assert one(spark, s, text.text_as_number) == want


@pytest.mark.parametrize("x", [1.0, 11.0, -3.0, 6.5, 12345678.0, 0.1, None])
def test_number_text(spark, x):
    assert one(spark, x, text.number_text, "double") == (None if x is None else str(x))


def test_cache_keys(spark):
    rows = spark.createDataFrame([("  Hello \n World", "m", None, '{"b": 1e-07, "a": [null, true], "é": "ü\\n"}'), ("hello world", "m", None, '{"é": "ü\\n", "a": [null, true], "b": 1e-07}'), ("hello world", "n", "2", None), ("x", "m", None, "[1]")], "prompt string, model string, model_version string, params string")
    got = [r.c for r in rows.select(codec.any_canonical(text.normalize_prompt(F.col("prompt")), "model", "model_version", "params").alias("c")).collect()]
    want = codec.key_of("hello world", "m", {"a": [None, True], "b": 1e-07, "é": "ü\n"})
    assert got[0] == got[1] == want[1] and got[2] == codec.key_of("hello world", "n", {}, "2")[1] and got[3] is None
    keyed = aicache.keyed(rows, {"top_k": F.lit("3"), "t": F.lit("0.5")}).collect()
    assert keyed[0].cache_key == keyed[1].cache_key == codec.key_of("hello world", "m", {"t": 0.5, "top_k": 3})[0]
    assert len(keyed[0].cache_key) == 64 and keyed[2].cache_key != keyed[1].cache_key


def test_codec(spark):
    values = ["short", "x" * 1023, "é" * 1024, "gz:not compressed", None, ""]
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("c", codec.compress_value(F.col("v"))).withColumn("d", codec.decompress_value(F.col("c")))
    rows = df.collect()
    assert [r.d for r in rows] == values
    assert [bool(r.c and r.c != r.v) for r in rows] == [False, False, True, False, False, False]


def test_lookup(spark):
    asked = aicache.keyed(spark.createDataFrame([(1, "A b", "m", None, "answer"), (2, "a  B", "m", None, "later"), (3, "c", "m", None, "x" * 2000)], "n int, prompt string, model string, model_version string, value string"), {})
    cache = aicache.stores(asked, "n", compress=True)
    assert cache.count() == 2
    got = {r.n: (r.hit, r.answer) for r in aicache.lookup(asked.drop("value"), cache).collect()}
    assert got == {1: (True, "later"), 2: (True, "later"), 3: (True, "x" * 2000)}
    assert aicache.lookup(asked, cache.where("false")).where("hit").count() == 0


def test_latency_and_percentiles(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["/a", "/b", None]), rng.choice(["GET", " get", None]), rng.choice([None, -3.0, 0.0, 1.0, 5.0, 5.1, 7000.0, rng.random() * 300]), rng.choice([True, False, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "request_id int, route string, method string, elapsed_ms double, error boolean")
    for r in metrics.percentiles(df).collect():
        v = sorted(x[3] for x in rows if x[1] == r.route and x[3] is not None)
        assert (r.p50, r.p95, r.p99) == (statistics.median(v), v[int(len(v) * 0.95)], v[int(len(v) * 0.99)])
    cum = {(r.route, r.le): r.n for r in metrics.latency_cumulative(df).collect()}
    for (route, le), n in cum.items():
        assert n == sum(1 for x in rows if x[1] == route and x[3] is not None and (le == "+Inf" or max(x[3], 0) <= float(le)))
    assert all((r, "+Inf") in cum for r in ("/a", "/b"))
    by = {r.method: (r.requests, r.errors) for r in metrics.requests(df).collect()}
    assert by["ALL"] == (400, sum(1 for x in rows if x[4])) and by["GET"][0] == sum(1 for x in rows if x[2])
    empty = df.where("false")
    assert metrics.percentiles(empty).count() == 0 and metrics.latency_cumulative(empty).count() == 0


def test_label_quotes(spark):
    df = spark.createDataFrame([(1, 'a"b', "GET", 2.0, False)], "request_id int, route string, method string, elapsed_ms double, error boolean")
    assert 'kv_request_latency_ms_bucket{route="a\\"b",le="5"} 1' in {r.line for r in metrics.exposition(df).collect()}


def test_rate_limit(spark):
    log = spark.createDataFrame([(1, "/a", "x", 0.0), (1, "/a", "x", 0.0), (2, "/a", "x", 1.0), (3, "/a", "y", 1.0), (4, "/a", "x", 11.0), (5, "/free", "x", 0.0), (6, None, "x", 0.0), (7, "/a", "x", None)], "request_id long, route string, client string, at double").withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    table = spark.createDataFrame([("/a", 0.1, 1, True), ("/free", 0.0, 0, True), ("default", 5.0, 5, False)], "route string, rps double, burst int, per_ip boolean")
    got = {r.request_id: (r.allowed, r.retry_after) for r in ratelimit.limit(log, table).collect()}
    assert got == {1: (True, 0), 2: (False, 9), 3: (True, 0), 4: (True, 0), 5: (True, 0), 6: (True, 0), 7: (True, 0)}
    assert ratelimit.limit(log, table.where("false")).where("allowed").count() == 7
    assert ratelimit.limit(log, table, exempt=("/a",)).where("allowed").count() == 7
    ip = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9.9.9.9"), ("", "9.9.9.9"), (None, None)], "f string, a string").select(ratelimit.client_ip(F.col("f"), F.col("a")).alias("ip"))
    assert [r.ip for r in ip.collect()] == ["1.2.3.4", "9.9.9.9", ""]


def test_access(spark):
    secrets = {"admin": ["root"], "writer": [""], "reader": ["r", "p"]}
    rows = [(None, None, None, "reader"), ("Bearer root", None, None, "admin"), ("bearer r", None, None, "admin"), ("Basic dTpw", None, None, "reader"), (None, "r", None, "reader"), (None, "bad", "root", "admin"), ("Bearer", "", "", "reader")]
    df = spark.createDataFrame(rows, "authorization string, token string, password string, required string")
    assert [r.status for r in access.authorize(df, secrets).collect()] == [401, 200, 403, 200, 200, 200, 401]
    assert {r.status for r in access.authorize(df, {}).collect()} == {200}
    need = spark.createDataFrame([("get",), ("SET",), ("AUTH",), ("SHUTDOWN",), (None,)], "c string").select(access.required_role(F.col("c")).alias("r"))
    assert [r.r for r in need.collect()] == ["reader", "writer", "reader", "admin", "admin"]


def test_replication(spark):
    ops = spark.createDataFrame([(n, n // 6, n, "create", "k") for n in range(10)], "delivery_id long, batch_id long, lsn long, op string, key string")
    assert {r.delivery_id for r in replication.shed(ops, 2).collect()} == {0, 1, 6, 7}
    assert {r.delivery_id for r in replication.shed(ops, 2, "drop_oldest").collect()} == {4, 5, 8, 9}
    assert replication.drops(ops, 1, "anything").first() == ("drop_newest", 8)
    assert replication.drops(ops.where("false"), 1).first().drops == 0
    assert replication.to_apply(ops, 7).count() == 2
    starts = spark.createDataFrame([(0,), (8,), (9,)], "start_lsn long")
    assert {r.start_lsn: r.status for r in replication.log_status(starts, 10).collect()} == {0: 410, 8: 410, 9: 200}
    assert {r.status for r in replication.log_status(starts, 0).collect()} == {200}
    acks = spark.createDataFrame([(1, "s", "f", 10, 4, True, None, None), (2, "s", "f", 12, 3, False, None, "busy"), (2, "s", "f", 12, 3, False, None, "busy"), (3, "s", "f", 50, 9, None, None, None), (4, "s", "g", 12, 20, True, None, None)], "ack_id long, stream string, follower string, leader_lsn long, ack_lsn long, ok boolean, finished_at timestamp, error string")
    lag = {r.follower: (r.ack_lsn, r.lag_lsn, r.last_error) for r in replication.lag(acks).collect()}
    assert lag == {"f": (3, 9, "busy"), "g": (20, 0, "")}
    names = spark.createDataFrame([("s", "f"), ("s", "g"), ("t", "new")], "stream string, follower string")
    got = {r.stream: (r.follower, r.source) for r in replication.read_from(replication.lag(acks), names, 5).collect()}
    assert got == {"s": ("g", "follower"), "t": ("new", "follower")}
    assert replication.read_from(replication.lag(acks.where("follower = 'f'")), names.where("follower = 'f'"), 5).first().source == "leader"


def test_read_modes_strategies_and_fallback(spark):
    lags = spark.createDataFrame([("s", "f", 9, 10.0), ("s", "g", 2, 900.0)], "stream string, follower string, lag_lsn long, last_applied_age_ms double")
    read = lambda *a, **k: tuple(replication.read_from(lags, lags, *a, **k).first())
    assert read(5) == read(5, mode="FOLLOWER") == read(5, mode="") == ("s", "g", 2, "follower", None)
    assert read(5, 100.0) == ("s", "g", 2, "leader", "stale_or_error")
    assert read(1) == ("s", "g", 2, "leader", "stale_or_error")
    assert read(5, mode="leader") == read(5, mode="other") == ("s", None, None, "leader", None)
    picked = {read(5, strategy="random", seed=n) for n in range(20)}
    assert picked == {("s", "g", 2, "follower", None), ("s", "f", 9, "leader", "stale_or_error")}


def test_object_ids_of_the_snapshot(spark, tmp_path):
    keys = ["user:{42}:a", "ключ", "", "gone", "gone"]
    spark.createDataFrame([(k, "1", "2020-01-01 00:00:00") for k in keys], "key string, value string, expire_at string").write.parquet(f"{tmp_path}/state_snapshot.parquet")
    got = sorted((r.key, r.crc, r.object_id) for r in service.QUERIES["sc06_object_keys"](spark, str(tmp_path)).collect())
    assert got == sorted((k, zlib.crc32(("42" if "{42}" in k else k).encode()), hashlib.sha256(k.encode()).hexdigest()) for k in set(keys))


def test_log_rotation_and_bad_lines(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    assert log.entries().count() == 0 and log.last() == 0
    rows = [(n, "create", f"k{n}", str(n)) for n in (1, 2, 3, (1 << 20) + 5)]
    df = spark.createDataFrame(rows, "lsn long, op string, key string, value string").selectExpr("*", "timestamp '2025-01-01 00:00:00.123456' AS ts", "double(NULL) AS delta", "double(NULL) AS ttl")
    log.append(df)
    (tmp_path / "log" / "segments" / "segment=0" / "part-bad.json").write_text("no json\n{}\n")
    assert sorted(r.lsn for r in log.entries(1).collect()) == [2, 3, (1 << 20) + 5]
    assert log.entries(2).first().ts.microsecond == 123456
    log.rotate(3)
    assert log.oldest() == 4 and [r.lsn for r in log.entries().collect()] == [(1 << 20) + 5]
    log.rotate((1 << 20) + 1)
    assert not (tmp_path / "log" / "segments" / "segment=0").exists() and log.last() == (1 << 20) + 5


def test_snapshots(spark, tmp_path):
    shots = Snapshots(spark, f"file://{tmp_path}/s")
    assert shots.load() is None
    rows = lambda ks: spark.createDataFrame([(99, k, '{"complex":"data"}') for k in ks], "shard int, key string, value string").selectExpr("*", "timestamp '2030-01-01' AS expire_at")
    for n, ks in enumerate((["a"], ["a", "b"], ["b", "c", "d"])):
        shots.save(rows(ks), n)
    lsn, st = shots.load(4)
    assert lsn == 2 and {r.key for r in st.collect()} == {"b", "c", "d"} and all(0 <= r.shard < 4 for r in st.collect())
    assert len(list((tmp_path / "s").glob("v*"))) == 2
    lines = to_lines(st.selectExpr("shard", "key", "value", "double(NULL) AS ttl"))
    assert from_lines(lines.unionByName(spark.createDataFrame([("bad",)], "line string"))).count() == 3


def test_cold_tier(spark, tmp_path):
    tier = ColdTier(spark, f"file://{tmp_path}/t")
    keys = spark.createDataFrame([("a",), ("b",), ("gone",), ("bytes",)], "key string")
    assert tier.get(keys, F.lit(0.0)).count() == 0
    tier.put(spark.createDataFrame([("a", "1", 10.0), ("b", "2", None), ("gone", "3", 0.0)], "key string, value string, ttl double"), F.lit(100.0))
    tier.put(spark.createDataFrame([("a", "new", 5.0)], "key string, value string, ttl double"), F.lit(101.0))
    tier.put(spark.createDataFrame([("bytes", bytearray(b"abc"), None)], "key string, value binary, ttl double"), F.lit(101.0))
    got = {r.key: (r.value, r.ttl_remaining) for r in tier.get(keys, F.lit(103.0)).collect()}
    assert got == {"a": ("new", 3.0), "b": ("2", None), "bytes": ("YWJj", None)}
    assert "a" not in {r.key for r in tier.get(keys, F.lit(106.0)).collect()}
    tier.delete(spark.createDataFrame([("b",), ("never",)], "key string"), F.lit(102.0))
    assert {r.key for r in tier.get(keys, F.lit(103.0)).collect()} == {"a", "bytes"}
    tier.put(spark.createDataFrame([("b", "3", None), ("b", "4", None)], "key string, value string, ttl double"), F.lit(104.0))
    small = tier.compact(f"file://{tmp_path}/u", F.lit(106.0))
    assert {r.key: r.value for r in small.get(keys, F.lit(106.0)).collect()} == {"b": "4", "bytes": "YWJj"}
    assert spark.read.parquet(small.path).count() == 2


def test_settings(spark):
    got = config.checked(config.resolve(config.layers(spark, {"KV_SHARDS": " 16 ", "KV_RATE_LIMIT": "TRUE", "OTHER": "1"}, ['{"shards": 3, "snapshot_seconds": "7", "unknown": 1}', "[]", None])))
    assert (got["shards"], got["rate_limit"], got["snapshot_seconds"]) == ("16", "true", "7.0") and set(got) == {s.name for s in config.SETTINGS}
    for bad in ({"KV_SHARDS": "0"}, {"KV_EVICTION_POLICY": "mru"}, {"KV_TIER": "tape"}):
        with pytest.raises(ValueError):
            config.checked(config.resolve(config.layers(spark, bad)))


def test_policies_changed_in_part(spark):
    schema = "route string, rps double, burst int, per_ip boolean"
    now = spark.createDataFrame([("default", 1.0, 5, False), ("/a", 2.0, 2, True), ("/b", 3.0, 3, True)], schema)
    rows = lambda df: {r.route: (r.rps, r.burst, r.per_ip) for r in df.collect()}
    change = json.dumps({"default_policy": json.dumps({"burst": "7"}), "route_policies": {"/a": None, "/b": {"rps": "fast", "per_ip": "true"}, "/c": {}}})
    assert rows(config.changed_policies(now, change)) == {"default": (1.0, 7, False), "/b": (1.0, 7, True), "/c": (1.0, 7, False)}
    assert rows(config.changed_policies(now, "nothing")) == rows(now)
    assert rows(config.changed_policies(now.where("false"), "{}")) == {"default": (0.0, 0, True)}


def test_dense_numbers(spark):
    rows = [(x % 7, x) for x in random.Random(1).sample(range(500), 500)]
    df = numbered(spark.createDataFrame(rows, "a int, b int"), ["a", "b"], "n", after=10)
    got = [(r.a, r.b) for r in sorted(df.collect(), key=lambda r: r.n)]
    assert got == sorted(rows) and [r.n for r in sorted(df.collect(), key=lambda r: r.n)] == list(range(11, 511))
    assert numbered(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_numbers_as_text(spark):
    rng = random.Random(4)
    odd = [12345678.5, 0.0005, 1e16, 1e-4, 9.999e-5, 0.0, -0.0, 1.0, -2.5, 1e22, 1.5e-7, 9999999999999998.0, float("inf"), float("-inf"), float("nan"), 2.0**63, 1e300, 2.5e-300, 0.1 + 0.2, None]
    values = odd + [rng.uniform(-1, 1) * 10 ** rng.randrange(-20, 25) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(text.number_text(F.col("x")), text.reply_integer(F.col("x"))).collect()
    assert [r[0] for r in rows[:20]] == [None if v is None else str(v) for v in odd]
    for v, r in zip(values[20:], rows[20:], strict=True):
        assert float(r[0]) == v and len(r[0]) <= len(str(v)) + 1 and ("e" in r[0]) == ("e" in str(v))
    short = [round(v, 4) for v in values[20:] if abs(v) < 1e11]
    texts = spark.createDataFrame([(v,) for v in short], "x double").select(text.number_text(F.col("x"))).collect()
    assert [r[0] for r in texts] == [str(v) for v in short]
    assert [r[1] for v, r in zip(values, rows, strict=True) if v is not None and abs(v) < 1e22] == [f":{int(v)}\r\n" for v in values if v is not None and abs(v) < 1e22]
    assert rows[14][1].startswith("-ERR") and rows[19][1] is None
