import importlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import commands, eviction, reads, routing
from ledgerfold.operators.fold import fold, keyspace_events, state
from ledgerfold.plans import store

LOG = "lsn long, op string, key string, value double, live string"


def brute(rows):
    """The store, one command after the other."""
    held, out = {}, {}
    for lsn, op, key, value, _ in sorted(rows):
        v = value or 0.0
        if op == "flush":
            held.clear()
            continue
        if key is None or op not in ("create", "update", "put", "delete", "incr", "read"):
            continue
        there = key in held
        ok = op in ("put", "incr") or (op == "create") != there
        if ok and op in ("create", "update", "put"):
            held[key] = v
        elif ok and op == "delete":
            del held[key]
        elif op == "incr":
            held[key] = held.get(key, 0.0) + v
        out[lsn] = (there, ok, held.get(key))
    return held, out


@pytest.mark.parametrize("bits, told", [(1, 1000), (3, 1), (16, 1000)])
def test_fold_against_the_store(spark, monkeypatch, bits, told):
    monkeypatch.setattr(importlib.import_module("ledgerfold.operators.fold"), "MOST_FLUSHES", told)
    rng = random.Random(bits)
    for flushes in ([], [60, 61, 200]):
        rows = [(n, rng.choice(["create", "update", "put", "delete", "incr", "read", "what", None]), rng.choice(["a", "b", "ключ", None]), rng.choice([1.0, 2.5, None]), "x") for n in range(1, 300)]
        rows = [r if r[0] not in flushes else (r[0], "flush", None, None, None) for r in rows]
        log = spark.createDataFrame(rows, LOG).repartition(4)
        folded = fold(log, bits)
        held, want = brute(rows)
        got = {r.lsn: (r.live, r.accepted, r.value_after) for r in folded.collect()}
        assert got == want
        assert {r.key: r.value for r in state(log, bits).collect()} == held
        told = {(r.lsn, r.op) for r in keyspace_events(folded).collect()}
        assert told == {(n, "del" if op == "delete" else "set") for n, op, *_ in rows if n in want and want[n][1] and op != "read"}


def test_fold_of_nothing(spark):
    assert fold(spark.createDataFrame([], LOG)).count() == 0


def replay(spark, rows, capacity, policy="lru", spill=False):
    full = [(0, n, float(r[4] if len(r) > 4 else n), *r[:3], r[3] if len(r) > 3 else None) for n, r in enumerate(rows)]
    df = spark.createDataFrame(full, "shard int, lsn long, now double, op string, key string, value double, ttl double")
    return [(r.lsn, r.action, r.key, r.value) for r in eviction.replay(df, capacity, policy, spill).orderBy("lsn").collect()]


def left(actions):
    held = {}
    for _, action, key, value in actions:
        if action in ("write", "promote"):
            held[key] = value
        elif action in ("evict", "spill", "delete", "expire"):
            held.pop(key, None)
    return held


def test_lru_victim(spark):
    rows = [("create", "p", 1.0), ("create", "q", 2.0), ("read", "p", None), ("create", "r", 3.0)]
    assert left(replay(spark, rows, 2)) == {"p": 1.0, "r": 3.0}


def test_lfu_victim(spark):
    rows = [("create", "p", 1.0), ("create", "q", 2.0), ("read", "q", None), ("read", "q", None), ("create", "r", 3.0)]
    assert left(replay(spark, rows, 2, "lfu")) == {"q": 2.0, "r": 3.0}


@pytest.mark.parametrize("policy", ["lru", "lfu"])
def test_spill_and_promote(spark, policy):
    rows = [("create", "a", 1.0), ("create", "b", 2.0), ("read", "a", None), ("read", "zz", None)]
    actions = replay(spark, rows, 1, policy, True)
    assert (2, "promote", "a", 1.0) in actions and (2, "hit", "a", 1.0) in actions and (3, "miss", "zz", None) in actions


def test_spilled_keys_count_as_absent_for_writes(spark):
    rows = [("create", "a", 5.0), ("create", "b", 1.0), ("update", "a", 9.0), ("incr", "a", 2.0)]
    actions = replay(spark, rows, 1, "lru", True)
    assert (2, "refuse", "a", None) in actions and (3, "write", "a", 2.0) in actions


def test_expiry(spark):
    rows = [("create", "x", 99.0, 0.1, 0.0), ("read", "x", None, None, 0.05), ("read", "x", None, None, 0.2), ("create", "y", 1.0, 1.0, 1.0), ("update", "y", 2.0, None, 1.5), ("read", "y", None, None, 1.9), ("read", "y", None, None, 2.0)]
    said = [a for _, a, _, _ in replay(spark, rows, 0)]
    assert said == ["write", "hit", "expire", "miss", "write", "write", "hit", "expire", "miss"]


def test_batch_set_and_expiry_by_policy(spark):
    rows = [("create", "k", 1.0, 1.0, 0.0), ("mset", "k", 2.0, None, 0.5), ("read", "k", None, None, 5.0)]
    assert replay(spark, rows, 0, "lru")[-1][1] == "hit"
    assert replay(spark, rows, 0, "lfu")[-1][1] == "miss"


def test_lru_rank_equals_replay_for_accesses(spark):
    rng = random.Random(6)
    trace = [(n % 3, n, float(n), "put", f"k{rng.randrange(40)}", 1.0, None) for n in range(500)]
    df = spark.createDataFrame(trace, "shard int, lsn long, now double, op string, key string, value double, ttl double")
    held = {}
    for r in eviction.replay(df, 5).orderBy("lsn").collect():
        s = held.setdefault(r.shard, set())
        s.add(r.key) if r.action == "write" else s.discard(r.key)
    hot = {}
    for r in eviction.ranked(eviction.touches(df), 5).where("hot").collect():
        hot.setdefault(r.shard, set()).add(r.key)
    assert hot == held


def test_policies_and_tiers_that_there_are():
    routing.check_policy("LRU", "file")
    for bad in (("mru", ""), ("lru", "tape")):
        with pytest.raises(ValueError):
            routing.check_policy(*bad)
    with pytest.raises(ValueError):
        routing.ring(0)


def test_routing(spark):
    keys = ["user:{42}:profile", "user:{42}:settings", "{}{b}", "a}{b}c", "{a{b}c}", "x{a", "", "ключ", "plain", None]
    df = spark.createDataFrame([(k, 9, "e") for k in keys], "key string, shard int, extra string")
    got = {r.key: r.shard for r in routing.with_shard(df, 7).collect()}
    assert got[keys[0]] == got[keys[1]] and got[None] is None
    ring = sorted((zlib.crc32(f"shard_{s}_v_{v}".encode()), s) for s in range(7) for v in range(routing.VNODES))
    for k in keys[:-1]:
        tag = k[k.find("{") + 1 : k.find("}", k.find("{"))] if "{" in k and k.find("}", k.find("{")) > k.find("{") + 1 else k
        h = zlib.crc32(tag.encode())
        assert got[k] == next((s for p, s in ring if p >= h), ring[0][1]) == routing.shard_of(k, 7)


def test_keys_without_a_known_shard_are_routed(spark, tmp_path):
    rows = [("user:{42}:a", None), ("user:{42}:b", 3), ("user:{42}:b", None), ("plain", None), ("", None)]
    spark.createDataFrame(rows, "key string, shard int").write.parquet(f"{tmp_path}/keyspace_event.parquet")
    got = {n: store.QUERIES[n](spark, str(tmp_path)).collect() for n in ("rt01_all_keys", "rt03_all_keys", "rt04_all_keys")}
    keys = {k for k, _ in rows}
    assert {r.key: r.material for r in got["rt01_all_keys"]} == {k: "42" if "{42}" in k else k for k in keys}
    shards = {k: routing.shard_of(k, store.SHARDS) for k in keys}
    assert {r.key: r.shard for r in got["rt03_all_keys"]} == shards and len(got["rt03_all_keys"]) == len(keys)
    assert {r.shard: r["keys"] for r in got["rt04_all_keys"]} == Counter(shards.values())


def test_uses_without_an_lsn_count(spark, tmp_path):
    rows = [("a", "set", 5, 1.0), ("a", "expire", 5, 1.0), ("a", " SET", 5, 2.0), ("b", "set", 0, 1.0), ("b", "SET ", 0, 1.0), ("b", "set", 0, 2.0), ("b", "set", None, None), ("c", "set", 0, 3.0), ("c", "set", 9, 3.0)]
    spark.createDataFrame([(*r, None) for r in rows], "key string, op string, lsn long, ts double, shard int").write.parquet(f"{tmp_path}/keyspace_event.parquet")
    spark.createDataFrame([("b",), ("x",)], "key string").write.parquet(f"{tmp_path}/ops.parquet")
    ask = lambda n: store.QUERIES[n](spark, str(tmp_path)).collect()
    want = {"a": (2, 5), "b": (3, 0), "c": (2, 9)}
    for n in ("ev01_lru_all", "ev02_lfu_all", "ev03_touch_all"):
        assert {r.key: (r.freq, r.last_seq) for r in ask(n)} == want, n
    assert sum(r["keys"] for r in ask("ev04_spill_all")) == 3
    assert [(r.key, r.tier) for r in ask("jn04_read_through_all")] == [("b", "hot")]


def test_reads(spark):
    st = spark.createDataFrame([("foo", "1", None), ("foo2", "2", None), ("bar", "3", None), ("fop", "4", None), ("a", "5", None), ("c", "6", None), (None, "7", None)], "key string, value string, expire_at timestamp")
    keys = spark.createDataFrame([("a",), ("c",), ("x",), ("a",), (None,)], "key string")
    assert {r.key: r.value for r in reads.mget(st, keys).collect()} == {"a": "5", "c": "6"}
    assert reads.exists(st, keys).first().hits == 3
    assert [r.key for r in reads.scan(st, "fo").collect()] == ["foo", "foo2", "fop"]
    assert [r.key for r in reads.scan(st, "fo", 5, "foo").collect()] == ["foo2", "fop"]
    assert reads.scan(st, None, 0).count() == 0 and reads.scan(st, limit=-1).count() == 0
    new = spark.createDataFrame([("a", "new", None), ("n", "new", None)], "key string, value string, expire_at timestamp")
    assert {r.key: r.value for r in reads.create_all(st, new).where("key IN ('a', 'n')").collect()} == {"a": "5", "n": "new"}
    assert {r.key: r.value for r in reads.update_all(st, new).where("key IN ('a', 'n')").collect()} == {"a": "new"}
    assert reads.delete_all(st, keys).count() == 5


def test_counters_in_replies(spark):
    log = spark.createDataFrame([(1, "SET", "n", 10.0), (2, "INCR", "n", None), (3, "INCRBY", "n", 5.5), (4, "GET", "n", None), (5, "DECR", "n", None), (6, "DEL", "n", None), (7, "GET", "n", None), (8, "NOPE", "n", None), (9, "decrby", "m", 2.0)], "lsn long, command string, key string, value double")
    got = {r.lsn: r.reply for r in commands.wire_replies(log).collect()}
    assert [got[n] for n in range(1, 10)] == ["+OK\r\n", ":11\r\n", ":16\r\n", "$4\r\n16.5\r\n", ":15\r\n", ":1\r\n", "$-1\r\n", "-ERR unknown command 'NOPE'\r\n", ":-2\r\n"]


def test_web_statuses(spark):
    log = spark.createDataFrame([(1, "GET", "k", None), (2, "PUT", "k", 1.0), (3, "PUT", "k", 2.0), (4, "INCR", "k", 5.5), (5, "GET", "k", None), (6, "DELETE", "k", None), (7, "DELETE", "k", None), (8, "PUT", "", 1.0)], "lsn long, method string, key string, value double")
    got = {r.lsn: (r.status, r.body) for r in commands.web_replies(log).collect()}
    assert [got[n][0] for n in range(1, 9)] == [404, 201, 204, 200, 200, 204, 404, 404]
    assert got[5][1] == '{"key": "k", "value": 7.5}'


def test_read_through(spark):
    hot = spark.createDataFrame([("a", "1")], "key string, value string")
    cold = spark.createDataFrame([("a", "old"), ("b", "2")], "key string, value string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "key string")
    assert sorted(tuple(r) for r in reads.read_through(hot, cold, keys).collect()) == [("a", "1", "hot"), ("b", "2", "cold")]


def test_expire_at_moves_and_dumps(spark):
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    st = spark.createDataFrame([(0, "k", "v"), (1, "n", "w")], "shard int, key string, value string").withColumn("expire_at", F.when(F.col("key") == "k", now + F.expr("INTERVAL 10 SECONDS")))
    dumped = reads.dump(st, now)
    assert {r.key: r.ttl for r in dumped.collect()} == {"k": 10.0, "n": None}
    later = now + F.expr("INTERVAL 1 DAY")
    back = reads.load(dumped, later)
    assert reads.live(back, later + F.expr("INTERVAL 9 SECONDS")).count() == 2
    assert reads.expired(back, later + F.expr("INTERVAL 10 SECONDS")).count() == 1
