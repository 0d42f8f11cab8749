import json
import random

from pyspark.sql import functions as F

from ledgerfold.operators import cdc

OPS = "delivery_id long, lsn long, op string, key string, value string, delta double, extra int"
SNAP = "key string, value string, snapshot_lsn long, extra int"


def number(v):
    x = json.loads(v)
    if isinstance(x, bool):
        return None
    if isinstance(x, (int, float)):
        return float(x)
    if isinstance(x, str):
        try:
            return float(x)
        except ValueError:
            return None
    return None


def brute(snap, ops, upto=None):
    start = max((r[2] for r in snap), default=0)
    state = {r[0]: (r[1] if r[1] is not None else "null", start) for r in snap if r[0] is not None}
    first = {}
    for r in sorted(ops):
        if r[1] is not None and r[1] > max(start, 0) and (upto is None or r[1] <= upto):
            first.setdefault(r[1], r)
    for lsn, (_, _, op, key, value, delta, _) in sorted(first.items()):
        op = (op or "").strip().lower()
        if op == "mset":
            try:
                m = json.loads(key)
            except (TypeError, ValueError):
                continue
            for k, v in m.items() if isinstance(m, dict) else ():
                state[k] = (json.dumps(v, separators=(",", ":"), ensure_ascii=False), lsn)
            continue
        if key is None:
            continue
        if op == "create" or (op == "update" and key in state):
            state[key] = (value if value is not None else "null", lsn)
        elif op == "delete":
            state.pop(key, None)
        elif op == "incr":
            step = delta if delta is not None else number(value) if value is not None and number(value) is not None else 1.0
            old = number(state[key][0]) if key in state else 0.0
            if old is not None:
                state[key] = (str(old + step), lsn)
    return state


def check(spark, snap, ops, bits, upto=None):
    s, o = spark.createDataFrame(snap, SNAP), spark.createDataFrame(ops, OPS).withColumn("batch_id", F.col("delivery_id"))
    for fan in (10, 1, 2):  # summaries in one round, and in many
        got = {r.key: (r.value, r.lsn) for r in cdc.replay(s, o, upto, bits, fan).collect()}
        assert got == brute(snap, ops, upto), fan


VALUES = ["1", "2.5", '"7"', '" 8.5 "', '"v"', "null", "true", '{"b":1,"a":[1,null]}', None, "-3", '"x \\" y"']


def some_ops(rng, n, keys):
    out = []
    for d in range(n):
        lsn = rng.choice([0, None, *[rng.randrange(1, 90) for _ in range(12)]])
        op = rng.choice(["create", "update", "delete", "incr", " INCR", "Mset", "noop", None])
        if op == "Mset":
            m = {rng.choice(keys): rng.choice([1, "5", "s", None, {"q": [1]}, 2.5]) for _ in range(2)}
            key = rng.choice([json.dumps(m), "no json", "[1]"])
        else:
            key = rng.choice([*keys, None])
        incr = op and "ncr" in op.lower()
        out.append((d, lsn, op, key, rng.choice(["2", None, "0.5"]) if incr else rng.choice(VALUES), rng.choice([1.0, -0.5, None]) if incr else None, d))
    # copies of an lsn are one change
    by = {}
    return [r if not r[1] else (r[0], *by.setdefault(r[1], r)[1:6], r[6]) for r in out]


def test_random_feeds_in_blocks_of_any_size(spark):
    rng = random.Random(21)
    for trial in range(4):
        keys = ["a", "ключ", "user:{1}"][: 1 + trial % 3]
        ops = some_ops(rng, 150, keys)
        rng.shuffle(ops)
        snap = [("a", '"7"', 10, 1), ("a", '"7"', 10, 2), ("z", None, 10, 1), (None, "1", 10, 1)] if trial % 2 else []
        check(spark, snap, ops, (1, 4, 16)[trial % 3])


def test_empty(spark):
    check(spark, [], [], 16)
    check(spark, [("a", "1", 5, 0)], [], 16)


def test_first_delivery_of_an_lsn_counts(spark):
    check(spark, [], [(2, 1, "create", "a", "1", None, 0), (1, 1, "create", "a", "2", None, 0), (3, 1, "incr", "a", None, 5.0, 0)], 16)


def test_watermark_holds_at_the_first_gap(spark):
    rows = lambda ns: spark.createDataFrame([(n,) for n in ns], "lsn long")
    for bits in (1, 2, 16):
        assert cdc.contiguous_watermark(rows([]), 4, bits) == 4
        assert cdc.contiguous_watermark(rows([6, 7]), 4, bits) == 4
        assert cdc.contiguous_watermark(rows([3, 5, 6, 6, 8, 0]), 4, bits) == 6
        assert cdc.contiguous_watermark(rows(range(5, 60)), 4, bits) == 59
        assert cdc.contiguous_watermark(rows([n for n in range(5, 60) if n != 33]), 4, bits) == 32
    ops = [(n, n, "create", f"k{n}", "1", None, 0) for n in (1, 2, 4)]
    check(spark, [], ops, 16, upto=2)


def test_gaps_declared_lost(spark):
    df = spark.createDataFrame([(1, 5), (2, 7), (3, 8), (9, 10), (10, 9), (10, 12)], "batch_id long, lsn long")
    assert cdc.settled(df, 4, 7) == 8 and cdc.contiguous_watermark(df, 8) == 10
    assert cdc.settled(df, 4, 100) == 4 and cdc.settled(df, 4) == 12 and cdc.settled(df.where("false"), 4) == 4
