import random
from collections import Counter

from ledgerfold.operators import hotkeys


def test_per_key_against_counter(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["", None, "ключ"] + [f"k{i}" for i in range(40)]), None if rng.random() < 0.2 else 3, rng.choice([None, float("nan"), 1.5, 2.5, -4.0]), "x") for _ in range(3000)]
    df = spark.createDataFrame(rows, "key string, shard int, ts double, n string").repartition(5)
    want = {}
    for k, s, t, _ in rows:
        e = want.setdefault(k, [0, None, None, None])
        e[0] += 1
        e[1] = s if s is not None else e[1]
        if t is not None and t == t:
            e[2] = t if e[2] is None else min(e[2], t)
            e[3] = t if e[3] is None else max(e[3], t)
    got = {r.key: [r.n, r.shard, r.first_ts, r.last_ts] for r in hotkeys.per_key(df).collect()}
    assert got == want
    hot = {r.key for r in hotkeys.hot_keys(df, 5).collect()}
    assert hot == {k for k, e in want.items() if k is not None and e[0] * 20 >= len(rows)}
    per_shard = {r.shard: r.n for r in hotkeys.per_shard(hotkeys.per_key(df)).collect()}
    assert sum(per_shard.values()) == len(rows)


def test_small_dictionaries_are_handed_on(spark):
    run = hotkeys._split(3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"key": pa.array(["a", "b", "a", None]), "shard": pa.array([1, None, None, 2], pa.int32()), "ts": pa.array([1.0, None, 3.0, 2.0])})
    old, hotkeys.ENTRIES = hotkeys.ENTRIES, 2
    try:
        out = [r for b in run(iter([batch, batch])) for r in pa.Table.from_batches([b]).to_pylist()]
    finally:
        hotkeys.ENTRIES = old
    total = Counter()
    for r in out:
        total.update(dict(zip(r["keys"], r["n"], strict=True)))
    assert total == {"a": 4, "b": 2, None: 2}


def test_no_rows(spark):
    df = spark.createDataFrame([], "key string, shard int, ts double")
    assert hotkeys.per_key(df).count() == 0 and hotkeys.hot_keys(df).count() == 0
