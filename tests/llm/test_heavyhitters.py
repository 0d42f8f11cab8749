import random
from collections import Counter

import pytest

from ledgerfold.llm import heavyhitters


def exact_top(rows, k):
    out = set()
    for g in {g for g, _ in rows}:
        c = Counter(i for h, i in rows if h == g and i is not None)
        out |= {(g, i, n) for i, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k]}
    return out


@pytest.mark.parametrize("held, broadcast", [(2_000_000, 100_000), (300, 0)])
def test_top_items_with_ties_nulls_and_pruning(spark, monkeypatch, held, broadcast):
    monkeypatch.setattr(heavyhitters, "HELD", held)
    monkeypatch.setattr(heavyhitters, "BROADCAST_ROWS", broadcast)
    rng = random.Random(9)
    rows = [(rng.choice(["set", "del", None]), rng.choice([None, "a", "b", "c", "d"] + [f"r{rng.randrange(4000)}" for _ in range(4)])) for _ in range(6000)]
    rows += [("one", "x"), ("flat", "b"), ("flat", "a"), ("void", None)]
    df = spark.createDataFrame(rows, "op string, key string").repartition(6)
    for k in (3, 10):
        for eps in (1 / 50, 1 / 20000):  # the first prunes so much that intervals cannot tell
            got = {(r.grp, r.item, r.n) for r in heavyhitters.top_items(df, "op", "key", k, eps).collect()}
            assert got == exact_top(rows, k), (k, eps)


def test_intervals_hold_the_count_and_are_narrow(spark):
    rng = random.Random(11)
    rows = [("g", "hot" if rng.random() < 0.3 else f"r{rng.randrange(3000)}") for _ in range(20000)]
    df = spark.createDataFrame(rows, "op string, key string").repartition(4)
    true = Counter(i for _, i in rows)
    eps = 1 / 100
    listed = {r.item: (r.low, r.high) for r in heavyhitters.lossy_counts(df, "op", "key", eps).collect()}
    missed = listed.pop(None)[1]
    assert len(listed) < len(true) / 2
    assert all(lo <= true[i] <= hi and hi - lo <= eps * len(rows) + 4 for i, (lo, hi) in listed.items())
    assert all(n <= missed for i, n in true.items() if i not in listed)


def test_memory_of_a_split_is_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(heavyhitters, "HELD", 1000)
    batches = (pa.RecordBatch.from_pydict({"grp": pa.array([f"g{(i * 50 + j) % 700}" for j in range(50)]), "item": pa.array([f"v{i}-{j}" for j in range(50)])}) for i in range(200))
    out = list(heavyhitters._summaries(20_000)(batches))
    total = sum(sum(b.column("n").to_pylist()) for b in out)
    most = max(b.num_rows for b in out)
    assert total == 200 * 50 and most <= 1051 and len(out) > 700


def test_no_rows(spark):
    assert heavyhitters.top_items(spark.createDataFrame([], "op string, key string"), "op", "key").count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("a", "x", 1, 2), ("a", "x", 3, 4), ("a", None, 5, 6)], "grp string, item string, n int, low int")
    assert [(r.grp, r.item, r.n) for r in heavyhitters.top_items(df, "grp", "item").collect()] == [("a", "x", 2)]
