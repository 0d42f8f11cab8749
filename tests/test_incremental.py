import random

import pytest

from ledgerfold.operators import incremental as inc

ACKS = "stream string, follower string, batch_from long, batch_to long, ok boolean"


def spans(df):
    out = []
    for lo, hi in sorted((r.lo, r.hi) for r in df.collect()):
        if out and lo == out[-1][1] + 1:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def test_merge_and_subtract_against_sets(spark):
    rng = random.Random(3)
    for bits in (2, 12):
        a = [(x, x + rng.randrange(9)) for x in rng.choices(range(200), k=40)] + [(5, 3), (None, 4)]
        b = [(x, x + rng.randrange(9)) for x in rng.choices(range(200), k=25)]
        cover = lambda rows: {n for lo, hi in rows if lo is not None and lo <= hi for n in range(lo, hi + 1)}
        da, db = (spark.createDataFrame(x, "lo long, hi long") for x in (a, b))
        merged = inc.merge_intervals(da, [], "lo", "hi", bits).collect()
        assert cover([(r.lo, r.hi) for r in merged]) == cover(a)
        assert sum(r.hi - r.lo + 1 for r in merged) == len(cover(a))
        gaps = inc.subtract_intervals(da, db, [], "lo", "hi", bits).collect()
        assert cover([(r.lo, r.hi) for r in gaps]) == cover(a) - cover(b)
        assert sum(r.hi - r.lo + 1 for r in gaps) == len(cover(a) - cover(b))


def due(spark, feed, acks, message=("lsn", "op", "key"), stream="s"):
    f = spark.createDataFrame(feed, "batch_id long, lsn long, op string, key string, extra string")
    a = spark.createDataFrame(acks, ACKS)
    return sorted((r.follower, r.lsn) for r in inc.unprocessed(f, list(message), a, stream).collect())


def test_late_failed_repeated_and_null(spark):
    feed = [
        (1, 10, "set", "a", "x"), (3, 10, "set", "a", "y"),  # a copy in a later batch
        (2, 11, "set", "a", None), (2, 11, "set", "b", None), (9, 11, "set", "c", None),  # one message of the lsn came late
        (None, 12, None, None, None), (1, 0, "set", "a", None), (1, None, "set", "a", None),
    ]
    acks = [("s", "f", 1, 2, True), ("s", "f", 1, 2, True), ("s", "f", 9, 9, False), ("s", "f", 9, 9, None), ("s", "g", 3, 3, True), ("s", "never", 1, 9, False), ("other", "h", 1, 9, True), ("s", None, 1, 9, True)]
    got = due(spark, feed, acks)
    assert got == [("f", 11), ("f", 12), ("g", 11), ("g", 12), ("never", 10), ("never", 11), ("never", 12)]


def test_nothing_known(spark):
    assert due(spark, [], [("s", "f", 1, 2, True)]) == []
    assert due(spark, [(1, 1, "set", "a", "x")], []) == []


def test_more_consumers_than_a_word_holds(spark):
    names = [f"f{i:03d}" for i in range(130)]
    acks = [("s", n, i, i, True) for i, n in enumerate(names)]
    got = due(spark, [(i, i + 1, "set", "k", "") for i in range(130)], acks, ("lsn",))
    assert len(got) == 130 * 129 and ("f007", 8) not in got and ("f007", 9) in got


def test_a_run_that_dies_is_taken_again_and_nothing_twice(spark, tmp_path):
    job = inc.IncrementalJob(spark, f"file://{tmp_path}/job")
    rows = lambda ns: spark.createDataFrame([(n, str(n)) for n in ns], "lsn long, v string")

    def dies(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        job.run(rows([1, 2, 5]), dies)
    assert job.output() is None
    job.run(rows([1, 2, 5]), lambda df: df)
    with pytest.raises(RuntimeError):
        job.run(rows([1, 2, 3, 5, 6]), dies)
    job.run(rows([1, 2, 3, 5, 6, None]), lambda df: df)  # 3 came late
    job.run(rows([1, 2, 3, 4, 5, 6]), lambda df: df)
    assert sorted(r.lsn for r in job.output().collect()) == [1, 2, 3, 4, 5, 6]
    assert spans(job.intervals()) == [(1, 6)]


def test_a_long_interval_is_cut_without_a_long_array(spark):
    df = spark.createDataFrame([(5, 5 + (1 << 34)), (0, 3), (4, 4)], "lo long, hi long")
    got = inc.merge_intervals(df, [], "lo", "hi", 20)
    assert got.count() == (1 << 14) + 1
    assert got.selectExpr("sum(hi - lo + 1)").first()[0] == (1 << 34) + 6


def test_ledger_grows_by_what_a_run_adds_and_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inc, "COMPACT_EACH", 3)
    job = inc.IncrementalJob(spark, f"file://{tmp_path}/job")
    for n in range(8):
        job.run(spark.createDataFrame([(n,), (n + 100,)], "lsn long"), lambda df: df)
        assert len(job._last()["ledger"]) <= 4
    assert spans(job.intervals()) == [(0, 7), (100, 107)]
    assert sorted(r.lsn for r in job.output().collect()) == [*range(8), *range(100, 108)]


def test_of_two_runs_at_once_one_commits(spark, tmp_path):
    a, b = (inc.IncrementalJob(spark, f"file://{tmp_path}/job") for _ in range(2))
    feed = spark.createDataFrame([(1,), (2,)], "lsn long")
    with pytest.raises(FileExistsError):
        a.run(feed, lambda df: (b.run(feed, lambda x: x), df)[1])
    assert sorted(r.lsn for r in a.output().collect()) == [1, 2]
    a.clean()
    assert len([x for x in (tmp_path / "job").iterdir() if x.name.startswith("run-")]) == 1
    assert sorted(r.lsn for r in b.output().collect()) == [1, 2]


def test_cells_that_are_too_many_to_broadcast(spark, monkeypatch):
    rng = random.Random(8)
    feed = [(rng.choice([None, *range(40)]), rng.randrange(1, 30), rng.choice(["set", None]), rng.choice(["a", None]), "") for _ in range(400)]
    acks = [("s", f, lo, lo + rng.randrange(9), True) for f in "fgh" for lo in rng.sample(range(40), 3)]
    want = due(spark, feed, acks)
    monkeypatch.setattr(inc, "BROADCAST_CELLS", 0)
    assert want and due(spark, feed, acks) == want
    done = {(f, b) for _, f, lo, hi, _ in acks for b in range(lo, hi + 1)}
    messages = {r[1:4] for r in feed}
    assert want == sorted({(f, m[0]) for f in "fgh" for m in messages if not any((f, r[0]) in done for r in feed if r[1:4] == m)})
