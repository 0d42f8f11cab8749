import random

from pyspark.sql import functions as F

from ledgerfold.operators import dedupe

SCHEMA = "delivery_id long, lsn long, op string, key string, ts double, seconds int"


def store(spark, tmp_path, name="s", delay=50.0):
    ids, columns = dedupe.message_ids("keyspace_event")
    made = dedupe.SeenStore(spark, f"file://{tmp_path}/{name}", ids, "delivery_id", F.col("__seconds"), dedupe.message_slot(), delay)
    return made, lambda rows: spark.createDataFrame(rows, SCHEMA).select("delivery_id", *columns, dedupe.event_seconds("keyspace_event").alias("__seconds"))


def brute(rows):
    seen, copies = {}, set()
    for r in sorted(rows):
        i = (r[1], (r[2] or "").strip().lower(), r[3]) if (r[1] or 0) > 0 else (0, (r[2] or "").strip().lower(), r[3], r[4])
        copies.add(r[0]) if i in seen else seen.setdefault(i, r[0])
    return copies


def some_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        lsn = rng.choice([0, 0, None, 7, 7, 7, rng.randrange(1, 60), 3_000_000 + rng.randrange(5)])
        rows.append((d, lsn, rng.choice(["set", " SET", "del", "expire "]), rng.choice(["a", "b", None]), rng.choice([None, float(d), 5.0, 1e12, 1e30, float("-inf")]), 1))
    return rows


def test_one_file_comes_in_several_batches(spark, data, monkeypatch):
    from ledgerfold.plans import problems

    seen = []
    process = dedupe.SeenStore.process
    monkeypatch.setattr(dedupe.SeenStore, "process", lambda self, rows, batch: (seen.append((batch, rows.count())), process(self, rows, batch)))
    copies = problems._copies_of(spark, data, "ops")
    rows = spark.read.parquet(f"{data}/ops.parquet")
    assert [b for b, _ in seen] == [0, 1, 2] and all(n for _, n in seen) and sum(n for _, n in seen) == rows.count()
    assert copies.count() == rows.count() - rows.select(*dedupe.message_ids("ops")[1]).distinct().count()


def test_any_batches_any_order(spark, tmp_path):
    rows = some_rows(300, 1)
    for name, order in (("in order", rows), ("shuffled", random.Random(2).sample(rows, len(rows)))):
        s, df = store(spark, tmp_path, name.replace(" ", ""))
        for b in range(4):
            s.process(df(order[b * 75 : (b + 1) * 75]), b)
        got = [r.delivery_id for r in s.copies().collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows), name


def test_expired_identifiers_are_looked_up(spark, tmp_path):
    s, df = store(spark, tmp_path, delay=1.0)
    s.process(df([(1, 5, "set", "a", 100.0, 0), (2, 0, "set", "a", 100.0, 0)]), 0)
    s.process(df([(3, 6, "set", "a", 9000.0, 0)]), 1)
    s.process(df([(4, 7, "set", "a", 99000.0, 0)]), 2)
    s.process(df([(5, 5, "SET ", "a", None, 0), (6, 0, "set", "a", 100.0, 0), (7, 7, "set", "a", 99000.0, 0)]), 3)
    assert sorted(r.delivery_id for r in s.copies().collect()) == [5, 6, 7]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    s, df = store(spark, tmp_path)
    rows = [(1, 5, "set", "a", 1.0, 0), (2, 5, "set", "a", 1.0, 0)]
    s.process(df(rows), 0)
    s.process(df(rows), 0)
    again, _ = store(spark, tmp_path)
    again.process(df([]), 1)
    assert [r.delivery_id for r in again.copies().collect()] == [2]


def test_none_and_exactly_once_keeps_columns(spark, tmp_path):
    s, df = store(spark, tmp_path, "none")
    assert s.copies().count() == 0
    s.process(df([(1, 5, "set", "a", 1.0, 0), (2, 5, "set", "a", 1.0, 0)]), 0)
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "delivery_id long, seconds string")
    assert sorted(tuple(r) for r in dedupe.exactly_once(rows, s.copies(), "delivery_id").collect()) == [(1, "x"), (3, None)]


def test_as_a_stream_with_offsets(spark, tmp_path):
    ids, columns = dedupe.message_ids("keyspace_event")
    folder = f"{tmp_path}/in"
    rows = some_rows(120, 4)
    schema = spark.createDataFrame(rows, SCHEMA).schema
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder).select("delivery_id", *columns, F.col("ts").alias("__seconds"))
        s = dedupe.SeenStore(spark, f"file://{tmp_path}/store", ids, "delivery_id", F.col("__seconds"), dedupe.message_slot())
        s.run(stream)
    assert {r.delivery_id for r in s.copies().collect()} == brute(rows)


def test_many_batches_keep_few_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedupe, "FAN", 3)
    monkeypatch.setattr(dedupe, "MOST_SLOTS", 2)
    s, df = store(spark, tmp_path, delay=1.0)
    rows = some_rows(150, 9)
    sizes = []
    for b in range(15):
        s.process(df(rows[b * 10 : b * 10 + 10]), b)
        sizes.append(len(s._manifest()["cold"]))
    assert {r.delivery_id for r in s.copies().collect()} == brute(rows)
    assert max(sizes) <= 6 and len(s._commits()) == 2
    kept = {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("v") and any(p.iterdir())}
    tables = {x.name for v in kept for x in (tmp_path / "s" / v).iterdir() if x.is_dir()}
    assert any(t.startswith("level=") for t in tables)


def test_nothing_kills_the_stream(spark, tmp_path):
    s, df = store(spark, tmp_path)
    rows = [(i, 0, "set", "a", t, 0) for i, t in enumerate([float("nan"), 1e30, -1e30, float("inf"), None, float("nan"), 1e30])]
    s.process(df(rows[:4]), 0)
    s.process(df(rows[4:]), 1)
    assert sorted(r.delivery_id for r in s.copies().collect()) == [5, 6]
