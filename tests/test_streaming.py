from pyspark.sql import functions as F

from ledgerfold.operators.fold import state
from ledgerfold.streaming.expiry import expire_events, keyspace_stream
from ledgerfold.streaming.live import LiveState

LOG = "lsn long, op string, key string, value double"


def test_live_state_over_batches_and_restarts(spark, tmp_path):
    rows = [(n, ["create", "incr", "update", "delete"][n * 7 % 4], f"k{n % 5}", float(n)) for n in range(1, 80)]
    folder = f"{tmp_path}/in"
    schema = spark.createDataFrame(rows, LOG).schema
    for part in (rows[:30], rows[30:60], rows[60:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(folder)
        LiveState(spark, f"file://{tmp_path}/live", 4).run(spark.readStream.schema(schema).parquet(folder))
    live = LiveState(spark, f"file://{tmp_path}/live", 4)
    want = {(r.key, r.value) for r in state(spark.createDataFrame(rows, LOG)).collect()}
    assert {(r.key, r.value) for r in live.read().collect()} == want
    live.process(spark.createDataFrame(rows, LOG), 0)  # a batch that was committed
    assert {(r.key, r.value) for r in live.read().collect()} == want


def test_expire_events(spark, tmp_path):
    rows = [(1, 100, "create", "a", 5.0), (2, 101, "create", "b", None), (3, 102, "create", "c", 100.0), (4, 103, "delete", "c", None), (5, 104, "update", "a", None), (6, 160, "create", "d", 1.0), (7, 300, "create", "z", None)]
    folder = f"{tmp_path}/in"
    schema = "lsn long, t long, op string, key string, ttl double"
    for part in (rows[:5], rows[5:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.createDataFrame(rows, schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    events = expire_events(stream.withColumn("at", F.timestamp_seconds("t")), "1 second")
    q = events.writeStream.format("memory").queryName("gone").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.op, r.key, r.at.timestamp()) for r in spark.table("gone").collect()}
    assert got == {("expire", "a", 105.0), ("expire", "d", 161.0)}


def test_keyspace_stream(spark, tmp_path):
    rows = [(1, " CREATE", "a"), (2, "delete", "a"), (3, "read", "a"), (4, None, "a")]
    spark.createDataFrame(rows, "lsn long, op string, key string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("lsn long, op string, key string").parquet(f"{tmp_path}/in")
    q = keyspace_stream(stream).writeStream.format("memory").queryName("told").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted((r.lsn, r.op) for r in spark.table("told").collect()) == [(1, "set"), (2, "del")]
