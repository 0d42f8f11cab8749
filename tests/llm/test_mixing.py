import random

from pyspark.sql import functions as F

from ledgerfold.llm import mixing

DOCS = "doc_id long, text string, source string, tokens string, place string"
TARGETS = "mix_name string, source string, weight double, max_repeats int, budget_ratio double"


def run(spark, docs, targets):
    d = mixing.sized(spark.createDataFrame(docs, DOCS).repartition(3))
    planned = mixing.plan(d, spark.createDataFrame(targets, TARGETS))
    return d, planned


def test_names(spark):
    df = spark.createDataFrame([("  Office--Full ",), ("OFFICE_ _full",), (None,), ("a",)], "s string").select(mixing.source_name(F.col("s")).alias("s"))
    assert [r.s for r in df.collect()] == ["office_full", "office_full", None, "a"]


def test_shares_repeats_and_order(spark):
    rng = random.Random(3)
    docs = [(i, "x" * rng.randrange(1, 60), rng.choice(["A", " a", "b", "B ", "c", None]), "t", "p") for i in range(900)] + [(5000, None, "a", None, None), (5001, "", "b", None, None)]
    targets = [("m", "a", 2.0, 1, 0.5), ("m", "b", 1.0, 1, 0.5), ("m", "c", 1.0, 5, 0.5), ("n", "a", 1.0, 3, 2.0), ("n", "c", 9.0, 2, 2.0), ("n", "gone", 1.0, 9, 2.0), ("n", "b", None, 1, 2.0)]
    d, planned = run(spark, docs, targets)
    size = {s: sum(len(t or "") for _, t, x, *_ in docs if (x or "").strip().lower() == s) for s in "abc"}
    total = sum(len(t or "") for _, t, *_ in docs)
    want = {("m", "a"): total * 0.25, ("m", "b"): total * 0.125, ("m", "c"): total * 0.125, ("n", "a"): total * 2 / 11, ("n", "c"): total * 18 / 11, ("n", "gone"): total * 2 / 11, ("n", "b"): 0.0}
    plan = {(r.mix_name, r.source): r for r in planned.collect()}
    reps = {(m, s): n for m, s, _, n, _ in targets}
    assert {k: round(r.target, 6) for k, r in plan.items()} == {k: round(v, 6) for k, v in want.items()}
    mixed = mixing.mix(d, planned)
    short = {(r.mix_name, r.source) for r in mixing.short_sources(mixed, planned).collect()}
    assert short == {k for k, v in want.items() if v > reps[k] * size.get(k[1], 0)}
    for r in mixing.checks(mixed, planned).collect():
        k = r.mix_name, r.source
        assert (r.reached, r.within_repeats, r.follows, r.all_given) == (True, True, True, reps[k] * size.get(k[1], 0) if k in short else None), k
    rows = mixed.collect()
    for k, v in want.items():
        own = [r for r in rows if (r.mix_name, r.source) == k]
        grant = min(v, reps[k] * size.get(k[1], 0))
        assert grant <= sum(r.tokens for r in own) < grant + 60 or grant == 0 == len(own)
        assert all(r["pass"] < reps[k] for r in own)
        assert len({(r.doc_id, r["pass"]) for r in own}) == len(own)
        assert all(0 <= r.position <= 1 for r in own)
    got = {(r.mix_name, r.source): r for r in mixing.shares(mixed, planned).collect()}
    for m in "mn":
        assert abs(sum(r.actual_share for k, r in got.items() if k[0] == m) - 1) < 1e-5
    assert got["n", "gone"].actual_tokens == 0
    # range-sorted: partitions follow each other and are sorted within
    placed = mixed.withColumn("p", F.spark_partition_id()).collect()
    keys = [(r.p, r.mix_name, r.position) for r in placed]
    assert keys == sorted(keys) and [k[1:] for k in keys] == sorted(k[1:] for k in keys)


def test_curriculum_runs_late_or_early(spark):
    for knots, early in ((mixing.ONCE, True), (mixing.REPEATED, False), ((1.0, 1.0), None), ((0.0, 2.0), False), ((2.0, 0.0, 1.0, 3.0), None)):
        xs = mixing.integrated(spark.range(0, 1001).select((F.col("id") / 1000).alias("x"), F.array(*map(F.lit, knots)).alias("knots")))
        rows = xs.withColumn("t", mixing.position("x")).withColumn("back", mixing.given_by("t")).orderBy("x").collect()
        assert all(abs(r.back - r.x) < 1e-6 for r in rows)
        ts = [r.t for r in rows]
        assert ts == sorted(ts) and ts[0] == 0 and abs(ts[-1] - 1) < 1e-9
        n = len(knots) - 1
        area = sum((a + b) / 2 for a, b in zip(knots, knots[1:], strict=False))

        def given(t, knots=knots, n=n, area=area):
            out = 0.0
            for i in range(n):
                u = min(max(t * n - i, 0.0), 1.0)
                out += knots[i] * u + (knots[i + 1] - knots[i]) * u * u / 2
            return out / area

        assert all(abs(given(r.t) - r.x) < 1e-6 for r in rows)
        if early is not None:
            assert (ts[500] < 0.5) == early


def test_a_source_of_copies_and_nothing(spark):
    d, planned = run(spark, [(1, "abcd", "a", None, None)] * 50, [("m", "a", 1.0, 1, 1.0)])
    assert mixing.mix(d, planned).agg(F.sum("tokens")).first()[0] == 200
    d, planned = run(spark, [], [("m", "a", 1.0, 1, 1.0)])
    assert mixing.mix(d, planned).count() == 0 and mixing.short_sources(mixing.mix(d, planned), planned).count() == 0
    d, planned = run(spark, [(1, "abcd", "a", None, None)], [])
    assert mixing.mix(d, planned).count() == 0


def test_schedules_as_input(spark):
    docs = [(i, "x" * 10, "ab"[i % 2], None, None) for i in range(2000)]
    d = mixing.sized(spark.createDataFrame(docs, DOCS))
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 0.5), ("m", "b", 1.0, 1, 0.5), ("flat", "a", 1.0, 1, 0.5), ("bad", "a", 1.0, 1, 0.5)], TARGETS)
    knots = spark.createDataFrame([("m", "a", [1.0, 0.0]), ("m", "b", [0.0, 1.0]), ("flat", "a", [2.0, 2.0, 2.0]), ("bad", "a", [None, -1.0]), ("other", "z", [1.0])], "mix_name string, source string, knots array<double>")
    planned = mixing.plan(d, targets, knots)
    got = {(r.mix_name, r.source, r.part): r.tokens for r in mixing.composition(mixing.mix(d, planned), planned, 4).collect()}
    for part in range(4):  # areas of a falling and a rising line
        assert abs(got["m", "a", part] - 5000 * (7 - 2 * part) / 16) <= 20 and abs(got["m", "b", part] - 5000 * (1 + 2 * part) / 16) <= 20
        assert abs(got["flat", "a", part] - 2500) <= 20 and abs(got["bad", "a", part] - 2500) <= 20


def test_order_does_not_follow_the_splits(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 3)
    docs = [(i % 40, "x" * (i % 40), "a", None, None) for i in range(300)]
    orders = []
    for parts in (1, 7):
        d = mixing.sized(spark.createDataFrame(docs, DOCS).repartition(parts))
        assert d.count() == 300 and d.select("place").distinct().count() == 300
        planned = mixing.plan(d, spark.createDataFrame([("m", "a", 1.0, 3, 2.2)], TARGETS))
        orders.append([tuple(r) for r in mixing.mix(d, planned).collect()])
    assert orders[0] == orders[1]
