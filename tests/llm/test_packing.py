import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import packing

SPECS = [("s", 10), ("m", 25), ("m2", 25), ("big", 60), ("none", None), ("zero", 0)]


def packed(spark, docs, specs=SPECS, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string, bin string, size long").repartition(parts)
    return packing.pack(d, spark.createDataFrame(specs, "spec_name string, capacity_tokens long"))


def check(rows, docs):
    sizes = sorted(len((t or "").encode()) for _, t, *_ in docs)
    for spec, cap in SPECS:
        own = [r for r in rows if r.spec_name == spec]
        if not cap:
            assert not own
            continue
        by_bin, by_doc = defaultdict(list), defaultdict(list)
        for r in own:
            by_bin[r.bin].append(r)
            by_doc[r.doc_id].append(r)
        permitted = sorted({c for _, c in SPECS if c and c <= cap})
        for b in by_bin.values():
            used, room = sum(r.piece_tokens for r in b), {r.bin_capacity for r in b}
            assert room == {next(c for c in permitted if c >= used)}  # cut down to its contents
        assert sorted(n for n in (sum(r.piece_tokens for r in d) for d in by_doc.values())) == sizes or len(by_doc) < len(docs)
        assert sum(r.piece_tokens for r in own) == sum(sizes)
        for d in by_doc.values():
            for r in d:
                assert r.piece_tokens <= cap and (r.pieces == 1 or r.piece == r.pieces - 1 or r.piece_tokens == cap)
                assert r.piece_start == r.piece * cap


def test_whole_and_within_capacity(spark):
    rng = random.Random(1)
    docs = [(i, "x" * rng.choice([0, 1, 3, 9, 10, 11, 24, 26, 60, 61, 150]), "own", 5) for i in range(200)] + [(900, None, None, None), (901, "ключ 日本", "b", 1)]
    rows = packed(spark, docs).collect()
    check(rows, docs)
    for spec, cap in (("s", 10), ("m", 25), ("big", 60)):
        split = {r.doc_id for r in rows if r.spec_name == spec and r.pieces > 1}
        assert split == {i for i, t, *_ in docs if len((t or "").encode()) > cap}


def test_repeated_rows_and_none(spark):
    docs = [(1, "xxxx", "a", 0)] * 5
    rows = packed(spark, docs, parts=1).where("spec_name = 's'").collect()
    assert len(rows) == 5 and sum(r.piece_tokens for r in rows) == 20
    assert packed(spark, []).count() == 0
    assert packed(spark, docs, []).count() == 0


def test_little_space_is_left(spark):
    rng = random.Random(2)
    docs = [(i, "x" * min(60, int(rng.expovariate(1 / 8))), "", 0) for i in range(3000)]
    for parts in (1, 64):
        f = {r.spec_name: r.filled for r in packing.fill(packed(spark, docs, parts=parts)).collect()}
        assert min(f.values()) > 0.97


def test_filled_whatever_the_splits(spark, data):
    docs, specs = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "container_spec"))
    some = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 2_000_000))
    one, many = ({r.spec_name: r.filled for r in packing.fill(packing.pack(some.repartition(n), specs)).collect()} for n in (1, 64))
    assert all(many[s] > one[s] - 0.02 for s in one)


def test_second_round_in_several_tasks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 20)
    rng = random.Random(6)
    docs = [(i, "x" * rng.choice([0, 1, 7, 13, 24, 59, 61]), "", 0) for i in range(300)] + [(7, "x" * 7, "", 0)] * 3
    check(packed(spark, docs, parts=8).collect(), docs)


def test_texts_of_one_bin_are_not_split(spark):
    rows = packed(spark, [(1, "x" * 61, "", 0), (2, "x" * 60, "", 0), (3, None, "", 0)])
    assert {(r.spec_name, r.doc_id) for r in packing.split_texts(rows).collect()} == {("big", 1), *((s, i) for s in ("s", "m", "m2") for i in (1, 2))}
    got = {r.spec_name: (r.texts, r.tokens, r.over, r.broken) for r in packing.checks(rows).collect()}
    assert got == {s: (3, 121, 0, 0) for s in ("s", "m", "m2", "big")}


def test_best_fit_against_plain_search():
    rng = random.Random(4)
    for _ in range(60):
        permitted = sorted(rng.sample(range(5, 40), 3))
        sizes = [rng.randrange(permitted[-1] + 1) for _ in range(rng.randrange(1, 25))]
        at, bins = packing.best_fit(sizes, permitted)
        used = defaultdict(int)
        for s, b in zip(sizes, at, strict=True):
            used[b] += s
        assert all(used[b] <= c and c in permitted for b, c in enumerate(bins))
        assert sum(bins) <= 2 * sum(sizes) + permitted[-1]


def test_token_size_is_bytes(spark):
    df = spark.createDataFrame([("é日",), (None,), ("",)], "t string").select(packing.token_size(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [5, 0, 0]


def test_too_many_specs(spark):
    with pytest.raises(ValueError):
        packed(spark, [], [(str(i), i + 1) for i in range(packing.MOST_SPECS + 1)])
