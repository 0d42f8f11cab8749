"""Mixing sources to target weights along a training curriculum.

A source's weight varies over training; integrating its schedule gives the
tokens it owes by any position, and inverting that gives each of its documents a
position. Range-sorting by position interleaves the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.runtime import materialize

#: Rows per block of a source's order; offsets within a source are running sums within blocks plus the sums of blocks before.
ROWS_PER_BLOCK = 250_000
#: Most rows of mix targets; they are a setting, and broadcast.
MOST_TARGETS = 10_000
#: Schedules where none are given: weights at equally spaced points of training, linear between them, of sources that come once, and of those that may repeat, which come late.
ONCE, REPEATED = (1.5, 1.0, 0.5), (0.5, 1.0, 1.5)
#: Copies of one row that a task makes at once.
COPIES = 10_000


def source_name(source: Column) -> Column:
    """A source's name however it is spelled: trimmed, lower case, runs of blanks, hyphens and underscores as one ``_``."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s_-]+", "_")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """``(key, source, tokens, place)`` of all documents, written once so that texts are read once.

    ``place`` orders a source at random: a hash of the key, of size and source, and of which
    copy it is where rows are repeated, so it is the same however the table is split, and even copies of one row are spread.
    """
    tokens = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    own = docs.select(F.col(key).alias("doc_id"), source_name(F.col(source)).alias("source"), tokens.alias("tokens"))
    known = materialize(own.groupBy("doc_id", "source", "tokens").agg(F.count(F.lit(1)).alias("n")), "known")
    runs = known.where("n > 1").selectExpr("doc_id", "source", "tokens", "n", f"explode(sequence(0L, (n - 1) div {COPIES})) AS run")
    copies = runs.repartition("doc_id", "run").selectExpr("doc_id", "source", "tokens", f"explode(sequence(run * {COPIES}, least(n, (run + 1) * {COPIES}) - 1)) AS copy")
    every = known.where("n = 1").selectExpr("doc_id", "source", "tokens", "0L AS copy").unionByName(copies)
    return materialize(every.select("doc_id", "source", "tokens", F.xxhash64(F.lit(seed), "doc_id", "source", "tokens", "copy").alias("place")), "sized")


def plan(documents: DataFrame, targets: DataFrame, schedules: DataFrame | None = None) -> DataFrame:
    """What each source owes: ``(mix_name, source, max_repeats, supply, target, granted, knots)`` in tokens.

    ``documents`` is from :func:`sized`, ``targets`` has ``mix_name, source,
    weight, max_repeats, budget_ratio``. ``target`` is the source's schedule
    integrated over training: its share of the mix's weights times the budget,
    a multiple of the size of all documents. ``granted`` is the target, or what
    the source gives at most. A source without documents has supply 0. A NULL or negative
    weight counts as 0, NULL ``max_repeats`` as 1.

    ``schedules`` are rows ``(mix_name, source, knots)``: the source's weight at
    equally spaced points of training, two or more, linear between. Only its course counts,
    its mean is the weight of ``targets``; so at any point of training sources come in the ratio
    of their weights there. Negative and NULL knots count as 0; a schedule that is 0
    throughout, or has fewer than two knots, is flat. A source without one follows ``ONCE`` or ``REPEATED``.
    """
    supply = materialize(documents.groupBy("source").agg(F.sum("tokens").alias("supply")), "supply")
    total = supply.agg(F.sum("supply")).first()[0] or 0
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    t = targets.select("mix_name", "source", weight.alias("weight"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats"), "budget_ratio")
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("mix_name"))
    owed = t.select("mix_name", "source", "max_repeats", F.coalesce(share * F.col("budget_ratio") * F.lit(total), F.lit(0.0)).alias("target"))
    known = owed.join(supply, "source", "left").select("mix_name", "source", "max_repeats", F.coalesce("supply", F.lit(0)).cast("long").alias("supply"), "target")
    known = known.withColumn("granted", F.least("target", (F.col("max_repeats") * F.col("supply")).cast("double")))
    usual = F.when(F.col("max_repeats") > 1, F.array(*map(F.lit, REPEATED))).otherwise(F.array(*map(F.lit, ONCE)))
    if schedules is None:
        return known.withColumn("knots", usual)
    clean = F.expr("transform(knots, k -> greatest(coalesce(CAST(k AS DOUBLE), 0D), 0D))")
    own = schedules.select("mix_name", "source", clean.alias("k")).groupBy("mix_name", "source").agg(F.min("k").alias("k"))
    flat = F.expr("size(k) < 2 OR NOT exists(k, x -> x > 0)")
    shaped = known.join(own, ["mix_name", "source"], "left")
    return shaped.withColumn("knots", F.when(F.col("k").isNull(), usual).when(flat, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.col("k"))).drop("k")


def integrated(planned: DataFrame) -> DataFrame:
    """``planned`` with ``sums``: what a source's schedule has come to by each of its knots, 1 at the last."""
    areas = "transform(sequence(1, size(knots) - 1), i -> (knots[i - 1] + knots[i]) / 2)"
    sums = F.expr(f"aggregate({areas}, array(0D), (acc, a) -> concat(acc, array(acc[size(acc) - 1] + a)))")
    return planned.withColumn("sums", sums).withColumn("whole", F.expr("sums[size(sums) - 1]")).withColumn("sums", F.expr("transform(sums, s -> s / whole)"))


def position(x: str) -> Column:
    """Where in training, in [0, 1], a source has given the share ``x`` of what it owes: the inverse of its integrated schedule. An expression over ``knots, sums, whole`` of :func:`integrated`."""
    piece = f"least(size(filter(sums, s -> s <= {x})), size(knots) - 1)"  # from 1
    # area into the piece, which is one wide: a u + (b - a) u^2 / 2; its root in a form that holds for a flat piece too
    at = f"named_struct('i', {piece}, 'y', greatest({x} - sums[{piece} - 1], 0D) * whole, 'a', knots[{piece} - 1], 'b', knots[{piece}])"
    u = "CASE WHEN p.y <= 0 THEN 0D ELSE 2 * p.y / (p.a + sqrt(greatest(p.a * p.a + 2 * (p.b - p.a) * p.y, 0D))) END"
    return F.expr(f"transform(array({at}), p -> least(1D, (p.i - 1 + least({u}, 1D)) / (size(knots) - 1)))[0]")


def given_by(t: str) -> Column:
    """The share of what it owes that a source has given by ``t`` in training, in [0, 1]: its integrated schedule; :func:`position` inverts it."""
    piece = f"least(CAST(floor({t} * (size(knots) - 1)) AS INT), size(knots) - 2)"
    u = f"({t} * (size(knots) - 1) - {piece})"
    return F.expr(f"sums[{piece}] + (knots[{piece}] * {u} + (knots[{piece} + 1] - knots[{piece}]) * {u} * {u} / 2) / whole")


def mix(documents: DataFrame, planned: DataFrame) -> DataFrame:
    """Training order of each mix: ``(mix_name, position, source, doc_id, pass, tokens)``, range-sorted by mix and position.

    A source runs through its documents in random order, again and again, until
    it has given what it is granted; ``pass`` counts from 0 and stays below
    ``max_repeats``. The document in which the grant ends is the last one.
    """
    spark = documents.sparkSession
    targets = materialize(integrated(planned.where((F.col("granted") > 0) & (F.col("supply") > 0))), "targets")
    if targets.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} mix targets")
    wanted = documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    blocks = max(1, -(-documents.count() // ROWS_PER_BLOCK))
    blocked = wanted.withColumn("block", F.pmod("place", F.lit(blocks).cast("long")))
    sums = blocked.groupBy("source", "block").agg(F.sum("tokens").alias("in_block"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).cast("long").alias("ahead"))
    inside = Window.partitionBy("source", "block").orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.withColumn("offset", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).cast("long")).join(sums, ["source", "block"])
    placed = placed.select("doc_id", "source", "tokens", (F.col("offset") + F.col("ahead")).alias("offset"))
    rows = placed.join(F.broadcast(targets), "source")
    passes = F.least(F.ceil((F.col("granted") - F.col("offset")) / F.col("supply")), F.col("max_repeats")).cast("int")
    rows = rows.withColumn("passes", passes).where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    given = (F.col("pass") * F.col("supply") + F.col("offset")) / F.col("granted")
    out = rows.withColumn("given", given).select("mix_name", position("given").alias("position"), "source", "doc_id", "pass", "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(parts, "mix_name", "position", "doc_id").sortWithinPartitions("mix_name", "position", "doc_id")


def short_sources(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """``(mix_name, source)`` that have given less than their target in a mix, although they gave all that they may."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum("tokens").alias("got"))
    return planned.join(got, ["mix_name", "source"], "left").where("coalesce(got, 0) < target").select("mix_name", "source")


def composition(mixed: DataFrame, planned: DataFrame, parts: int = 10) -> DataFrame:
    """``(mix_name, source, part, tokens, wanted, largest)``: what each of equal parts of training holds of a source, and what its schedule wants there; they differ by less than two documents."""
    held = mixed.groupBy("mix_name", "source", F.least(F.floor(F.col("position") * parts), F.lit(parts - 1)).cast("int").alias("part")).agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))
    wide = integrated(planned.where("granted > 0 AND supply > 0")).selectExpr("*", f"explode(sequence(0, {parts - 1})) AS part").withColumns({"lo": F.col("part") / parts, "hi": (F.col("part") + 1) / parts})
    wanted = wide.select("mix_name", "source", "part", ((given_by("hi") - given_by("lo")) * F.col("granted")).alias("wanted"))
    both = wanted.join(held, ["mix_name", "source", "part"], "left")
    most = F.max("largest").over(Window.partitionBy("mix_name", "source"))
    return both.select("mix_name", "source", "part", F.coalesce("tokens", F.lit(0)).alias("tokens"), "wanted", F.coalesce(most, F.lit(0)).alias("largest"))


def checks(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """``(mix_name, source, target_tokens, all_given, reached, within_repeats, follows)`` of a mix.

    ``all_given``: the tokens of a source that can't give its target, NULL for others, for which ``reached`` tells whether
    they have given it, and no more than the last document beyond; ``follows``: whether each tenth of training holds what the schedule wants, but for two documents.
    """
    got = mixed.groupBy("mix_name", "source").agg(F.sum("tokens").alias("got"), F.max("tokens").alias("largest"), (F.max("pass") + 1).alias("passes"))
    course = composition(mixed, planned).groupBy("mix_name", "source").agg(F.bool_and(F.abs(F.col("tokens") - F.col("wanted")) <= 2 * F.col("largest") + 1).alias("follows"))
    both = planned.join(got, ["mix_name", "source"], "left").join(course, ["mix_name", "source"], "left")
    return both.selectExpr(
        "mix_name", "source", "round(target, 3) AS target_tokens", "CASE WHEN granted < target THEN coalesce(got, 0) END AS all_given",
        "granted < target OR (coalesce(got, 0) >= target AND coalesce(got, 0) < target + coalesce(largest, 0) + 1) AS reached", "coalesce(passes, 0) <= max_repeats AS within_repeats", "coalesce(follows, true) AS follows",
    )


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """``(mix_name, source, target_tokens, actual_tokens, actual_share, most_passes)``: what each source gives in fact."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum("tokens").alias("got"), (F.max("pass") + 1).alias("most_passes"))
    both = planned.join(got, ["mix_name", "source"], "left")
    actual = F.coalesce("got", F.lit(0)).cast("long")
    whole = F.sum(actual).over(Window.partitionBy("mix_name"))
    return both.select("mix_name", "source", F.round("target", 3).alias("target_tokens"), actual.alias("actual_tokens"), F.round(actual / whole, 6).alias("actual_share"), F.coalesce("most_passes", F.lit(0)).alias("most_passes"))
