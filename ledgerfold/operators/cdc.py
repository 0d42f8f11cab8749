"""Applying a change feed that arrives repeated and out of order.

Changes with one lsn are one transaction (a batch set writes many keys). Replay
is in commit order within each key and parallel over keys; the history of a key
is cut into blocks of lsn that fold independently, so a key with a third of all
changes is spread over tasks. State can be exposed at any lsn up to the
contiguous watermark, before the first gap in the sequence, or past gaps that
were declared lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions.text import json_as_number, json_string, number_text

#: lsns per block of a key's history: what one window partition or task can get of a single key is at most so many changes.
BLOCK_BITS = 16
#: Summaries of blocks are chained in rounds of 2**FAN_BITS at most, so no row holds more of them, however long a key's history is.
FAN_BITS = 10
#: What a key can be before a block: absent, live with a number, live with something else.
_ABSENT, _NUMBER, _OTHER = 0, 1, 2


def transactions(changes: DataFrame, after: int = 0, upto: int | None = None) -> DataFrame:
    """One row per transaction: the first delivered copy of each lsn in ``(after, upto]``.

    lsn NULL or below 1 was never logged and is left out. The struct aggregate is
    combined before the shuffle, so an lsn delivered very often stays small.
    """
    named = changes.where((F.col("lsn") > F.greatest(F.lit(after), F.lit(0))) & (F.lit(True) if upto is None else F.col("lsn") <= upto))
    body = F.struct(F.lower(F.trim("op")).alias("op"), "key", "value", F.col("delta").cast("double").alias("delta"))
    return named.groupBy("lsn").agg(F.min_by(body, F.col("delivery_id")).alias("c")).select("lsn", "c.*")


def contiguous_watermark(changes: DataFrame, start: int, block_bits: int = BLOCK_BITS) -> int:
    """The last lsn up to which every lsn above ``start`` has been delivered; ``start`` if the next is missing.

    Delivered numbers are counted per block; the first block that is not full
    decides, and only its own numbers are looked at.
    """
    size = 1 << block_bits
    seen = changes.where(F.col("lsn") > start).select((F.col("lsn") - (start + 1)).alias("at")).distinct()
    full = seen.groupBy(F.shiftright("at", block_bits).alias("block")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size).select("block")
    # The blocks that are full and contiguous from 0: the first missing block number.
    w = Window.partitionBy(F.shiftright("block", block_bits)).orderBy("block")
    runs = full.withColumn("place", F.row_number().over(w) - 1).where(F.pmod("block", F.lit(size).cast("long")) == F.col("place"))
    tops = {r[0]: r[1] for r in runs.groupBy(F.shiftright("block", block_bits).alias("top")).agg(F.count(F.lit(1))).collect()}
    block, top = 0, 0
    while tops.get(top, 0) == size:
        top += 1
    block = top * size + tops.get(top, 0)
    inside = seen.where(F.shiftright("at", block_bits) == block)
    order = Window.orderBy("at")  # at most one block of numbers
    held = inside.withColumn("place", F.row_number().over(order) - 1 + block * size).where(F.col("at") == F.col("place")).count()
    return start + block * size + held


def settled(changes: DataFrame, start: int, patience: int = 0) -> int:
    """The lsn up to which nothing more is waited for: the highest that was delivered at least ``patience`` batches before the latest.

    Numbers below it that haven't come are declared lost. With a patience of 0, for
    a feed that has ended, it is the highest lsn of all; ``start`` if there is none above it.
    """
    ends = changes.agg(F.max("batch_id")).first()[0] if patience else None
    seen = changes if ends is None else changes.where(F.col("batch_id") <= ends - patience)
    return max(start, seen.agg(F.max("lsn")).first()[0] or 0)


def writes(txns: DataFrame) -> DataFrame:
    """Key-level writes ``(key, lsn, op, value, num, delta)`` of transactions.

    A batch set gives one write per key of its map, all under its lsn; a map that
    is no JSON object gives none. A step is in ``delta``, in older records in
    ``value``; without either it is 1. Unknown operations and NULL keys are dropped.
    """
    op = F.col("op")
    step = F.when(op == "incr", F.coalesce("delta", json_as_number(F.col("value")), F.lit(1.0)))
    text = F.when(op.isin("create", "update"), F.coalesce("value", F.lit("null")))
    one = F.array(F.struct(F.col("key"), op.alias("op"), text.alias("value"), step.alias("delta")))
    # A map's values as text in their own spelling; the variant tells strings from the rest.
    sets = F.when(op == "mset", F.col("key"))
    texts = F.from_json(sets, "map<string, string>")
    kinds = F.expr("try_variant_get(try_parse_json(CASE WHEN op = 'mset' THEN key END), '$', 'map<string, variant>')")

    def item(e: Column) -> Column:
        is_text = F.call_function("schema_of_variant", F.col("kinds")[e["key"]]) == "STRING"
        value = F.when(e["value"].isNull(), "null").when(is_text, json_string(e["value"])).otherwise(e["value"])
        return F.struct(e["key"].alias("key"), F.lit("create").alias("op"), value.alias("value"), F.lit(None).cast("double").alias("delta"))

    known = txns.where(op.isin("create", "update", "delete", "incr", "mset")).select("lsn", "op", one.alias("one"), texts.alias("texts"), kinds.alias("kinds"))
    many = F.when(F.col("kinds").isNotNull(), F.transform(F.map_entries("texts"), item))
    rows = known.select("lsn", F.explode(F.when(op == "mset", many).otherwise(F.col("one"))).alias("w")).select("lsn", "w.*")
    return rows.where(F.col("key").isNotNull()).select("key", "lsn", "op", "value", json_as_number(F.col("value")).alias("num"), "delta")


def _fold_blocks(w: DataFrame, block_bits: int) -> DataFrame:
    """``(key, block, lsns, steps, same, dead, alive)``: for each state before the block the lsn last accepted and the sum of steps since the last reset.

    What that reset left is ``dead`` if the key was absent before, ``alive`` if it
    was live; where both are one write, ``same`` holds and it is given once.
    """
    blocks = w.withColumn("block", F.shiftright("lsn", block_bits))
    order = Window.partitionBy("key", "block").orderBy("lsn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    op = F.col("op")
    lives = F.when(op.isin("create", "incr"), True).when(op == "delete", False)
    kind = F.when(F.col("num").isNotNull(), _NUMBER).otherwise(_OTHER)
    x = blocks.withColumn("was", F.last(lives, ignorenulls=True).over(before))
    # What each write resets the key to, where the key was absent (0) or live (1) before the block.
    for live in (0, 1):
        resets = F.when(op == "create", kind).when(op == "delete", _ABSENT).when((op == "update") & F.coalesce("was", F.lit(bool(live))), kind)
        x = x.withColumn(f"r{live}", resets)
    whole = Window.partitionBy("key", "block")
    x = x.withColumns({f"k{live}": F.last(f"r{live}", ignorenulls=True).over(before) for live in (0, 1)})
    x = x.withColumns({f"z{live}": F.max(F.when(F.col(f"r{live}").isNotNull(), F.col("lsn"))).over(whole) for live in (0, 1)})
    lsns, steps, bases = [], [], []
    for s in (_ABSENT, _NUMBER, _OTHER):
        live = int(s != _ABSENT)
        now = F.coalesce(F.col(f"k{live}"), F.lit(s))
        adds = (op == "incr") & (now != _OTHER)
        taken = F.col(f"r{live}").isNotNull() & (op != "delete") | adds
        since = adds & (F.col("lsn") > F.coalesce(f"z{live}", F.lit(-1).cast("long")))
        lsns.append(F.max(F.when(taken, F.col("lsn"))))
        steps.append(F.sum(F.when(since, F.col("delta"))))
    for live in (0, 1):
        base = F.struct(F.col(f"r{live}").alias("kind"), F.col("value"), F.col("num"))
        given = F.col("lsn") == F.col(f"z{live}")
        bases.append(F.first(F.when(given & ~F.col("same") if live else given, base), ignorenulls=True))
    x = x.withColumn("same", F.col("z0").eqNullSafe(F.col("z1")))
    return x.groupBy("key", "block").agg(F.array(*lsns).alias("lsns"), F.array(*steps).alias("steps"), F.first("same").alias("same"), bases[0].alias("dead"), bases[1].alias("alive"))


def _then(a: Column, b: Column) -> Column:
    """The summary of block ``a`` followed by block ``b``."""
    out = {}
    kinds = []
    for s in (_ABSENT, _NUMBER, _OTHER):
        base = a["dead"] if s == _ABSENT else F.when(a["same"], a["dead"]).otherwise(a["alive"])
        kind = F.when(a["steps"][s].isNotNull(), _NUMBER).otherwise(F.coalesce(base["kind"], F.lit(s)))
        kinds.append(kind)
        last = F.when((kind == _ABSENT) | b["same"], b["dead"]).otherwise(b["alive"])
        add = b["steps"][kind]
        both = F.when(add.isNull(), a["steps"][s]).otherwise(F.coalesce(a["steps"][s], F.lit(0.0)) + add)
        out[s] = F.coalesce(last, base), F.when(last.isNotNull(), add).otherwise(both), F.coalesce(b["lsns"][kind], a["lsns"][s])
    # one write is given once: b's, where it resets alike from any state, or a's, where b resets from none
    same = b["same"] & (b["dead"].isNotNull() | a["same"])
    return F.struct(
        b["block"].alias("block"), F.array(*[out[s][2] for s in out]).alias("lsns"), F.array(*[out[s][1] for s in out]).alias("steps"),
        same.alias("same"), out[_ABSENT][0].alias("dead"), F.when(~same, out[_NUMBER][0]).alias("alive"),
    )


def _rounds(parts: DataFrame, last_block: int, fan_bits: int) -> DataFrame:
    """Summaries chained in rounds until a key has ``2**fan_bits`` at most (and the snapshot's)."""
    while last_block >> fan_bits:
        last_block >>= fan_bits
        up = F.shiftright("block", fan_bits)
        runs = parts.groupBy("key", up.alias("up")).agg(F.array_sort(F.collect_list(F.struct("block", "lsns", "steps", "same", "dead", "alive"))).alias("b"))
        parts = runs.select("key", "up", F.aggregate(F.slice("b", F.lit(2), F.size("b")), F.col("b")[0], _then).alias("s")).select("key", F.col("up").alias("block"), "s.lsns", "s.steps", "s.same", "s.dead", "s.alive")
    return parts


def replay(snapshot: DataFrame, changes: DataFrame, upto: int | None = None, block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """Live keys ``(key, value, lsn)`` after the snapshot and each change above its lsn, once, in order of lsn.

    ``snapshot``: ``key``, ``value``, ``snapshot_lsn`` (one value; 0 if empty). ``changes``:
    ``delivery_id``, ``lsn``, ``op``, ``key``, ``value``, ``delta``. Other columns are
    ignored. Repeated rows of either side count once. A create sets the key, an
    update of an absent key is refused, a delete makes it absent, a step starts
    an absent key at 0 and is refused on what is no number. A SQL NULL value is
    JSON null. State is exposed as of ``upto``, the watermark: :func:`contiguous_watermark` of
    the start to hold at the first gap, or of :func:`settled` to pass gaps that are declared lost.
    Without it all that was delivered counts.

    ``value`` is JSON text; after steps it is the number as a float. ``lsn`` is
    that of the last accepted change, or ``snapshot_lsn``.
    """
    start = snapshot.agg(F.max("snapshot_lsn")).first()[0] or 0
    held = snapshot.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.coalesce("value", F.lit("null"))).alias("value"))
    base = F.struct(F.when(F.col("num").isNotNull(), _NUMBER).otherwise(_OTHER).alias("kind"), F.col("value"), F.col("num"))
    first = held.withColumn("num", json_as_number(F.col("value"))).select(
        "key", F.lit(-1).cast("long").alias("block"), F.array_repeat(F.lit(start).cast("long"), 3).alias("lsns"), F.array_repeat(F.lit(None).cast("double"), 3).alias("steps"), F.lit(True).alias("same"), base.alias("dead"), F.lit(None).cast("struct<kind: int, value: string, num: double>").alias("alive")
    )
    upto = settled(changes, start) if upto is None else upto
    parts = first.unionByName(_rounds(_fold_blocks(writes(transactions(changes, start, upto)), block_bits), upto >> block_bits, fan_bits))

    def step(acc: Column, b: Column) -> Column:
        new = F.when((acc["kind"] == _ABSENT) | b["same"], b["dead"]).otherwise(b["alive"])
        add = b["steps"][acc["kind"]]
        num = F.when(new.isNotNull(), new["num"]).otherwise(acc["num"])
        return F.struct(
            F.when(add.isNotNull(), _NUMBER).otherwise(F.coalesce(new["kind"], acc["kind"])).alias("kind"),
            F.when(add.isNotNull(), F.lit(None)).when(new.isNotNull(), new["value"]).otherwise(acc["value"]).alias("value"),
            F.when(add.isNotNull(), F.coalesce(num, F.lit(0.0)) + add).otherwise(num).alias("num"),
            F.coalesce(b["lsns"][acc["kind"]], acc["lsn"]).alias("lsn"),
        )

    blank = F.struct(F.lit(_ABSENT).alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("long").alias("lsn"))
    state = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "lsns", "steps", "same", "dead", "alive"))).alias("b")).select("key", F.aggregate("b", blank, step).alias("s"))
    return state.where(F.col("s.kind") != _ABSENT).select("key", F.coalesce("s.value", number_text(F.col("s.num"))).alias("value"), F.col("s.lsn").alias("lsn"))
