"""Queries of the text problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import heavyhitters, mixing, packing, sentences
from ledgerfold.runtime import materialize
from ledgerfold.sources.tables import plain_op, table


def _notices_by_op(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "keyspace_event").select(plain_op(F.col("op")).alias("op"), "key")


def _top(spark: SparkSession, folder: str) -> DataFrame:
    return heavyhitters.top_items(_notices_by_op(spark, folder), "op", "key").select(F.col("grp").alias("op"), F.col("item").alias("key"))


def _top_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The exact count beside whether the guaranteed interval holds it, as it must."""
    top = heavyhitters.top_items(_notices_by_op(spark, folder), "op", "key")
    return top.selectExpr("grp AS op", "item AS key", "n", "n BETWEEN low AND high AS inside")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "container_spec"))


def _split_texts(spark: SparkSession, folder: str) -> DataFrame:
    return packing.split_texts(_packed(spark, folder))


def _planned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = mixing.sized(table(spark, folder, "documents"))
    return documents, materialize(mixing.plan(documents, table(spark, folder, "mix_target")), "plan")


def _short(spark: SparkSession, folder: str) -> DataFrame:
    documents, planned = _planned(spark, folder)
    return mixing.short_sources(mixing.mix(documents, planned), planned)


def _mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(*_planned(spark, folder))


def _shares(spark: SparkSession, folder: str) -> DataFrame:
    documents, planned = _planned(spark, folder)
    return mixing.shares(mixing.mix(documents, planned), planned)


def _mix_checks(spark: SparkSession, folder: str) -> DataFrame:
    documents, planned = _planned(spark, folder)
    return mixing.checks(mixing.mix(documents, planned), planned)


QUERIES = {
    "p4_found": _top,
    "p4_intervals": _top_intervals,
    "p6_found": _split_texts,
    "p6_packing": _packed,
    "p6_checks": lambda spark, folder: packing.checks(_packed(spark, folder)),
    "p6_fill": lambda spark, folder: packing.fill(_packed(spark, folder)),
    "p7_found": _short,
    "p7_mix": _mix,
    "p7_shares": _shares,
    "p7_checks": _mix_checks,
    "p8_found": lambda spark, folder: sentences.sentence_units(table(spark, folder, "documents")),
}

_OWED = r"""sizes AS (SELECT regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g') AS source, sum(coalesce(strlen(text), 0)) AS supply FROM documents GROUP BY 1),
    owed AS (SELECT mix_name, t.source, max_repeats, coalesce(supply, 0) AS supply, weight / sum(weight) OVER (PARTITION BY mix_name) * budget_ratio * (SELECT sum(supply) FROM sizes) AS target FROM mix_target t LEFT JOIN sizes USING (source))"""

ORACLE = {
    "p4_found": """SELECT op, key FROM (SELECT lower(trim(op)) AS op, key, row_number() OVER (PARTITION BY lower(trim(op)) ORDER BY count(*) DESC, key) AS place
        FROM keyspace_event WHERE key IS NOT NULL GROUP BY 1, 2) WHERE place <= 10""",
    "p4_intervals": """SELECT op, key, n, true AS inside FROM (SELECT lower(trim(op)) AS op, key, count(*) AS n, row_number() OVER (PARTITION BY lower(trim(op)) ORDER BY count(*) DESC, key) AS place
        FROM keyspace_event WHERE key IS NOT NULL GROUP BY 1, 2) WHERE place <= 10""",
    "p6_found": "SELECT spec_name, doc_id FROM documents JOIN container_spec ON strlen(text) > capacity_tokens",
    "p6_checks": """SELECT spec_name, count(*) AS texts, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS tokens, 0 AS over, 0 AS broken FROM documents, container_spec GROUP BY spec_name""",
    "p7_found": f"""WITH {_OWED} SELECT mix_name, source FROM owed WHERE target > max_repeats * supply""",
    "p7_checks": f"""WITH {_OWED} SELECT mix_name, source, round(target, 3) AS target_tokens, CASE WHEN target > max_repeats * supply THEN CAST(max_repeats * supply AS BIGINT) END AS all_given, true AS reached, true AS within_repeats, true AS follows FROM owed""",
}
