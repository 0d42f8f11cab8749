"""Access to the tables of a data folder, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.runtime import SharedFiles


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str, triggers: int = 3, bytes_per_trigger: str = "64g") -> DataFrame:
    """The same table as a file stream, taken in at least ``triggers`` steps where it has that many files.

    A step also ends at ``bytes_per_trigger``, which is what bounds it in production.
    A table that is one file comes in one step; :func:`table_parts` cuts it.
    """
    path = f"{folder}/{name}.parquet"
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    if SharedFiles(spark).is_file(path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    size = _folder_bytes(spark, path)
    step = max(1, min(_bytes(bytes_per_trigger), -(-size // triggers)))
    return reader.option("maxBytesPerTrigger", str(step)).parquet(path)


def table_parts(spark: SparkSession, folder: str, name: str, by: str, parts: int = 3) -> list[DataFrame]:
    """A table that is one file in up to ``parts`` ranges of the whole number ``by``, rising, NULL in the first; empty for a table of several files."""
    if not SharedFiles(spark).is_file(f"{folder}/{name}.parquet"):
        return []
    rows = table(spark, folder, name)
    lo, hi = rows.agg(F.min(by), F.max(by)).first()
    if lo is None:
        return [rows]
    width = -(-(hi - lo + 1) // parts)
    place = F.coalesce(F.floor((F.col(by) - lo) / width), F.lit(0))
    return [rows.where(place == k) for k in range((hi - lo) // width + 1)]


def _bytes(text: str) -> int:
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1].lower())
    return int(text[:-1]) << unit if unit else int(text)


def _folder_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def plain_op(op):
    """Spelling of an operation name without case and outer blanks."""
    return F.lower(F.trim(op))
