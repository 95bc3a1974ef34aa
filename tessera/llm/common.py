"""Shared small parts: the word pattern, reading tables, cutting lineage by a written table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.written import shared_folder, written

__all__ = ["BROADCAST_ROWS", "SPACES", "documents", "free_name", "looked_up", "mounted", "shared_folder", "words_of", "written"]

#: Characters that separate words: space and tab..carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
BROADCAST_ROWS = 1_000_000
#: A key of more rows is heavy; a lookup broadcasts at most so many heavy keys, 24 bytes each.
HEAVY, HEAVY_KEYS = 64, 10_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mounted(folder: str) -> str:
    """The path of a shared folder that all machines mount; files that tasks map must lie there."""
    path = folder.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{folder} is no mounted folder: name one in spark.checkpoint.dir")
    return path


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``value`` of their key, null where ``table`` (key, value; keys once) lacks it.

    Keys that many rows hold are looked up in a broadcast of at most ``HEAVY_KEYS`` rows; the others
    are joined, so no task gets all rows of a hot key.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HEAVY)
    heavy = written(counts.orderBy(F.desc("_n"), key).limit(HEAVY_KEYS).join(table, key, "left").select(F.col(key).alias("_key"), F.col(value).alias("_heavy"), F.lit(True).alias("_is")), "heavy")
    r = rows.join(F.broadcast(heavy), F.col(key) == F.col("_key"), "left")
    # Rows that need no join are spread by what tells them apart.
    spread = F.when(F.col("_is").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns))
    other = table.select(F.col(key).alias("_at"), F.col(value).alias("_value"))
    r = r.withColumn("_spread", spread).join(other, F.col("_spread") == F.col("_at"), "left")
    found = F.when(F.col("_is"), F.col("_heavy")).when(F.col(key).isNotNull(), F.col("_value"))
    return r.select(*rows.columns, found.alias(value))
