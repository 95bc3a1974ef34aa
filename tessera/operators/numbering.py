"""Numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written


def numbered(rows: DataFrame, by: str, order: str, name: str = "r") -> DataFrame:
    """``rows`` with their place in order within ``by``, from 1.

    Rows are sorted into ranges of both columns, so a group of a third of all rows lies in several; a place is the one within the
    range and the sizes of the group's ranges before it.
    """
    r = written(rows.repartitionByRange(by, order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("_range", by).orderBy(order))
    # A row for each range and each group.
    size = r.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = size.select(F.col(by).alias("_by"), F.col("_range").alias("_of"), before.alias("_before"))
    j = r.withColumn("_inside", inside).join(size, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")))
    return j.select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))
