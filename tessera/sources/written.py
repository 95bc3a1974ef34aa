"""Cutting lineage by a written table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A local one stands in where the setting is unset and all runs on this machine, as in tests; on a
    cluster each machine would write a disk of its own, so that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet in the shared folder and reads them back.

    A lost executor then costs a reread, not a new run of all that came before.  All tables of an
    application lie in one folder, named by its id, which may go once the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # Shuffle files of the written plan go once the driver has collected its plan as garbage.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
