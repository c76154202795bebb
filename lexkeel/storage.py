"""Tables that several steps of a run use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names. Only a session on this machine alone may do without: it gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lexkeel-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def broadcast_by_rows(spark: SparkSession) -> None:
    """Leaves it to adaptive execution which joins broadcast a side: it knows the size of the rows that were shuffled.

    Before a run Spark goes by the size of files, which compress repetitive rows a hundredfold, and takes it that a Python step returns no more than
    it reads; tables of any size would pass through the driver. Sides that a query itself marks by ``broadcast`` stay so.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if (limit := spark.conf.get(static)) not in ("-1", "-1b"):
        if spark.conf.get(adaptive, None) is None:
            spark.conf.set(adaptive, limit)
        spark.conf.set(static, "-1")


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new ``folder`` and read back."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    broadcast_by_rows(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
