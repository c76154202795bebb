"""The driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its declared columns; Parquet itself checks the types."""
    columns = [c.split()[0] for c in TABLES[name].split(", ")]
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
