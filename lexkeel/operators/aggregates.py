"""Aggregations: weighted ratios and modes, repeated values, shares, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_ratio(flag: Column, weight: Column) -> Column:
    """Weight where the flag holds over all weight; 0 without weight."""
    return F.coalesce(F.try_divide(F.sum(F.when(flag, weight).otherwise(0)), F.sum(weight)), F.lit(0.0))


def weighted_mode(rows: DataFrame, by: list[str], value: str, weight: Column, smallest: bool = True) -> DataFrame:
    """The value of greatest total weight in each group; of equals the smallest (or greatest)."""
    sums = rows.groupBy(*by, value).agg(F.sum(weight).alias("weight"))
    best = Window.partitionBy(*by).orderBy(F.desc("weight"), F.asc(value) if smallest else F.desc(value))
    return sums.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def repeated(rows: DataFrame, value: str, unit: str, least: int = 2) -> DataFrame:
    """Values found in at least ``least`` distinct units: ``n_units`` and ``n_rows`` of each."""
    return rows.groupBy(value).agg(F.count_distinct(unit).alias("n_units"), F.count(F.lit(1)).alias("n_rows")).where(F.col("n_units") >= least)


def share(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``; map-side limits come with the filter."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def first_few(values: Column, k: int = 5) -> Column:
    """The first ``k`` of the sorted distinct values, as text."""
    return F.array_join(F.slice(F.array_sort(F.array_distinct(values)), 1, k), ", ")
