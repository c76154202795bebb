"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every round is two shuffles of the edges, written to the shared folder so that lost
executors cost a reread; nothing but two numbers a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame, name: str) -> DataFrame:
    """Turns edges ``(u, v)`` into stars: each node ``u`` that isn't the smallest of its component, and that smallest ``v``."""
    now = materialize(edges.where("u <> v").select("u", "v").distinct(), name)
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(now)
    while before[0]:
        now = materialize(_small_star(_large_star(now)), name)
        if (after := mark(now)) == before:
            return now
        before = after
    return now
