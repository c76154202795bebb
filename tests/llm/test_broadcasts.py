from __future__ import annotations

from pyspark.sql import functions as F

from lexkeel.llm import simhash
from lexkeel.llm.common import materialize


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_never_pass_through_the_driver(spark):
    """A file of fingerprints is small, the 84 cells of each are not; Spark would broadcast them by the file's size."""
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    nodes = materialize(spark.range(2_000).select(F.xxhash64("id").alias("fp")), "nodes")
    pairs = simhash.listed(nodes)
    assert "BroadcastHashJoin" not in plan_of(pairs)
    assert pairs.where("u >= v").count() == 0


def test_written_tables_are_broadcast_by_their_rows_only(spark):
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    big = materialize(spark.range(1_000).select("id", F.repeat(F.lit("x"), 50_000).alias("text")), "big")
    small = materialize(spark.range(1_000), "small")
    for one in (big, small):
        joined = spark.range(2_000).join(one, "id")
        assert "BroadcastHashJoin" not in plan_of(joined)
        assert joined.count() == 1_000
    joined = spark.range(2_000).join(F.broadcast(small), "id")
    assert "BroadcastHashJoin" in plan_of(joined)
