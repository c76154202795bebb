"""Turns that most conversations share are dealt over several tasks, and nothing is lost or doubled."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from lexkeel.llm import chat


def test_shared_turns_are_dealt(spark, write):
    rows = [(c, t, r, x) for c in range(1_500) for t, (r, x) in enumerate([("system", "be kind"), ("user", f"q {c % 7}"), ("assistant", f"a {c % 300}")])]
    rows += [(None, 0, "system", "be kind"), (5_000, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    at = write(conversations=df)
    got = chat.op10(spark, at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet/*.parquet'")
    res = con.execute(chat.OP10_SQL)
    names = [d[0] for d in res.description]
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(res.fetchall())


def test_crowded_nodes_stand_several_times(spark):
    rows = [(c, 0, "system", "s") for c in range(2_000)] + [(c, 1, "user", f"u{c}") for c in range(2_000)]
    nodes, turns = chat.tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert nodes.count() == 2_001
    out = chat.attention(nodes, turns)
    assert out.count() == 2_000 and out.select(F.size("intervals").alias("n")).distinct().collect() == [(2,)]
