"""Committed tables and the incremental store of results."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexkeel import commits as C
from lexkeel.functions.identity import cache_digest
from lexkeel.plans import documents as D
from lexkeel.plans import gate as G
from lexkeel.plans import report as R
from lexkeel.plans.rulebook import rulebook
from lexkeel.schemas import TABLES
from lexkeel.stages import StageStore
from lexkeel.streaming import ingest


def rows_of(df):
    return sorted(map(str, df.collect()))


# ---- commits ----


def test_tables_become_visible_together(spark, tmp_path):
    at = f"file://{tmp_path}/x"
    c = C.Commits(spark, at)
    assert c.latest() == C.Manifest(0) and c.read("a") is None
    base = c.latest()
    a, schema = c.write(spark.range(3), "a")
    assert c.latest() == base
    first = c.commit(base, {"a": [a]}, {"a": schema}, {"note": "один"})
    assert c.latest() == first and first.notes == {"note": "один"} and c.read("a").count() == 3
    # A second writer from the same version is refused, and what it wrote stays unseen.
    b, _ = c.write(spark.range(5), "a")
    with pytest.raises(C.Conflict):
        c.commit(base, {"a": [b]}, {"a": schema})
    assert c.read("a").count() == 3
    second = c.commit(first, {"a": [a, b]}, {"a": schema})
    assert c.read("a").count() == 8 and c.read("a", first).count() == 3
    assert second.number == 2 and c.sweep(0) == 0
    third = c.commit(second, {"a": []}, {"a": schema})
    assert c.read("a").count() == 0 and c.sweep(3_600) == 0 and c.sweep(0) == 2 and c.latest() == third


def test_a_manifest_that_was_cut_off_does_not_count(spark, tmp_path):
    c = C.Commits(spark, f"file://{tmp_path}/x")
    a, schema = c.write(spark.range(3), "a")
    first = c.commit(c.latest(), {"a": [a]}, {"a": schema})
    torn = Path(tmp_path) / "x" / "manifests" / "0000000002.json"
    torn.write_text(json.dumps({"number": 2, "tables": {}, "schemas": {}, "notes": {}})[:20])
    assert c.latest() == first
    with pytest.raises(C.Conflict):  # its writer may still be at it
        c.commit(first, {"a": []}, {"a": schema})
    os.utime(torn, (1, 1))
    assert c.commit(first, {"a": [a, a]}, {"a": schema}).number == 3 and c.read("a").count() == 6


DOCS = [(i, "word " * (10 * i) + ("mail a@b.example" if i % 3 == 0 else ""), "en", "s", 5 * i) for i in range(1, 13)]


def test_a_report_that_dies_leaves_the_one_before(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/out"
    docs = spark.createDataFrame(DOCS, TABLES["documents"])
    found = G.order(D.findings(docs), rulebook(spark))
    R.publish_reports(R.reports(found), at, found)
    before = {n: rows_of(df) for n, df in R.read_reports(spark, at).items()}
    assert set(before) == {"report", "markdown", "summary", "stages"} and len(before["report"]) == 12
    real, calls = C.Commits.write, []

    def dies(self, df, table, **more):
        calls.append(table)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return real(self, df, table, **more)

    fewer = G.order(D.findings(docs.where("doc_id < 5")), rulebook(spark))
    monkeypatch.setattr(C.Commits, "write", dies)
    with pytest.raises(KeyboardInterrupt):
        R.publish_reports(R.reports(fewer), at, fewer)
    monkeypatch.setattr(C.Commits, "write", real)
    assert {n: rows_of(df) for n, df in R.read_reports(spark, at).items()} == before
    R.publish_reports(R.reports(fewer), at)
    after = R.read_reports(spark, at)
    assert set(after) == {"report", "markdown", "summary"} and all(df.count() == 4 for df in after.values())


# ---- the store ----


def keyed(df, version="1"):
    return df.withColumn("key", cache_digest(F.lit(version), F.sha2(F.coalesce("text", F.lit("")), 256), F.coalesce("n_chars", F.lit(0)).cast("string")))


def only_remarks(df):
    """Rules whose sound documents have no row at all."""
    return D.findings(df).where("status <> 'pass'")


def view(df):
    return sorted((r["doc_id"], r["rule_id"], r["status"], r["message"]) for r in df.collect())


def test_only_what_changed_is_computed(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}/s")
    docs = spark.createDataFrame([*DOCS, (100, DOCS[0][1], "en", "s", DOCS[0][4]), (101, None, None, None, None)], TABLES["documents"])
    first = store.update(keyed(docs), only_remarks, complete=True)
    assert (first.changed, first.computed, first.removed) == (14, 13, 0)  # one text stands twice
    assert view(store.current()) == view(only_remarks(docs))
    # The same again: nothing is computed; a changed one, a new one, one that is gone, one whose new version has no remark.
    assert store.update(keyed(docs), only_remarks, complete=True).computed == 0
    good = "word " * 60
    edited = docs.where("doc_id <> 12").withColumn("text", F.when(F.col("doc_id") == 1, good).when(F.col("doc_id") == 2, "other").otherwise(F.col("text"))).withColumn("n_chars", F.when(F.col("doc_id") == 1, len(good)).otherwise(F.col("n_chars")))
    edited = edited.unionByName(spark.createDataFrame([(50, "brand new", "en", "s", 9)], TABLES["documents"]))
    assert any(r[0] == 1 for r in view(store.current()))
    second = store.update(keyed(edited), only_remarks, complete=True)
    assert (second.changed, second.computed, second.removed) == (3, 3, 1)
    assert view(store.current()) == view(only_remarks(edited))
    assert not any(r[0] in (1, 12) for r in view(store.current()))
    # Back to the earlier state: all results are still known.
    third = store.update(keyed(docs), only_remarks, complete=True)
    assert (third.computed, third.removed) == (0, 1) and view(store.current()) == view(only_remarks(docs))
    # Other rules are other digests.
    assert store.update(keyed(docs, "2"), only_remarks, complete=True).computed == 13
    assert view(store.current()) == view(only_remarks(docs))


def test_a_part_of_the_documents_leaves_the_others(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}/s")
    docs = spark.createDataFrame(DOCS, TABLES["documents"])
    store.update(keyed(docs), D.findings)
    got = store.update(keyed(docs.where("doc_id = 3").withColumn("text", F.lit("x"))), D.findings)
    assert (got.changed, got.computed, got.removed) == (1, 1, 0)
    assert view(store.current()) == view(D.findings(docs.withColumn("text", F.when(F.col("doc_id") == 3, "x").otherwise(F.col("text")))))
    assert store.update(keyed(docs.limit(0)), D.findings).computed == 0
    assert store.update(keyed(docs.limit(0)), D.findings, complete=True).removed == 12 and store.current().count() == 0


def test_damage_is_a_miss(spark, tmp_path):
    at = tmp_path / "s"
    store = StageStore(spark, f"file://{at}")
    docs = spark.createDataFrame(DOCS, TABLES["documents"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    store.update(keyed(docs), D.findings)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = view(store.current())
    lost = sorted(p for p in at.glob("data/rows-*/part-*.parquet"))[0]
    lost.unlink()
    (lost.parent / f".{lost.name}.crc").unlink(missing_ok=True)
    assert store.update(keyed(docs), D.findings).computed == 0  # not looked for
    got = store.update(keyed(docs), D.findings, verify=True)
    assert 0 < got.computed < 12
    store.compact()  # drops the folder with the hole
    assert view(store.current()) == want and store.update(keyed(docs), D.findings, verify=True).computed == 0


def test_compaction_keeps_what_is_seen(spark, tmp_path):
    at = tmp_path / "s"
    store = StageStore(spark, f"file://{at}")
    docs = spark.createDataFrame(DOCS, TABLES["documents"])
    for n in (3, 6, 12):
        store.update(keyed(docs.where(F.col("doc_id") <= n)), D.findings)
    store.update(keyed(docs.where("doc_id > 4").withColumn("text", F.upper("text"))), D.findings, complete=True)
    want, before = view(store.current()), len(list(at.glob("data/rows-*")))
    m = store.compact(sweep_after_s=0)
    assert view(store.current()) == want and before == 4 and len(list(at.glob("data/rows-*"))) == 1
    assert all(len(f) == 1 for f in m.tables.values())
    assert store.update(keyed(docs.where("doc_id > 4").withColumn("text", F.upper("text"))), D.findings, complete=True).computed == 0


def test_a_run_that_dies_changes_nothing(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}/s")
    docs = spark.createDataFrame(DOCS, TABLES["documents"])
    store.update(keyed(docs.where("doc_id < 4")), D.findings)
    want, m = view(store.current()), store.commits.latest()

    def dies(df):
        return D.findings(df).withColumn("message", F.raise_error(F.lit("stop")).cast("string"))

    with pytest.raises(Exception, match="stop"):
        store.update(keyed(docs), dies)
    assert store.commits.latest() == m and view(store.current()) == want


def test_a_stream_shows_no_stale_finding(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    docs = spark.createDataFrame(DOCS, TABLES["documents"])
    docs.coalesce(1).write.parquet(source)
    run = lambda: ingest.evaluate_stream(ingest.document_stream(spark, source), only_remarks, out, state).awaitTermination()
    run()
    assert any(r[0] == 1 for r in view(ingest.latest_findings(spark, out)))
    good = "word " * 60
    spark.createDataFrame([(1, good, "en", "s", len(good))], TABLES["documents"]).write.mode("append").parquet(source)
    run()
    run()
    left = view(ingest.latest_findings(spark, out))
    assert not any(r[0] == 1 for r in left) and left == view(only_remarks(docs.where("doc_id > 1")))
    # A batch that comes again after a restart changes nothing.
    store = StageStore(spark, out)
    m = store.commits.latest()
    assert store.update(ingest.content_key(docs, "rules"), only_remarks, batch=(state, 0)).version == m.number and store.commits.latest() == m
