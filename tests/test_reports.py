from __future__ import annotations

import json

from pyspark.sql import functions as F

from lexkeel.plans import advisory as A
from lexkeel.plans import documents as D
from lexkeel.plans import gate as G
from lexkeel.plans import report as R
from lexkeel.plans.rulebook import rulebook
from lexkeel.schemas import TABLES
from lexkeel.sources.corpus import table
from lexkeel.streaming import ingest

DOCS = [(1, "hello " * 60, "en", "s", 360), (2, "mail me: a.b@example.com " + "word " * 60, "en", "s", 5), (3, "", "en", "s", None), (4, "длинный текст " * 40, "ru", "s", 560)]


def findings(spark):
    return D.findings(spark.createDataFrame(DOCS, TABLES["documents"]))


def test_reports_hide_passes_and_keep_counts(spark):
    ordered = G.order(findings(spark), rulebook(spark))
    rows = {r["doc_id"]: json.loads(r["json"]) for r in R.as_json(R.reports(ordered, stamp=F.lit("2025-01-02 03:04:05.6").cast("timestamp"), profile="software")).collect()}
    assert rows[1]["findings"] == []
    assert rows[1]["header"]["gate_status"] == "pass"
    assert rows[1]["header"]["generated_at"] == "2025-01-02T03:04:05Z"
    assert {f["rule_id"] for f in rows[2]["findings"]} == {"DOC-02", "DOC-05"}
    assert rows[2]["exit_code"] == 2
    assert rows[3]["counts"]["blocking_unverifiable"] == 1
    assert rows[3]["header"]["degraded"] is True
    assert rows[4]["counts"]["llm_advisory"] == 1
    assert all("path" not in f for r in rows.values() for f in r["findings"])


def test_markdown_folds_and_cuts(spark):
    ordered = G.order(findings(spark), rulebook(spark))
    report = R.reports(ordered)
    text = {r["doc_id"]: r["markdown"] for r in R.markdown(report, collapse_after=0).collect()}
    assert "<details>" in text[2]
    assert "## formal_errors (2)" in text[2]
    assert "## formal_errors (0)\n\nnone" in text[1]
    short = {r["doc_id"]: r["markdown"] for r in R.markdown(report, limit=100).collect()}
    assert "too long" in short[2]
    assert "formal_errors: 2" in short[2]
    assert all(r["summary"].startswith("gate ") for r in R.summary(report).collect())


def test_sinks(spark, tmp_path):
    R.write_reports(R.reports(G.order(findings(spark), rulebook(spark))), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/report").count() == len(DOCS)
    assert spark.read.json(f"file://{tmp_path}/out/markdown").count() == len(DOCS)


def test_evidence_text_is_escaped(spark):
    from lexkeel.functions.redaction import evidence_text

    df = spark.createDataFrame([("a <b> & `c` *d* [x](y) _e_ f_g\n token=zzz",)], "v string")
    assert df.select(evidence_text(F.col("v"))).first()[0] == r"a &lt;b&gt; &amp; \`c\` \*d\* \[x\](y) \_e\_ f_g token=[REDACTED]"


def sections(spark):
    rows = [("d", "s1", "введение", "introduction", 2, 0), ("d", "s2", "постановка задачи", "other", 2, 100), ("d", "s3", "анализ результатов", "other", 2, 200), ("d", "s4", "список литературы", "other", 2, 300), ("e", "s1", "введение", "introduction", 2, 0)]
    chunks = [("d", s, f"{s}:{i}", f"text {s} {i}", at + i) for s, at in (("s1", 0), ("s2", 100), ("s3", 200), ("s4", 300)) for i in range(5)] + [("e", "s1", "s1:0", "   ", 0)]
    return spark.createDataFrame(rows, "doc_id string, section_id string, norm string, kind string, level int, char_start int"), spark.createDataFrame(chunks, "doc_id string, section_id string, chunk_id string, text string, char_start int")


def test_plan_shows_heads_and_tails_of_the_right_sections(spark):
    planned = {(r["doc_id"], r["rule_id"]): r for r in A.plan(spark, *sections(spark)).collect()}
    assert len(planned) == 2 * 25
    ids = lambda d, r: [c["chunk_id"] for c in planned[(d, r)]["chunks"]]
    assert ids("d", "INT-01") == ["s1:0", "s1:4"]
    assert ids("d", "TSK-03") == ["s2:0", "s2:4", "s3:0", "s3:4"]
    assert ids("d", "RES-01") == ["s2:0", "s2:1", "s2:4", "s3:0", "s3:1", "s3:4"]
    assert planned[("d", "RES-01")]["state"] == "ready"
    assert planned[("d", "IMP-01")]["state"] == "section_missing"
    assert planned[("d", "IMP-01")]["missing_roles"] == ["architecture", "implementation"]
    assert planned[("d", "REV-05")]["state"] == "section_missing"
    assert planned[("e", "INT-01")]["state"] == "section_missing"  # a blank section has nothing to show
    assert not any(c["chunk_id"].startswith("s4") for r in planned.values() for c in r["chunks"] or [])


def test_answers_count_only_with_sound_quotes(spark):
    planned = A.plan(spark, *sections(spark))
    digests = spark.createDataFrame([("d", "0" * 64), ("e", "1" * 64)], "doc_id string, digest string")
    answers = spark.createDataFrame(
        [("d", "INT-01", "pass", 0.9, [("s1:0", "text s1")]), ("d", "TSK-03", "warn", 0.5, [("s2:0", "invented")]), ("d", "TSK-01", "fail", 0.5, [("s2:0", "text")]), ("d", "CON-01", "pass", 0.5, [("s4:0", "text")]), ("d", "RES-01", "warn", 0.5, [("s3:4", "s3 4"), ("s3:4", "s3 4")]), ("d", "GEN-01", "pass", 2.0, [("s1:0", "text")])],
        "doc_id string, rule_id string, status string, confidence double, evidence array<struct<chunk_id:string,quote:string>>",
    )
    got = {(r["doc_id"], r["rule_id"]): r for r in A.conclude(planned, A.annotated(planned, answers), digests).collect()}
    assert got[("d", "INT-01")]["status"] == "pass"
    assert got[("d", "INT-01")]["evidence"][0]["locator"] == f"sha256:{'0' * 64}:0-7"
    assert {got[("d", r)]["status"] for r in ("TSK-03", "TSK-01", "RES-01", "GEN-01")} == {"unverifiable"}
    assert got[("d", "REV-05")]["status"] == "not_applicable"
    assert got[("d", "ANN-01")]["message"] == "section_missing"
    assert got[("d", "GEN-02")]["message"] == "no_answer"
    assert "fail" not in {r["status"] for r in got.values()}
    off = A.conclude(planned, A.disabled(planned), digests).where("status <> 'not_applicable'")
    assert {(r["status"], r["message"]) for r in off.collect()} == {("unverifiable", "provider_disabled")}
    assert G.gate(A.conclude(planned, A.annotated(planned, answers), digests)).where("exit_code <> 0").count() == 0


def test_stream_upserts_findings(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    docs = spark.createDataFrame(DOCS, TABLES["documents"])
    docs.where("doc_id <= 2").coalesce(1).write.parquet(source)
    run = lambda: ingest.evaluate_stream(ingest.document_stream(spark, source), D.findings, out, state).awaitTermination()
    run()
    docs.where("doc_id >= 2").withColumn("n_chars", F.length("text").cast("long")).coalesce(1).write.mode("append").parquet(source)
    run()
    run()  # nothing new: nothing changes
    rows = ingest.latest_findings(spark, out).collect()
    assert len(rows) == 5 * 4
    assert {r["status"] for r in rows if r["doc_id"] == 2 and r["rule_id"] == "DOC-05"} == {"pass"}


def test_stream_windows(spark, tmp_path):
    rows = table(spark, "/root/testdata/sf0.001", "events").limit(500)
    rows.write.parquet(f"file://{tmp_path}/ev")
    stream = spark.readStream.schema(TABLES["events"]).parquet(f"file://{tmp_path}/ev")
    q = ingest.event_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM rates").first()[0] == 500


def test_providers_fall_back_and_never_raise(spark):
    planned = A.plan(spark, *sections(spark)).where("doc_id = 'd'")
    prompted = A.prompts(planned)
    assert prompted.where("rule_id = 'RES-01'").first()["prompt"].startswith('{"rule_id":"RES-01","elements":["0","1",')
    assert prompted.where("rule_id = 'TSK-01'").first()["prompt"].startswith('{"rule_id":"TSK-01","elements":["analysis_summary"')

    def down(_prompt):
        raise ConnectionError

    def local(prompt):
        asked = json.loads(prompt)
        if asked["rule_id"] == "CON-01":
            return {"status": "fail", "elements": asked["elements"]}
        return {"status": "pass", "confidence": 0.5, "elements": asked["elements"], "evidence": [{"chunk_id": asked["chunks"][0]["id"], "quote": "text"}]}

    rows = {r["rule_id"]: r for r in A.ask(prompted, [("down", down), ("local", local)]).collect()}
    assert rows["RES-01"]["status"] == "pass"
    assert len(rows["RES-01"]["elements"]) == 8
    assert (rows["TSK-01"]["provider"], rows["TSK-01"]["attempts"]) == ("local", 2)
    assert (rows["CON-01"]["diagnostic"], rows["CON-01"]["status"]) == ("invalid_answer", None)
    assert {r["diagnostic"] for r in A.ask(prompted, [("down", down)]).collect()} == {"provider_unavailable"}
    assert len({r["prompt_hash"] for r in rows.values()}) == len(rows)


def test_semantic_rates_and_warnings(spark):
    from lexkeel.plans.metrics import semantic_rates
    from lexkeel.plans.rulebook import PARAMETERS, Settings, warnings

    cases = spark.createDataFrame([("A", True, True, True, True), ("A", True, False, False, True), ("B", False, False, False, False)], "rule_id string, schema_ok boolean, evidence_ok boolean, useful boolean, actionable boolean")
    got = {r["rule_id"]: tuple(r)[1:] for r in semantic_rates(cases).collect()}
    assert got["A"] == (2, 1.0, 0.5, 0.5)
    assert got["B"] == (1, 0.0, 0.0, 0.0)
    assert got[None][0] == 3
    assert len(warnings(Settings(), "1-draft", set(), "research")) == len(PARAMETERS) + 1
    assert warnings(Settings(), "1", set(), "software") == []
