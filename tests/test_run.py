from __future__ import annotations

import pytest

from lexkeel.plans import thesis as T
from lexkeel.plans.report import as_json
from lexkeel.plans.run import main, run
from lexkeel.plans.rulebook import Settings

from .test_thesis import CASES, project

pytest.importorskip("yaml")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("run")
    for name in ("pass", "bib02", "fig02"):
        for path, text in CASES[name][0].items():
            (at / name).mkdir(exist_ok=True)
            (at / name / path).write_text(text, encoding="utf-8")
    return at


def test_a_whole_run(spark, root):
    got = run(spark, f"file://{root}")
    gates = {r["doc_id"]: r for r in got.gate.collect()}
    assert {d: r["gate_status"] for d, r in gates.items()} == {"pass": "fail", "bib02": "fail", "fig02": "fail"}  # builds are unverified
    assert "BIB-02" in gates["bib02"]["blocking_rules"]
    assert got.missing.count() == 0
    assert as_json(got.reports).count() == 3
    stages = {r["stage"]: r["count"] for r in got.findings.groupBy("stage").count().collect()}
    assert stages == {"formal": 3 * 45, "semantic": 3 * 25}
    text = {r["doc_id"]: r["text"] for r in got.projects.collect()}
    parts: dict[str, dict] = {}
    for c in got.chunks.collect():
        parts.setdefault(c["doc_id"], {})[c["content_start"]] = c["text"][c["overlap_chars"] :]
        assert text[c["doc_id"]][c["char_start"] : c["char_end"]] == c["text"]
    assert {d: "".join(p[k] for k in sorted(p)) for d, p in parts.items()} == text


def test_filters_and_modes(spark, root):
    got = run(spark, f"file://{root}", Settings(only=("BIB", "FIG-02"), gate_mode="advisory"))
    assert {r["doc_id"]: r["gate_status"] for r in got.gate.collect()} == {"pass": "pass", "bib02": "fail", "fig02": "fail"}
    assert {r["rule_id"][:3] for r in got.findings.select("rule_id").distinct().collect()} == {"BIB", "FIG"}


def test_command_line(spark, root, tmp_path, capsys):
    assert main([f"file://{root}", "--only", "FIG-02", "--out", f"file://{tmp_path}/out"]) == 2
    assert capsys.readouterr().out.split() == ["fail", "1", "pass", "2"]
    assert spark.read.json(f"file://{tmp_path}/out/report").count() == 3


def test_numbered_figures(spark, tmp_path):
    for path, text in project("\\section{A}\\begin{figure}\\caption{Рисунок 7 — X}\\label{a}\\end{figure}\\begin{figure}\\caption{Рисунок 8}\\end{figure}").items():
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / path).write_text(text, encoding="utf-8")
    from lexkeel.sources import projects as P

    got = T.numbered_figures(P.projects(P.read_files(spark, f"file://{tmp_path}"))).collect()
    assert [(r["doc_id"], r["no"]) for r in got] == [("d", 7)]
