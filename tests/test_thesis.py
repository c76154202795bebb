"""Rules over LaTeX projects: a sound project, and copies that differ in one property each."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lexkeel.plans import gate as G
from lexkeel.plans import metrics as M
from lexkeel.plans import thesis as T
from lexkeel.plans.rulebook import Settings, rulebook
from lexkeel.sources import policy as Y
from lexkeel.sources import projects as P

pytest.importorskip("yaml")

CLS = r"""
\RequirePackage{fontspec}\setmainfont{Times New Roman}\RequirePackage{titlesec}\onehalfspacing\setlength{\parindent}{12.5mm}
\RequirePackage[left=30mm,right=10mm,top=20mm,bottom=20mm]{geometry}
\newcommand{\risref}[1]{x}\counterwithin{figure}{section}\captionsetup[figure]{position=below, justification=centering, labelsep=endash, font={stretch=1}}
\captionsetup[table]{position=top, singlelinecheck=off, justification=raggedright}\hyphenpenalty=10000 hyphenpenalty=10000 font={stretch=1}
\newcommand{\vkrlongtable}{x}\RequirePackage{amsmath}\RequirePackage[style=gost-numeric,sorting=none]{biblatex}
"""
KEYS = [f"k{i}" for i in range(24)]
BIB = "\n".join(f"@article{{{k}, author={{Smith J.}}, title={{On Things}}, year={{2024}}, url={{https://a.example/{k}}}, urldate={{2025-01-01}}}}" for k in KEYS)
WORDS = "слово " * 40


def body(review: str | None = None, **over: str) -> str:
    cites = " ".join(f"\\cite{{{k}}}" for k in KEYS)
    parts = {
        "Аннотация": WORDS, "Введение": WORDS, "Обзор НТИ": review or f"{WORDS} {cites}",
        "Структурный системный анализ": "Схема на \\ref{f1}. \\begin{figure}\\caption{Схема}\\label{f1}\\end{figure}",
        "Постановка задачи": "\\begin{itemize}\\item Разработать и проверить метод обработки больших данных\\item Сравнить метод с известными решениями задачи\\end{itemize}",
        "Архитектурно-техническое решение": "Решение на \\ref{f2}. \\begin{figure}\\caption{Решение}\\label{f2}\\end{figure}",
        "Математическая модель": "\\begin{equation}x=1\\end{equation}", "Алгоритм": "Блок 1. Начало. \\begin{algorithm}x\\end{algorithm}", "Программная реализация": WORDS,
        "Анализ результатов": "В \\ref{t1}. \\begin{table}\\caption{Итоги}\\label{t1}\\end{table}", "Заключение": WORDS, "Список источников": "\\addbibresource{refs.bib}", "Приложения": "https://github.com/a/b",
    } | over
    return "\n".join(f"\\section{{{k}}}\n{v}" for k, v in parts.items() if v is not None)


def project(tex: str | None = None, preamble: str = "", cls: str = CLS, bib: str = BIB) -> dict[str, str]:
    tex = body() if tex is None else tex
    digest = hashlib.sha256(CLS.encode()).hexdigest()
    return {"main.tex": f"\\documentclass{{x}}{preamble}\n\\begin{{document}}\n{tex}\n\\end{{document}}", "x.cls": cls, "refs.bib": bib, "protected-files.yaml": f'version: 1\nclass_files:\n  - path: x.cls\n    sha256: "{digest}"\nforbidden_preamble:\n  - pattern: "\\\\\\\\renewcommand"\n    message: renewed\n'}


CASES = {
    "pass": (project(), {}),
    "sys01": (project(cls=CLS + "%"), {"SYS-01": "fail"}),
    "sys02": (project(preamble="\\usepackage{geometry}"), {"SYS-02": "fail"}),
    "sys02b": (project(preamble="\\renewcommand{\\a}{b}"), {"SYS-02": "fail"}),
    "str01": (project(body(**{"Программная реализация": None})), {"STR-01": "fail"}),
    "str02": (project(body(Заключение="\\subsubsection{Отдельный пункт}")), {"STR-02": "fail"}),
    "ann02": (project(body(Аннотация="\\begin{itemize}\\item a\\end{itemize}")), {"ANN-02": "fail"}),
    "int02": (project(body(Введение="\\begin{enumerate}\\item a\\end{enumerate}")), {"INT-02": "fail"}),
    "fig02": (project(body(Заключение="\\begin{figure}\\caption{Лишний}\\end{figure}")), {"FIG-02": "fail"}),
    "fig02b": (project(body(Заключение="\\begin{figure}\\caption{Лишний}\\label{z}\\ref{z}\\end{figure}")), {"FIG-02": "fail"}),
    "fig03": (project(body(Заключение="см. рис. 2")), {"FIG-03": "fail"}),
    "tab03": (project(body(Заключение="\\begin{table}\\caption{Лишняя}\\label{tz}\\end{table}")), {"TAB-03": "warn"}),
    "tab02": (project(body(Заключение="\\begin{longtable}{l}a\\end{longtable}")), {"TAB-02": "warn", "TAB-03": "warn"}),
    "cap01": (project(body(Заключение="\\ref{q}\\begin{figure}\\caption{с малой буквы.}\\label{q}\\end{figure}")), {"CAP-01": "fail"}),
    "bib01": (project(body(Заключение="\\footcite{k1}")), {"BIB-01": "fail"}),
    "bib01w": (project(body(Заключение="\\footnote{См. https://a.example}")), {"BIB-01": "warn"}),
    "bib02": (project(body(Заключение="как в [1, 2-3]")), {"BIB-02": "fail"}),
    "bib03": (project(bib=BIB.replace("title={On Things}", "note={x}", 1)), {"BIB-03": "fail"}),
    "bib04": (project(bib=BIB.replace("urldate", "seen", 1)), {"BIB-04": "fail"}),
    "bib05": (project(bib=BIB + "\n@book{extra, author={A}, title={B}, year={2024}}"), {"BIB-05": "warn"}),
    "bib05n": (project(body(Заключение="\\nocite{*}")), {"BIB-05": "warn"}),
    "rev01": (project(body("\\cite{k0,k1}")), {"REV-01": "warn", "REV-02": "warn", "BIB-05": "warn"}),
    "rev03": (project(bib=BIB.replace("year={2024}", "year={1999}")), {"REV-03": "warn"}),
    "rev04": (project(bib=BIB.replace("https://a.example/k0", "https://ru.wikipedia.org/x")), {"REV-04": "fail"}),
    "rev07": (project(body(f"{'слово ' * 200}\n\n" + " ".join(f"\\cite{{{k}}}" for k in KEYS))), {"REV-07": "warn"}),
    "mth01": (project(body(**{"Математическая модель": "$$x$$"})), {"MTH-01": "fail"}),
    "tsk02": (project(body(**{"Постановка задачи": "\\begin{itemize}\\item Сделать.\\end{itemize}"})), {"TSK-02": "warn"}),
    "alg": (project(body(Алгоритм="нет")), {"ALG-01": "warn", "ALG-03": "warn"}),
    "app01": (project(body(Приложения="нет ссылки")), {"APP-01": "info"}),
    "ssa01": (project(body(**{"Структурный системный анализ": "нет"})), {"SSA-01": "warn"}),
    "res01": (project(body(**{"Анализ результатов": "нет"})), {"RES-01": "warn"}),
    "verbatim": (project(body(Заключение="\\begin{verbatim}\\begin{figure}\\end{figure}\\end{verbatim} % \\footcite{x}")), {"FIG-02": "fail"}),
}
#: Rules that these inputs (no PDF, no build log) leave open, and rules without an implementation.
OPEN = {"SYS-03", "DEP-01", "ANN-03", "FIG-01", "STR-03", "STR-04"}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("projects")
    for name, (files, _) in CASES.items():
        for path, text in files.items():
            (root / name).mkdir(exist_ok=True)
            (root / name / path).write_text(text, encoding="utf-8")
    (root / "broken").mkdir()
    (root / "broken" / "main.tex").write_text("\\input{main}", encoding="utf-8")
    files = P.read_files(spark, f"file://{root}")
    projects = P.projects(files).cache()
    sections = P.sections(spark, projects).cache()
    protected, forbidden = Y.policies(files)
    facts = T.facts(spark, projects, sections, files, P.bib_entries(files, projects), protected, forbidden)
    return projects, sections, T.evaluate(spark, facts).cache()


def test_each_case_shows_its_own_findings_only(run):
    got: dict[str, dict[str, set[str]]] = {}
    for r in run[2].collect():
        got.setdefault(r["doc_id"], {}).setdefault(r["rule_id"], set()).add(r["status"])
    for name, (_, want) in CASES.items():
        shown = {rule: s for rule, s in got[name].items() if rule not in OPEN and s - {"pass", "not_applicable"}}
        assert shown == {rule: {s} for rule, s in want.items()}, name
        assert got[name]["DEP-01"] == {"unverifiable"}
    assert len(got["pass"]) == 45


def test_a_broken_project_is_never_passed(run):
    statuses = {r["rule_id"]: r["status"] for r in run[2].where("doc_id = 'broken'").collect()}
    assert "pass" not in {statuses[r.id] for r in T.RULES if "L" in r.needs}


def test_sections_cover_each_text(run, spark):
    projects, sections, _ = run
    total = {r["doc_id"]: r["n"] for r in projects.select("doc_id", F.length("text").alias("n")).collect()}
    by: dict[str, list] = {}
    for r in sections.collect():
        by.setdefault(r["doc_id"], []).append((r["char_start"], r["char_end"], r["section_id"]))
    for doc, spans in by.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == total[doc]
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert len({s[2] for s in spans}) == len(spans)


def test_gate_modes_and_order(run, spark):
    findings = run[2]
    strict = {r["doc_id"]: r for r in G.gate(findings).collect()}
    advisory = {r["doc_id"]: r for r in G.gate(findings, "advisory").collect()}
    assert strict["pass"]["gate_status"] == "fail"  # the build could not be verified
    assert advisory["pass"]["gate_status"] == "degraded"
    assert advisory["bib02"]["gate_status"] == "fail"
    for doc, r in strict.items():
        assert set(filter(None, advisory[doc]["blocking_rules"].split(","))) <= set(r["blocking_rules"].split(","))
    ordered = G.order(findings, rulebook(spark))
    again = G.order(findings.repartition(7), rulebook(spark))
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "place", "fingerprint").collect())
    assert key(ordered) == key(again)


def test_metrics_over_the_cases(run, spark):
    labels = [(name, rule, s) for name, (_, want) in CASES.items() for rule, s in want.items() if s in ("fail", "warn")]
    labels += [("pass", r.id, "silent") for r in T.RULES]
    observed = M.observe(spark.createDataFrame(labels, "fixture_id string, rule_id string, expected string"), run[2])
    total = M.confusion(observed, []).first()
    assert (total["precision"], total["recall"], total["f1"], total["mismatches"]) == (1.0, 1.0, 1.0, 0)
    rows = {r["rule_id"]: r for r in M.per_rule(observed, rulebook(spark)).collect()}
    assert len(rows) == 64
    assert rows["GEN-01"]["labeled_pairs"] == 0


def test_build_logs(spark, run):
    projects, sections, _ = run
    logs = spark.createDataFrame(
        [("pass", "success", "", True, 0), ("sys01", "compile_error", "Overfull \\hbox (20.5pt too wide)\nOverfull \\hbox (3.0pt too wide)", True, 1), ("sys02", "missing_dependency", "! LaTeX Error: File `a.sty' not found", False, 0), ("str01", "timeout", "", True, 0)],
        "doc_id string, status string, log string, chktex_available boolean, chktex_returncode int",
    )
    facts = T.facts(spark, projects, sections, logs=logs)
    rows = T.evaluate(spark, facts, Settings(only=("SYS-03",))).collect()
    got = {d: sorted((r["status"], r["severity"]) for r in rows if r["doc_id"] == d) for d in ("pass", "sys01", "sys02", "str01", "bib01")}
    assert got == {"pass": [("pass", "error")], "sys01": [("fail", "error"), ("warn", "warn"), ("warn", "warn")], "sys02": [("fail", "error"), ("unverifiable", "info")], "str01": [("fail", "error")], "bib01": [("unverifiable", "error")]}


def test_declared_counts(spark, tmp_path):
    for name, text in {"right": "10 страниц, 2 рисунка, 1 таблица, 1 приложение", "wrong": "9 страниц, 2 рисунка, 1 таблица, 1 приложение", "open": "10 страниц", "torn": "10 страниц, 11 страниц, 2 рисунка, 1 таблица, 1 приложение"}.items():
        for path, t in project(body(Аннотация=text) + "\n\\appendix\n\\section{Код}").items():
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / path).write_text(t, encoding="utf-8")
    files = P.read_files(spark, f"file://{tmp_path}")
    projects = P.projects(files).cache()
    pages = projects.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("number"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.lit(0).alias("rotation"))
    rows = T.evaluate(spark, T.facts(spark, projects, P.sections(spark, projects), pages=pages), Settings(only=("ANN-03",))).collect()
    assert {r["doc_id"]: r["status"] for r in rows} == {"right": "pass", "wrong": "fail", "open": "unverifiable", "torn": "unverifiable"}
