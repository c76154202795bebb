"""What is wrong in one project's files stays that project's business."""

from __future__ import annotations

import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexkeel.functions import identity as I
from lexkeel.functions import latex as L
from lexkeel.plans import thesis as T
from lexkeel.plans.run import run
from lexkeel.sources import dependencies as D
from lexkeel.sources import policy as Y
from lexkeel.sources import projects as P

from .test_thesis import CASES

pytest.importorskip("yaml")
GOOD = CASES["pass"][0]


def put(at, name, files):
    for path, content in files.items():
        (at / name / path).parent.mkdir(parents=True, exist_ok=True)
        (at / name / path).write_bytes(content if isinstance(content, bytes) else content.encode())


BAD = {
    "tex1251": {"main.tex": GOOD["main.tex"].encode("cp1251", "replace")},
    "bib1251": {"refs.bib": next(v for k, v in GOOD.items() if k.endswith(".bib")).encode() + "автор".encode("cp1251")},
    "cls1251": {"unused.cls": "класс".encode("cp1251")},
    "yaml_twice": {Y.POLICY: "version: 1\nversion: 2\n"},
    "yaml_broken": {Y.POLICY: "class_files: [}\n"},
    "yaml_bytes": {Y.POLICY: b"version: \xff\xfe\n"},
    "yaml_shape": {Y.POLICY: "class_files:\n- path: a.cls\n"},
    "pattern": {Y.POLICY: "forbidden_preamble:\n- pattern: '([a-z'\n  message: broken\n"},
    "java_only": {Y.POLICY: "forbidden_preamble:\n- pattern: '(?P<x>a)'\n  message: python only\n"},
}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    at = tmp_path_factory.mktemp("faults")
    for name in ("good1", "good2"):
        put(at, name, GOOD)
    for name, files in BAD.items():
        put(at, name, GOOD | files)
    put(at, "brace", GOOD | {Y.POLICY: "forbidden_preamble:\n- pattern: 'newcommand{.x'\n  message: braces\n", "main.tex": GOOD["main.tex"].replace("\\begin{document}", "\\newcommand{\\x}\\begin{document}")})
    return at


def test_faults_stay_with_their_projects(spark, corpus, tmp_path):
    got = run(spark, f"file://{corpus}")
    status = {}
    for r in got.findings.where("stage = 'formal'").collect():
        status.setdefault(r["doc_id"], {})[r["rule_id"]] = (r["status"], r["message"])
    put(tmp_path, "alone", GOOD)
    alone = {r["rule_id"]: (r["status"], r["message"]) for r in run(spark, f"file://{tmp_path}").findings.where("stage = 'formal'").collect()}
    assert status["good1"] == status["good2"] == alone
    assert set(status) >= {*BAD, "good1", "good2"}
    assert all(s == "unverifiable" for s in (status["tex1251"]["SYS-02"][0], status["tex1251"]["STR-01"][0]))
    assert "not UTF-8" in status["tex1251"]["STR-01"][1]
    assert status["bib1251"]["BIB-02"][0] == "unverifiable" and status["bib1251"]["STR-01"] == alone["STR-01"]
    assert status["brace"]["SYS-02"] == ("fail", "braces")  # a brace that counts nothing is a literal
    for name in ("yaml_twice", "yaml_broken", "yaml_bytes", "yaml_shape", "pattern", "java_only"):
        assert status[name]["SYS-02"][0] == "unverifiable" and "policy" in status[name]["SYS-02"][1], name
        assert {k: v for k, v in status[name].items() if k in ("STR-01", "FIG-02", "TAB-03", "REV-03")} == {k: v for k, v in alone.items() if k in ("STR-01", "FIG-02", "TAB-03", "REV-03")}


def test_faults_are_listed(spark, corpus):
    files = P.read_files(spark, f"file://{corpus}")
    got = {(r["doc_id"], r["path"]) for r in P.faults(files).collect()}
    assert got == {("tex1251", "main.tex"), ("bib1251", "refs.bib"), ("cls1251", "unused.cls"), ("yaml_bytes", Y.POLICY)}
    assert {r["doc_id"] for r in Y.policy_faults(files).collect()} == {"yaml_twice", "yaml_broken", "yaml_bytes", "yaml_shape", "pattern", "java_only"}


@pytest.mark.parametrize("root", [".", "./data", "data", "data/", "{abs}/data", "file://{abs}/data"])
def test_roots(spark, tmp_path, monkeypatch, root):
    """A relative root, and folders named like the root further down."""
    base = tmp_path / "data" if root != "." else tmp_path
    for path in ("doc1/main.tex", "doc1/data/fig.tex", "doc1/data/sub/deep.tex", "doc2/main.tex"):
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text("x")
    before = os.getcwd()
    # Spark resolves relative paths against the folder that its own process started in.
    at = root.format(abs=tmp_path) if "{abs}" in root else os.path.relpath(base if root in (".", "data", "./data") else f"{base}/", before) + ("/" if root.endswith("/") else "")
    got = {(r["doc_id"], r["path"]) for r in P.read_files(spark, at).collect()}
    assert got == {("doc1", "main.tex"), ("doc1", "data/fig.tex"), ("doc1", "data/sub/deep.tex"), ("doc2", "main.tex")}


def test_includes_of_any_depth(spark):
    """A chain longer than the former limit, with a cycle at its end."""
    n = 120
    rows = [("d", f"f{i}.tex", f"\\input{{f{i + 1}}}") for i in range(n)] + [("d", f"f{n}.tex", "\\input{f0}\\input{gone}\\includegraphics{lost}")]
    files = spark.createDataFrame(rows, "doc_id string, path string, text string").select("doc_id", "path", F.col("text").cast("binary").alias("content"))
    got = D.missing(files, spark.createDataFrame([("d", "f0.tex")], "doc_id string, main string")).collect()
    assert [(r["kind"], r["ref"], r["place"]) for r in got] == [("include", "gone.tex", 1), ("image", "lost", 2)]


def test_locators_beyond_nine_digits(spark):
    digest = "a" * 64
    row = spark.createDataFrame([(f"sha256:{digest}:1234567890-12345678901",), (f"sha256:{digest}:5-5",), (f"sha256:{digest}:1-{'9' * 30}",)], "l string").select(I.parse_locator(F.col("l")).alias("p")).collect()
    assert (row[0]["p"]["start"], row[0]["p"]["end"]) == (1234567890, 12345678901)
    assert row[1]["p"] is None and row[2]["p"] is None


def test_lists_beyond_the_former_cap(spark):
    items = "\\item слово " * 100_050 + "\\item я"
    body = "\\section{Постановка задачи}\\begin{itemize}" + "\\item достаточно длинная постановка задачи номер " * 100_010 + "\\item коротко\\end{itemize}\\section{A}"
    sec = "array<struct<section_id:string,title:string,norm:string,kind:string,level:int,locator:string>>"
    df = spark.createDataFrame([(body,)], "visible string").withColumn("secs", F.array(F.struct(F.lit("s").alias("section_id"), F.lit("Постановка задачи").alias("title"), F.lit("постановка задачи").alias("norm"), F.lit("other").alias("kind"), F.lit(1).alias("level"), F.lit("l").alias("locator"))).cast(sec))
    got = df.select(F.inline(T.shorter(30))).first()
    assert got["status"] == "warn" and "short tasks: 1;" in got["message"] and len(items) > 100_000


def test_titles_that_hold_a_quote_mark_of_patterns(spark):
    title = r"A \E b"
    got = spark.createDataFrame([(f"\\section{{{title}}} inside \\section{{C}} out", title)], "b string, t string").select(L.section_body(F.col("b"), F.col("t")).alias("x")).first()["x"]
    assert got == " inside "


def test_decomposed_headings_are_composed(spark, tmp_path):
    """Headings typed as letters and combining marks meet the same names as composed ones."""
    put(tmp_path, "nfd", {k: unicodedata.normalize("NFD", v) for k, v in GOOD.items()})
    put(tmp_path, "nfc", GOOD)
    got = {}
    for r in run(spark, f"file://{tmp_path}").findings.where("stage = 'formal'").collect():
        got.setdefault(r["doc_id"], {})[r["rule_id"]] = (r["status"], r["message"])
    assert {k: v for k, v in got["nfd"].items() if k != "SYS-01"} == {k: v for k, v in got["nfc"].items() if k != "SYS-01"}
