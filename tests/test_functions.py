from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexkeel.functions import bibtex, identity, latex, redaction, text
from lexkeel.operators import windows
from lexkeel.plans import rulebook
from lexkeel.plans.rulebook import RulebookError
from lexkeel.sources import policy


def apply(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_text_functions(spark):
    assert apply(spark, text.estimate_tokens, "", "a", "abcd", "abcde", "éé", None) == [0, 1, 1, 2, 1, 0]
    assert apply(spark, text.word_count, "привет мир foo_1", "") == [3, 0]
    assert apply(spark, text.compound_word_count, "well-known author's what-if") == [3]
    assert apply(spark, text.latin_ratio, "abв1", "123") == [pytest.approx(2 / 3), 0.0]
    assert apply(spark, text.first_year, "in 1899, 1999 and 2020", "none") == [1999, None]
    assert apply(spark, text.significant_chars, " a\u200bb\t\u00a0c") == [3]
    assert apply(spark, text.repeated_key, "Page 12 of 345, Глава") == ["page # of # глава"]
    assert apply(spark, text.plain_title, "Глава 1. Ёлка — и всё", "2.3.1 Обзор") == ["елка и все", "обзор"]
    assert apply(spark, text.slug, "1.2 Обзор НТИ!", "...") == ["обзор-нти", "section"]
    assert apply(spark, text.normalize_plain, " a \r\n\r\n\r\n\r\n b\u00a0 c\t d ") == ["a\n\nb c d"]
    assert apply(spark, text.url_host, "HTTPS://u:p@Host.Example:80/x", "no") == ["host.example", ""]
    assert apply(spark, text.strip_comments, r"a % c", r"a \% b % c", r"a \\% c") == ["a ", r"a \% b ", r"a \\"]


def test_redaction(spark):
    got = apply(
        spark, redaction.redact_text, "token = abc123, next", 'API_KEY: "x y"', "sk-abcdefgh12", "Authorization Bearer abcdefghijk", "write a.b@c.org now", r"see C:\Users\me\file.txt.", "in /home/me/x/y.txt!", "~/secret/notes done",
        'raw_prompt = "do it\nnow" end', "x\nTraceback (most recent call last):\n  File", "a\x00b", "http://host/path stays",
    )
    assert got == [
        "token = [REDACTED], next", 'API_KEY: [REDACTED] y"', "[REDACTED]", "Authorization Bearer [REDACTED]", "write [REDACTED] now", "see [REDACTED_PATH]", "in [REDACTED_PATH]", "~[REDACTED_PATH] done",
        "raw_prompt = [REDACTED] end", "x [REDACTED_TRACEBACK]", "ab", "http://host/path stays",
    ]
    long = "w " * 200
    assert apply(spark, redaction.truncate_public, long, "x" * 240) == [long[:240].rstrip() + "… [TRUNCATED]", "x" * 240]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=8))
def test_json_strings_equal_the_standard_library(spark, values):
    assert apply(spark, identity.json_string, *values) == [json.dumps(v, ensure_ascii=False) for v in values]


def test_fingerprint_is_the_hash_of_canonical_json(spark):
    row = ("R", "script", "error", "fail", 'a "q"\n', [("loc", None), ("l2", "d")], None, 3)
    df = spark.createDataFrame([row], "rule_id string, layer string, severity string, status string, message string, evidence array<struct<locator:string,description:string>>, path string, page int")
    want = {"rule_id": "R", "layer": "script", "severity": "error", "status": "fail", "message": 'a "q"\n', "evidence": [{"locator": "loc"}, {"locator": "l2", "description": "d"}], "page": 3}
    canonical = json.dumps(want, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    got = df.select(identity.canonical_finding().alias("c"), identity.fingerprint().alias("f")).first()
    assert got["c"] == canonical
    assert got["f"] == "sha256:" + hashlib.sha256(canonical.encode()).hexdigest()


def test_locators(spark):
    digest = "0" * 64
    made = f"sha256:{digest}:3-9"
    got = apply(spark, identity.parse_locator, made, f"sha256:{digest}:9-3", "sha256:x:1-2", f"sha256:{digest}:1-99999999999")
    assert [g and tuple(g) for g in got] == [(digest, 3, 9), None, None, (digest, 1, 99999999999)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab .\n\n!é漢😀"), max_size=400), st.integers(1, 30), st.integers(0, 3))
def test_chunks_are_lossless_and_within_budget(source, budget, overlap):
    overlap = min(overlap, budget // 10)
    at, parts = 0, []
    for start, new, end in windows.chunk_text(source, budget, overlap):
        assert new == at and start <= new < end
        parts.append(source[new:end])
        assert len(source[start:end].encode()) <= 4 * budget or end - start == 1 or end - new == 1
        assert len(source[start:new].encode()) <= 4 * overlap
        at = end
    assert "".join(parts) == source


def test_chunks_break_at_paragraphs():
    source = "First sentence here. Second one.\n\nNew paragraph follows with words."
    ends = [e for _, _, e in windows.chunk_text(source, 10, 0)]
    assert source[: ends[0]].endswith("\n\n")


def test_latex_sources():
    files = {"main.tex": r"\documentclass{x}\begin{document}A \input{ch/one} % \input{no}" "\n" r"\begin{verbatim}\input{lit} % kept\end{verbatim}\end{document}", "ch/one.tex": r"one \input{two}", "ch/two.tex": "two"}
    full, read, error = latex.expand(files, "main.tex")
    assert error is None
    assert "A one two" in full
    assert r"\input{lit} % kept" in full
    assert read == ["main.tex", "ch/one.tex", "ch/two.tex"]
    assert latex.expand({"main.tex": r"\input{main}"}, "main.tex")[2] == "include cycle"
    assert latex.expand({"main.tex": r"\input{../x}"}, "main.tex")[2] == "include leaves the project"
    assert latex.expand({"main.tex": r"\input{gone}"}, "main.tex")[2] == "include not found"
    assert latex.structural("a\\begin{lstlisting}x\\end{lstlisting}b % c\nd") == "a b \nd"
    nested = "\\begin{verbatim}\\begin{verbatim}x\\end{verbatim}y\\end{verbatim}z"
    assert latex.mask_literals(nested)[0].endswith("z")
    assert len(latex.mask_literals(nested)[1]) == 1
    assert latex.mask_literals("\\begin{minted}open")[1] == ["\\begin{minted}open"]


def test_plain_text_and_headings():
    tex = r"\section{Введение} Text \emph{bold} \cite{a} 5\% of~it. \subsection*{Part $x$} More"
    plain = latex.plain(tex)
    assert plain == "Введение Text bold  5% of it. Part x More".replace("  ", " ")
    assert latex.headings(tex, plain) == [("Введение", 2, 0), ("Part x", 3, plain.index("Part"))]


def test_bibtex():
    source = '@Article{k1, author = {A {B} C}, title="T \\"q\\"", year = 2020,\n url={u}}\n@misc{nokey}\n@book{ , title={x}}\n@online{k2,\n title = {two}\n}\n@article{cut, title = {never ends'
    assert list(bibtex.entries(source)) == [("k1", "article", {"author": "A {B} C", "title": 'T "q"', "year": "2020", "url": "u"}), ("k2", "online", {"title": "two"})]


def test_rulebook(spark):
    book = rulebook.rulebook(spark)
    assert book.count() == 64
    assert {r["severity"]: r["count"] for r in book.groupBy("severity").count().collect()} == {"error": 26, "warn": 34, "info": 4}
    research = rulebook.effective(book, rulebook.Settings(profile="research")).where("enabled")
    assert research.count() == 57
    only = rulebook.effective(book, rulebook.Settings(only=("FMT", "SYS-02"), final=True))
    assert {r["id"] for r in only.collect()} == {"FMT-01", "FMT-02", "FMT-03", "FMT-04", "FMT-05", "SYS-02"}
    with pytest.raises(RulebookError):
        rulebook.Settings(only=("XYZ",)).check()
    with pytest.raises(RulebookError):
        rulebook.Settings(profile="other").check()
    assert rulebook.fill("size {font_size_pt} and {defense_year} \\{x}", {"font_size_pt": 14, "defense_year": 2026}, {"font_size_pt"}) == "size 14 and {defense_year} \\{x}"
    with pytest.raises(RulebookError):
        rulebook.fill("{who}", {}, set())


def test_yaml_is_strict():
    pytest.importorskip("yaml")
    with pytest.raises(RulebookError):
        policy.parse("a: 1\na: 2")
    texts = {"c/main.yaml": "include: [base.yaml]\nparams: {x: 2}", "c/base.yaml": "params: {x: 1, y: 1}", "c/loop.yaml": "include: loop.yaml"}
    assert policy.load_config(texts.__getitem__, "c/main.yaml") == {"params": {"x": 2, "y": 1}}
    with pytest.raises(RulebookError):
        policy.load_config(texts.__getitem__, "c/loop.yaml")


def test_quote_spans(spark):
    got = apply(spark, windows.quote_spans, "one two three four five. six\nseven; eight", "", "a  b")
    assert [list(g) for g in got] == [["one two three four", "five.", "six", "seven;", "eight"], [], ["a  b"]]


def test_missing_dependencies(spark):
    from lexkeel.sources import dependencies

    main = "\\documentclass{thesis}\\usepackage{amsmath,styles/own}\\input{ch/a}\\include{ch/b}\\includegraphics{fig/x}\\includegraphics{fig/y}\\addbibresource{r.bib} % \\input{no}\n\\begin{verbatim}\\input{lit}\\end{verbatim}\\input{\\dyn}"
    rows = [("p", "main.tex", main), ("p", "ch/a.tex", "\\input{c} \\input{gone}"), ("p", "ch/c.tex", "\\input{main} \\bibliography{q,r}"), ("p", "fig/x.png", ""), ("p", "r.bib", ""), ("p", "lost.tex", "\\input{unreached}"), ("o", "main.tex", "\\documentclass{article}")]
    files = spark.createDataFrame([(d, p, t.encode()) for d, p, t in rows], "doc_id string, path string, content binary")
    mains = spark.createDataFrame([("p", "main.tex"), ("o", "main.tex")], "doc_id string, main string")
    got = sorted((r["doc_id"], r["place"], r["kind"], r["ref"]) for r in dependencies.missing(files, mains).collect())
    assert [g[2:] for g in got] == [("include", "ch/b.tex"), ("include", "gone.tex"), ("class", "thesis.cls"), ("style", "styles/own.sty"), ("bibliography", "q.bib"), ("image", "fig/y")]
    assert {g[0] for g in got} == {"p"}
