"""The one-pass LaTeX scanner, its maps back to the files, and texts that must not end a run."""

from __future__ import annotations

import random
import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexkeel.functions import identity as I
from lexkeel.functions import latex as L
from lexkeel.functions import redaction as R
from lexkeel.functions import text as X
from lexkeel.functions import texscan as T
from lexkeel.plans import advisory as A
from lexkeel.plans.run import run
from lexkeel.sources import origins as O
from lexkeel.sources import policy as Y
from lexkeel.sources import projects as P

from .test_faults import put
from .test_thesis import CASES

GOOD = CASES["pass"][0]


def source_of(spans, text, at):
    """Where one character of an output comes from."""
    return T.parts(spans, [s.at for s in spans], at, at + 1)[0]


SOURCES = [
    "plain text", "a % comment\nb", "a \\% b % c", "\\\\% after a line end", "\\begin{verbatim}% kept \\input{x}\\end{verbatim}after", "\\begin{minted}open % kept",
    "\\begin{verbatim}\\begin{verbatim}x\\end{verbatim}y\\end{verbatim}z % gone", "% \\begin{verbatim}\nnot literal % gone", "\x005\x00 \x00", "\\", "%", "{", "}", "[", "]", "\\input{", "\\inputenc{x}", "\\input file rest",
]


@pytest.mark.parametrize("tex", SOURCES)
def test_pieces_have_no_gaps(tex):
    cut = list(T.pieces(tex))
    assert "".join(tex[p.start : p.end] for p in cut) == tex
    assert all(a.end == b.start for a, b in zip(cut, cut[1:], strict=False))


@given(st.text(alphabet="ab \n%\\{}[]~$-`'\x00é\u0301") | st.lists(st.sampled_from(["\\begin{verbatim}", "\\end{verbatim}", "\\input{a}", "\\section{", "}", "%", "\n", "\\\\", "x ", "\\cite[p]{k}", "\\'e", "\\emph{", "[", "]", "\\item", "\x000\x00"])).map("".join))
@settings(max_examples=300, deadline=None)
def test_any_text_is_read(tex):
    assert "".join(tex[p.start : p.end] for p in T.pieces(tex)) == tex
    got = T.read(tex)
    assert got.text == got.text.strip(" \t\f\v\r\n\u00a0") and "\n\n\n" not in got.text and "  " not in got.text
    assert sum(s.n for s in got.spans) == len(got.text)
    for s in got.spans:
        if s.n == s.m and s.n > 1:
            same = zip(got.text[s.at : s.at + s.n], tex[s.offset : s.offset + s.m], strict=True)
            assert all(a == b or b in "\t\f\v\r\n~\u00a0" for a, b in same)
    for h in got.headings:
        assert got.text[h.start : h.start + len(h.title)].split() == h.title.split()


def test_readings():
    tex = "a % c\nb \\begin{lstlisting}x % y\\end{lstlisting} z"
    assert T.visible(tex) == "a \nb \\begin{lstlisting}x % y\\end{lstlisting} z"
    assert T.structural(tex) == "a \nb   z"
    assert T.read(tex).text == "a\nb x % y z"
    # A comment hides what opens an environment; nothing that a text holds is taken for a mark.
    assert T.visible("% \\begin{verbatim}\nx % y\nz") == "\nx \nz"
    assert T.visible("\x005\x00") == "\x005\x00" and T.structural("\x000\x00") == "\x000\x00"


@pytest.mark.parametrize(
    ("tex", "text", "heads"),
    [
        (r"\section{A \textbf{b \emph{c {d}}} e} f", "A b c d e f", [("A b c d e", 2, 0)]),
        (r"\section[short]{Long \label{x} title} t", "Long title t", [("Long title", 2, 0)]),
        (r"see Intro. \section*{Intro} x \subsection{Intro}", "see Intro. Intro x Intro", [("Intro", 2, 11), ("Intro", 3, 19)]),
        (r"\section{open \textbf{x}", "open x", []),
        (r"\chapter{}\section{ }\section{A}", "A", [("A", 2, 0)]),
        (r"\cite[p.~5][q]{a,b} \footcite{x} \label{a{b}c} y \begin{figure}[ht]z\end{figure}", "y z", []),
        (r"a\\[2mm]b \item[x] c \item d~e --- f -- ``g''", 'a\nb c d e — f – "g"', []),
        (r"\'etude \'{e}t\"{u}de na\"ive \^o", "étude étüde naïve ô", []),
        ("a\u00a0\t b \r\n \r\n\r\n c", "a b\n\nc", []),
        (r"\{x\} \$5 \# \_ \& 5\%", "{x} $5 # _ & 5%", []),
    ],
)
def test_plain_text_and_headings(tex, text, heads):
    got = T.read(tex)
    assert got.text == text
    assert [tuple(h) for h in got.headings] == heads


def test_headings_map_to_their_arguments():
    rng = random.Random(2)
    for _ in range(40):
        names = [rng.choice(["Ёлка", "Ab \\emph{c}", "x~y", "\\'et\\'e"]) + str(i) for i in range(6)]
        tex = "".join(f"{rng.choice(['text', '% note', 'a $x$'])}\n\\section{{{n}}}\n" for n in names)
        got = T.read(tex)
        starts = [s.at for s in got.spans]
        assert len(got.headings) == 6
        for h, n in zip(got.headings, names, strict=True):
            (_, lo, hi), *more = T.parts(got.spans, starts, h.start, h.start + len(h.title))
            assert not more and tex[lo:hi] == n


@given(st.text(alphabet="aeo\u0301\u0308\u0327\u1100\u1161\u11a8q \u0915\u093c\u212b"))
@settings(max_examples=300, deadline=None)
def test_composed_texts_map_back(text):
    made, spans = T.composed(text)
    assert made == unicodedata.normalize("NFC", text)
    assert sum(s.n for s in spans) == len(made) and sum(s.m for s in spans) == len(text)
    for s in spans:
        assert unicodedata.normalize("NFC", text[s.offset : s.offset + s.m]) == made[s.at : s.at + s.n]


def test_maps_through_includes():
    files = {"main.tex": "top % x\n\\input{a}\nend", "a.tex": "in \\input{b/c} out", "b/c.tex": "deep"}
    got = T.expand(files, "main.tex")
    assert got.text == "top \nin deep out\nend" and got.error is None
    for at, ch in enumerate(got.text):
        no, lo, _ = source_of(got.spans, got.text, at)
        assert files[got.read[no]][lo] == ch
    assert T.parts(got.spans, [s.at for s in got.spans], 0, len(got.text)) == [(0, 0, 8), (1, 0, 3), (2, 0, 4), (1, 14, 18), (0, 17, 21)]


def test_a_deep_chain_of_includes_needs_no_stack():
    n = 5_000
    files = {f"f{i}.tex": f"{i} \\input{{f{i + 1}}}" for i in range(n)} | {f"f{n}.tex": "end"}
    got = T.expand(files, "f0.tex")
    assert got.error is None and got.text.endswith("end") and len(got.read) == n + 1


@pytest.mark.parametrize("unit", ["{", "\\emph{", "\\section{a {b {c}} d}", "\\begin{verbatim}", "[1,", "%x\n", "\\cite[a][b]{c}", "x", "\\label{", "e\u0301", "\\[\\{", "}", "\\item["])
def test_reading_is_linear(unit):
    took = []
    for size in (100_000, 400_000):
        tex = unit * (size // len(unit))
        began = time.perf_counter()
        T.read(T.composed(tex)[0])
        T.visible(tex)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5 and took[1] < 20


# ---- origins ----


def test_locators_lead_to_the_files(spark, tmp_path):
    part = "\\section{Re\u0301sume\u0301 \\textbf{x}}\nLe cafe\u0301 est\nouvert. \U0001f600 fin\n"
    main = "\\documentclass{x}\n\\begin{document}\n\\section{Top}\na % no\nb \\input{part}\n\\section{End~here}\nz\n\\end{document}"
    put(tmp_path, "d", {"main.tex": main, "part.tex": part})
    files = P.read_files(spark, f"file://{tmp_path}")
    projects = P.projects(files).cache()
    text = projects.first()["text"]
    assert "Résumé x" in text and "café est" in text
    digest = I.source_hash(F.col("text"))
    heads = projects.select("doc_id", digest.alias("digest"), F.explode("headings").alias("h")).select("doc_id", I.locator(F.col("digest"), F.col("h.char_start"), F.col("h.char_start") + F.length("h.title")).alias("locator"), "h.title")
    raw = {"main.tex": main, "part.tex": part}
    want = {"Top": ("main.tex", "Top"), "Résumé x": ("part.tex", "Re\u0301sume\u0301 \\textbf{x"), "End here": ("main.tex", "End~here")}
    for r in O.resolve(heads, projects, files).join(heads, ["doc_id", "locator"]).collect():
        path, words = want.pop(r["title"])
        assert (r["path"], r["quote"]) == (path, words) and raw[path][r["char_start"] : r["char_end"]] == words
        assert raw[path].encode()[r["byte_start"] : r["byte_end"]].decode() == words
    assert not want
    # Quotes of either composition, a locator over two files, one of another text, and one beyond the end.
    at = text.index("café est")
    quotes = spark.createDataFrame([("d", "R", 0, "c", "cafe\u0301 est"), ("d", "S", 0, "c", "café est")], "doc_id string, rule_id string, pos int, chunk_id string, quote string")
    shown = projects.crossJoin(spark.createDataFrame([("R",), ("S",)], "rule_id string")).select("doc_id", "rule_id", F.lit("c").alias("chunk_id"), "text", F.lit(0).alias("char_start"), digest.alias("digest"))
    checked = A.verify(quotes, shown)
    assert [r["error"] for r in checked.collect()] == [None, None]
    got = O.resolve(checked, projects, files).collect()
    assert {(r["path"], r["quote"]) for r in got} == {("part.tex", "cafe\u0301 est")}
    wide = projects.select("doc_id", F.explode(F.array(I.locator(digest, F.lit(0), F.length("text")), I.locator(F.lit("0" * 64), F.lit(0), F.lit(3)), I.locator(digest, F.lit(at), F.length("text") + 5))).alias("locator"))
    parts = O.parts(wide, projects).collect()
    assert [r["path"] for r in sorted((r for r in parts if r["path"]), key=lambda r: r["part"])] == ["main.tex", "part.tex", "main.tex"]
    assert sum(r["path"] is None for r in parts) == 2


def test_findings_have_origins(spark, tmp_path):
    put(tmp_path, "good", GOOD)
    got = run(spark, f"file://{tmp_path}")
    rows = O.finding_origins(got.findings, got.projects, P.read_files(spark, f"file://{tmp_path}")).collect()
    assert rows and all(r["path"] == "main.tex" and r["quote"] for r in rows)
    assert any("\\begin{figure}" in r["quote"] for r in rows)


# ---- what must not end a run ----

BIG = 100_000
HOSTILE = {
    "path": {"main.tex": GOOD["main.tex"].replace("\\end{document}", "/a" * BIG + "\n\\end{document}")},
    "numbers": {"main.tex": GOOD["main.tex"].replace("\\end{document}", "\\begin{verbatim}[" + "1," * BIG + "2]\\end{verbatim}\n\\end{document}")},
    "words": {"main.tex": GOOD["main.tex"].replace("\\end{document}", "-".join(["слово"] * BIG) + "\n\\end{document}")},
    "marks": {"main.tex": GOOD["main.tex"].replace("\\end{document}", "\x005\x00 \x00\n\\end{document}")},
    "groups": {"main.tex": GOOD["main.tex"].replace("\\end{document}", "{" * BIG + "[x]" * BIG + "\n\\end{document}")},
    "options": {"main.tex": GOOD["main.tex"].replace("\\end{document}", "\\cite" + "[x]" * BIG + "\n\\end{document}")},
    "title": {"main.tex": GOOD["main.tex"].replace("\\end{document}", "\\subsection{" + "1." * BIG + " A}\n\\end{document}")},
    "policy": {Y.POLICY: "version: 1\nforbidden_preamble:\n- pattern: '(a|b)*c'\n  message: choice\n", "main.tex": "% x\n" + GOOD["main.tex"].replace("\\begin{document}", "ab" * 4_000 + "\\begin{document}")},
    "nested": {Y.POLICY: "version: 1\nforbidden_preamble:\n- pattern: '(a+)+$'\n  message: nested\n"},
    "bib": {"refs.bib": "@article{a, title={" + "{" * BIG},
}


def test_hostile_texts_leave_the_others_alone(spark, tmp_path):
    for name in ("good1", "good2"):
        put(tmp_path, name, GOOD)
    for name, files in HOSTILE.items():
        put(tmp_path, name, GOOD | files)
    got = run(spark, f"file://{tmp_path}")
    status = {}
    for r in got.findings.where("stage = 'formal'").collect():
        status.setdefault(r["doc_id"], {})[r["rule_id"]] = (r["status"], r["message"])
    assert status["good1"] == status["good2"] and set(status) == {*HOSTILE, "good1", "good2"}
    assert {r["doc_id"] for r in got.reports.select("doc_id").collect()} == set(status)
    good = status["good1"]
    for name in ("path", "words", "marks", "groups", "title"):
        same = {k for k in good if status[name].get(k) == good[k]}
        assert len(same) >= len(good) - 2, (name, {k: status[name].get(k) for k in set(good) - same})
    assert status["numbers"]["BIB-02"][0] == "fail"
    assert all(status[n]["SYS-02"][0] == "unverifiable" for n in ("policy", "nested"))


@pytest.mark.parametrize(
    ("column", "text", "want"),
    [
        (R.redact_text, "/a" * BIG + "/ end", "[REDACTED_PATH]/ end"), (R.redact_text, "see /usr/lib/x, ok", "see [REDACTED_PATH], ok"),
        (X.compound_word_count, "-".join(["ab"] * BIG) + " it's", 2), (X.plain_title, "1." * BIG + " A", "a"), (X.plain_title, "1.2Title", "2title"), (X.plain_title, "1.2 Title", "title"), (X.plain_title, "1.2.3Title", "3title"), (X.plain_title, "12Title", "12title"),
        (lambda c: F.size(L.matches(c, L.MANUAL_CITE, 0)), "[" + "1, " * BIG + "2-3] [4] [5,] [6-7,8]", 3), (lambda c: F.size(L.keys(c, L.CITE)), "\\cite" + "[x]" * BIG + "{a, b} \\footcite[p][q]{c}", 3),
    ],
)
def test_patterns_need_no_stack(spark, column, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"] == want


@pytest.mark.parametrize(("pattern", "refused"), [("(a|b)*c", True), ("(a+)+$", True), ("(?:x[0-9]+,)*", True), ("((a|b)c)+", True), ("(ab)*c", False), ("[ab]*c", False), ("(?:a|b)c+", False), (r"\\renewcommand\s*\{", False)])
def test_patterns_that_may_run_away(pattern, refused):
    assert Y._may_run_away(pattern) is refused
