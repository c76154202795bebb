"""All rules over made theses, with a plain statement in SQL of what each must find.

Every document becomes a thesis: sources, class file, bibliography, build log and PDF tables whose properties follow from its id. The
query takes the whole way from files to findings; the SQL states from the same properties, rule by rule, which status, severity, message and
page must come out. It knows nothing of how the rules look for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import projects as P
from ..storage import keep
from . import thesis as H
from .catalog import docs, register

ID = "doc_id"
ENTRIES, PLAIN = 26, "слово " * 40


def mod(n: int, *values: int) -> Column:
    return (F.col(ID) % n).isin(*values)


def pick(n: int, choices: dict[int, str], other: str = "") -> Column:
    out = F.lit(other)
    for k, v in choices.items():
        out = F.when(mod(n, k), F.lit(v)).otherwise(out)
    return out


def join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


CLASS = [
    r"\RequirePackage{fontspec}\setmainfont{Times New Roman}", r"\RequirePackage{titlesec}", r"\onehalfspacing", r"\setlength{\parindent}{12.5mm}",
    r"\RequirePackage[left=30mm,right=10mm,top=20mm,bottom=20mm]{geometry}", r"\newcommand{\risref}[1]{x}", r"\counterwithin{figure}{section}",
    r"\captionsetup[figure]{position=below, justification=centering, labelsep=endash}", "hyphenpenalty=10000", "font={stretch=1}",
    r"\captionsetup[table]{position=top, singlelinecheck=off, justification=raggedright}", r"\newcommand{\vkrlongtable}{x}",
]


def class_text() -> Column:
    """The class file; one in thirteen ids lacks each line, others formulas or the citation style."""
    lines = [F.when(~mod(13, k + 1), F.lit(line)).otherwise(F.lit("")) for k, line in enumerate(CLASS)]
    return F.concat_ws("\n", *lines, pick(11, {0: ""}, r"\RequirePackage{amsmath}"), pick(11, {1: ""}, r"\RequirePackage[style=gost-numeric,sorting=none]{biblatex}"))


def main_text() -> Column:
    cite = lambda a: F.array_join(F.transform(a, lambda k: F.concat(F.lit(r"\cite{k"), k.cast("string"), F.lit("}"))), " ")
    n = (F.col(ID) % 26).cast("int")
    keys = F.sequence(F.lit(0), F.lit(ENTRIES - 1))
    figure = lambda caption, label: rf"\begin{{figure}}\caption{{{caption}}}\label{{{label}}}\end{{figure}} на \ref{{{label}}}"
    sections = {
        "Аннотация": pick(4, {0: "10 страниц, 2 рисунка, 1 таблица, 1 приложение", 1: r"\begin{itemize}\item a\end{itemize}", 2: "9 страниц, 2 рисунка, 1 таблица, 1 приложение"}, PLAIN),
        "Введение": pick(8, {1: r"\begin{enumerate}\item a\end{enumerate}"}, PLAIN),
        "Обзор НТИ": join(PLAIN, cite(F.filter(keys, lambda k: k < n)), pick(16, {1: "\n\n" + "слово " * 160})),
        "Структурный системный анализ": F.when(mod(10, 3), F.lit("нет")).when(mod(25, 1), F.lit(figure("схема.", "f1"))).otherwise(F.lit(figure("Схема", "f1"))),
        "Постановка задачи": pick(6, {0: r"\begin{itemize}\item Сделать.\end{itemize}", 1: "без списка"}, r"\begin{itemize}\item Разработать и проверить метод обработки больших данных\item Сравнить метод с известными решениями задачи\end{itemize}"),
        "Архитектурно-техническое решение": pick(10, {4: "нет"}, figure("Решение", "f2")),
        "Математическая модель": pick(7, {1: "$$x$$"}, r"\begin{equation}x=1\end{equation}"),
        "Алгоритм": pick(5, {1: "нет", 2: "Блок 1. Начало."}, r"Блок 1. Начало. \begin{algorithm}x\end{algorithm}"),
        "Программная реализация": F.lit(PLAIN),
        "Анализ результатов": pick(10, {5: "нет"}, r"В \ref{t1}. \begin{table}\caption{Итоги}\label{t1}\end{table}"),
        "Заключение": join(
            PLAIN, pick(9, {1: r"\begin{figure}\caption{Лишний}\end{figure}", 2: r"\begin{figure}\caption{Лишний}\label{z}\end{figure}"}), pick(14, {1: r"\begin{longtable}{l}a\end{longtable}", 2: r"\begin{table}\caption{Лишняя}\label{tz}\end{table}"}),
            pick(22, {1: r" \footcite{k0}", 2: r" \footnote{См. https://a.example}"}), pick(18, {1: " как в [1, 2-3] "}), pick(20, {1: " см. рис. 2 "}), pick(34, {1: "\n\\subsection{Деталь}\nтекст\n"}), pick(24, {1: "\n\\subsubsection{Пункт}\nтекст\n"}),
            pick(12, {2: r"\nocite{*}", 3: r"\nocite{zz}"}), cite(F.filter(keys, lambda k: k >= n)),
        ),
        "Список источников": pick(32, {1: ""}, r"\addbibresource{refs.bib}"),
        "Приложения": pick(36, {1: "нет ссылки"}, "https://github.com/a/b"),
    }
    parts = [F.when(mod(21, 1), F.lit("")).otherwise(join(f"\\section{{{k}}}\n", v)) if k == "Программная реализация" else join(f"\\section{{{k}}}\n", v) for k, v in sections.items()]
    head = pick(27, {1: r"\usepackage{geometry}", 2: r"\renewcommand{\a}{b}"})
    return F.concat_ws("\n", join(r"\documentclass{x}", head), F.lit(r"\begin{document}"), *parts, F.lit("\\appendix\n\\section{Код}\nтекст\n\\end{document}"))


def bibliography() -> Column:
    entries = []
    for i in range(ENTRIES):
        title = F.lit("title={On Things},") if i != 1 else pick(28, {1: "note={x},"}, "title={On Things},")
        url = F.lit(f"url={{https://a.example/{i}}},") if i != 3 else pick(15, {1: "url={https://ru.wikipedia.org/x},"}, "url={https://a.example/3},")
        seen = F.lit("urldate={2025-01-01}") if i != 2 else pick(30, {1: "note={x}"}, "urldate={2025-01-01}")
        entries.append(join(f"@{'book' if i % 2 else 'article'}{{k{i}, author={{Smith J.}}, year={{{1999 if i % 3 else 2024}}},", title, url, seen, "}"))
    return F.concat_ws("\n", *entries, pick(12, {1: "@article{extra, author={A}, title={B}, year={2024}}"}))


def theses(spark, sf_dir) -> tuple[DataFrame, ...]:
    """Files, protected files, forbidden patterns, build logs, pages, figure pages, typographic facts of every document's thesis."""
    d = docs(spark, sf_dir).select("doc_id")
    name = F.col(ID).cast("string").alias("doc_id")
    file = lambda path, text, where: F.when(where, F.struct(F.lit(path).alias("path"), text.cast("binary").alias("content")))
    made = F.array_compact(F.array(file("main.tex", main_text(), F.lit(True)), file("x.cls", class_text(), ~mod(33, 1)), file("refs.bib", bibliography(), ~mod(32, 1, 2))))
    files = d.select(ID, F.explode(made).alias("f")).select(name, "f.path", F.sha2("f.content", 256).alias("sha256"), "f.content")
    told = d.where(~mod(17, 0))
    protected = told.select(name, F.lit(0).alias("pos"), F.lit("x.cls").alias("path"), F.when(mod(33, 2), "0").otherwise(F.sha2(class_text().cast("binary"), 256)).alias("sha256"))
    forbidden = told.select(name, F.lit(0).alias("pos"), F.lit(r"\\renewcommand").alias("pattern"), F.lit("renewed").alias("message"))
    build = {0: ("success", "", True, 0), 2: ("compile_error", "Overfull \\hbox (20.5pt too wide)\nOverfull \\hbox (3.0pt too wide)", True, 0), 3: ("missing_dependency", "! LaTeX Error: File `a.sty' not found", False, 0), 4: ("timeout", "", True, 0), 5: ("success", "", True, 1)}
    logs = d.join(spark.createDataFrame([(k, *v) for k, v in build.items()], "k long, status string, log string, chktex_available boolean, chktex_returncode int"), F.col(ID) % 6 == F.col("k")).select(name, "status", "log", "chktex_available", "chktex_returncode")
    printed = d.where(~mod(4, 3))
    pages = printed.select(name, F.explode(F.sequence(F.lit(1), F.lit(10))).alias("number"))
    places = printed.select(name, F.lit(1).alias("no"), F.when(mod(29, 1), 5).otherwise(2).alias("caption_page"), F.lit(2).alias("ref_page"))
    typography = printed.select(name, *[(~mod(31, k)).alias(c) for k, c in enumerate(("fonts_ok", "headings_ok", "spacing_ok", "margins_ok"), 1)], F.when(mod(31, 4), 4).alias("margin_page"))
    ranges = printed.select(name, F.lit("Введение").alias("title"), F.lit(2).alias("page_start"), (F.col(ID) % 4 + 2).cast("int").alias("page_end")).unionByName(printed.select(name, F.lit("Деталь").alias("title"), F.lit(9).alias("page_start"), F.lit(9).alias("page_end")))
    return files, protected, forbidden, logs, pages, places, typography, ranges


# ---- what must come out ----

#: Properties by name, over the id ``d``.
PROPERTIES = {
    "pdf": "d % 4 <> 3", "policy": "d % 17 <> 0", "cls": "d % 17 <> 0 AND d % 33 <> 1", "bib": "d % 32 NOT IN (1, 2)", "declared": "d % 32 <> 1", "n": "d % 26", "nf": "2 - (d % 10 = 3)::INT - (d % 10 = 4)::INT + (d % 9 IN (1, 2))::INT", "nt": "1 - (d % 10 = 5)::INT + (d % 14 IN (1, 2))::INT",
}


def lacks(k: int) -> str:
    return f"d % 13 = {k}"


def _fmt(k: int, what: str, pdf: int, page: str = "NULL") -> list[tuple[str, ...]]:
    bad = f"pdf AND d % 31 = {pdf}"
    return [(f"cls AND {lacks(k)}", "fail", f"'{what}: the class does not set it'"), (bad, "fail", f"'{what}: the PDF breaks it'", "", f"CASE WHEN {bad} THEN {page} END"), ("NOT cls", "unverifiable", f"'{what}: no protected class'"), ("true", "pass", f"'{what}'")]


def _class(k: int, what: str, bad: str | None = None) -> list[tuple[str, ...]]:
    return [("NOT cls", "unverifiable", f"'{what}: no protected class'"), (lacks(k), "fail", f"'{bad or what + ': the class does not set it'}'"), ("true", "pass", f"'{what}'")]


def _legs(class_bad: str, source_bad: str, what: str, worse: str = "fail") -> list[tuple[str, ...]]:
    return [(f"cls AND {class_bad}", "fail", f"'{what}: the class does not provide it'"), (source_bad, worse, f"'{what}: the source breaks it'"), ("NOT cls", "unverifiable", f"'{what}: no protected class'"), ("true", "pass", f"'{what}'")]


def _section(bad: str, what: str) -> list[tuple[str, ...]]:
    return [(bad, "warn", f"'{what}: not found'"), ("true", "pass", f"'{what}'")]


NO_BIB = [("NOT declared", "not_applicable", "'no bibliography is declared'"), ("NOT bib", "unverifiable", "'not available: bib_files'")]
NO_PDF = [("NOT pdf", "not_applicable", "'does not apply to this input'")]
NO_LABEL = "no reference to: "
ANN = "CASE WHEN d % 4 = 2 THEN 'pages: declared 9, found 10' END, CASE WHEN nf <> 2 THEN 'figures: declared 2, found ' || nf END, CASE WHEN nt <> 1 THEN 'tables: declared 1, found ' || nt END"
#: Rule, severity, and in order: condition, status, message, severity if another, page.
EXPECTED: list[tuple[str, str, list[tuple[str, ...]]]] = [
    ("SYS-01", "error", [("NOT policy", "unverifiable", "'APPROVAL_REQUIRED: no reference class is approved'"), ("d % 33 = 1", "fail", "'protected file is missing: x.cls'"), ("d % 33 = 2", "fail", "'protected file was changed: x.cls'"), ("true", "pass", "'protected files are unchanged'")]),
    ("SYS-02", "error", [("policy AND d % 27 = 2", "fail", "'renewed'"), ("d % 27 = 1", "fail", "'geometry is loaded outside the class'"), ("true", "pass", "'the preamble overrides nothing'")]),
    ("FMT-01", "error", _fmt(1, "body font", 1)), ("FMT-02", "error", _fmt(2, "bold headings", 2)), ("FMT-03", "error", _fmt(3, "line spacing", 3)), ("FMT-04", "error", _class(4, "paragraph indent")), ("FMT-05", "error", _fmt(5, "margins", 4, "4")),
    ("FIG-01", "warn", [*NO_PDF, ("d % 29 = 1", "warn", "'figures far behind their mention: 1'"), ("true", "pass", "'figures follow their mention'")]),
    ("FIG-02", "error", [("d % 9 = 1", "fail", f"'{NO_LABEL}figure without a label'"), ("d % 9 = 2", "fail", f"'{NO_LABEL}z'"), ("nf = 0", "not_applicable", "'no figure'"), ("true", "pass", "'every figure has a label and a reference'")]),
    ("FIG-03", "error", _legs(lacks(6), "d % 20 = 1", "figure references in words")), ("FIG-04", "error", _class(7, "figure numbering")), ("FIG-05", "error", _class(8, "caption setup of figure", "caption setup of figure: options are missing")),
    ("FIG-06", "error", _class(9, "no hyphens in captions")), ("FIG-07", "error", _class(10, "single spacing in captions")), ("TAB-01", "error", _class(11, "caption setup of table", "caption setup of table: options are missing")),
    ("TAB-02", "warn", _legs(lacks(12), "d % 14 = 1", "continued tables", "warn")),
    ("TAB-03", "warn", [("d % 14 = 1", "warn", f"'{NO_LABEL}table without a label'"), ("d % 14 = 2", "warn", f"'{NO_LABEL}tz'"), ("nt = 0", "not_applicable", "'no table'"), ("true", "pass", "'every table has a label and a reference'")]),
    ("CAP-01", "error", [("d % 25 = 1 AND d % 10 <> 3", "fail", "'wrong captions: схема.'"), ("true", "pass", "'captions are in order'")]),
    ("BIB-01", "error", [("d % 22 = 1", "fail", "'footcite is used'"), ("d % 22 = 2", "warn", "'a footnote holds a source'", "warn"), ("true", "pass", "'sources are cited behind the text'")]),
    ("BIB-02", "error", [*NO_BIB, *_legs("d % 11 = 1", "d % 18 = 1", "numeric references by macro")]), ("BIB-03", "error", [*NO_BIB, *_legs("d % 11 = 1", "d % 28 = 1", "complete bibliography entries")]),
    ("BIB-04", "error", [*NO_BIB, ("d % 30 = 1", "fail", "'no urldate: k2'"), ("true", "pass", "'electronic sources have dates'")]),
    ("BIB-05", "warn", [*NO_BIB, ("d % 12 = 2", "warn", "'nocite of everything'"), ("d % 12 = 3", "warn", "'nocite without cite: zz'"), ("d % 12 = 1", "warn", "'never cited: extra'"), ("true", "pass", "'every source is cited'")]),
    ("STR-01", "error", [("d % 21 = 1", "fail", "'sections are out of order; expected: Программная реализация'"), ("true", "pass", "'all sections in order'")]), ("STR-02", "error", [("d % 24 = 1", "fail", "'subsubsection is used'"), ("true", "pass", "'no deeper nesting'")]),
    ("STR-03", "warn", [*NO_PDF, ("d % 34 = 1", "warn", "'under a page: Деталь'", "", "9"), ("true", "pass", "'subsections fill a page'")]), ("STR-04", "warn", [*NO_PDF, ("d % 4 = 0", "warn", "'Введение: 1 pages'", "", "2"), ("true", "pass", "'sections have the recommended size'")]),
    ("ANN-02", "error", [("d % 4 = 1", "fail", "'Аннотация holds a list'"), ("true", "pass", "'Аннотация is running text'")]), ("INT-02", "error", [("d % 8 = 1", "fail", "'Введение holds a list'"), ("true", "pass", "'Введение is running text'")]),
    ("ANN-03", "warn", [("NOT pdf", "unverifiable", "'not available: pdf'"), ("d % 4 = 1", "unverifiable", "'the annotation does not declare all four numbers'"), (f"concat_ws('; ', {ANN}) <> ''", "fail", f"concat_ws('; ', {ANN})"), ("true", "pass", "'declared numbers are right'")]),
    ("REV-01", "warn", [*NO_BIB, ("n >= 20", "pass", "'sources in the review: ' || n"), ("true", "warn", "'sources in the review: ' || n")]), ("REV-02", "warn", [*NO_BIB, ("(n + 1) // 2 >= 10", "pass", "'foreign reviewed sources: ' || (n + 1) // 2"), ("true", "warn", "'foreign reviewed sources: ' || (n + 1) // 2")]),
    ("REV-03", "warn", [*NO_BIB, ("n = 0", "unverifiable", "'no years are known'"), ("2 * ((n + 2) // 3) >= n", "pass", "'recent sources: ' || round(100 * ((n + 2) // 3) / n)::INT || '%'"), ("true", "warn", "'recent sources: ' || round(100 * ((n + 2) // 3) / n)::INT || '%'")]),
    ("REV-04", "error", [*NO_BIB, ("n > 3 AND d % 15 = 1", "fail", "'forbidden sources: k3 (wikipedia)'"), ("true", "pass", "'no forbidden sources'")]),
    ("REV-07", "warn", [("n = 0", "warn", "'few references for the length'"), ("d % 16 = 1", "warn", "'long paragraphs without a reference'"), ("true", "pass", "'references run through the text'")]),
    ("SSA-01", "warn", _section("d % 10 = 3", "figure of the present state")), ("ARC-01", "warn", _section("d % 10 = 4", "figure of the target state")), ("RES-01", "warn", _section("d % 10 = 5", "figure or table of results")),
    ("MTH-01", "error", _legs("d % 11 = 0", "d % 7 = 1", "numbered formulas")),
    ("TSK-02", "warn", [("d % 6 = 0", "warn", "'short tasks: 1; shortest 8'"), ("d % 6 = 1", "unverifiable", "'the task section has no list'"), ("true", "pass", "'every task is described'")]),
    ("ALG-01", "warn", _section("d % 5 IN (1, 2)", "representation of the algorithm")), ("ALG-03", "warn", _section("d % 5 = 1", "description of the blocks")),
    ("APP-01", "info", [("d % 36 = 1", "info", "'no repository is named'"), ("true", "pass", "'a repository is named'")]),
]
#: The build rule may find several things at once: condition, status, severity, message.
BUILDS = [
    ("d % 6 = 0", "pass", "error", "the document compiles"), ("d % 6 = 1", "unverifiable", "error", "no build tool"), ("d % 6 = 2", "fail", "error", "the document does not compile"), ("d % 6 = 2", "warn", "warn", "overfull box: 20.5 pt"),
    ("d % 6 = 3", "fail", "error", "missing: a.sty"), ("d % 6 = 3", "unverifiable", "info", "no linter"), ("d % 6 = 4", "fail", "error", "the build took too long"), ("d % 6 = 5", "warn", "warn", "the linter has remarks"),
]


def _sql() -> str:
    rows = []
    for rule, own, cases in EXPECTED:
        case = lambda pick_, cases=cases: "CASE " + " ".join(f"WHEN {c[0]} THEN {pick_(c)}" for c in cases) + " END"
        rows.append(f"SELECT d, '{rule}' AS rule_id, {case(lambda c: repr(c[1]))} AS status, {case(lambda c, own=own: repr((c[3] if len(c) > 3 else '') or own))} AS severity, {case(lambda c: c[2])} AS message, {case(lambda c: c[4] if len(c) > 4 else 'NULL')}::INT AS page FROM p")
    rows += [f"SELECT d, 'SYS-03', '{status}', '{sev}', '{message}', NULL FROM p WHERE {condition}" for condition, status, sev, message in BUILDS]
    rows.append("SELECT d, 'DEP-01', 'unverifiable', 'warn', 'no implementation', NULL FROM p")
    props = ", ".join(f"{v} AS {k}" for k, v in PROPERTIES.items())
    return f"WITH p AS (SELECT d, {props} FROM (SELECT doc_id AS d FROM documents)), r AS ({' UNION ALL '.join(rows)}) SELECT d::VARCHAR AS doc_id, rule_id, status, severity, message, page FROM r"


@register("thesis_rules", _sql())
def thesis_rules(spark, sf_dir):
    """Every formal rule over a thesis for every document: status, severity, message and page."""
    files, protected, forbidden, logs, pages, places, typography, ranges = theses(spark, sf_dir)
    # No finding here leads back to its place in a file, so no source map is made; a bibliography is read with its project.
    projects = keep(P.projects(files, ["doc_id", "main", "preamble", "visible", "structural", "text", "headings", "bib_paths", "bib_declared", "error", "bib"]), "projects")
    sections = P.sections(spark, projects).join(ranges, ["doc_id", "title"], "left")
    facts = H.facts(spark, projects, sections, files, None, protected, forbidden, logs, pages, places, typography)
    return H.evaluate(spark, facts).select("doc_id", "rule_id", "status", "severity", "message", "page")
