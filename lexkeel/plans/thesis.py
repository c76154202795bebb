"""Rules over LaTeX projects.

A project becomes one row of facts (sources, sections, bibliography, protected files, build log, PDF figures); every
rule is an array of outcomes computed from that row. All rules are evaluated in one projection, wrapped in
the ladder that turns missing inputs into ``unverifiable``, and exploded into findings. So a run is a handful of joins on
``doc_id`` and one pass, whatever the number of rules.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import latex as L
from ..functions.text import SPACES, WORD, first_year, latin_ratio, plain_title, utf8, word_count
from ..operators.aggregates import first_few
from ..sources import projects as P
from . import rulebook as B

OUTCOME = "array<struct<status:string,severity:string,message:string,path:string,page:int,locator:string>>"

#: The canonical sections in order, their aliases, and recommended numbers of pages.
CANON = ["Аннотация", "Введение", "Обзор НТИ", "Структурный системный анализ", "Постановка задачи", "Архитектурно-техническое решение", "Математическая модель", "Алгоритм", "Программная реализация", "Анализ результатов", "Заключение", "Список источников", "Приложения"]
ALIASES = {"обзор научно-технической информации": "Обзор НТИ", "структурный анализ": "Структурный системный анализ", "архитектурное решение": "Архитектурно-техническое решение", "программная реализация системы": "Программная реализация", "список литературы": "Список источников", "библиография": "Список источников"}
PAGES = {"Введение": (2, 3), "Обзор НТИ": (3, 5), "Структурный системный анализ": (6, 7), "Постановка задачи": (2, 3), "Архитектурно-техническое решение": (4, 6), "Математическая модель": (4, 6), "Алгоритм": (4, 5), "Программная реализация": (3, 5), "Анализ результатов": (2, 4), "Заключение": (1, 2)}
TASK_TITLES = ["постановка задачи", "постановка задач", "цель и задачи", "задачи исследования"]
AS_IS_TITLES = ["структурный системный анализ", "системный анализ", "модель as is", "анализ текущего состояния"]
TO_BE_TITLES = ["архитектурно техническое решение", "архитектурное решение", "архитектура", "модель to be"]
RESULT_TITLES = ["анализ результатов", "результаты", "экспериментальные результаты", "оценка результатов"]
ALGORITHM_TITLE = r"(?iu)^(?:алгоритм(?![\p{L}\p{N}_])|(?:описание|разработка|проектирование)\s+алгоритм(?:а|ов)?(?![\p{L}\p{N}_]))"
REVIEW, MATH = "Обзор НТИ", "Математическая модель"
REQUIRED = {"online": ["author", "title", "year", "url"]}
REQUIRED_DEFAULT = ["author", "title", "year"]
DOMAINS = [("wikipedia.", "wikipedia"), ("habr.com", "habr.com"), ("stackoverflow.com", "stackoverflow.com")]
PREAMBLE = [(r"\\usepackage\s*\{geometry\}", "geometry is loaded outside the class"), (r"\\usepackage\s*\{fontspec\}", "fontspec is loaded outside the class"), (r"\\usepackage\s*\{setspace\}", "setspace is loaded outside the class"), (r"\\setlength\s*\{\s*\\parindent\s*\}", "parindent is set outside the class")]
COUNTS = {"pages": r"(?iu)(?<![0-9])([0-9]{1,5})\s*(?:страниц(?:а|ы)?|стр\.?)(?![\p{L}\p{N}_])", "figures": r"(?iu)(?<![0-9])([0-9]{1,5})\s*рисун(?:ок|ка|ки|ков)(?![\p{L}\p{N}_])", "tables": r"(?iu)(?<![0-9])([0-9]{1,5})\s*таблиц(?:а|ы|у)?(?![\p{L}\p{N}_])", "appendices": r"(?iu)(?<![0-9])([0-9]{1,5})\s*приложени(?:е|я|й)(?![\p{L}\p{N}_])"}
REPOSITORY = r"""(?i)\bhttps?://(?:(?:www\.)?(?:github\.com|gitlab\.com|bitbucket\.org|codeberg\.org|git\.sr\.ht)/[A-Za-z0-9_.~-]+/[A-Za-z0-9_.~-]+|[A-Za-z0-9.-]+(?::[0-9]+)?/[^\s<>{}\[\]"']+\.git)"""
APPENDIX_TITLE = r"(?iu)^(?:приложен(?:ие|ия)|appendix|appendices)(?![\p{L}\p{N}_])"

FACTS = {
    "cls": "string", "protected": "array<struct<pos:int,path:string,expected:string,actual:string>>", "forbidden": "array<struct<pos:int,pattern:string,message:string>>",
    "bib": "array<struct<pos:int,key:string,entry_type:string,fields:map<string,string>>>", "log": "struct<status:string,log:string,chktex_available:boolean,chktex_returncode:int>",
    "pdf_pages": "array<int>", "figure_pages": "array<struct<no:int,caption_page:int,ref_page:int>>",
    "fonts_ok": "boolean", "headings_ok": "boolean", "spacing_ok": "boolean", "margins_ok": "boolean", "margin_page": "int",
}


def facts(spark: SparkSession, projects: DataFrame, sections: DataFrame, files: DataFrame | None = None, bib: DataFrame | None = None, protected: DataFrame | None = None, forbidden: DataFrame | None = None, logs: DataFrame | None = None, pages: DataFrame | None = None, figure_pages: DataFrame | None = None, typography: DataFrame | None = None) -> DataFrame:
    """One row a document: a LaTeX project, or a PDF alone. Tables that are not given leave their facts null."""
    from ..operators.joins import last_wins

    def gather(df: DataFrame, out: str, *cols: str) -> DataFrame:
        return df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(out))

    secs = gather(sections.withColumn("place", F.col("char_start")), "secs", "place", "section_id", "title", "norm", "kind", "level", "char_start", "char_end", "locator", *[c for c in ("page_start", "page_end") if c in sections.columns])
    parts = [secs]
    if protected is not None and files is not None:
        found = protected.join(files.select("doc_id", "path", F.col("sha256").alias("actual"), "content"), ["doc_id", "path"], "left")
        parts.append(found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "path", F.col("sha256").alias("expected"), "actual"))).alias("protected"), utf8(F.min_by(F.when(F.col("path").endswith(".cls"), F.col("content")), F.when(F.col("path").endswith(".cls"), F.col("pos")))).alias("cls")))
    if forbidden is not None:
        parts.append(gather(forbidden, "forbidden", "pos", "pattern", "message"))
    if bib is not None and "bib" not in projects.columns:
        parts.append(last_wins(bib, ["doc_id", "key"], "pos").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "key", "entry_type", "fields")).alias("bib")))
    if logs is not None:
        parts.append(logs.select("doc_id", F.struct("status", "log", "chktex_available", "chktex_returncode").alias("log")))
    if pages is not None:
        parts.append(pages.groupBy("doc_id").agg(F.array_sort(F.collect_list("number")).alias("pdf_pages")))
    if figure_pages is not None:
        parts.append(gather(figure_pages, "figure_pages", "no", "caption_page", "ref_page"))
    if typography is not None:
        parts.append(typography)
    out = projects.drop("headings", "read", "expanded", "source_map")
    if pages is not None:
        alone = pages.select("doc_id").distinct().join(projects.select("doc_id"), "doc_id", "left_anti")
        out = out.unionByName(alone, allowMissingColumns=True)
    # Dealt once: what is joined and the rules go by the same tasks, whose work is far more than their bytes tell.
    out = P.spread(out)
    for p in parts:
        out = out.join(p, "doc_id", "left")
    missing = {k: F.lit(None).cast(t) for k, t in FACTS.items() if k not in out.columns}
    out = out.withColumns(missing)
    names, bodies = L.section_list(F.col("visible"))
    out = out.withColumns({"section_names": names, "section_bodies": bodies})
    derived = {
        "floats": L.floats(F.col("visible")), "refs": L.references(F.col("visible")), "captions": L.trimmed(L.matches(F.col("visible"), L.CAPTION)),
        "cited": L.keys(F.col("visible"), L.CITE), "nocited": L.keys(F.col("visible"), L.NOCITE), "review": source_of(F.lit(REVIEW)),
    }
    return out.withColumns(derived).withColumn("review_cited", L.keys(F.col("review"), L.CITE)).withColumn("reviewed_entries", F.filter(F.coalesce("bib", F.array().cast(FACTS["bib"])), lambda e: F.array_contains(F.col("review_cited"), e["key"])))


def source_of(title: Column) -> Column:
    """Source of the first section whose argument holds a title."""
    return L.section_of(F.col("section_names"), F.col("section_bodies"), F.col("visible"), title)


def numbered_figures(projects: DataFrame) -> DataFrame:
    """``doc_id`` and ``no`` of the labelled figures whose caption tells a number."""
    figures = projects.select("doc_id", F.explode(L.floats(F.col("visible"))).alias("f")).where("f.env = 'figure' AND f.label IS NOT NULL")
    return figures.select("doc_id", F.nullif(F.regexp_extract("f.caption", r"(?iu)Рисунок\s+([0-9]+)", 1), F.lit("")).try_cast("int").alias("no")).where("no IS NOT NULL").distinct()


# ---- outcomes ----


def one(status: str | Column, message: str | Column, severity: str | None = None, path: Column | None = None, page: Column | None = None, locator: Column | None = None) -> Column:
    lit = lambda v: F.lit(v) if not isinstance(v, Column) else v
    parts = {"status": lit(status), "severity": lit(severity).cast("string"), "message": lit(message), "path": lit(path).cast("string"), "page": lit(page).cast("int"), "locator": lit(locator).cast("string")}
    return F.array(F.struct(*[v.alias(k) for k, v in parts.items()]))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used and whatever branch asks for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tri(class_ok: Column, script_ok: Column, what: str, script_warn: bool = False, script_optional: bool = False) -> Column:
    """A class leg and a source leg, each true, false or unknown. A proven failure comes before what is unknown."""
    unknown = one("pass", what) if script_optional else one("unverifiable", f"{what}: the source is not available")

    def source(cls: Column) -> Column:
        return let(
            script_ok,
            lambda ok: F.when(ok.eqNullSafe(F.lit(False)), one("warn" if script_warn else "fail", f"{what}: the source breaks it"))
            .when(cls.isNull(), one("unverifiable", f"{what}: no protected class"))
            .when(ok.isNull(), unknown)
            .otherwise(one("pass", what)),
        )

    return let(class_ok, lambda cls: F.when(cls.eqNullSafe(F.lit(False)), one("fail", f"{what}: the class does not provide it")).otherwise(source(cls)))


def class_rule(what: str, *patterns: str) -> Column:
    """The class text must match all patterns."""
    ok = F.lit(True)
    for p in patterns:
        ok = ok & F.col("cls").rlike(p)
    return F.when(F.col("cls").isNull(), one("unverifiable", f"{what}: no protected class")).when(ok, one("pass", what)).otherwise(one("fail", f"{what}: the class does not set it"))


def caption_setup(kind: str, *options: str) -> Column:
    args = F.regexp_extract("cls", rf"(?is)\\captionsetup\s*\[\s*{kind}\s*\]\{{([^}}]+)\}}", 1)
    ok = F.lit(True)
    for o in options:
        ok = ok & F.contains(F.replace(F.lower(args), F.lit(" "), F.lit("")), F.lit(o))
    what = f"caption setup of {kind}"
    return F.when(F.col("cls").isNull(), one("unverifiable", f"{what}: no protected class")).when(ok & (args != ""), one("pass", what)).otherwise(one("fail", f"{what}: options are missing"))


def class_has(pattern: str) -> Column:
    return F.when(F.col("cls").isNotNull(), F.col("cls").rlike(pattern))


def sections_where(pick: Callable[[Column], Column]) -> Column:
    return F.filter("secs", pick)


def bodies(found: Column) -> Column:
    """Source of each section: struct of ``body`` (null if its heading is no ``\\section``) and ``locator``."""
    return F.transform(found, lambda s: F.struct(source_of(s["title"]).alias("body"), s["locator"].alias("locator")))


def presence(titles: list[str], environments: str, what: str) -> Column:
    """Some matching section must hold one of the environments."""
    holds = rf"(?i)\\begin\s*\{{(?:{environments})\*?\}}"
    known = lambda found: F.filter(found, lambda b: b["body"].isNotNull())
    hits = lambda found: F.filter(known(found), lambda b: F.regexp_replace(b["body"], LITERALS, " ").rlike(holds))
    judged = lambda found, hit: (
        F.when(F.size(found) == 0, one("unverifiable", f"{what}: no such section"))
        .when(F.size(hit) > 0, one("pass", what, locator=F.get(hit, F.lit(0))["locator"]))
        .when(F.size(known(found)) == 0, one("unverifiable", f"{what}: no text", locator=F.get(found, F.lit(0))["locator"]))
        .otherwise(one("warn", f"{what}: not found", locator=F.get(known(found), F.lit(0))["locator"]))
    )
    return let(bodies(sections_where(lambda s: (s["level"] <= 2) & s["norm"].isin(*titles))), lambda found: let(hits(found), lambda hit: judged(found, hit)))


LITERALS = r"(?s)\\begin\{(verbatim\*?|Verbatim|lstlisting|minted)\}.*?(?:\\end\{\1\}|\z)"


def monolith(kind: str, title: str) -> Column:
    """No list in a section, found by kind or else by title."""
    found = sections_where(lambda s: s["kind"] == kind)
    body = source_of(F.coalesce(F.get(found, F.lit(0))["title"], F.lit(title)))
    return let(body, lambda b: F.when(b.isNull(), one("unverifiable", f"{title}: no such section")).when(b.rlike(r"(?i)\\begin\s*\{(?:itemize|enumerate)\}"), one("fail", f"{title} holds a list")).otherwise(one("pass", f"{title} is running text")))


def labelled(envs: list[str], bad: str, what: str) -> Column:
    """Every float has a label that the text refers to; a float without a label counts as missing."""
    mine = F.filter("floats", lambda f: f["env"].isin(*envs))
    missing = F.filter(mine, lambda f: f["label"].isNull() | ~F.array_contains(F.col("refs"), f["label"]))
    names = lambda missing: F.array_join(F.transform(missing, lambda f: F.coalesce(f["label"], F.lit(f"{what} without a label"))), ", ")
    sev = "warn" if bad == "warn" else None
    return let(missing, lambda m: F.when(F.size(m) > 0, one(bad, F.concat(F.lit("no reference to: "), names(m)), sev)).when(F.size(mine) == 0, one("not_applicable", f"no {what}")).otherwise(one("pass", f"every {what} has a label and a reference")))


def field(entry: Column, name: str) -> Column:
    return F.nullif(F.try_element_at(entry["fields"], F.lit(name)), F.lit(""))


def missing_fields(entry: Column) -> Column:
    wanted = F.when(entry["entry_type"] == "online", F.array(*map(F.lit, REQUIRED["online"]))).otherwise(F.array(*map(F.lit, REQUIRED_DEFAULT)))
    return F.array_except(wanted, F.map_keys(F.map_filter(entry["fields"], lambda k, v: F.coalesce(v != "", F.lit(False)))))


def forbidden_source(entry: Column) -> Column:
    url = F.lower(F.coalesce(field(entry, "url"), F.lit("")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for needle, label in DOMAINS:
        out = out.when(F.contains(url, F.lit(needle)), F.lit(label))
    blob = F.lower(F.array_join(F.map_values(entry["fields"]), " "))
    return out.when(F.contains(url, F.lit("arxiv.org")) & ~F.contains(blob, F.lit("published")), F.lit("arxiv.org"))


def reviewed(body: Column) -> Column:
    return F.when(F.col("review").isNull(), one("not_applicable", f"no section {REVIEW}")).otherwise(body)


def cited_entries() -> Column:
    return F.col("reviewed_entries")


def shorter(limit: int) -> Column:
    """Visible lengths of the items of all lists of the task section."""

    def items(body: Column) -> Column:
        lists = F.regexp_extract_all(body, F.lit(r"(?is)\\begin\s*\{(itemize|enumerate)\}(.*?)\\end\s*\{\1\}"), F.lit(2))
        found = F.flatten(F.transform(lists, lambda t: F.slice(F.split(t, r"(?i)\\item(?![a-zA-Z])(?:\s*\[[^\]]*\])?"), F.lit(2), F.length(t) + 1)))
        return F.transform(found, lambda t: F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\\[a-zA-Z]+\*?\s?|[{}$]", ""), SPACES, " "), "^ | $", "")))

    def judged(section: Column, body: Column, plain: Column) -> Column:
        short, at = F.filter(plain, lambda n: n < limit), section["locator"]
        return (
            F.when(section.isNull(), one("unverifiable", "no task section"))
            .when(body.isNull(), one("unverifiable", "the task section has no text", locator=at))
            .when(F.size(plain) == 0, one("unverifiable", "the task section has no list", locator=at))
            .when(F.size(short) > 0, one("warn", F.concat(F.lit("short tasks: "), F.size(short).cast("string"), F.lit("; shortest "), F.array_min(short).cast("string")), locator=at))
            .otherwise(one("pass", "every task is described", locator=at))
        )

    section = F.get(sections_where(lambda s: (s["level"] <= 2) & s["norm"].isin(*TASK_TITLES)), F.lit(0))
    return let(section, lambda s: let(F.regexp_replace(source_of(s["title"]), LITERALS, " "), lambda body: let(items(body), lambda plain: judged(s, body, plain))))


def algorithm(pattern: str, what: str) -> Column:
    section = F.get(sections_where(lambda s: (s["level"] <= 2) & F.translate(F.lower(s["title"]), "ё", "е").rlike(r"(?iu)^(?:\s*+[0-9]++(?:\.[0-9]++(?=[.\s:—-]))*+[.\s:—-]++)?+" + ALGORITHM_TITLE[5:].lstrip("^"))), F.lit(0))
    found = lambda s, body: F.when(s.isNull() | body.isNull(), one("unverifiable", "no algorithm section")).when(F.regexp_replace(body, LITERALS, " ").rlike(pattern), one("pass", what, locator=s["locator"])).otherwise(one("warn", f"{what}: not found", locator=s["locator"]))
    return let(section, lambda s: let(source_of(s["title"]), lambda body: found(s, body)))


def declared_counts() -> Column:
    """Numbers that the annotation declares against numbers counted."""
    source = F.col("structural")

    def counted() -> Column:
        envs = L.matches(source, r"(?i)\\begin\s*\{(figure|table|longtable)\*?\}")
        region = F.regexp_extract(source, r"(?is)(?:\\appendix\b|\\begin\s*\{appendices\})(.*)", 1)
        marked = source.rlike(r"(?i)\\appendix\b|\\begin\s*\{appendices\}")
        titles = L.matches(F.when(marked, region).otherwise(source), r"(?i)\\(?:chapter|section)\*?\s*\{([^{}]+)\}")
        appendices = let(marked, lambda m: F.size(F.filter(titles, lambda t: m | F.trim(t).rlike(r"(?iu)^(?:приложение|appendix)\s+[a-zа-яё0-9](?![\p{L}\p{N}_])"))))
        floats = let(envs, lambda e: F.struct(F.size(F.filter(e, lambda x: F.lower(x) == "figure")).alias("figures"), F.size(F.filter(e, lambda x: F.lower(x) != "figure")).alias("tables")))
        return let(floats, lambda f: F.struct(F.size("pdf_pages").alias("pages"), f["figures"].alias("figures"), f["tables"].alias("tables"), appendices.alias("appendices")))

    def judged(section: Column, body: Column, said: Column) -> Column:
        most, least = F.greatest(*[F.size(said[m]) for m in COUNTS]), F.least(*[F.size(said[m]) for m in COUNTS])
        differ = lambda actual: F.array_compact(F.array(*[F.when(F.get(said[m], F.lit(0)) != actual[m], F.concat(F.lit(f"{m}: declared "), F.get(said[m], F.lit(0)).cast("string"), F.lit(", found "), actual[m].cast("string"))) for m in COUNTS]))
        at = section["locator"]
        return (
            F.when(section.isNull() | body.isNull(), one("unverifiable", "no annotation"))
            .when(most > 1, one("unverifiable", "the annotation contradicts itself", locator=at))
            .when(least < 1, one("unverifiable", "the annotation does not declare all four numbers", locator=at))
            .when(F.size("pdf_pages") != F.array_max("pdf_pages"), one("unverifiable", "pages are not numbered in order"))
            .otherwise(let(let(counted(), differ), lambda wrong: F.when(F.size(wrong) > 0, one("fail", F.array_join(wrong, "; "), locator=at)).otherwise(one("pass", "declared numbers are right", locator=at))))
        )

    section = F.get(sections_where(lambda s: (s["kind"] == "annotation") | s["norm"].isin("аннотация", "реферат")), F.lit(0))
    numbers = lambda body: F.struct(*[F.array_distinct(F.transform(L.matches(body, p), lambda n: n.cast("int"))).alias(m) for m, p in COUNTS.items()])
    return let(section, lambda s: let(F.regexp_replace(source_of(s["title"]), LITERALS, " "), lambda body: let(numbers(body), lambda said: judged(s, body, said))))


def build_outcomes() -> Column:
    log = F.col("log")
    missing = first_few(F.regexp_extract_all(log["log"], F.lit(r"(?m)^! LaTeX Error: File `([^']+)' not found"), F.lit(1)), 50)
    boxes = F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(log["log"], F.lit(r"Overfull \\hbox \(([0-9]+(?:\.[0-9]+)?)pt too wide\)"), F.lit(1)), lambda p: p.cast("double")), lambda p: p > 15)))
    result = F.when(log["status"] == "missing_dependency", one("fail", F.concat(F.lit("missing: "), missing))).when(log["status"] == "compile_error", one("fail", "the document does not compile")).otherwise(F.array().cast(OUTCOME))
    overfull = F.transform(boxes, lambda p: one("warn", F.concat(F.lit("overfull box: "), p.cast("string"), F.lit(" pt")), "warn")[0])
    lint = F.when(~F.coalesce(log["chktex_available"], F.lit(False)), one("unverifiable", "no linter", "info")).when(log["chktex_returncode"] != 0, one("warn", "the linter has remarks", "warn")).otherwise(F.array().cast(OUTCOME))
    every = F.concat(result, F.coalesce(overfull, F.array().cast(OUTCOME)), lint)
    return (
        F.when(log.isNull() | (log["status"] == "tool_missing"), one("unverifiable", "no build tool"))
        .when(log["status"] == "timeout", one("fail", "the build took too long"))
        .when((F.size(every) == 0) & (log["status"] == "success"), one("pass", "the document compiles"))
        .otherwise(every)
    )


def title_order() -> Column:
    """Canonical sections as an ordered subsequence; ``title_hits`` holds the canonical numbers that each title meets."""
    n = F.aggregate("title_hits", F.lit(0), lambda i, m: F.when(F.array_contains(m, i), i + 1).otherwise(i))
    missing = F.get(F.array(*map(F.lit, CANON)), n)
    return F.when(n < len(CANON), one("fail", F.concat(F.lit("sections are out of order; expected: "), missing))).otherwise(one("pass", "all sections in order"))


@dataclass(frozen=True)
class Rule:
    id: str
    needs: str  # L: LaTeX, B: bibliography, P: PDF
    outcomes: Callable[[B.Settings], Column]
    applies: Callable[[], Column] = lambda: F.lit(True)


def _simple(rule_id: str, needs: str, make: Callable[[], Column], **more) -> Rule:
    return Rule(rule_id, needs, lambda _s: make(), **more)


def _protected() -> Column:
    p = F.col("protected")
    bad = F.transform(F.filter(p, lambda x: ~x["actual"].eqNullSafe(x["expected"])), lambda x: one("fail", F.concat(F.when(x["actual"].isNull(), "protected file is missing: ").otherwise("protected file was changed: "), x["path"]), path=x["path"])[0])
    return F.when(F.coalesce(F.size(p), F.lit(0)) <= 0, one("unverifiable", "APPROVAL_REQUIRED: no reference class is approved")).when(F.size(bad) > 0, bad).otherwise(one("pass", "protected files are unchanged"))


def _preamble() -> Column:
    # Patterns of the policy come first, in their order.
    own = F.filter(F.coalesce("forbidden", F.array().cast(FACTS["forbidden"])), lambda f: F.regexp_like(F.col("preamble"), F.concat(F.lit("(?im)"), f["pattern"])))
    out = F.when(F.size(own) > 0, one("fail", F.get(own, F.lit(0))["message"], path=F.lit("preamble")))
    for pattern, message in PREAMBLE:
        out = out.when(F.col("preamble").rlike("(?i)" + pattern), one("fail", message, path=F.lit("preamble")))
    broken = F.filter(F.coalesce("forbidden", F.array().cast(FACTS["forbidden"])), lambda f: f["pattern"].isNull())
    return out.when(F.size(broken) > 0, one("unverifiable", F.concat(F.lit("the policy cannot be used: "), F.get(broken, F.lit(0))["message"]))).otherwise(one("pass", "the preamble overrides nothing"))


def _captions() -> Column:
    wrong = F.filter("captions", lambda c: (c == "") | ~c.rlike("^[A-ZА-ЯЁ]") | c.endswith("."))
    return F.when(F.size("captions") == 0, one("not_applicable", "no captions")).when(F.size(wrong) > 0, one("fail", F.concat(F.lit("wrong captions: "), F.array_join(F.transform(wrong, lambda c: F.when(c == "", "(empty)").otherwise(F.substring(c, 1, 32))), ", ")))).otherwise(one("pass", "captions are in order"))


def _footnotes() -> Column:
    notes = L.matches(F.col("visible"), L.FOOTNOTE)
    cites = F.exists(notes, lambda n: n.rlike(r"(?i)https?://|www\.") | n.rlike(r"\b(?:19|20)[0-9]{2}\b"))
    return F.when(F.col("visible").rlike(r"(?i)\\footcite\b"), one("fail", "footcite is used")).when(cites, one("warn", "a footnote holds a source", "warn")).otherwise(one("pass", "sources are cited behind the text"))


GOST = [r"(?i)style\s*=\s*gost-numeric", r"(?i)sorting\s*=\s*none", r"(?i)biblatex"]


def _gost() -> Column:
    return F.when(F.col("cls").isNotNull(), F.col("cls").rlike(GOST[0]) & F.col("cls").rlike(GOST[1]) & F.col("cls").rlike(GOST[2]))


def _manual() -> Column:
    text = F.regexp_replace("visible", L.CITE_OR_NOCITE, " ")
    return tri(_gost(), ~text.rlike(L.MANUAL_CITE), "numeric references by macro")


def _complete() -> Column:
    bad = F.exists("bib", lambda e: F.size(missing_fields(e)) > 0)
    return tri(_gost(), F.when(F.coalesce(F.size("bib"), F.lit(0)) > 0, ~bad), "complete bibliography entries")


def _access_dates() -> Column:
    bad = F.transform(F.filter("bib", lambda e: field(e, "url").isNotNull() & field(e, "urldate").isNull()), lambda e: e["key"])
    return let(bad, lambda b: F.when(F.size(b) > 0, one("fail", F.concat(F.lit("no urldate: "), first_few(b)))).when(F.coalesce(F.size("bib"), F.lit(0)) <= 0, one("not_applicable", "no entries")).otherwise(one("pass", "electronic sources have dates")))


def _uncited() -> Column:
    extra = F.array_except("nocited", "cited")
    unused = F.array_except(F.transform(F.coalesce("bib", F.array().cast(FACTS["bib"])), lambda e: e["key"]), "cited")
    return (
        F.when(F.array_contains("nocited", "*"), one("warn", "nocite of everything", "warn"))
        .when(F.size(extra) > 0, one("warn", F.concat(F.lit("nocite without cite: "), first_few(extra)), "warn"))
        .when(F.size(unused) > 0, one("warn", F.concat(F.lit("never cited: "), first_few(unused)), "warn"))
        .otherwise(one("pass", "every source is cited"))
    )


def _subsection_pages() -> Column:
    short = F.transform(F.filter("secs", lambda s: (s["level"] == 3) & (s["page_end"] - s["page_start"] < 1)), lambda s: one("warn", F.concat(F.lit("under a page: "), s["title"]), "warn", page=s["page_start"])[0])
    return F.when(F.size(short) > 0, short).otherwise(one("pass", "subsections fill a page"))


def _volumes() -> Column:
    low = F.create_map(*[F.lit(x) for k, (a, _) in PAGES.items() for x in (k, a)])
    high = F.create_map(*[F.lit(x) for k, (_, b) in PAGES.items() for x in (k, b)])
    n = lambda s: s["page_end"] - s["page_start"] + 1
    bad = F.filter("secs", lambda s: (n(s) < F.try_element_at(low, canonical(s["title"]))) | (n(s) > F.try_element_at(high, canonical(s["title"]))))
    rows = F.transform(bad, lambda s: one("warn", F.concat(s["title"], F.lit(": "), n(s).cast("string"), F.lit(" pages")), "warn", page=s["page_start"])[0])
    return F.when(F.size(rows) > 0, rows).otherwise(one("pass", "sections have the recommended size"))


def canonical(title: Column) -> Column:
    """A title by its alias, else trimmed."""
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.trim(F.regexp_replace(F.translate(F.lower(title), "ё", "е"), r"\s+", " "))), F.trim(title))


def _enough(n: Column, least: int, what: str) -> Column:
    text = lambda n: F.concat(F.lit(f"{what}: "), n.cast("string"))
    return reviewed(let(n, lambda k: F.when(k >= least, one("pass", text(k))).otherwise(one("warn", text(k), "warn"))))


def _foreign() -> Column:
    peer = F.filter(cited_entries(), lambda e: e["entry_type"].isin("article", "inproceedings") & (latin_ratio(F.concat_ws(" ", F.coalesce(field(e, "author"), F.lit("")), F.coalesce(field(e, "title"), F.lit("")))) >= 0.6))
    return _enough(F.size(peer), 10, "foreign reviewed sources")


def _recent(s: B.Settings) -> Column:
    years = F.filter(F.transform(cited_entries(), lambda e: first_year(F.coalesce(field(e, "year"), F.lit("")))), lambda y: y.isNotNull())
    def judged(known: Column) -> Column:
        recent = F.size(F.filter(known, lambda y: y >= int(s.value("defense_year")) - 5)) / F.size(known)
        text = F.concat(F.lit("recent sources: "), F.format_number(100 * recent, 0), F.lit("%"))
        return F.when(F.size(known) == 0, one("unverifiable", "no years are known")).when(recent >= float(s.value("recent_sources_share")), one("pass", text)).otherwise(one("warn", text, "warn"))

    return reviewed(let(years, judged))


def _blacklist() -> Column:
    bad = F.filter(F.transform(cited_entries(), lambda e: F.struct(e["key"].alias("key"), forbidden_source(e).alias("label"))), lambda x: x["label"].isNotNull())
    names = lambda bad: first_few(F.transform(bad, lambda x: F.concat(x["key"], F.lit(" ("), x["label"], F.lit(")"))))
    return reviewed(let(bad, lambda b: F.when(F.size(b) > 0, one("fail", F.concat(F.lit("forbidden sources: "), names(b)))).otherwise(one("pass", "no forbidden sources"))))


def _density() -> Column:
    """A source for every 300 words, and no paragraph of 150 words without a reference."""
    cites = F.size("review_cited")
    wanted = F.greatest(F.lit(1), F.floor(word_count(F.col("review")) / 300))
    bare = F.filter(F.split("review", r"\n\s*\n+"), lambda p: (word_count(p) >= 150) & ~p.rlike(L.CITE))
    return reviewed(F.when(cites < wanted, one("warn", "few references for the length", "warn")).when(F.size(bare) > 0, one("warn", "long paragraphs without a reference", "warn")).otherwise(one("pass", "references run through the text")))


def _numbered() -> Column:
    body = source_of(F.lit(MATH))
    bad = body.rlike(r"(?i)\\\[|\\begin\s*\{equation\*+\}|\\begin\s*\{displaymath\}|\$\$")
    legs = tri(class_has(r"\\RequirePackage\{amsmath\}|\\usepackage\{amsmath\}|\\begin\{equation\}"), ~bad, "numbered formulas")
    return F.when(body.isNull(), one("not_applicable", f"no section {MATH}")).otherwise(legs)


def _long_tables() -> Column:
    starts = F.regexp_extract_all("visible", F.lit(r"(?is)(?=(\\begin\{longtable\*?\}.{0,785}))"), F.lit(1))
    bad = F.exists(starts, lambda t: ~t.rlike(r"(?i)\\end(?:first)?head\b"))
    return tri(class_has(r"\\(?:newcommand|NewDocumentCommand)\{\\vkrlongtable\}|\\end(?:first)?head\b"), ~bad, "continued tables", script_warn=True)


def _repository() -> Column:
    mine = sections_where(lambda s: (s["kind"] == "appendix") | F.regexp_replace(F.translate(F.lower(s["title"]), "ё", "е"), r"^\s*+[0-9]++(?:\.[0-9]++(?=[.\s:—-]))*+[.\s:—-]++", "").rlike(APPENDIX_TITLE))
    hits = lambda mine: F.filter(mine, lambda s: F.substring(F.col("text"), s["char_start"] + 1, s["char_end"] - s["char_start"]).rlike(REPOSITORY))
    judged = lambda mine, hit: F.when(F.size(mine) == 0, one("not_applicable", "no appendices")).when(F.size(hit) > 0, one("pass", "a repository is named", locator=F.get(hit, F.lit(0))["locator"])).otherwise(one("info", "no repository is named", locator=F.get(mine, F.lit(0))["locator"]))
    return let(mine, lambda m: let(hits(m), lambda hit: judged(m, hit)))


def _figure_places() -> Column:
    late = F.filter(F.coalesce("figure_pages", F.array().cast(FACTS["figure_pages"])), lambda f: f["caption_page"] > f["ref_page"] + 1)
    return F.when(F.size(late) > 0, one("warn", F.concat(F.lit("figures far behind their mention: "), F.array_join(F.transform(late, lambda f: f["no"].cast("string")), ", ")), "warn")).otherwise(one("pass", "figures follow their mention"))


def class_pdf(class_ok: Column, pdf_ok: str, what: str, page: Column | None = None) -> Column:
    """The class is asked where there is a source, the PDF must answer where it is all there is."""
    source = F.col("main").isNotNull()
    return (
        F.when(source & class_ok.eqNullSafe(F.lit(False)), one("fail", f"{what}: the class does not set it"))
        .when(F.col(pdf_ok).eqNullSafe(F.lit(False)), one("fail", f"{what}: the PDF breaks it", page=page))
        .when(source & class_ok.isNull(), one("unverifiable", f"{what}: no protected class"))
        .when(~source & F.col(pdf_ok).isNull(), one("unverifiable", f"{what}: the PDF does not tell"))
        .otherwise(one("pass", what))
    )


_has_pages = lambda: F.col("pdf_pages").isNotNull()

RULES = [
    _simple("SYS-01", "L", _protected), _simple("SYS-02", "L", _preamble), _simple("SYS-03", "L", build_outcomes),
    _simple("FMT-01", "", lambda: class_pdf(F.when(F.col("cls").isNotNull(), F.col("cls").rlike(r"\\(?:RequirePackage|usepackage)\s*\{fontspec\}") & F.col("cls").rlike(r"(?i)Times\s*New\s*Roman")), "fonts_ok", "body font")),
    _simple("FMT-02", "", lambda: class_pdf(class_has(r"\\(?:RequirePackage|usepackage)\s*\{titlesec\}|\\titleformat\b"), "headings_ok", "bold headings")),
    _simple("FMT-03", "", lambda: class_pdf(class_has(r"\\onehalfspacing\b|\\linespread\s*\{\s*1\.5\s*\}"), "spacing_ok", "line spacing")),
    _simple("FMT-05", "", lambda: class_pdf(class_has(r"(?is)left\s*=\s*30\s*mm.*right\s*=\s*10\s*mm.*top\s*=\s*20\s*mm.*bottom\s*=\s*20\s*mm"), "margins_ok", "margins", F.col("margin_page"))),
    _simple("FMT-04", "", lambda: F.when(F.col("main").isNull(), one("unverifiable", "parindent: no source")).otherwise(class_rule("paragraph indent", r"(?i)\\parindent\s*=\s*12\.5\s*mm|\\setlength\s*\{\s*\\parindent\s*\}\s*\{\s*12\.5\s*mm\s*\}"))),
    _simple("FIG-01", "L", _figure_places, applies=lambda: F.col("pdf_pages").isNotNull()),
    _simple("FIG-02", "L", lambda: labelled(["figure"], "fail", "figure")),
    _simple("FIG-03", "L", lambda: tri(class_has(r"\\(?:newcommand|NewDocumentCommand)\{\\risref\}"), ~F.col("visible").rlike(r"[Рр]ис\.(?:\s*|~)\s*[0-9]"), "figure references in words")),
    _simple("FIG-04", "L", lambda: class_rule("figure numbering", r"\\counterwithin\{figure\}|\\numberwithin\{figure\}")),
    _simple("FIG-05", "L", lambda: caption_setup("figure", "position=below", "justification=centering", "labelsep=endash")),
    _simple("FIG-06", "L", lambda: class_rule("no hyphens in captions", r"(?i)hyphenpenalty\s*=\s*10000")),
    _simple("FIG-07", "L", lambda: class_rule("single spacing in captions", r"(?i)font\s*=\s*\{\s*stretch\s*=\s*1\s*\}")),
    _simple("TAB-01", "L", lambda: caption_setup("table", "position=top", "singlelinecheck=off", "justification=raggedright")),
    _simple("TAB-02", "L", _long_tables), _simple("TAB-03", "L", lambda: labelled(["table", "longtable"], "warn", "table")), _simple("CAP-01", "L", _captions),
    _simple("BIB-01", "L", _footnotes), _simple("BIB-02", "LB", _manual), _simple("BIB-03", "LB", _complete), _simple("BIB-04", "B", _access_dates), _simple("BIB-05", "LB", _uncited),
    _simple("STR-01", "L", title_order), _simple("STR-02", "L", lambda: F.when(F.col("visible").rlike(r"\\subsubsection\b"), one("fail", "subsubsection is used")).otherwise(one("pass", "no deeper nesting"))),
    _simple("STR-03", "L", _subsection_pages, applies=_has_pages), _simple("STR-04", "L", _volumes, applies=_has_pages),
    _simple("ANN-02", "L", lambda: monolith("annotation", "Аннотация")), _simple("ANN-03", "LP", declared_counts), _simple("INT-02", "L", lambda: monolith("introduction", "Введение")),
    _simple("REV-01", "LB", lambda: _enough(F.size("review_cited"), 20, "sources in the review")), _simple("REV-02", "LB", _foreign), Rule("REV-03", "LB", _recent), _simple("REV-04", "LB", _blacklist), _simple("REV-07", "L", _density),
    _simple("SSA-01", "L", lambda: presence(AS_IS_TITLES, "figure", "figure of the present state")), _simple("ARC-01", "L", lambda: presence(TO_BE_TITLES, "figure", "figure of the target state")), _simple("RES-01", "L", lambda: presence(RESULT_TITLES, "figure|table|longtable", "figure or table of results")),
    _simple("MTH-01", "L", _numbered), _simple("TSK-02", "L", lambda: shorter(30)),
    _simple("ALG-01", "L", lambda: algorithm(r"(?i)\\begin\s*\{(?:figure\*?|algorithm|algorithmic|algorithm2e)\}", "representation of the algorithm")), _simple("ALG-03", "L", lambda: algorithm(r"(?iu)(?<![\p{L}\p{N}_])блок\s+[0-9]+\s*\.", "description of the blocks")),
    _simple("APP-01", "", _repository),
]

SOURCES = {"L": "latex_project", "B": "bib_files", "P": "pdf"}


def ladder(rule: Rule, settings: B.Settings) -> Column:
    """Missing inputs first: never a pass. A project without any bibliography command owes no bibliography."""
    have = {"L": F.col("main").isNotNull() & F.col("error").isNull(), "B": F.size("bib_paths") > 0, "P": F.col("pdf_pages").isNotNull()}
    gaps = F.array_compact(F.array(*[F.when(~F.coalesce(have[n], F.lit(False)), SOURCES[n]) for n in rule.needs])) if rule.needs else F.array().cast("array<string>")
    only_bib = (F.array_join(gaps, ",") == SOURCES["B"]) & F.col("main").isNotNull() & ~F.coalesce("bib_declared", F.lit(False))
    failed = one("fail" if settings.fail_closed else "unverifiable", F.concat(F.lit("tool_error: "), F.col("error")), "error" if settings.fail_closed else "warn")
    return (
        F.when(F.col("error").isNotNull() & F.lit("L" in rule.needs), failed)
        .when(only_bib, one("not_applicable", "no bibliography is declared"))
        .when(F.size(gaps) > 0, one("unverifiable", F.concat(F.lit("not available: "), F.array_join(gaps, ", "))))
        .when(~F.coalesce(rule.applies(), F.lit(False)), one("not_applicable", "does not apply to this input"))
        .otherwise(rule.outcomes(settings))
    )


@functools.lru_cache(P.TITLES_KNOWN)
def canonical_hits(title: str) -> list[int]:
    """Numbers of the canonical sections that a title equals or resembles at 0.9."""
    from difflib import SequenceMatcher

    return [i for i, c in enumerate(CANON) if title == c or SequenceMatcher(None, title.casefold(), c.casefold()).ratio() >= 0.9]


def title_hits(spark: SparkSession, facts_: DataFrame) -> DataFrame:
    """Adds ``title_hits``: for each observed title, the canonical sections that it equals or resembles at 0.9.

    Similarity runs over the distinct titles of a batch only, and where facts are made, so these need no second shuffle.
    """
    titles = F.transform(F.filter("secs", lambda s: (s["kind"] != "document") & (s["level"] <= 2)), lambda s: canonical(s["title"]))
    return facts_.withColumn("title_hits", F.coalesce(P.by_distinct(titles, canonical_hits, "array<int>"), F.array().cast("array<array<int>>")))


def evaluate(spark: SparkSession, facts_: DataFrame, settings: B.Settings = B.Settings(), more: dict[str, Column] | None = None, rules: list[Rule] | None = None, extra: list[dict[str, str]] | None = None, reasons: dict[str, str] | None = None, listed: bool = True) -> DataFrame:
    """Findings of all enabled formal rules; a rule without an implementation is unverifiable.

    ``more`` maps further rules (the typographic ones) to columns of outcomes that ``facts_`` holds. A ``registry`` gives its own ``rules``, those that
    the rulebook doesn't list (``extra``: id, formal_layer, severity), with or without those that it lists, and the ``reasons`` why some have no implementation.
    """
    book = [r.asDict() for r in B.effective(B.rulebook(spark), settings).where("enabled").where(B.is_formal(F.col("capabilities"))).select("id", "formal_layer", "severity").collect()] if listed else []
    book += extra or []
    known = {r.id: r for r in (RULES if rules is None else rules)}
    rows = []
    for r in book:
        if r["id"] in known:
            got = ladder(known[r["id"]], settings)
        elif more and r["id"] in more:
            got = more[r["id"]]
        else:
            got = one("unverifiable", (reasons or {}).get(r["id"], "no implementation"))
        rows.append(_tag(got, r["id"], r["formal_layer"], r["severity"]))
    if "page_start" not in facts_.select("secs").schema["secs"].dataType.elementType.names:
        facts_ = facts_.withColumn("secs", F.transform("secs", lambda s: s.withField("page_start", F.lit(None).cast("int")).withField("page_end", F.lit(None).cast("int"))))
    out = title_hits(spark, facts_).select("doc_id", F.explode(F.flatten(F.array(*rows))).alias("f"))
    evidence = F.when(F.col("f.locator").isNotNull(), F.array(F.struct(F.col("f.locator").alias("locator"), F.lit(None).cast("string").alias("description")))).otherwise(F.array().cast("array<struct<locator:string,description:string>>"))
    return out.select("doc_id", F.lit("formal").alias("stage"), "f.rule_id", "f.layer", "f.severity", "f.status", "f.message", evidence.alias("evidence"), "f.path", "f.page")


def _tag(outcomes: Column, rule_id: str, layer: str, severity: str) -> Column:
    return F.transform(outcomes, lambda o: F.struct(F.lit(rule_id).alias("rule_id"), F.lit(layer).alias("layer"), F.coalesce(o["severity"], F.lit(severity)).alias("severity"), o["status"].alias("status"), o["message"].alias("message"), o["path"].alias("path"), o["page"].alias("page"), o["locator"].alias("locator")))
