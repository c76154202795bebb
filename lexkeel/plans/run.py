"""A whole run over a folder of projects: sources, rules, advisory stage, gate, reports.

Every step is lazy; the tables that several steps use are written once to the shared folder if there is one, else cached.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import locator, source_hash
from ..operators.windows import chunks
from ..sources import dependencies, pdf_bundle, policy
from ..sources import projects as P
from ..storage import keep
from . import advisory, gate, page_roles, report, thesis, typography
from .rulebook import Settings, rulebook


@dataclass(frozen=True)
class Run:
    """Tables of a run; ``findings`` are in order and free of duplicates."""

    projects: DataFrame
    sections: DataFrame
    chunks: DataFrame
    missing: DataFrame
    findings: DataFrame
    gate: DataFrame
    reports: DataFrame


def section_chunks(projects: DataFrame, sections: DataFrame, budget: int = 800) -> DataFrame:
    """Chunks of every section, with offsets in the whole text and locators."""
    text = sections.join(projects.select("doc_id", "text"), "doc_id")
    part = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    cut = chunks(text.select("doc_id", "section_id", F.col("char_start").alias("base"), source_hash(F.col("text")).alias("digest"), part.alias("text")), ["doc_id", "section_id", "base", "digest"], budget)
    at = {c: (F.col(c) + F.col("base")).cast("int") for c in ("char_start", "content_start", "char_end")}
    out = cut.withColumns(at).withColumn("chunk_id", F.concat_ws(":", "section_id", F.col("seq").cast("string")))
    return out.withColumn("locator", locator(F.col("digest"), F.col("char_start"), F.col("char_end"))).drop("base")


def run(spark: SparkSession, root: str, settings: Settings = Settings(), spans: DataFrame | None = None, pages: DataFrame | None = None, objects: DataFrame | None = None, logs: DataFrame | None = None, answers: DataFrame | None = None, outline: DataFrame | None = None) -> Run:
    """Checks every project under ``root``. PDF tables, build logs and advisory answers are optional: what they would tell is unverifiable without them."""
    settings.check()
    files = P.read_files(spark, root)
    projects = keep(P.projects(files), "projects")
    sections = keep(P.sections(spark, projects), "sections")
    protected, forbidden = policy.policies(files)
    if spans is not None and pages is not None and {"place", "block", "line"} <= set(spans.columns):
        # Spans that tell their lines and blocks are a document of their own, whose sections have pages.
        placed = keep(pdf_bundle.with_offsets(spans), "spans")
        printed = pdf_bundle.sections(spark, keep(pdf_bundle.documents(placed, pages, outline), "pdf-documents"), placed, pages)
        sections = keep(pdf_bundle.with_pages(sections, printed), "sections-with-pages")
    typo = figures = None
    if spans is not None and pages is not None:
        hidden = page_roles.excluded(page_roles.roles(spans, pages))
        typo = typography.facts(spans, pages, objects, hidden, float(settings.value("font_size_pt")), float(settings.value("geometry_tolerance_pt")))
        figures = typography.figure_pages(thesis.numbered_figures(projects), spans)
    facts = thesis.facts(spark, projects, sections, files, P.bib_entries(files, projects), protected, forbidden, logs, pages, figures, typo)
    formal = thesis.evaluate(spark, facts, settings)
    pieces = keep(section_chunks(projects, sections), "chunks")
    planned = advisory.plan(spark, sections, pieces)
    answered = advisory.annotated(planned, answers) if answers is not None else advisory.disabled(planned)
    semantic = advisory.conclude(planned, answered, projects.select("doc_id", source_hash(F.col("text")).alias("digest")))
    if settings.only:
        semantic = semantic.where(F.col("rule_id").isin(*settings.only) | F.substring("rule_id", 1, 3).isin(*settings.only))
    every = gate.union_stages(("formal", formal), ("semantic", semantic))
    findings = keep(gate.dedupe(gate.order(every, rulebook(spark))), "findings")
    mains = P.main_files(files).where("main IS NOT NULL")
    # The gate looks at the formal stage; reports hold all stages.
    return Run(projects, sections, pieces, dependencies.missing(files, mains), findings, gate.gate(findings.where("stage = 'formal'"), settings.gate_mode), report.reports(findings, settings.gate_mode, profile=settings.profile))


def main(args: list[str] | None = None) -> int:
    import argparse

    from ..session import session

    p = argparse.ArgumentParser(prog="python -m lexkeel", description="Checks the LaTeX projects in a folder, one folder each.")
    p.add_argument("root")
    p.add_argument("--out")
    p.add_argument("--publish", help="a folder of versions: reports, Markdown, summaries and findings that become visible together")
    p.add_argument("--profile", default="software")
    p.add_argument("--only", nargs="*", default=[])
    p.add_argument("--final", action="store_true")
    p.add_argument("--gate", default="strict", choices=["strict", "advisory"])
    a = p.parse_args(args)
    spark = session()
    got = run(spark, a.root, Settings(a.profile, a.final, tuple(a.only), a.gate))
    if a.out:
        report.write_reports(got.reports, a.out)
    if a.publish:
        report.publish_reports(got.reports, a.publish, got.findings)
    for r in got.gate.groupBy("gate_status").count().orderBy("gate_status").collect():
        print(r["gate_status"], r["count"])
    return int(got.gate.agg(F.max("exit_code")).first()[0] or 0)
