"""Published reports: redacted findings, counters, a header; as JSON lines, Markdown and a console summary.

Reports are rows; ``publish_reports`` writes all tables of a report aside and commits them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..commits import Commits
from ..functions import redaction as R
from . import gate as G

SCHEMA_VERSION = "1.2"
MARKER = "<!-- corpus-report -->"
GROUPS = ("formal_errors", "warnings", "llm_advisory", "unverifiable", "approvals_required")


def recommendation(status: Column, message: Column) -> Column:
    return (
        F.when(status == "fail", "Fix the violation and run the formal gate again.")
        .when(status == "unverifiable", "Provide the sources that the rule needs.")
        .when(status == "warn", "Look at the remark before the final check.")
        .when(G.needs_approval(message), "Wait until the parameter is approved.")
        .otherwise("For information; nothing is blocked.")
    )


def published(findings: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """Findings that a reader sees: no passes, skips or inapplicable rules unless an approval is due; public text redacted and cut."""
    shown = ~F.col("status").isin("pass", "skipped", "not_applicable") | G.needs_approval(F.col("message"))
    out = findings.where(shown)
    evidence = F.transform("evidence", lambda e: F.struct(e["locator"].alias("locator"), R.public_text(e["description"]).alias("description")))
    out = out.withColumns({"recommendation": recommendation(F.col("status"), F.col("message")), "message": R.public_text(F.col("message")), "evidence": evidence, "page": F.when(F.col("page") >= 1, F.col("page"))})
    if confidence is None:
        return out.withColumn("confidence", F.lit(None).cast("double"))
    return out.join(F.broadcast(confidence.select("rule_id", "confidence")), "rule_id", "left")


def groups(f: Column) -> dict[str, Column]:
    """Which sections of a report a finding belongs to; it may be in several."""
    advisory = f["layer"].isin("llm", "vision")
    error = G.formal(f["layer"]) & (f["severity"] == "error") & (f["status"] == "fail")
    return {
        "formal_errors": ~advisory & error, "warnings": ~advisory & ~error & ((f["status"] == "warn") | (f["severity"] == "warn")), "llm_advisory": advisory,
        "unverifiable": f["status"] == "unverifiable", "approvals_required": G.needs_approval(f["message"]),
    }


def reports(findings: DataFrame, mode: str = "strict", stamp: Column | None = None, **header: str) -> DataFrame:
    """A row for each document: ``schema_version``, ``header``, ``exit_code``, ``counts``, ``findings`` in order."""
    counts = G.gate(findings, mode)
    cols = ["rule_id", "layer", "severity", "status", "message", "evidence", "path", "page", "fingerprint", "recommendation", "confidence"]
    shown = published(findings).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", *cols))).alias("f"))
    out = counts.join(shown, "doc_id", "left")
    listed = F.transform(F.coalesce("f", F.array()), lambda x: F.struct(*[x[c].alias(c) for c in cols]))
    when = F.date_format(F.date_trunc("second", stamp if stamp is not None else F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = {"gate_status": F.col("gate_status"), "gate_mode": F.lit(mode), "degraded": F.col("blocking_unverifiable") > 0, "approvals_required": F.col("approvals_required") > 0, "generated_at": when} | {k: F.lit(v) for k, v in header.items()}
    counters = ("formal_errors", "warnings", "llm_advisory", "unverifiable", "blocking_unverifiable", "approvals_required")
    return out.select("doc_id", F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(*[v.alias(k) for k, v in head.items()]).alias("header"), "exit_code", F.struct(*counters).alias("counts"), F.when(F.size("f") > 0, listed).otherwise(F.slice(listed, 1, 0)).alias("findings"))


def as_json(report: DataFrame) -> DataFrame:
    """``doc_id`` and ``json`` of each report; null members are left out."""
    return report.select("doc_id", F.to_json(F.struct("schema_version", "header", "exit_code", "counts", "findings")).alias("json"))


def markdown(report: DataFrame, collapse_after: int = 8, limit: int = 60_000) -> DataFrame:
    """``doc_id`` and ``markdown``: five sections, long ones folded; a report over ``limit`` characters keeps its counts only."""
    def section(name: str) -> Column:
        mine = F.filter("findings", lambda f: groups(f)[name])
        line = lambda f: F.concat(F.lit("- **"), f["rule_id"], F.lit("** "), R.evidence_text(f["message"]), F.coalesce(F.concat(F.lit(" (p. "), f["page"].cast("string"), F.lit(")")), F.lit("")), F.lit(" — "), f["recommendation"])
        body = F.array_join(F.transform(mine, line), "\n")
        folded = F.concat(F.lit("<details>\n\n"), body, F.lit("\n\n</details>"))
        text = F.when(F.size(mine) == 0, "none").when(F.size(mine) > collapse_after, folded).otherwise(body)
        return F.concat(F.lit(f"## {name} ("), F.size(mine).cast("string"), F.lit(")\n\n"), text)

    title = F.concat(F.lit(f"{MARKER}\n# Gate: "), F.col("header.gate_status"), F.lit(" ("), F.col("header.gate_mode"), F.lit(")\n\n"))
    counts = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.col(f"counts.{c}").cast("string")) for c in (*GROUPS, "blocking_unverifiable")])
    whole = F.concat(title, counts, F.lit("\n\n"), F.concat_ws("\n\n", *map(section, GROUPS)))
    return report.select("doc_id", F.when(F.length(whole) <= limit, whole).otherwise(F.concat(title, counts, F.lit("\n\nThe findings are too long to be shown here."))).alias("markdown"))


def summary(report: DataFrame) -> DataFrame:
    """One line for each document that holds no text of it."""
    line = F.concat_ws(" ", F.lit("gate"), "header.gate_status", F.lit("exit"), F.col("exit_code").cast("string"), F.lit("errors"), F.col("counts.formal_errors").cast("string"), F.lit("warnings"), F.col("counts.warnings").cast("string"), F.lit("unverifiable"), F.col("counts.unverifiable").cast("string"))
    return report.select("doc_id", line.alias("summary"))


def write_reports(report: DataFrame, to: str) -> None:
    """``report`` (JSON), ``markdown`` and ``summary`` as plain folders of any store that Spark writes, one after the other."""
    as_json(report).select("json").write.mode("overwrite").text(f"{to}/report")
    markdown(report).write.mode("overwrite").json(f"{to}/markdown")
    summary(report).write.mode("overwrite").json(f"{to}/summary")


def publish_reports(report: DataFrame, to: str, findings: DataFrame | None = None) -> None:
    """``report`` (JSON), ``markdown`` and ``summary`` as tables of one version under a folder, and ``stages`` if ``findings`` are given.

    They become visible together: a run that dies between two of them leaves the report before it whole (``read_reports``).
    """
    commits = Commits(report.sparkSession, to)
    parent = commits.latest()
    tables = {"report": as_json(report), "markdown": markdown(report), "summary": summary(report)}
    if findings is not None:
        tables["stages"] = findings
    put = {name: commits.write(df, name) for name, df in tables.items()}
    commits.commit(parent, {n: [where] for n, (where, _) in put.items()}, {n: schema for n, (_, schema) in put.items()})


def read_reports(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    """The tables of the last report that was written whole."""
    commits = Commits(spark, at)
    m = commits.latest()
    return {name: commits.read(name, m) for name in m.schemas}
