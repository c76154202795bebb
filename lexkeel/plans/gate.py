"""Findings and what follows from them: order, duplicates, counts, gate, exit codes.

A finding is a row; see ``schemas.FINDINGS``. Advisory layers can't fail and never block; an unknown state
is ``unverifiable``, never a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import fingerprint
from .rulebook import FORMAL

STATUSES = ("pass", "fail", "warn", "info", "unverifiable", "not_applicable", "skipped")
APPROVAL = "APPROVAL_REQUIRED"
SUCCESS, FORMAL_FAILURE, CONFIG_ERROR, INTERNAL_ERROR = 0, 2, 3, 4


def formal(layer: Column) -> Column:
    return layer.isin(*FORMAL)


def blocks(layer: Column, severity: Column, status: Column, mode: str) -> Column:
    """Strict mode also blocks on what could not be verified."""
    bad = status == "fail"
    if mode == "strict":
        bad = bad | (status == "unverifiable")
    return formal(layer) & (severity == "error") & bad


def unverified_blocker(layer: Column, severity: Column, status: Column) -> Column:
    return formal(layer) & (severity == "error") & (status == "unverifiable")


def needs_approval(message: Column) -> Column:
    return F.contains(F.upper(message), F.lit(APPROVAL))


def counters() -> list[Column]:
    """Six counters; ``warnings`` holds formal rows that warn by status or by severity, advisory rows are apart."""
    layer, severity, status = F.col("layer"), F.col("severity"), F.col("status")
    advisory = layer.isin("llm", "vision")
    error = formal(layer) & (severity == "error") & (status == "fail")
    return [
        F.count_if(error).alias("formal_errors"),
        F.count_if(~advisory & ~error & ((status == "warn") | (severity == "warn"))).alias("warnings"),
        F.count_if(advisory & status.isin("warn", "info")).alias("llm_advisory"),
        F.count_if(status == "unverifiable").alias("unverifiable"),
        F.count_if(unverified_blocker(layer, severity, status)).alias("blocking_unverifiable"),
        F.count_if(needs_approval(F.col("message"))).alias("approvals_required"),
    ]


def gate(findings: DataFrame, mode: str = "strict", key: str = "doc_id") -> DataFrame:
    """A row for each document: counters, blocking and suppressed rules, gate status, exit code."""
    layer, severity, status = F.col("layer"), F.col("severity"), F.col("status")
    stops = blocks(layer, severity, status, mode)
    hidden = unverified_blocker(layer, severity, status) if mode == "advisory" else F.lit(False)
    rules = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("rule_id")))), ",")
    out = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n_findings"), *counters(), rules(stops).alias("blocking_rules"), rules(hidden).alias("suppressed_rules"))
    state = F.when(F.col("blocking_rules") != "", "fail").when(F.col("suppressed_rules") != "", "degraded").otherwise("pass")
    return out.withColumns({"gate_status": state, "exit_code": F.when(state == "fail", FORMAL_FAILURE).otherwise(SUCCESS)})


def exit_code(formal_exit: Column, config_error: Column, internal_error: Column) -> Column:
    """The code of a run: an internal error first, then a wrong configuration, then the gate."""
    return F.when(internal_error, INTERNAL_ERROR).when(config_error, CONFIG_ERROR).otherwise(formal_exit)


def order(findings: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``fingerprint`` and ``place``, the position in a document: by rulebook, first locator, fingerprint."""
    rank = rules.select(F.col("id").alias("rule_id"), "rubric_index")
    out = findings.withColumn("fingerprint", fingerprint()).join(F.broadcast(rank), "rule_id", "left")
    by = Window.partitionBy(key).orderBy(F.coalesce("rubric_index", F.lit(10_000)), F.coalesce(F.get("evidence", F.lit(0))["locator"], F.lit("")), "fingerprint")
    return out.withColumn("place", F.row_number().over(by)).drop("rubric_index")


def union_stages(*stages: tuple[str, DataFrame]) -> DataFrame:
    """All findings of a run with the stage that made them and its number."""
    frames = [df.withColumns({"stage": F.lit(name), "stage_no": F.lit(i)}) for i, (name, df) in enumerate(stages)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def dedupe(findings: DataFrame, key: str = "doc_id", by: str = "place") -> DataFrame:
    """One finding of each fingerprint in a document, the first by ``by``."""
    first = Window.partitionBy(key, "fingerprint").orderBy(by)
    return findings.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def status_counts(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """A column for each status, zeros included, and the sorted distinct blocking rules."""
    stops = blocks(F.col("layer"), F.col("severity"), F.col("status"), "strict")
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    return findings.groupBy(key).agg(*counts, F.array_join(F.array_sort(F.collect_set(F.when(stops, F.col("rule_id")))), ",").alias("blocking_rules"))
