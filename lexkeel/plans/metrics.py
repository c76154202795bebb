"""Evaluation of findings against labels: confusion matrices and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def triggered(statuses: Column) -> Column:
    return F.exists(statuses, lambda s: s.isin("fail", "warn"))


def matches(expected: Column, statuses: Column) -> Column:
    return F.when(expected == "silent", ~triggered(statuses)).when(expected == "detect", triggered(statuses)).when(expected.isin("fail", "warn"), F.array_contains(statuses, expected))


def observe(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """Labels (``fixture_id``, ``rule_id``, ``expected``) with the statuses that their rules gave; none is an empty array."""
    got = findings.groupBy(F.col("doc_id").alias("fixture_id"), "rule_id").agg(F.array_sort(F.collect_list("status")).alias("statuses"))
    out = labels.join(got, ["fixture_id", "rule_id"], "left")
    return out.withColumn("statuses", F.coalesce("statuses", F.array().cast("array<string>")))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(observed: DataFrame, by: list[str]) -> DataFrame:
    """Counts, precision, recall and F1; zero denominators give 0. ``by`` may be empty."""
    positive, hit = F.col("expected") != "silent", triggered(F.col("statuses"))
    of = lambda status: F.sum(F.size(F.filter("statuses", lambda s: s == status)))
    out = observed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("labeled_pairs"), F.count_if(positive & hit).alias("tp"), F.count_if(~positive & hit).alias("fp"), F.count_if(positive & ~hit).alias("fn"), F.count_if(~positive & ~hit).alias("tn"),
        F.coalesce(of("unverifiable"), F.lit(0)).alias("unverifiable"), F.coalesce(of("not_applicable"), F.lit(0)).alias("not_applicable"), F.count_if(~matches(F.col("expected"), F.col("statuses"))).alias("mismatches"),
    )
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def per_rule(observed: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each rule of ``rules`` (``id``), zeros where it has no label."""
    got = confusion(observed, ["rule_id"])
    out = rules.select(F.col("id").alias("rule_id")).join(got, "rule_id", "left")
    return out.fillna(0).fillna(0.0)


def semantic_rates(cases: DataFrame) -> DataFrame:
    """Rates of valid schemas, valid evidence and useful answers, by rule and (``rule_id`` null) over all.

    ``cases``: ``rule_id``, ``schema_ok``, ``evidence_ok``, ``useful``, ``actionable``; usefulness counts over actionable cases only.
    """
    rate = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    return cases.rollup("rule_id").agg(F.count(F.lit(1)).alias("cases"), rate(F.col("schema_ok")).alias("schema_rate"), rate(F.col("evidence_ok")).alias("evidence_rate"), rate(F.when(F.col("actionable"), F.col("useful"))).alias("useful_rate"))
