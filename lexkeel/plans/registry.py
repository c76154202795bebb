"""Rules that a run knows: those of the library and those that its user adds, each implemented or declared as not.

A rule is a function to a column of outcomes, so a registered one joins the single projection over all facts; what a pass over the findings has counted is
read from an observation, without another job.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import rulebook as B
from . import thesis as H

IMPLEMENTED, UNSUPPORTED, MISSING = "implemented", "unsupported", "missing"


class DuplicateRule(ValueError):
    """A rule was declared twice."""


class UnknownRule(KeyError):
    """A rule was never declared."""


@dataclass(frozen=True)
class Registration:
    rule_id: str
    state: str
    rule: H.Rule | None = None
    reason: str | None = None
    layer: str | None = None  # of a rule that the rulebook doesn't list
    severity: str | None = None

    def __post_init__(self) -> None:
        if self.state == IMPLEMENTED and self.rule is None:
            raise ValueError("an implemented rule needs its implementation")
        if self.state == UNSUPPORTED and not self.reason:
            raise ValueError("an unsupported rule needs a reason")


class Registry:
    def __init__(self) -> None:
        self._entries: dict[str, Registration] = {}

    @classmethod
    def standard(cls) -> Registry:
        """All rules of the library."""
        out = cls()
        for rule in H.RULES:
            out.register(rule)
        out.mark_unsupported("DEP-01", "no implementation")
        return out

    def _add(self, entry: Registration) -> None:
        if entry.rule_id in self._entries:
            raise DuplicateRule(entry.rule_id)
        self._entries[entry.rule_id] = entry

    def register(self, rule: H.Rule, layer: str | None = None, severity: str | None = None) -> None:
        """``layer`` and ``severity`` are for rules that the rulebook doesn't list."""
        if (layer is None) != (severity is None):
            raise ValueError("a rule of one's own has a layer and a severity")
        if layer is not None and layer not in B.FORMAL:
            raise ValueError(f"not a formal layer: {layer}")
        self._add(Registration(rule.id, IMPLEMENTED, rule, None, layer, severity))

    def mark_unsupported(self, rule_id: str, reason: str) -> None:
        self._add(Registration(rule_id, UNSUPPORTED, reason=reason))

    def get(self, rule_id: str) -> Registration | None:
        return self._entries.get(rule_id)

    def require(self, rule_id: str) -> Registration:
        if rule_id not in self._entries:
            raise UnknownRule(rule_id)
        return self._entries[rule_id]

    def rule_ids(self) -> list[str]:
        return sorted(self._entries)

    def coverage(self, spark: SparkSession) -> DataFrame:
        """``rule_id``, ``state``, ``reason`` and ``listed`` (in the rulebook): one row for each rule of the rulebook and of the registry."""
        own = spark.createDataFrame([(e.rule_id, e.state, e.reason) for e in self._entries.values()], "rule_id string, state string, reason string")
        book = B.rulebook(spark).where(B.is_formal(F.col("capabilities"))).select(F.col("id").alias("rule_id"), F.lit(True).alias("listed"))
        out = book.join(own, "rule_id", "full")
        return out.select("rule_id", F.coalesce("state", F.lit(MISSING)).alias("state"), "reason", F.coalesce("listed", F.lit(False)).alias("listed"))

    def evaluate(self, spark: SparkSession, facts: DataFrame, settings: B.Settings = B.Settings(), more: dict[str, Column] | None = None) -> DataFrame:
        """Findings by the rules registered here; the rulebook's others are unverifiable, with the reason if one was given."""
        entries = self._entries.values()
        book = {r["id"] for r in B.rulebook(spark).select("id").collect()}
        extra = [{"id": e.rule_id, "formal_layer": e.layer, "severity": e.severity} for e in entries if e.layer and e.rule_id not in book]
        if bad := sorted(e.rule_id for e in entries if e.rule and not e.layer and e.rule_id not in book):
            raise UnknownRule(f"not in the rulebook and without a layer: {', '.join(bad)}")
        # What is chosen by name may be a rule of one's own, which the rulebook doesn't know.
        own = {name for r in extra for name in (r["id"], r["id"][:3])}
        if settings.only:
            extra = [r for r in extra if r["id"] in settings.only or r["id"][:3] in settings.only]
        rest = tuple(name for name in settings.only if name not in own)
        return H.evaluate(spark, facts, replace(settings, only=rest), more, [e.rule for e in entries if e.rule], extra, {e.rule_id: e.reason for e in entries if e.reason}, listed=bool(rest) or not settings.only)


def observed(findings: DataFrame, name: str = "rules") -> tuple[DataFrame, Observation]:
    """``findings`` and an observation: how many, and how many of each status, a pass over them has seen."""
    from .gate import STATUSES

    seen = Observation(name)
    return findings.observe(seen, F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]), seen
