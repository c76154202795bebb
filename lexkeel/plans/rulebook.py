"""The rulebook as a table: capabilities, profiles, parameters, severities.

Rules are data. The table is small and fixed, so joins with it may broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id, layer, severity and, where it differs for the final check, final severity of every rule, in order.
RULES = """
SYS-01 script error
SYS-02 script error
SYS-03 script error
FMT-01 class error
FMT-02 class error
FMT-03 class error
FMT-04 class error
FMT-05 class error
FIG-01 script warn
FIG-02 script error
FIG-03 class+script error
FIG-04 class error
FIG-05 class error
FIG-06 class error
FIG-07 class error
TAB-01 class error
TAB-02 class+script warn
TAB-03 script warn
CAP-01 script error
BIB-01 script error
BIB-02 class+script error
BIB-03 class+script error
BIB-04 script error
BIB-05 script warn
STR-01 script error
STR-02 class error
STR-03 script warn
STR-04 script warn
STR-05 llm warn
ANN-01 llm warn
ANN-02 script error
ANN-03 script warn error
INT-01 llm warn
INT-02 script error
REV-01 script warn error
REV-02 script+llm warn
REV-03 script warn
REV-04 script+llm error
REV-05 llm warn
REV-06 llm warn
REV-07 script warn
SSA-01 script+llm warn
SSA-02 llm warn
SSA-03 llm warn
SSA-04 llm warn
TSK-01 llm warn
TSK-02 script+llm warn
TSK-03 llm warn
ARC-01 script+llm warn
ARC-02 llm warn
MTH-01 class+script error
MTH-02 llm warn
MTH-03 llm warn
ALG-01 script+llm warn
ALG-02 vision info
ALG-03 script+llm warn
IMP-01 llm warn
IMP-02 vision info
RES-01 script+llm warn
CON-01 llm warn
APP-01 script info
GEN-01 llm warn
GEN-02 llm info
DEP-01 script warn
"""
#: Legal spellings of a layer and the capabilities that they name.
CAPABILITIES = {"class": ["class"], "script": ["script"], "class+script": ["class", "script"], "llm": ["llm"], "vision": ["vision"], "script+llm": ["script", "llm"]}
#: Rule families that a profile does without.
DISABLED = {"software": [], "research": ["ARC", "ALG", "IMP"], "organizational": ["ARC", "ALG", "IMP", "MTH"]}
FORMAL = ("class", "script", "class+script")
PARAMETERS = {"font_size_pt": 14, "fig_numbering": "сквозная", "defense_year": 2026, "geometry_tolerance_pt": 0.5, "recent_sources_share": 0.5}
PLACEHOLDER = r"(?<![\\A-Za-z0-9_])\{([A-Za-z_][A-Za-z0-9_]*)\}"


class RulebookError(ValueError):
    """The rulebook or its configuration is not valid."""


@dataclass(frozen=True)
class Settings:
    """What a run may choose; unset parameters keep the rulebook's values."""

    profile: str = "software"
    final: bool = False
    only: tuple[str, ...] = ()
    gate_mode: str = "strict"
    fail_closed: bool = False
    parameters: dict[str, Any] = field(default_factory=dict)

    def value(self, name: str) -> Any:
        return self.parameters.get(name, PARAMETERS[name])

    def check(self) -> Settings:
        if self.profile not in DISABLED:
            raise RulebookError(f"unknown profile: {self.profile}")
        if self.gate_mode not in ("strict", "advisory"):
            raise RulebookError(f"unknown gate mode: {self.gate_mode}")
        if unknown := sorted(set(self.parameters) - set(PARAMETERS)):
            raise RulebookError(f"unknown parameters: {', '.join(unknown)}")
        ids = {line.split()[0] for line in RULES.strip().splitlines()}
        if unknown := [t for t in self.only if t not in ids and t not in {i[:3] for i in ids}]:
            raise RulebookError(f"unknown rules: {', '.join(unknown)}")
        return self


def rule_rows() -> list[tuple[int, str, str, str, str | None]]:
    return [(n, *(line.split() + [None])[:4]) for n, line in enumerate(RULES.strip().splitlines())]


#: What a rulebook file must hold, and the ranges of its parameters.
META = {"sources": {"M1", "M2", "DEP"}, "layers": {"class", "script", "llm", "vision"}, "severity": {"error", "warn", "info"}}
RANGES = {"font_size_pt": (int, 8, 72), "defense_year": (int, 2000, 2100), "recent_sources_share": (float, 0, 1), "geometry_tolerance_pt": (float, 0, 1)}
NUMBERINGS = ("сквозная", "по разделам")
RULE_COUNT, RULE_ID = 64, r"[A-Z]{3}-[0-9]{2}"


@dataclass(frozen=True)
class Rulebook:
    """A rulebook file: version, parameters, and a row (``id``, ``layer``, ``severity``, ``severity_final``, ``src``, ``rule``, ``check``) for each rule in order."""

    version: str
    parameters: dict[str, Any]
    rules: list[dict[str, Any]]


def load(text: str) -> Rulebook:
    """A rulebook from YAML, strictly: no key twice or unknown, no rule twice, layers and severities in their words, parameters in their ranges."""
    from ..sources.policy import parse

    def mapping(value: Any, at: str, keys: set[str], optional: set[str] = frozenset()) -> dict:
        if not isinstance(value, dict):
            raise RulebookError(f"{at} is a mapping")
        if wrong := sorted(map(str, set(value) ^ (keys | (optional & set(value))))):
            raise RulebookError(f"{at}: missing or unknown {', '.join(wrong)}")
        return value

    def words(value: Any, at: str) -> str:
        if not isinstance(value, str) or not value.strip():
            raise RulebookError(f"{at} is a text that isn't empty")
        return value.strip()

    book = mapping(parse(text), "a rulebook", {"meta", "rules"})
    meta = mapping(book["meta"], "meta", {"version", "sources", "layers", "severity", "policy", "params_to_approve"})
    for name, keys in META.items():
        for k, v in mapping(meta[name], f"meta.{name}", keys).items():
            words(v, f"meta.{name}.{k}")
    told = mapping(meta["params_to_approve"], "meta.params_to_approve", set(PARAMETERS))
    for name, (kind, low, high) in RANGES.items():
        v = told[name]
        if isinstance(v, bool) or not isinstance(v, int if kind is int else (int, float)) or not low <= v <= high:
            raise RulebookError(f"meta.params_to_approve.{name} lies between {low} and {high}")
    if told["fig_numbering"] not in NUMBERINGS:
        raise RulebookError(f"meta.params_to_approve.fig_numbering is one of {', '.join(NUMBERINGS)}")
    if not isinstance(book["rules"], list) or len(book["rules"]) != RULE_COUNT:
        raise RulebookError(f"a rulebook has {RULE_COUNT} rules")
    rules, seen = [], set()
    for i, raw in enumerate(book["rules"]):
        at = f"rules[{i}]"
        r = {k: words(v, f"{at}.{k}") for k, v in mapping(raw, at, {"id", "src", "rule", "layer", "check", "severity"}, {"severity_final"}).items() if v is not None or k != "severity_final"}
        if not re.fullmatch(RULE_ID, r["id"]) or r["id"] in seen:
            raise RulebookError(f"{at}.id is no id, or stands twice: {r['id']}")
        if r["layer"] not in CAPABILITIES:
            raise RulebookError(f"{at}.layer is not a layer: {r['layer']}")
        if bad := [r[k] for k in ("severity", "severity_final") if r.get(k, "info") not in META["severity"]]:
            raise RulebookError(f"{at} has no such severity: {bad[0]}")
        seen.add(r["id"])
        rules.append({"severity_final": None} | r)
    return Rulebook(words(meta["version"], "meta.version"), told, rules)


def rulebook(spark: SparkSession, book: Rulebook | None = None) -> DataFrame:
    """``rubric_index``, ``id``, ``layer``, ``severity``, ``severity_final``, ``capabilities``, ``formal_layer`` of the library's rules or of a file's."""
    given = rule_rows() if book is None else [(n, r["id"], r["layer"], r["severity"], r["severity_final"]) for n, r in enumerate(book.rules)]
    rows = spark.createDataFrame(given, "rubric_index int, id string, layer string, severity string, severity_final string")
    return rows.withColumn("capabilities", capabilities(F.col("layer"))).withColumn("formal_layer", formal_layer(F.col("capabilities")))


def capabilities(layer: Column) -> Column:
    """Null for a spelling that is not legal."""
    table = F.create_map(*[x for k, v in CAPABILITIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.try_element_at(table, layer)


def formal_layer(caps: Column) -> Column:
    """The layer that a rule's findings carry: both formal capabilities, one of them, else the first."""
    has = lambda c: F.array_contains(caps, c)
    return F.when(has("class") & has("script"), "class+script").when(has("class"), "class").when(has("script"), "script").otherwise(F.get(caps, F.lit(0)))


def enabled(rule_id: Column, profile: str) -> Column:
    return ~F.split_part(rule_id, F.lit("-"), F.lit(1)).isin(*DISABLED[profile]) if DISABLED[profile] else F.lit(True)


def effective(rules: DataFrame, settings: Settings) -> DataFrame:
    """Rules of a run: enabled by profile, chosen by ``only`` (an id or a family), with final severities if asked."""
    settings.check()
    out = rules.withColumn("enabled", enabled(F.col("id"), settings.profile))
    if settings.only:
        out = out.where(F.col("id").isin(*settings.only) | F.substring("id", 1, 3).isin(*settings.only))
    return out.withColumn("severity", F.coalesce("severity_final", "severity")) if settings.final else out


def is_formal(caps: Column) -> Column:
    return F.array_contains(caps, "class") | F.array_contains(caps, "script")


def fill(text: str, values: dict[str, Any], approved: set[str]) -> str:
    """Puts approved values in place of ``{name}``; an unknown name is an error, one not approved stays."""

    def put(m: re.Match[str]) -> str:
        if m[1] not in values:
            raise RulebookError(f"unknown placeholder {{{m[1]}}}")
        return str(values[m[1]]) if m[1] in approved else m[0]

    return re.sub(PLACEHOLDER, put, text)


def check_placeholders(texts: list[str], values: dict[str, Any]) -> None:
    """Every ``{name}`` of the texts must have a value, and every value a text that uses it."""
    used = {m for t in texts for m in re.findall(PLACEHOLDER, t)}
    if unknown := sorted(used - set(values)):
        raise RulebookError(f"unknown placeholders: {', '.join(unknown)}")
    if unused := sorted(set(values) - used):
        raise RulebookError(f"values that no text uses: {', '.join(unused)}")


def warnings(settings: Settings, version: str, approved: set[str], suggested: str | None = None) -> list[tuple[str, str]]:
    """Codes and messages: parameters of a draft rulebook that nobody approved, and a profile other than the suggested one (which never changes it)."""
    out = [("APPROVAL_REQUIRED", f"draft parameter {p} is not approved") for p in PARAMETERS if "draft" in version.casefold() and p not in approved]
    if suggested and suggested != settings.profile:
        out.append(("PROFILE_MISMATCH", f"suggested profile {suggested}, selected {settings.profile}"))
    return out
