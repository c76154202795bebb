"""Rulebooks and policies read from files, strictly."""

from __future__ import annotations

import copy

import pytest

from lexkeel.plans import rulebook as B
from lexkeel.sources import policy as Y

yaml = pytest.importorskip("yaml")

BOOK = {
    "meta": {
        "version": "1-draft", "sources": {"M1": "a", "M2": "b", "DEP": "c"}, "layers": {k: "x" for k in ("class", "script", "llm", "vision")}, "severity": {k: "x" for k in ("error", "warn", "info")}, "policy": "p",
        "params_to_approve": {"font_size_pt": 14, "fig_numbering": "сквозная", "defense_year": 2026, "geometry_tolerance_pt": 0.5, "recent_sources_share": 0.5},
    },
    "rules": [{"id": i, "src": "M1", "rule": "r {font_size_pt}", "layer": layer, "check": "c", "severity": severity} | ({"severity_final": final} if final else {}) for _, i, layer, severity, final in B.rule_rows()],
}


def test_a_file_gives_the_same_rules(spark):
    got = B.load(yaml.safe_dump(BOOK, allow_unicode=True))
    assert (got.version, got.parameters["defense_year"], len(got.rules)) == ("1-draft", 2026, 64)
    assert B.rulebook(spark, got).collect() == B.rulebook(spark).collect()
    assert B.fill(got.rules[0]["rule"], got.parameters, {"font_size_pt"}) == "r 14"


@pytest.mark.parametrize(
    ("change", "what"),
    [
        (lambda b: b.update(more=1), "unknown more"), (lambda b: b.pop("meta"), "unknown meta"), (lambda b: b["meta"]["sources"].pop("M2"), "M2"), (lambda b: b["meta"]["layers"].update(class_=1), "class_"), (lambda b: b["meta"].update(version=" "), "version"),
        (lambda b: b["meta"]["params_to_approve"].update(font_size_pt=7), "font_size_pt"), (lambda b: b["meta"]["params_to_approve"].update(font_size_pt=14.5), "font_size_pt"), (lambda b: b["meta"]["params_to_approve"].update(defense_year=True), "defense_year"),
        (lambda b: b["meta"]["params_to_approve"].update(recent_sources_share=float("nan")), "recent_sources_share"), (lambda b: b["meta"]["params_to_approve"].update(fig_numbering="x"), "fig_numbering"), (lambda b: b["rules"].pop(), "64 rules"), (lambda b: b["rules"][1].update(id=b["rules"][0]["id"]), "stands twice"),
        (lambda b: b["rules"][3].update(layer="magic"), "not a layer"), (lambda b: b["rules"][3].update(severity="bad"), "severity: bad"), (lambda b: b["rules"][3].update(severity_final="bad"), "severity: bad"), (lambda b: b["rules"][3].pop("check"), "check"), (lambda b: b["rules"][3].update(check=""), "check"), (lambda b: b.update(rules=5), "64 rules"),
    ],
)
def test_what_a_file_must_hold(change, what):
    book = copy.deepcopy(BOOK)
    change(book)
    with pytest.raises(B.RulebookError, match=what):
        B.load(yaml.safe_dump(book, allow_unicode=True))


def test_a_key_twice_is_refused():
    with pytest.raises(B.RulebookError, match="repeated key"):
        B.load(yaml.safe_dump(BOOK, allow_unicode=True) + "\nmeta: {}\n")


@pytest.mark.parametrize(
    ("text", "what"),
    [("allowed_renewcommand: x\n", "list of names"), ("allowed_renewcommand: [1]\n", "list of names"), ("class_files: [{path: a.cls, sha256: abc}]\n", "SHA-256"), (f"class_files: [{{path: a.cls, sha256: {'a' * 64}}}, {{path: a.cls, sha256: {'b' * 64}}}]\n", "twice")],
)
def test_what_a_policy_must_hold(text, what):
    with pytest.raises(B.RulebookError, match=what):
        Y._rows_of(Y.parse(text))
    assert Y._rows_of(Y.parse(f"allowed_renewcommand: [thefigure]\nclass_files: [{{path: a.cls, sha256: {'a' * 64}}}]\n")) == [("file", 0, "a.cls", "a" * 64)]
