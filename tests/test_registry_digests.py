"""The rule registry, observations, headings-only plans, and digests of nested tables."""

from __future__ import annotations

import hashlib
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexkeel.functions import digests as D
from lexkeel.plans import advisory as A
from lexkeel.plans import registry as R
from lexkeel.plans import rulebook as B
from lexkeel.plans import thesis as H
from lexkeel.sources import projects as P

from .test_faults import put
from .test_thesis import CASES

# ---- registry ----


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("registry")
    for name in ("pass", "str02", "fig02"):
        put(at, name, CASES[name][0])
    files = P.read_files(spark, f"file://{at}")
    projects = P.projects(files).cache()
    return H.facts(spark, projects, P.sections(spark, projects), files, P.bib_entries(files, projects))


def shorts() -> H.Rule:
    return H.Rule("OWN-01", "L", lambda s: F.when(F.length("text") < 400, H.one("warn", "short")).otherwise(H.one("pass", "long enough")))


def test_declarations(spark):
    r = R.Registry()
    r.register(shorts(), "script", "warn")
    r.mark_unsupported("DEP-01", "no network")
    for again in (lambda: r.register(shorts(), "script", "warn"), lambda: r.mark_unsupported("OWN-01", "x"), lambda: r.mark_unsupported("DEP-01", "x")):
        with pytest.raises(R.DuplicateRule):
            again()
    assert r.rule_ids() == ["DEP-01", "OWN-01"] and r.get("X-1") is None and r.require("DEP-01").reason == "no network"
    with pytest.raises(R.UnknownRule):
        r.require("X-1")
    for wrong in (lambda: R.Registration("A", R.IMPLEMENTED), lambda: R.Registration("A", R.UNSUPPORTED), lambda: r.register(shorts(), "script"), lambda: r.register(H.Rule("Q", "", lambda s: F.lit(1)), "llm", "warn")):
        with pytest.raises(ValueError):
            wrong()
    rows = {x["rule_id"]: (x["state"], x["reason"], x["listed"]) for x in r.coverage(spark).collect()}
    assert rows["OWN-01"] == ("implemented", None, False) and rows["DEP-01"] == ("unsupported", "no network", True) and rows["STR-01"] == ("missing", None, True)
    full = R.Registry.standard().coverage(spark).collect()
    assert {x["state"] for x in full if x["listed"]} == {"implemented", "unsupported"} and sum(x["state"] == "implemented" for x in full) == 44


def test_the_standard_registry_finds_what_the_rules_find(spark, facts):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(R.Registry.standard().evaluate(spark, facts)) == key(H.evaluate(spark, facts))


def test_a_rule_from_outside_and_its_metrics(spark, facts, tmp_path):
    r = R.Registry()
    r.register(shorts(), "script", "warn")
    r.register(next(x for x in H.RULES if x.id == "STR-02"))
    r.mark_unsupported("FIG-02", "not this time")
    findings, seen = R.observed(r.evaluate(spark, facts))
    before = spark.sparkContext.statusTracker()
    findings.write.parquet(f"file://{tmp_path}/f")
    told = seen.get  # of the pass that wrote them
    got = spark.read.parquet(f"file://{tmp_path}/f")
    rows = {(x["doc_id"], x["rule_id"]): (x["status"], x["message"]) for x in got.collect()}
    assert rows[("pass", "OWN-01")][0] in ("pass", "warn") and rows[("str02", "STR-02")][0] == "fail" and rows[("pass", "FIG-02")] == ("unverifiable", "not this time")
    assert told["findings"] == got.count() and told["fail"] == got.where("status = 'fail'").count() and told["unverifiable"] == got.where("status = 'unverifiable'").count()
    assert before is not None and r.evaluate(spark, facts, B.Settings(only=("OWN-01",))).select("rule_id").distinct().collect() == [("OWN-01",)]
    r.register(H.Rule("ZZZ-99", "", lambda s: H.one("pass", "x")))
    with pytest.raises(R.UnknownRule, match="ZZZ-99"):
        r.evaluate(spark, facts)


def test_attempts_and_tokens_in_the_same_pass(spark):
    asked = spark.createDataFrame([(str(i), "R", ["a"], "p", "h") for i in range(6)], "doc_id string, rule_id string, elements array<string>, prompt string, prompt_hash string")

    def provider(prompt):
        return {"status": "pass", "elements": ["a"], "tokens_in": 10, "tokens_out": 3}

    def stubborn(prompt):
        return {"status": "no such", "elements": ["a"], "tokens_in": 1}

    answers, seen = A.observed(A.ask(asked, [("x", provider)]), "good")
    assert answers.count() == 6 and seen.get == {"questions": 6, "attempts": 6, "tokens_in": 60, "tokens_out": 18, "unanswered": 0}
    answers, seen = A.observed(A.ask(asked, [("bad", stubborn)]), "bad")
    assert {x["tokens_in"] for x in answers.collect()} == {2}
    assert seen.get == {"questions": 6, "attempts": 12, "tokens_in": 12, "tokens_out": 0, "unanswered": 6}


def test_rules_over_headings_see_headings_only(spark):
    cols = "doc_id string, section_id string, title string, norm string, kind string, level int, char_start int"
    sections = spark.createDataFrame([("d", "s1", "Обзор НТИ", "обзор нти", "other", 2, 0), ("d", "s2", "Методы", "методы", "other", 3, 50), ("d", "s3", "Список литературы", "список литературы", "other", 2, 90)], cols)
    chunks = spark.createDataFrame([("d", s, f"{s}:{i}", f"body {s} {i}", at + i) for s, at in (("s1", 0), ("s2", 50), ("s3", 90)) for i in range(4)], "doc_id string, section_id string, chunk_id string, text string, char_start int")
    got = {r["rule_id"]: [(c["chunk_id"], c["text"], c["char_start"]) for c in r["chunks"] or []] for r in A.plan(spark, sections, chunks).collect()}
    name = lambda t: "heading:" + hashlib.sha256(t.encode()).hexdigest()[:16]
    assert got["STR-05"] == [(name("Обзор НТИ"), "Обзор НТИ", 0), (name("Методы"), "Методы", 50)]
    assert [c[0] for c in got["REV-05"]] == ["s1:0", "s1:1", "s1:3"]


def test_placeholders_are_known_and_used():
    B.check_placeholders(["a {x} b {y}", "{x}"], {"x": 1, "y": 2})
    for texts, values, what in ((["{x}"], {}, "unknown placeholders: x"), (["no"], {"x": 1}, "no text uses: x")):
        with pytest.raises(B.RulebookError, match=what):
            B.check_placeholders(texts, values)


# ---- digests ----

NESTED = "a int, b struct<z:string,y:array<struct<k:string,v:double>>>, m map<string,array<int>>, t string, d date, f boolean, raw binary"


def nested_rows(seed, n=40):
    rng = random.Random(seed)
    word = lambda: rng.choice(["x", "é\"\\\n", "ß\u0001", ""])
    return [(rng.choice([None, 1, -5]), (rng.choice([None, word()]), [(word(), rng.choice([None, 0.5, -2.0])) for _ in range(rng.randrange(3))]), {word(): [1, 2] for _ in range(2)} if rng.random() < 0.7 else None, word(), None, rng.random() < 0.5, bytes([rng.randrange(256)])) for _ in range(n)]


def plain(row):
    """The canonical form by the standard library."""

    def value(x):
        if isinstance(x, dict):
            return {k: value(v) for k, v in x.items() if v is not None}
        if isinstance(x, (list, tuple)):
            return [value(v) for v in x]
        return x.hex() if isinstance(x, (bytes, bytearray)) else x

    a, (z, y), m, t, d, f, raw = row
    out = {"a": a, "b": {"z": z, "y": [{"k": k, "v": v} for k, v in y]}, "m": m, "t": t, "d": d, "f": f, "raw": raw}
    return json.dumps(value({k: v for k, v in out.items() if v is not None}), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_rows_have_one_canonical_form(spark):
    rows = nested_rows(1)
    df = spark.createDataFrame(rows, NESTED)
    got = [r[0] for r in df.select(D.row_digest(df)).collect()]
    assert got == [hashlib.sha256(plain(r).encode()).hexdigest() for r in rows]
    other = df.select(*reversed(df.columns))
    assert [r[0] for r in other.select(D.row_digest(other)).collect()] == got


def test_tables_and_bundles_in_any_order(spark):
    rows = nested_rows(2)
    one = lambda r: D.table_digest(spark.createDataFrame(r, NESTED)).first()["digest"]
    assert one(rows) == one(rows[::-1]) == D.table_digest(spark.createDataFrame(rows, NESTED).repartition(5)).first()["digest"]
    assert len({one(rows), one(rows[1:]), one([*rows, rows[0]]), one([])}) == 4
    keyed = lambda r: spark.createDataFrame([(f"b{i % 3}", *x) for i, x in enumerate(r)], "bundle string, " + NESTED)
    tables = {"rows": keyed(rows), "more": keyed(rows[:5])}
    first = {r["bundle"]: r["digest"] for r in D.bundle_digest(tables, "bundle").collect()}
    shuffled = {"more": tables["more"].repartition(4), "rows": tables["rows"].orderBy(F.rand(3))}
    assert {r["bundle"]: r["digest"] for r in D.bundle_digest(shuffled, "bundle").collect()} == first
    swapped = {"rows": tables["more"], "more": tables["rows"]}
    assert all(r["digest"] != first[r["bundle"]] for r in D.bundle_digest(swapped, "bundle").collect())


def test_paths_in_their_stable_order(spark):
    paths = ["b.tex", "A.tex", "a.tex", "e\u0301.tex", "É.tex", "ß.tex", "SS.tex", "dir/x", "Dir/X"]
    files = [("d", p, hashlib.sha256(p.encode()).hexdigest()) for p in paths]
    key = lambda p: (unicodedata.normalize("NFC", p).casefold(), p)
    want = hashlib.sha256(b"".join(p.encode() + b"\0" + s.encode() + b"\0" for _, p, s in sorted(files, key=lambda f: key(f[1])))).hexdigest()
    for seed in (1, 2):
        random.Random(seed).shuffle(files)
        got = D.path_digests(spark.createDataFrame(files, "doc_id string, path string, sha256 string").repartition(3), "doc_id").first()
        assert (got["n_files"], got["digest"]) == (9, want)
    rows = spark.createDataFrame([("d", i, p) for i, p in enumerate(paths)], "doc_id string, pos int, path string")
    assert {r["path"] for r in D.unique_paths(rows, "doc_id", "pos").collect()} == {"b.tex", "A.tex", "e\u0301.tex", "ß.tex", "dir/x"}


@pytest.mark.parametrize(
    ("path", "root", "want"),
    [
        ("/home/u/Repo/src/a.py", "/home/u/repo", "src/a.py"), ("C:\\work\\Repo\\docs\\b.md", "C:/work/repo", "docs/b.md"), ("/other/tests/x/y.tex", "/home/u", "tests/x/y.tex"), ("/opt/thing/c.tex", None, "c.tex"), ("rel\\d.tex", None, "rel/d.tex"), ("D:\\e.tex", None, "e.tex"), (None, None, None), ("/home/u/repository/z", "/home/u/repo", "z"),
    ],
)
def test_paths_from_the_root(spark, path, root, want):
    assert spark.createDataFrame([(path,)], "p string").select(D.relative_path(F.col("p"), root)).first()[0] == want
