"""Folders of projects as a Spark data source."""

from __future__ import annotations

import hashlib
import os

import pytest

from lexkeel.sources import datasource as S
from lexkeel.sources import projects as P

from .test_faults import put
from .test_thesis import CASES


@pytest.fixture
def tree(spark, tmp_path):
    at = tmp_path / "root"
    put(at, "a", {"main.tex": "\\begin{document}\\input{ch/One}\\end{document}", "ch/One.tex": "one", "build/out.log": "x", "ch/build/kept.tex": "k", "Z.bib": "", "é.tex": "e"})
    put(at, "b", {"main.tex": "b"})
    put(at, "c", CASES["pass"][0])
    put(tmp_path, "outside", {"secret.tex": "s"})
    (at / "empty").mkdir()
    (at / "stray.txt").write_text("not in a project")
    os.symlink(tmp_path / "outside" / "secret.tex", at / "b" / "link.tex")
    os.symlink(tmp_path / "outside", at / "b" / "folder")
    os.symlink(at / "a" / "gone.tex", at / "a" / "broken.tex")
    os.symlink(at / "a" / "ch", at / "a" / "again")
    os.symlink(at / "a" / "ch" / "One.tex", at / "a" / "same.tex")
    S.register(spark)
    return at


def test_reads_a_tree(spark, tree):
    df = spark.read.format("latex_projects").option("exclude", "build").load(f"file://{tree}")
    rows = [tuple(r) for r in df.collect()]
    good = {(d, p): (sha, bytes(c)) for d, p, sha, c, e in rows if e is None}
    want = {(d, p): (tree / d / p).read_bytes() for d, p in [("a", x) for x in ("main.tex", "ch/One.tex", "ch/build/kept.tex", "Z.bib", "é.tex", "same.tex")] + [("b", "main.tex")] + [("c", p) for p in CASES["pass"][0]]}
    assert good == {k: (hashlib.sha256(v).hexdigest(), v) for k, v in want.items()}
    assert {(d, p): e for d, p, _, _, e in rows if e} == {("b", "link.tex"): "a link leads out of the project", ("b", "folder"): "a link leads out of the project", ("a", "broken.tex"): "a link leads nowhere"}
    assert [p for d, p, *_ in rows if d == "a"] == sorted((p for d, p, *_ in rows if d == "a"), key=S.order)


@pytest.mark.parametrize("per_task", [1, 2, 100])
def test_partitions_change_nothing(spark, tree, per_task):
    read = lambda n: spark.read.format("latex_projects").option("projectsPerTask", n).load(str(tree))
    df = read(per_task)
    assert df.rdd.getNumPartitions() == -(-4 // per_task)
    assert sorted(map(str, df.collect())) == sorted(map(str, read(3).collect()))


def test_the_rules_take_it(spark, tree):
    files = spark.read.format("latex_projects").load(f"file://{tree}").where("error IS NULL").drop("error")
    plain = P.read_files(spark, f"file://{tree}")
    key = lambda df: sorted((r["doc_id"], r["text"], r["error"]) for r in P.projects(df.where("doc_id IN ('a', 'c')")).collect())
    assert key(files) == key(plain) and len(key(files)) == 2


def test_large_files_and_wrong_roots(spark, tree, tmp_path):
    rows = spark.read.format("latex_projects").option("maxFileBytes", 3).load(str(tree)).where("doc_id = 'b' OR path = 'Z.bib'").collect()
    assert {(r["doc_id"], r["path"]): r["error"] for r in rows if "link" not in (r["error"] or "")} == {("b", "main.tex"): None, ("a", "Z.bib"): None}
    assert spark.read.format("latex_projects").option("maxFileBytes", 3).load(str(tree)).where("error = 'larger than 3 bytes'").count() > 3
    (tmp_path / "nothing").mkdir()
    assert spark.read.format("latex_projects").load(str(tmp_path / "nothing")).count() == 0
    with pytest.raises(Exception, match="needs a root"):
        spark.read.format("latex_projects").load().count()
