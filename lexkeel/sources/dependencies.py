"""Files that a project's reachable sources refer to but that it does not have.

References are extracted by expressions, resolved against the folder of the source and the project's root, and
anti-joined with the listing. What a main source reaches is followed project by project, over paths only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_comments, utf8
from ..storage import keep

#: Classes that need no file, image suffixes that may be left out, and the order of kinds.
STANDARD = ["article", "beamer", "book", "extarticle", "extbook", "extreport", "letter", "memoir", "minimal", "proc", "report", "scrartcl", "scrbook", "scrreprt", "slides", "standalone"]
SUFFIXES = {"include": [".tex"], "class": [".cls"], "style": [".sty"], "bibliography": [".bib"], "image": [".pdf", ".png", ".jpg", ".jpeg", ".eps", ".svg"]}
KINDS = list(SUFFIXES)
OPTIONS = r"\s*(?:\[[^\]]*\]\s*)?"
LITERALS = r"(?s)\\begin\{(verbatim\*?|Verbatim|lstlisting|minted)\}.*?(?:\\end\{\1\}|\z)"


def references(sources: DataFrame) -> DataFrame:
    """``doc_id``, ``path`` (of the source), ``kind``, ``ref``: literal references, dynamic ones left out."""
    tex = F.regexp_replace(strip_comments(F.col("text")), LITERALS, " ")
    all_of = lambda p, g=1: F.regexp_extract_all(tex, F.lit(p), F.lit(g))
    split = lambda a: F.flatten(F.transform(a, lambda x: F.split(x, ",")))
    found = {
        "include": F.concat(all_of(r"\\(?:input|include)(?![\p{L}@])\s*\{([^{}]+)\}"), all_of(r"\\(?:input|include)(?![\p{L}@])[ \t]+([^\s{}%\\]+)")),
        "class": all_of(rf"(?i)\\documentclass{OPTIONS}\{{([^{{}}]+)\}}"), "style": split(all_of(rf"(?i)\\usepackage{OPTIONS}\{{([^{{}}]+)\}}")),
        "bibliography": F.concat(all_of(rf"(?i)\\addbibresource{OPTIONS}\{{([^{{}}]+)\}}"), split(all_of(rf"(?i)\\bibliography{OPTIONS}\{{([^{{}}]+)\}}"))), "image": all_of(rf"(?i)\\includegraphics\*?{OPTIONS}\{{([^{{}}]+)\}}"),
    }
    rows = F.flatten(F.array(*[_tag(v, k) for k, v in found.items()]))
    out = sources.select("doc_id", "path", F.explode(rows).alias("r")).select("doc_id", "path", "r.kind", F.trim("r.ref").alias("ref"))
    named = (F.col("ref") != "") & ~F.col("ref").rlike(r"[\\#{}]") & ~F.col("ref").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")
    needed = ((F.col("kind") != "class") | ~F.lower("ref").isin(*STANDARD)) & ((F.col("kind") != "style") | F.col("ref").rlike(r"[/.]"))
    return out.where(named & needed).distinct()


def _tag(refs: Column, kind: str) -> Column:
    return F.transform(refs, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))


def resolved(refs: DataFrame) -> DataFrame:
    """Adds ``target`` candidates in order of preference: beside the source, then from the root, each suffix in turn."""
    suffixes = F.create_map(*[x for k, v in SUFFIXES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    has = F.col("ref").rlike(r"\.[^./]+$")
    names = F.when(has, F.array("ref")).otherwise(F.transform(F.element_at(suffixes, F.col("kind")), lambda s: F.concat(F.col("ref"), s)))
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    every = F.concat(F.transform(names, lambda n: F.concat(folder, n)), names)
    clean = F.array_distinct(F.transform(every, lambda p: F.regexp_replace(p, r"(^|/)(?:\./)+", "$1")))
    return refs.select("*", F.posexplode(clean).alias("order", "target"))


def _reached(edges: pa.Table) -> pa.Table:
    """Sources that one project's main source includes, itself among them, at any depth; a cycle adds nothing."""
    doc, main = edges.column("doc_id")[0], edges.column("main")[0].as_py()
    into: dict[str, list[str]] = {}
    for path, target in zip(edges.column("path").to_pylist(), edges.column("target").to_pylist(), strict=True):
        into.setdefault(path, []).append(target)
    seen, front = {main}, [main]
    while front:
        front = [t for p in front for t in into.get(p, ()) if t not in seen]
        seen.update(front)
    return pa.table({"doc_id": [doc.as_py()] * len(seen), "path": sorted(seen)})


def missing(files: DataFrame, mains: DataFrame) -> DataFrame:
    """``doc_id``, ``kind``, ``ref``, ``place``: what is missing, once each, by kind and name. ``mains``: ``doc_id``, ``main``."""
    sources = files.where(F.col("path").rlike(r"(?i)\.tex$")).select("doc_id", "path", utf8(F.col("content")).alias("text")).where("text IS NOT NULL")
    refs = references(sources)
    have = files.select("doc_id", F.col("path").alias("target"))
    hits = resolved(refs).join(have, ["doc_id", "target"])
    best = Window.partitionBy("doc_id", "path", "kind", "ref").orderBy("order")
    hits = hits.withColumn("n", F.row_number().over(best)).where("n = 1").select("doc_id", "path", "kind", "ref", "target")
    hits = keep(hits, "references")
    edges = hits.where("kind = 'include'").select("doc_id", "path", "target").join(mains.select("doc_id", "main"), "doc_id", "right")
    reached = edges.groupBy("doc_id").applyInArrow(_reached, "doc_id string, path string")
    open_ = refs.join(reached, ["doc_id", "path"], "left_semi").join(hits, ["doc_id", "path", "kind", "ref"], "left_anti")
    shown = F.when(F.col("ref").rlike(r"\.[^./]+$") | (F.col("kind") == "image"), F.col("ref")).otherwise(F.concat("ref", F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k, SUFFIXES[k][0])]), F.col("kind"))))
    out = open_.select("doc_id", "kind", shown.alias("ref")).distinct()
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, F.lower("ref"), "ref")))
