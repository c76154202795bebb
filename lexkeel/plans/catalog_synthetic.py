"""Queries whose inputs are made from the driver's tables by rule: LaTeX sources, PDF spans, sections.

The tables hold no theses, so each document becomes a small source whose properties follow from its id. What the
rules must find is then known, and SQL states it. These are the library's rules on made inputs, not rules about the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import windows as W
from ..schemas import SECTIONS
from ..storage import keep
from . import advisory, report
from . import documents as D
from . import gate as G
from . import rulebook as B
from . import thesis as H
from . import typography as Y
from .catalog import docs, gate_sql, register


def projects(spark, sf_dir) -> DataFrame:
    """Sources by id: a figure (5 kinds), a table (4), a remark (3), a preamble, a nested heading."""
    i = F.col("doc_id")

    def pick(n: int, *choices: str):
        out = F.lit(choices[-1])
        for k, c in reversed(list(enumerate(choices[:-1]))):
            out = F.when(i % n == k, F.lit(c)).otherwise(out)
        return out

    figure = pick(5, r"\begin{figure}\caption{Схема}\label{f}\end{figure} см. \ref{f}", r"\begin{figure}\caption{Схема}\label{f}\end{figure}", r"\begin{figure}\caption{Схема}\end{figure}", "", r"\begin{figure}\caption{Схема}\label{f}\ref{f}\end{figure}")
    table = pick(4, r"\begin{table}\caption{Итоги.}\label{t}\end{table} \ref{t}", r"\begin{table}\caption{Итоги}\label{t}\end{table}", r"\begin{table}\caption{Итоги}\label{t}\end{table} \ref{t}", "")
    remark = pick(3, "на рис. 3 видно", r"\footcite{a}", r"\footnote{Год 2020}")
    nested = F.when(i % 11 == 0, F.lit(r"\subsubsection{Пункт}")).otherwise("")
    body = F.concat_ws("\n", figure, table, remark, nested)
    none = F.array().cast("array<string>")
    return docs(spark, sf_dir).select(
        i.cast("string").alias("doc_id"), F.lit("main.tex").alias("main"), F.lit("").alias("expanded"), F.when(i % 7 == 0, r"\usepackage{geometry}").otherwise("").alias("preamble"), body.alias("body"), body.alias("visible"), body.alias("structural"),
        F.lit("").alias("text"), F.array().cast("array<struct<title:string,level:int,char_start:int>>").alias("headings"), none.alias("read"), none.alias("bib_paths"), F.lit(False).alias("bib_declared"), F.lit(None).cast("string").alias("error"),
    )


@register("latex_rule_statuses", r"""
WITH r AS (
 SELECT doc_id, 'FIG-02' AS rule_id, CASE doc_id % 5 WHEN 0 THEN 'pass' WHEN 3 THEN 'not_applicable' ELSE 'fail' END AS status FROM documents
 UNION ALL SELECT doc_id, 'TAB-03', CASE doc_id % 4 WHEN 1 THEN 'warn' WHEN 3 THEN 'not_applicable' ELSE 'pass' END FROM documents
 UNION ALL SELECT doc_id, 'CAP-01', CASE WHEN doc_id % 4 = 0 THEN 'fail' WHEN doc_id % 4 = 3 AND doc_id % 5 = 3 THEN 'not_applicable' ELSE 'pass' END FROM documents
 UNION ALL SELECT doc_id, 'FIG-03', CASE WHEN doc_id % 3 = 0 THEN 'fail' ELSE 'unverifiable' END FROM documents
 UNION ALL SELECT doc_id, 'BIB-01', CASE doc_id % 3 WHEN 1 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'pass' END FROM documents
 UNION ALL SELECT doc_id, 'STR-02', CASE WHEN doc_id % 11 = 0 THEN 'fail' ELSE 'pass' END FROM documents
 UNION ALL SELECT doc_id, 'SYS-02', CASE WHEN doc_id % 7 = 0 THEN 'fail' ELSE 'pass' END FROM documents
 UNION ALL SELECT doc_id, 'REV-01', 'not_applicable' FROM documents
 UNION ALL SELECT doc_id, 'SYS-01', 'unverifiable' FROM documents)
SELECT doc_id::VARCHAR AS doc_id, rule_id, status FROM r""")
def latex_rule_statuses(spark, sf_dir):
    """Nine rules over a source for every document; one of them owes nothing, one lacks its policy."""
    none = spark.createDataFrame([], SECTIONS)
    settings = B.Settings(only=("FIG-02", "FIG-03", "TAB-03", "CAP-01", "BIB-01", "STR-02", "SYS-01", "SYS-02", "REV-01"))
    found = H.evaluate(spark, H.facts(spark, projects(spark, sf_dir), none), settings)
    return found.select("doc_id", "rule_id", "status")


@register("latex_gate", r"""
SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 5 IN (1, 2, 4) OR doc_id % 4 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0 THEN 'fail' ELSE 'pass' END AS gate_status FROM documents""")
def latex_gate(spark, sf_dir):
    """The gate over four of those rules."""
    none = spark.createDataFrame([], SECTIONS)
    settings = B.Settings(only=("FIG-02", "CAP-01", "STR-02", "SYS-02"))
    return G.gate(H.evaluate(spark, H.facts(spark, projects(spark, sf_dir), none), settings)).select("doc_id", "gate_status")


@register("tri_state_legs", """
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'fail' WHEN (doc_id // 3) % 3 = 1 THEN 'fail' WHEN doc_id % 3 = 2 THEN 'unverifiable' WHEN (doc_id // 3) % 3 = 2 THEN 'unverifiable' ELSE 'pass' END AS strict,
 CASE WHEN doc_id % 3 = 1 THEN 'fail' WHEN (doc_id // 3) % 3 = 1 THEN 'warn' WHEN doc_id % 3 = 2 THEN 'unverifiable' ELSE 'pass' END AS lenient FROM documents""")
def tri_state_legs(spark, sf_dir):
    """True, false and unknown legs, all nine pairs: a proven failure comes before what is unknown."""
    leg = lambda n: F.when(n == 0, True).when(n == 1, False)
    a, b = leg(F.col("doc_id") % 3), leg(F.floor(F.col("doc_id") / 3) % 3)
    return docs(spark, sf_dir).select("doc_id", H.tri(a, b, "x")[0]["status"].alias("strict"), H.tri(a, b, "x", script_warn=True, script_optional=True)[0]["status"].alias("lenient"))


@register("strip_comments", r"SELECT doc_id, sha256(regexp_replace(text, '%[^\n\r]*', '', 'g')) AS digest FROM documents")
def strip_comments(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.strip_comments(F.col("text")), 256).alias("digest"))


@register("normalize_plain", r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[\t\f\x0B ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))) AS digest FROM pages")
def normalize_plain(spark, sf_dir):
    from ..sources.corpus import table

    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.normalize_plain(F.col("html")), 256).alias("digest"))


# ---- PDF spans ----


def spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each line of a document as a span: 30 lines a page, width and font by id."""
    lines = W.lines(docs(spark, sf_dir), "doc_id").withColumn("page", (F.floor(F.col("line_no") / 30) + 1).cast("int"))
    y, i = 60.0 + 21.0 * (F.col("line_no") % 30), F.col("doc_id")
    x1 = 90.0 + F.least(F.length("line") * 2.0, 400.0 + (i % 5) * 40.0)
    font = F.when(i % 3 == 0, "ABCDEF+TimesNewRomanPSMT").when(i % 3 == 1, "Times-Roman").otherwise("Arial")
    box = F.struct(F.lit(90.0).alias("x0"), y.alias("y0"), x1.alias("x1"), (y + 14.0).alias("y1"))
    s = lines.select(i.cast("string").alias("doc_id"), F.col("line_no").cast("int").alias("span_idx"), F.col("line").alias("text"), "page", F.col("char_start"), (F.col("char_start") + F.length("line")).alias("char_end"), font.alias("font"), F.when(i % 4 == 0, 12.0).otherwise(14.0).alias("font_size"), F.lit(0).alias("flags"), box.alias("bbox"))
    s = keep(s, "spans")  # read many times by what follows
    p = s.select("doc_id", F.col("page").alias("number")).distinct().select("doc_id", "number", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.lit(0).alias("rotation"))
    return s, p


SPAN_SQL = r"""l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line, (i - 1) // 30 + 1 AS page FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)),
s AS (SELECT *, greatest(0.0, 90.0 + least(length(line) * 2.0, 400.0 + (doc_id % 5) * 40.0) - (595 - 8 * 72 / 25.4)) AS delta, length(regexp_replace(line, '[\s\p{Z}\p{C}]', '', 'g')) AS chars FROM l)"""


@register("margin_check", f"WITH {SPAN_SQL} SELECT doc_id::VARCHAR AS doc_id, CASE WHEN count(*) FILTER (chars >= 2 AND delta > 0.5 + 1e-9) > 0 THEN FALSE WHEN count(*) FILTER (chars >= 2) > 0 THEN TRUE END AS margins_ok, arg_min(page, line_no) FILTER (chars >= 2 AND delta > 0.5 + 1e-9)::INT AS margin_page FROM s GROUP BY doc_id")
def margin_check(spark, sf_dir):
    s, p = spans(spark, sf_dir)
    return Y.margin_facts(s, p, None, 0.5)


@register("margin_overflow", f"WITH {SPAN_SQL} SELECT doc_id::VARCHAR AS doc_id, round(max(delta), 6) AS overflow FROM s GROUP BY doc_id")
def margin_overflow(spark, sf_dir):
    s, p = spans(spark, sf_dir)
    return s.join(p.withColumnRenamed("number", "page"), ["doc_id", "page"]).groupBy("doc_id").agg(F.round(F.max(Y.overflow(F.col("bbox"))), 6).alias("overflow"))


@register("compatible_fonts", "SELECT doc_id::VARCHAR AS doc_id, doc_id % 3 <> 2 AS compatible, CASE doc_id % 3 WHEN 0 THEN 'timesnewromanpsmt' WHEN 1 THEN 'timesroman' ELSE 'arial' END AS font FROM documents")
def compatible_fonts(spark, sf_dir):
    s, _ = spans(spark, sf_dir)
    return s.groupBy("doc_id").agg(F.bool_and(Y.compatible(F.col("font"))).alias("compatible"), F.min(Y.font_key(F.col("font"))).alias("font"))


@register("line_spacing_ratio", f"WITH {SPAN_SQL}, b AS (SELECT doc_id, page, count(DISTINCT line_no % 30) AS n, min(CASE WHEN doc_id % 4 = 0 THEN 12.0 ELSE 14.0 END) AS size FROM s WHERE chars >= 2 GROUP BY ALL), g AS (SELECT doc_id, page, 21 * (line_no % 30 - lag(line_no % 30) OVER (PARTITION BY doc_id, page ORDER BY line_no)) AS gap FROM s WHERE chars >= 2), m AS (SELECT doc_id, page, median(gap) AS gap FROM g WHERE gap > 0 GROUP BY ALL) SELECT m.doc_id::VARCHAR AS doc_id, median(m.gap / b.size) BETWEEN 1.35 AND 1.65 AS spacing_ok FROM m JOIN b USING (doc_id, page) GROUP BY m.doc_id")
def line_spacing_ratio(spark, sf_dir):
    s, _ = spans(spark, sf_dir)
    return Y.spacing_facts(s)


@register("span_kinds")
def span_kinds(spark, sf_dir):
    """What every span counts as; the rules are sequential on a page, so this is tested on fixtures."""
    s, p = spans(spark, sf_dir)
    return Y.classify(s, p).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


@register("typography_facts")
def typography_facts(spark, sf_dir):
    s, p = spans(spark, sf_dir)
    return Y.facts(s, p)


# ---- reports and advisory plans ----


@register("published_findings", f"""WITH {D.FINDINGS_SQL} SELECT doc_id, rule_id, status, CASE status WHEN 'fail' THEN 'Fix the violation and run the formal gate again.' WHEN 'unverifiable' THEN 'Provide the sources that the rule needs.' WHEN 'warn' THEN 'Look at the remark before the final check.' ELSE 'For information; nothing is blocked.' END AS recommendation
FROM f WHERE status NOT IN ('pass', 'skipped', 'not_applicable')""")
def published_findings(spark, sf_dir):
    return report.published(D.findings(docs(spark, sf_dir))).select("doc_id", "rule_id", "status", "recommendation")


@register("console_summary", f"""WITH {D.FINDINGS_SQL}, g AS (SELECT doc_id, count(*) FILTER (layer IN ('class', 'script', 'class+script') AND severity = 'error' AND status = 'fail') AS e,
 count(*) FILTER (layer NOT IN ('llm', 'vision') AND NOT (layer IN ('class', 'script', 'class+script') AND severity = 'error' AND status = 'fail') AND (status = 'warn' OR severity = 'warn')) AS w, count(*) FILTER (status = 'unverifiable') AS u,
 count(*) FILTER (layer IN ('class', 'script', 'class+script') AND severity = 'error' AND status IN ('fail', 'unverifiable')) > 0 AS bad FROM f GROUP BY doc_id)
SELECT doc_id, 'gate ' || CASE WHEN bad THEN 'fail exit 2' ELSE 'pass exit 0' END || ' errors ' || e || ' warnings ' || w || ' unverifiable ' || u AS summary FROM g""")
def console_summary(spark, sf_dir):
    return report.summary(report.reports(G.order(D.findings(docs(spark, sf_dir)), B.rulebook(spark))))


REPORT_SQL = f"""
WITH {D.FINDINGS_SQL},
s AS (SELECT *, 'sha256:' || sha256('{{"evidence":[],"layer":"' || layer || '","message":"' || message || '","rule_id":"' || rule_id || '","severity":"' || severity || '","status":"' || status || '"}}') AS fp,
  CASE status WHEN 'fail' THEN 'Fix the violation and run the formal gate again.' WHEN 'unverifiable' THEN 'Provide the sources that the rule needs.' ELSE 'Look at the remark before the final check.' END AS advice FROM f),
l AS (SELECT doc_id, string_agg('{{"rule_id":"' || rule_id || '","layer":"' || layer || '","severity":"' || severity || '","status":"' || status || '","message":"' || message || '","fingerprint":"' || fp || '","recommendation":"' || advice || '"}}', ',' ORDER BY fp) AS items
  FROM s WHERE status NOT IN ('pass', 'skipped', 'not_applicable') GROUP BY doc_id)
SELECT g.doc_id, '{{"schema_version":"1.2","header":{{"gate_status":"' || gate_status || '","gate_mode":"strict","degraded":' || (blocking_unverifiable > 0) || ',"approvals_required":' || (approvals_required > 0) || ',"generated_at":"2025-01-01T00:00:00Z"}},"exit_code":' || exit_code
  || ',"counts":{{"formal_errors":' || formal_errors || ',"warnings":' || warnings || ',"llm_advisory":' || llm_advisory || ',"unverifiable":' || unverifiable || ',"blocking_unverifiable":' || blocking_unverifiable || ',"approvals_required":' || approvals_required || '}},"findings":[' || coalesce(items, '') || ']}}' AS json
FROM ({gate_sql("strict")}) g LEFT JOIN l ON l.doc_id = g.doc_id"""


@register("report_json", REPORT_SQL)
def report_json(spark, sf_dir):
    """Published reports as JSON; a fixed stamp keeps them equal from run to run."""
    stamp = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return report.as_json(report.reports(G.order(D.findings(docs(spark, sf_dir)), B.rulebook(spark)), stamp=stamp))


TITLES = ["введение", "постановка задачи", "анализ результатов"]


def sections(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Three sections a document; its lines are dealt to them in turn as chunks."""
    titles = F.array(*map(F.lit, TITLES))
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(titles).alias("n", "norm"))
    secs = d.select("doc_id", F.concat(F.lit("s"), F.col("n").cast("string")).alias("section_id"), "norm", F.when(F.col("n") == 0, "introduction").otherwise("other").alias("kind"), F.lit(2).alias("level"), F.col("n").alias("char_start"))
    lines = W.lines(docs(spark, sf_dir), "doc_id")
    sid = F.concat(F.lit("s"), (F.col("line_no") % 3).cast("string"))
    return secs, lines.select("doc_id", sid.alias("section_id"), F.concat_ws(":", sid, F.col("line_no").cast("string")).alias("chunk_id"), F.col("line").alias("text"), "char_start")


@register("advisory_plan", r"""
WITH l AS (SELECT doc_id, (i - 1) % 3 AS sec, count(*) AS n, count(*) FILTER (trim(ls[i]) <> '') AS filled FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(i) GROUP BY ALL),
c AS (SELECT doc_id, coalesce(max(n) FILTER (sec = 0 AND filled > 0), 0) AS a, coalesce(max(n) FILTER (sec = 1 AND filled > 0), 0) AS b, coalesce(max(n) FILTER (sec = 2 AND filled > 0), 0) AS r FROM l GROUP BY doc_id)
SELECT doc_id, 'INT-01' AS rule_id, least(a, 2)::INT AS shown, CASE WHEN a > 0 THEN 'ready' ELSE 'section_missing' END AS state FROM c
UNION ALL SELECT doc_id, 'TSK-03', least(b, 2) + least(r, 2), CASE WHEN b + r > 0 THEN 'ready' ELSE 'section_missing' END FROM c
UNION ALL SELECT doc_id, 'RES-01', least(b, 3) + least(r, 3), CASE WHEN b > 0 AND r > 0 THEN 'ready' ELSE 'section_missing' END FROM c
UNION ALL SELECT doc_id, 'REV-05', 0, 'section_missing' FROM c""")
def advisory_plan(spark, sf_dir):
    """How many chunks four rules are shown, heads and tails of the sections of their roles."""
    planned = advisory.plan(spark, *sections(spark, sf_dir)).where(F.col("rule_id").isin("INT-01", "TSK-03", "RES-01", "REV-05"))
    return planned.select("doc_id", "rule_id", F.greatest(F.coalesce(F.size("chunks"), F.lit(0)), F.lit(0)).alias("shown"), "state")


@register("advisory_disabled", "SELECT doc_id, 25::BIGINT AS n, 0::BIGINT AS assessed FROM documents")
def advisory_disabled(spark, sf_dir):
    """Without a provider no advisory rule passes or warns."""
    planned = advisory.plan(spark, *sections(spark, sf_dir))
    digests = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest"))
    rows = advisory.conclude(planned, advisory.disabled(planned), digests)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("pass", "warn", "info", "fail")).alias("assessed"))


@register("quote_spans", r"""
SELECT doc_id, len(list_filter(string_split_regex(text, '\n'), lambda l: trim(l) <> ''))::INT AS lines, sha256(array_to_string(regexp_extract_all(text, '\S+'), ' ')) AS words FROM documents""")
def quote_spans(spark, sf_dir):
    """Fragments hold every word once and in order; there are at least as many as filled lines."""
    filled = F.size(F.filter(F.split("text", "\n", -1), lambda s: F.trim(s) != ""))
    cut = docs(spark, sf_dir).select("doc_id", W.quote_spans(F.col("text")).alias("spans"), filled.alias("filled"))
    words = F.trim(F.regexp_replace(F.array_join("spans", " "), r"\s+", " "))
    return cut.select("doc_id", F.when(F.size("spans") >= F.col("filled"), F.col("filled")).alias("lines"), F.sha2(words, 256).alias("words"))
