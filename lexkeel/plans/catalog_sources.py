"""Queries of sources and stages: where words come from, what hostile files do, and what a second run computes.

Sources are made from the driver's documents by rule, whole texts included; the SQL states places and verdicts from the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from ..functions import redaction as R
from ..functions.identity import locator, source_hash
from ..sources import origins, policy
from ..sources import pdf_bundle as B
from ..sources import projects as P
from ..sources.corpus import table
from ..stages import StageStore
from ..storage import folder, keep
from ..streaming.ingest import content_key
from . import advisory
from . import documents as D
from . import thesis as H
from .catalog import docs, register

ACCENT = "\u0301"
#: Pieces of the two files of a project, around the id and the text of its document.
MAIN = ("\\documentclass{x}\n\\begin{document}\n% ", "\n\\section{Erster~Teil}\n", "\n\\input{part}\n\\section{Letzter \\emph{Teil}}\nEnde\n\\end{document}")
PART = (f"\\section{{Re{ACCENT}sume{ACCENT}}}\n", f"\nDas Zitat e{ACCENT}tude ", " steht hier.\n")


def made_files(d: DataFrame, *texts: tuple[str, F.Column]) -> DataFrame:
    """Files of projects as ``projects.read_files`` gives them: a path and a text (null: no such file) for each document."""
    made = F.array_compact(F.array(*[F.when(t.isNotNull(), F.struct(F.lit(p).alias("path"), t.cast("binary").alias("content"))) for p, t in texts]))
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(made).alias("f")).select("doc_id", "f.path", F.sha2("f.content", 256).alias("sha256"), "f.content")


@register("source_origins", rf"""
WITH t AS (SELECT doc_id::VARCHAR AS doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ,.\n]', ' ', 'g') AS s FROM documents),
f AS (SELECT doc_id, s, '{MAIN[0]}' || doc_id || '{MAIN[1]}' || s || '{MAIN[2]}' AS m, '{PART[0]}' || s || '{PART[1]}' || doc_id || '{PART[2]}' AS p, length('{MAIN[0]}' || doc_id || '{MAIN[1]}') AS a, length(s) AS n FROM t),
w AS (SELECT doc_id, 'Erster Teil' AS words, 'main.tex' AS path, m AS file, a - 13 AS lo, 11 AS n FROM f
 UNION ALL SELECT doc_id, 'Résumé', 'part.tex', p, 9, 8 FROM f
 UNION ALL SELECT doc_id, 'Letzter Teil', 'main.tex', m, a + n + 23, 18 FROM f
 UNION ALL SELECT doc_id, 'étude ' || doc_id || ' steht', 'part.tex', p, n + 30, 13 + length(doc_id) FROM f)
SELECT doc_id, words, path, lo::INT AS char_start, (lo + n)::INT AS char_end, octet_length(encode(substr(file, 1, lo)))::BIGINT AS byte_start, octet_length(encode(substr(file, 1, lo + n)))::BIGINT AS byte_end, substr(file, lo + 1, n) AS quote FROM w""")
def source_origins(spark, sf_dir):
    """Headings, and a quote given in composed letters, traced to characters and bytes of included files with comments, macros and decomposed letters."""
    # Both files and what tells whether they exist hold the text, which is made safe once.
    d = docs(spark, sf_dir).withColumn("safe", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9 ,.\n]", " "))
    safe, name = F.col("safe"), F.col("doc_id").cast("string")
    # Projects and origins read the same files; made for each of them, they took longer than the projects.
    files = keep(made_files(d, ("main.tex", F.concat(F.lit(MAIN[0]), name, F.lit(MAIN[1]), safe, F.lit(MAIN[2]))), ("part.tex", F.concat(F.lit(PART[0]), safe, F.lit(PART[1]), name, F.lit(PART[2])))), "files")
    projects = keep(P.projects(files, ["doc_id", "text", "headings", "read", "source_map"]), "projects")
    digest = source_hash(F.col("text"))
    heads = projects.select("doc_id", digest.alias("digest"), F.explode("headings").alias("h"))
    heads = heads.select("doc_id", F.col("h.title").alias("words"), locator(F.col("digest"), F.col("h.char_start"), F.col("h.char_start") + F.length("h.title")).alias("locator"))
    shown = projects.select("doc_id", F.lit("Q").alias("rule_id"), F.lit("whole").alias("chunk_id"), "text", F.lit(0).alias("char_start"), digest.alias("digest"))
    quotes = d.select(name.alias("doc_id"), F.lit("Q").alias("rule_id"), F.lit(0).alias("pos"), F.lit("whole").alias("chunk_id"), F.concat(F.lit("étude "), name, F.lit(" steht")).alias("quote"))
    found = keep(heads.unionByName(advisory.verify(quotes, shown).select("doc_id", F.col("quote").alias("words"), "locator")), "locators")
    return origins.resolve(found, projects, files).join(found, ["doc_id", "locator"]).select("doc_id", "words", "path", "char_start", "char_end", "byte_start", "byte_end", "quote")


#: Parts of a hostile text, and every how many documents each kind comes.
PARTS, EVERY = 20_000, 500


@register("hostile_inputs", f"""
WITH d AS (SELECT doc_id, doc_id % {EVERY} AS h FROM documents),
r AS (SELECT doc_id, 'SYS-02' AS rule_id, CASE WHEN h = 5 THEN 'unverifiable' WHEN doc_id % 7 = 0 THEN 'fail' WHEN h IN (4, 7) THEN 'unverifiable' ELSE 'pass' END AS status FROM d
 UNION ALL SELECT doc_id, 'INT-02', CASE WHEN h = 5 THEN 'unverifiable' WHEN doc_id % 3 = 0 THEN 'fail' ELSE 'pass' END FROM d
 UNION ALL SELECT doc_id, 'FIG-02', CASE WHEN h = 5 THEN 'unverifiable' WHEN doc_id % 5 = 0 THEN 'fail' ELSE 'not_applicable' END FROM d
 UNION ALL SELECT doc_id, 'BIB-02', CASE WHEN h = 1 THEN 'fail' ELSE 'unverifiable' END FROM d)
SELECT doc_id::VARCHAR AS doc_id, rule_id, status FROM r""")
def hostile_inputs(spark, sf_dir):
    """Rules over projects of which some hold what overflows, misleads or can't be read: those get their own verdicts, the others theirs."""
    d, i = docs(spark, sf_dir).select("doc_id"), F.col("doc_id")
    many = lambda s: F.repeat(F.lit(s), PARTS)
    kinds = [many("/a"), F.concat(F.lit("\\begin{verbatim}["), many("1, "), F.lit("2]\\end{verbatim}")), F.concat(many("слово-"), F.lit("слово")), F.lit("\x005\x00 \x00"), F.lit("x"), F.lit("x"), F.concat(many("{"), many("[x]"), F.lit("\\cite"), many("[y]")), F.lit("x")]
    hostile = F.lit("")
    for k, text in enumerate(kinds):
        hostile = F.when(i % EVERY == k, text).otherwise(hostile)
    when = lambda n, text, other="": F.when(i % n == 0, F.lit(text)).otherwise(F.lit(other))
    head = F.concat(F.lit("\\documentclass{x}"), when(7, "\\usepackage{geometry}"), F.when(i % EVERY == 4, F.repeat(F.lit("ab"), PARTS)).otherwise(""), F.lit("\n\\begin{document}\n\\section{Введение}\n"))
    body = F.concat(when(3, "\\begin{itemize}\\item a\\end{itemize}", "текст"), F.lit("\n"), when(5, "\\begin{figure}\\caption{A}\\end{figure}"), F.lit("\n"), hostile, F.lit("\n\\end{document}"))
    main = F.concat(head, body)
    raw = F.when(i % EVERY == 5, F.concat(main.cast("binary"), F.lit(b"\xff\xfe"))).otherwise(main.cast("binary"))
    rules = F.when(i % EVERY == 4, "forbidden_preamble:\n- pattern: '(a|b)*c'\n  message: choice\n").when(i % EVERY == 7, "forbidden_preamble:\n- pattern: '(a+)+$'\n  message: nested\n")
    files = made_files(d, ("main.tex", raw), ("refs.bib", F.lit("@book{a, title={B}}")), (policy.POLICY, rules))
    projects = keep(P.projects(files), "projects")
    protected, forbidden = policy.policies(files)
    facts = H.facts(spark, projects, P.sections(spark, projects), files, P.bib_entries(files, projects), protected, forbidden)
    return H.evaluate(spark, facts, H.B.Settings(only=("SYS-02", "INT-02", "FIG-02", "BIB-02"))).select("doc_id", "rule_id", "status")


@register("incremental_findings", rf"""
WITH old AS (SELECT text, lang, source, n_chars FROM documents WHERE doc_id % 100 NOT IN (7, 50) UNION SELECT 'Old: ' || text, lang, source, n_chars FROM documents WHERE doc_id % 100 = 50),
{D.FINDINGS_SQL}
SELECT f.doc_id, f.rule_id, f.status, f.message, NOT EXISTS (SELECT 1 FROM old o WHERE o.text IS NOT DISTINCT FROM d.text AND o.lang IS NOT DISTINCT FROM d.lang AND o.source IS NOT DISTINCT FROM d.source AND o.n_chars IS NOT DISTINCT FROM d.n_chars) AS computed
FROM f JOIN documents d USING (doc_id) WHERE f.status <> 'pass'""")
def incremental_findings(spark, sf_dir):
    """Findings after a second run: of the first run's documents one in a hundred has another text now, one in a hundred is new, some are gone. ``computed``: not known from the first run."""
    now = docs(spark, sf_dir)
    i = F.col("doc_id")
    before = now.where(i % 100 != 7).withColumn("text", F.when(i % 100 == 50, F.concat(F.lit("Old: "), F.col("text"))).otherwise(F.col("text")))
    gone = now.where(i % 100 == 3).withColumn("doc_id", -1 - i)
    store = StageStore(spark, folder(spark, "stage-findings"))
    rules = lambda df: D.findings(df).where("status <> 'pass'")
    store.update(content_key(before.unionByName(gone), "documents"), rules, complete=True)
    second = store.update(content_key(now, "documents"), rules, complete=True)
    return store.current().select("doc_id", "rule_id", "status", "message", (F.col("computed_in") == second.version).alias("computed"))


# ---- pages of printed documents ----

PIECE, LINES, CHAPTER = 80, 20, 35


def printed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Spans and pages of every document as a PDF: its whole text in pieces, a running header a page, a heading every so many pieces."""
    d = docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    # All pieces by one pass over a text; a piece by its number would be counted from the start each time.
    pieces = F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    rows = d.select("doc_id", F.posexplode(pieces).alias("k", "piece"))
    item = lambda kind, text, size, y: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(size).cast("double").alias("font_size"), y.cast("double").alias("y"))
    at = F.col("k") % LINES * 30
    made = F.array(
        F.when(F.col("k") % LINES == 0, item(0, F.lit("Kopfzeile"), 20.0, F.lit(20.0))), F.when(F.col("k") % CHAPTER == 0, item(1, F.concat(F.lit("Kapitel "), (F.floor(F.col("k") / CHAPTER) + 1).cast("string")), 18.0, at + 100)),
        item(2, F.col("piece"), 10.0, at + 110),
    )
    spans = rows.select("doc_id", (F.floor(F.col("k") / LINES) + 1).cast("int").alias("page"), (F.col("k") * 3).alias("k3"), F.explode(F.array_compact(made)).alias("i"))
    place = F.col("k3") + F.col("i.kind")
    box = F.struct(F.lit(50.0).alias("x0"), F.col("i.y").alias("y0"), F.lit(500.0).alias("x1"), (F.col("i.y") + 8).alias("y1"))
    spans = spans.select("doc_id", "page", place.alias("place"), place.alias("block"), F.lit(0).alias("line"), "i.text", F.lit("Times").alias("font"), "i.font_size", F.lit(0).alias("flags"), box.alias("bbox"))
    count = F.greatest(F.ceil(F.length("t") / (PIECE * LINES)), F.lit(1)).cast("int")
    pages = d.select("doc_id", count.alias("count")).select("doc_id", F.explode(F.sequence(F.lit(1), "count")).alias("number"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit(0).alias("rotation"))
    return spans, pages


@register("pdf_sections", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, greatest(ceil(length(coalesce(text, '')) / {PIECE}.0), 1)::INT AS n FROM documents),
k AS (SELECT doc_id, t, unnest(range(n)) AS k FROM d),
i AS (SELECT doc_id, 3 * k AS place, k // {LINES} + 1 AS page, 'Kopfzeile' AS text, 20.0 AS size, 20.0 / 800 AS y FROM k WHERE k % {LINES} = 0
 UNION ALL SELECT doc_id, 3 * k + 1, k // {LINES} + 1, 'Kapitel ' || (k // {CHAPTER} + 1), 18.0, (k % {LINES} * 30 + 100) / 800.0 FROM k WHERE k % {CHAPTER} = 0
 UNION ALL SELECT doc_id, 3 * k + 2, k // {LINES} + 1, substr(t, {PIECE} * k + 1, {PIECE}), 10.0, (k % {LINES} * 30 + 110) / 800.0 FROM k),
o AS (SELECT *, (coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS lo FROM i WHERE text <> ''),
c AS (SELECT *, regexp_replace(text, '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g') AS title FROM o),
m AS (SELECT doc_id, median(size) AS body FROM c WHERE length(title) >= 2 GROUP BY doc_id),
pages AS (SELECT doc_id, max(page) AS last, max(lo + length(text)) AS total FROM o GROUP BY doc_id),
h AS (SELECT c.doc_id, title, lo, c.page FROM c JOIN m USING (doc_id) JOIN pages USING (doc_id) WHERE length(title) >= 2 AND size > 10 AND size >= body * 1.18 AND NOT (title = 'Kopfzeile' AND pages.last >= 2)),
s AS (SELECT doc_id, replace(lower(title), ' ', '-') AS section_id, title, lo, coalesce(lead(lo) OVER (PARTITION BY doc_id ORDER BY lo), total) AS hi FROM h JOIN pages USING (doc_id)
 UNION ALL SELECT doc_id, 'document-preamble', 'Преамбула', 0, min(lo) FROM h GROUP BY doc_id HAVING min(lo) > 0
 UNION ALL SELECT doc_id, 'document', 'Документ', 0, total FROM pages WHERE doc_id NOT IN (SELECT doc_id FROM h))
SELECT s.doc_id, section_id, s.title, s.lo::INT AS char_start, s.hi::INT AS char_end, min(o.page)::INT AS page_start, max(o.page)::INT AS page_end
FROM s JOIN o ON o.doc_id = s.doc_id AND o.lo + length(o.text) > s.lo AND o.lo < s.hi GROUP BY ALL""")
def pdf_sections(spark, sf_dir):
    """Headings by font, running headers left out, and the pages of the sections that they open."""
    spans, pages = printed(spark, sf_dir)
    spans = keep(B.with_offsets(spans), "spans")
    found = B.sections(spark, keep(B.documents(spans, pages), "pdf-documents"), spans, pages)
    return found.select("doc_id", "section_id", "title", "char_start", "char_end", "page_start", "page_end")


@register("printed_rules", """
WITH r AS (SELECT doc_id, 'STR-03' AS rule_id, CASE WHEN doc_id % 3 = 0 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN doc_id % 3 = 0 THEN doc_id % 4 + 3 END AS page FROM documents
 UNION ALL SELECT doc_id, 'STR-04', CASE WHEN doc_id % 4 IN (1, 2) THEN 'pass' ELSE 'warn' END, CASE WHEN doc_id % 4 IN (0, 3) THEN 2 END FROM documents)
SELECT doc_id::VARCHAR AS doc_id, rule_id, status, page::INT AS page FROM r""")
def printed_rules(spark, sf_dir):
    """STR-03 and STR-04 from spans to verdicts: a source for every document and its PDF, in which an introduction of 1 to 4 pages, a detail of 0 to 2 page turns and an end follow a contents page."""
    d, i = docs(spark, sf_dir).select("doc_id"), F.col("doc_id")
    files = made_files(d, ("main.tex", F.lit("\\begin{document}\n\\section{Введение}\nтекст\n\\subsection{Деталь}\nтекст\n\\section{Заключение}\nтекст\n\\end{document}")))
    n, turns = (i % 4 + 1).cast("int"), (i % 3).cast("int")
    pages = d.select(i.cast("string").alias("doc_id"), F.explode(F.sequence(F.lit(1), n + turns + 3)).alias("number"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit(0).alias("rotation"), n.alias("n"), turns.alias("turns"))
    at = F.col("number")
    title = F.when(at == 1, "Содержание").when(at == 2, "Введение").when(at == F.col("n") + 2, "Деталь").when(at == F.col("n") + F.col("turns") + 3, "Заключение")
    item = lambda text, size, y: F.struct(text.alias("text"), F.lit(size).alias("font_size"), F.lit(y).alias("y"))
    body = [item(F.when(at == 1, f"Введение {k}").otherwise("текст страницы"), 12.0, 200.0 + 30 * k) for k in range(6)]
    rows = pages.select("doc_id", at.alias("page"), F.posexplode(F.array_compact(F.array(F.when(title.isNotNull(), item(title, 18.0, 130.0)), *body))).alias("k", "i"))
    place, box = at * 100 + F.col("k"), F.struct(F.lit(50.0).alias("x0"), F.col("i.y").alias("y0"), F.lit(500.0).alias("x1"), (F.col("i.y") + 8).alias("y1"))
    spans = rows.withColumnRenamed("page", "number").select("doc_id", at.alias("page"), place.alias("place"), place.alias("block"), F.lit(0).alias("line"), "i.text", F.lit("Times").alias("font"), "i.font_size", F.lit(0).alias("flags"), box.alias("bbox"))
    spans = keep(B.with_offsets(spans), "spans")
    pages = pages.drop("n", "turns")
    projects = keep(P.projects(files), "projects")
    there = B.sections(spark, keep(B.documents(spans, pages), "pdf-documents"), spans, pages)
    facts = H.facts(spark, projects, B.with_pages(P.sections(spark, projects), there), files, pages=pages)
    return H.evaluate(spark, facts, H.B.Settings(only=("STR-03", "STR-04"))).select("doc_id", "rule_id", "status", "page")


@register("redact_events", """
SELECT event_id, '{"deep":{"Password":"[REDACTED]","note":"' || event_type || ' [REDACTED]"},"items":[{"message":"' || rtrim(substr(repeat(event_type || ' ', 60), 1, 240)) || '… [TRUNCATED]","n":' || (event_id % 7) || '}]'
  || coalesce(',"k":' || regexp_extract(props, '"k": ?([0-9]+)', 1), '') || '}' AS props FROM events""")
def redact_events(spark, sf_dir):
    """Each event's own properties and others with secrets inside, as JSON that no schema declares, redacted by key."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    more = F.concat(
        F.lit('{"items": [{"n": '), (F.col("event_id") % 7).cast("string"), F.lit(', "message": "'), F.repeat(F.concat("event_type", F.lit(" ")), F.lit(60)), F.lit('"}], "deep": {"note": "'), F.col("event_type"), F.lit(" a"), F.col("event_id").cast("string"),
        F.lit('@b.example", "Password": "p'), F.col("event_id").cast("string"), F.lit('"}'), F.coalesce(F.concat(F.lit(", "), F.expr("substring(props, 2)")), F.lit("}")),
    )
    return R.redact_json(e.select("event_id", more.alias("props")), "props")


@register("bundle_digests", """
WITH f AS (SELECT lang || '/' || source AS bundle, sha256(coalesce(text, '')) AS sha, 'Dir/' || CASE WHEN doc_id % 3 = 0 THEN 'E' || chr(769) WHEN doc_id % 3 = 1 THEN 'e' ELSE 'Z' END || doc_id || '.tex' AS path FROM documents)
SELECT bundle, count(*) AS n_files, sha256(string_agg(path || chr(1) || sha || chr(1), '' ORDER BY encode(lower(nfc_normalize(path))), encode(path))) AS digest FROM f GROUP BY 1""")
def bundle_digests(spark, sf_dir):
    """Documents as files of bundles: digests over paths in their stable order, from rows that come in another one and in decomposed letters."""
    i = F.col("doc_id")
    letter = F.when(i % 3 == 0, f"E{ACCENT}").when(i % 3 == 1, "e").otherwise("Z")
    files = docs(spark, sf_dir).select(F.concat("lang", F.lit("/"), "source").alias("bundle"), F.concat(F.lit("Dir/"), letter, i.cast("string"), F.lit(".tex")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return digests.path_digests(files.repartition(7, "path"), "bundle", mark="\x01").select("bundle", "n_files", "digest")
