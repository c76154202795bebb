"""Named queries over the driver's tables and the SQL that they equal.

Each entry applies operators of the library to whole tables. ``register`` keeps a query and its SQL together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import redaction as R
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import windows as W
from ..sources.corpus import table
from . import documents as D
from . import gate as G
from . import metrics as M
from . import rulebook as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return put


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---- scalar text functions ----


@register("token_estimate", "SELECT doc_id, ceil(octet_length(encode(text)) / 4.0)::INT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@register("word_count", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::INT AS words, len(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''’][\p{L}\p{N}_]+)*'))::INT AS compound FROM documents")
def word_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("words"), T.compound_word_count(F.col("text")).alias("compound"))


@register("source_hash", "SELECT doc_id, sha256(text) AS digest, 'sha256:' || sha256(text) || ':0-' || length(text) AS locator FROM documents")
def source_hash(spark, sf_dir):
    digest = I.source_hash(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", digest.alias("digest"), I.locator(digest, F.lit(0), F.length("text")).alias("locator"))


@register("locator_parse", "SELECT doc_id, sha256(text) AS hash, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 2 END::INT AS start, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE length(text) + 3 END::INT AS \"end\" FROM (SELECT * FROM documents WHERE doc_id % 3 <> 0) UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE doc_id % 3 = 0")
def locator_parse(spark, sf_dir):
    """Well-formed locators come back in parts; every third is turned round and must be refused."""
    start, end = F.lit(2), F.length("text") + 3
    made = F.when(F.col("doc_id") % 3 == 0, I.locator(I.source_hash(F.col("text")), end, start)).otherwise(I.locator(I.source_hash(F.col("text")), start, end))
    parsed = I.parse_locator(made)
    return docs(spark, sf_dir).select("doc_id", parsed["hash"].alias("hash"), parsed["start"].alias("start"), parsed["end"].alias("end"))


@register("cache_key", "SELECT doc_id, sha256(concat_ws('|', lang, source, sha256(text), 'v1')) AS key FROM documents")
def cache_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", I.cache_digest(F.col("lang"), F.col("source"), I.source_hash(F.col("text")), F.lit("v1")).alias("key"))


@register("latin_ratio", r"SELECT doc_id, round(CASE WHEN l = 0 THEN 0 ELSE a / l END, 9) AS ratio FROM (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS l FROM documents)")
def latin_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(T.latin_ratio(F.col("text")), 9).alias("ratio"))


@register("significant_chars", r"SELECT doc_id, length(regexp_replace(text, '[\s\p{Z}\p{C}]', '', 'g'))::INT AS chars FROM documents")
def significant_chars(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.significant_chars(F.col("text")).alias("chars"))


@register("first_year", "SELECT page_id, nullif(regexp_extract(html, '((?:19|20)[0-9]{2})', 1), '')::INT AS year FROM pages")
def first_year(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.first_year(F.col("html")).alias("year"))


REDACT_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'),
  '(?i)(\b(?:api[_-]?key|token|secret|password|authorization|llm_api_key)\b\s*[:=]\s*)([''"]?)[^\s,;''")}}\]]+', '\1[REDACTED]', 'g'),
  '\b(?:sk-[A-Za-z0-9_-]{{8,}}|AQVN[A-Za-z0-9_-]{{8,}})\b', '[REDACTED]', 'g'), '(?i)\bBearer\s+[A-Za-z0-9._~+/-]{{8,}}=*', 'Bearer [REDACTED]', 'g'),
  '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b', '[REDACTED]', 'g')"""


@register("redact_text", f"SELECT doc_id, sha256({REDACT_SQL.format('text')}) AS redacted FROM documents")
def redact_text(spark, sf_dir):
    """Whole documents; they hold no paths, prompts or tracebacks, whose patterns need look-behind and are tested on fixtures."""
    return docs(spark, sf_dir).select("doc_id", F.sha2(R.redact_text(F.col("text")), 256).alias("redacted"))


@register("redact_conversations", f"SELECT conv_id, turn, sha256({REDACT_SQL.format('text')}) AS redacted FROM conversations")
def redact_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(R.redact_text(F.col("text")), 256).alias("redacted"))


@register("truncate_public_text", r"SELECT doc_id, CASE WHEN length(text) <= 240 THEN text ELSE regexp_replace(substring(text, 1, 240), '\s+$', '') || '… [TRUNCATED]' END AS shown FROM documents")
def truncate_public_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", R.truncate_public(F.col("text")).alias("shown"))


@register("evidence_text", rf"""
WITH r AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), s AS (SELECT doc_id, {REDACT_SQL.format('t')} AS t FROM r),
c AS (SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(substring(t, 1, 240), '\s+$', '') || '… [TRUNCATED]' END AS t FROM s)
SELECT doc_id, regexp_replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*])', '\\\1', 'g') AS shown FROM c
""")
def evidence_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", R.evidence_text(F.col("text")).alias("shown"))


TITLE_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), 'ё', 'е'), '^\s*(?:глава|раздел)\s+[0-9]+[.\s:—-]*', ''), '^\s*[0-9]+(?:\.[0-9]+)*[.\s:—-]+', ''), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
PAGE_TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"


@register("normalize_title", f"SELECT page_id, {TITLE_SQL.format(PAGE_TITLE)} AS title, coalesce(nullif(substring(replace({TITLE_SQL.format(PAGE_TITLE)}, ' ', '-'), 1, 48), ''), 'section') AS slug FROM pages")
def normalize_title(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", T.plain_title(title).alias("title"), T.slug(title).alias("slug"))


@register("repeated_key", r"SELECT doc_id, sha256(regexp_replace(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), '[0-9]+', '#', 'g')) AS key FROM documents")
def repeated_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.repeated_key(F.col("text")), 256).alias("key"))


@register("url_host", "SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)', 1)) AS host FROM pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


@register("json_finding", """SELECT doc_id, '{"evidence":[],"layer":"script","message":' || to_json(text) || ',"rule_id":"DOC-01","severity":"error","status":"fail"}' AS canonical FROM documents""")
def json_finding(spark, sf_dir):
    """Canonical JSON of a finding whose message is a whole document."""
    made = {"rule_id": "DOC-01", "layer": "script", "severity": "error", "status": "fail"}
    f = docs(spark, sf_dir).withColumns({**{k: F.lit(v) for k, v in made.items()}, "message": F.col("text"), "path": F.lit(None).cast("string"), "page": F.lit(None).cast("int"), "evidence": F.array().cast("array<struct<locator:string,description:string>>")})
    return f.select("doc_id", I.canonical_finding().alias("canonical"))


# ---- joins ----


@register("evidence_verify", "SELECT doc_id, item_id, strpos(d.text, b.text)::INT AS at FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def evidence_verify(spark, sf_dir):
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    hits = J.contains_any(docs(spark, sf_dir).select("doc_id", "text"), quotes)
    return hits.select("doc_id", "item_id", F.expr("cast(locate(needle, text) as int)").alias("at"))


@register("uncited_keys", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def uncited_keys(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@register("cited_entries", "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def cited_entries(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@register("required_missing_ladder", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unverifiable' WHEN l.quality = 1 THEN 'pass' ELSE 'fail' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def required_missing_ladder(spark, sf_dir):
    """A missing source is never a pass."""
    joined = docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("quality").isNull(), "unverifiable").when(F.col("quality") == 1, "pass").otherwise("fail").alias("status"))


RANGES = [("en", 500, 5000), ("fr", 400, 4000), ("de", 600, 6000)]


@register("range_lookup", "SELECT doc_id, CASE WHEN r.lang IS NULL THEN 'unknown' WHEN n_chars < lo THEN 'short' WHEN n_chars > hi THEN 'long' ELSE 'ok' END AS verdict FROM documents d LEFT JOIN (VALUES ('en', 500, 5000), ('fr', 400, 4000), ('de', 600, 6000)) r(lang, lo, hi) ON r.lang = d.lang")
def range_lookup(spark, sf_dir):
    ranges = spark.createDataFrame(RANGES, "lang string, lo int, hi int")
    joined = docs(spark, sf_dir).join(F.broadcast(ranges), "lang", "left")
    return joined.select("doc_id", F.when(F.col("lo").isNull(), "unknown").when(F.col("n_chars") < F.col("lo"), "short").when(F.col("n_chars") > F.col("hi"), "long").otherwise("ok").alias("verdict"))


LINES_SQL = """l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line, coalesce(list_sum([length(x) + 1 for x in ls[1:i-1]]), 0)::INT AS char_start
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(i))"""


@register("interval_overlap", f"WITH {LINES_SQL} SELECT l.doc_id, w AS window_no, min(line_no)::INT AS first_line, max(line_no)::INT AS last_line FROM l JOIN documents d USING (doc_id), unnest(range(0, (length(text) + 999) // 1000)) u(w) WHERE char_start + length(line) > w * 1000 AND char_start < least((w + 1) * 1000, length(text)) GROUP BY ALL")
def interval_overlap(spark, sf_dir):
    """Lines that share a character with fixed windows of 1000 characters."""
    lines = W.lines(docs(spark, sf_dir), "doc_id").select("doc_id", "line_no", F.col("char_start").alias("a_start"), (F.col("char_start") + F.length("line")).alias("a_end"))
    n = F.length("text")
    windows = docs(spark, sf_dir).where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 1000))).alias("window_no"))
    windows = windows.select("doc_id", "window_no", (F.col("window_no") * 1000).alias("b_start"), F.least((F.col("window_no") + 1) * 1000, F.col("n")).alias("b_end"))
    return J.overlap(lines, windows, "doc_id").groupBy("doc_id", "window_no").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@register("containment_join", f"""WITH h AS (SELECT doc_id, item_id, strpos(d.text, b.text) - 1 AS s, strpos(d.text, b.text) - 1 + length(b.text) AS e FROM documents d JOIN benchmark b ON contains(d.text, b.text)), {LINES_SQL}
SELECT doc_id, item_id, s::INT AS start, (SELECT min(line_no) FROM l WHERE l.doc_id = h.doc_id AND char_start <= s AND e <= char_start + length(line))::INT AS line_no FROM h""")
def containment_join(spark, sf_dir):
    """The line that holds a quote whole; null where it spans several."""
    hits = evidence_verify(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("n")), "item_id")
    points = hits.select("doc_id", "item_id", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.col("n")).alias("end"))
    lines = W.lines(docs(spark, sf_dir), "doc_id").select("doc_id", F.col("line_no").alias("s_id"), F.col("char_start").alias("s_start"), (F.col("char_start") + F.length("line")).alias("s_end"))
    return J.contained(points, lines, "doc_id").select("doc_id", "item_id", "start", F.col("s_id").alias("line_no"))


@register("range_anti_join", """SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'error' AND b.user_id = e.user_id AND b.event_id <= e.event_id AND e.event_id < b.event_id + 200)""")
def range_anti_join(spark, sf_dir):
    """Events outside the 200 that follow an error of the same user."""
    events = table(spark, sf_dir, "events")
    points = events.select("user_id", "event_id", F.col("event_id").alias("at"))
    ranges = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("r_start"), (F.col("event_id") + 200).alias("r_end"))
    return J.outside(points, ranges, "user_id").select("event_id")


PATTERNS = [(1, "(?i)licen[sc]ed? under", "license notice"), (2, r"(?i)\btoken\b\s*=", "secret"), (3, r"[0-9]{3}-[0-9]{4}", "phone"), (4, "@", "address")]


@register("pattern_theta_join", r"""SELECT doc_id, arg_min(message, pos) AS message FROM documents JOIN (VALUES (1, '(?i)licen[sc]ed? under', 'license notice'), (2, '(?i)\btoken\b\s*=', 'secret'), (3, '[0-9]{3}-[0-9]{4}', 'phone'), (4, '@', 'address')) p(pos, pattern, message) ON regexp_matches(text, pattern) GROUP BY doc_id""")
def pattern_theta_join(spark, sf_dir):
    patterns = spark.createDataFrame(PATTERNS, "pos int, pattern string, message string")
    return J.first_pattern(docs(spark, sf_dir), patterns, F.col("text"), "doc_id")


@register("declared_vs_actual", "SELECT doc_id, n_chars AS declared, length(text)::BIGINT AS actual, n_chars = length(text) AS ok FROM documents")
def declared_vs_actual(spark, sf_dir):
    actual = F.length("text").cast("long")
    return docs(spark, sf_dir).select("doc_id", F.col("n_chars").alias("declared"), actual.alias("actual"), (F.col("n_chars") == actual).alias("ok"))


@register("as_of_reference", """SELECT e.event_id, c.click AS asof_click FROM (SELECT * FROM events WHERE event_type = 'error') e
LEFT JOIN LATERAL (SELECT event_id AS click FROM events c WHERE c.event_type = 'click' AND c.user_id = e.user_id AND c.ts <= e.ts ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) c ON TRUE""")
def as_of_reference(spark, sf_dir):
    """For each error, the latest click of the same user at or before it."""
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("user_id", "event_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("click"))
    return J.as_of(errors, clicks, "user_id", "ts", "at", "click").select("event_id", "asof_click")


@register("last_wins_lookup", "SELECT conv_id, role, max(turn) AS turn, sha256(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id, role")
def last_wins_lookup(spark, sf_dir):
    last = J.last_wins(table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn")
    return last.select("conv_id", "role", "turn", F.sha2("text", 256).alias("digest"))


@register("forbidden_source", "SELECT page_id, CASE WHEN contains(lower(url), 'm.') THEN 'mobile' WHEN contains(lower(url), '.net/') THEN 'net' WHEN contains(lower(url), '.org/') AND NOT contains(lower(html), 'published') THEN 'org' END AS label FROM pages")
def forbidden_source(spark, sf_dir):
    """The first needle of an ordered list in an address; the last only without a mark in the text."""
    url = F.lower("url")
    label = F.when(F.contains(url, F.lit("m.")), "mobile").when(F.contains(url, F.lit(".net/")), "net").when(F.contains(url, F.lit(".org/")) & ~F.contains(F.lower("html"), F.lit("published")), "org")
    return table(spark, sf_dir, "pages").select("page_id", label.alias("label"))


# ---- findings, gate, counts ----


@register("document_findings", f"WITH {D.FINDINGS_SQL} SELECT * FROM f")
def document_findings(spark, sf_dir):
    return D.findings(docs(spark, sf_dir)).select("doc_id", "rule_id", "layer", "severity", "status", "message")


def gate_sql(mode: str) -> str:
    stops = "status IN ('fail', 'unverifiable')" if mode == "strict" else "status = 'fail'"
    hidden = "FALSE" if mode == "strict" else "status = 'unverifiable'"
    formal = "layer IN ('class', 'script', 'class+script')"
    return f"""
WITH {D.FINDINGS_SQL}, g AS (SELECT doc_id, count(*) AS n_findings, count(*) FILTER ({formal} AND severity = 'error' AND status = 'fail') AS formal_errors,
  count(*) FILTER (layer NOT IN ('llm', 'vision') AND NOT ({formal} AND severity = 'error' AND status = 'fail') AND (status = 'warn' OR severity = 'warn')) AS warnings,
  count(*) FILTER (layer IN ('llm', 'vision') AND status IN ('warn', 'info')) AS llm_advisory, count(*) FILTER (status = 'unverifiable') AS unverifiable,
  count(*) FILTER ({formal} AND severity = 'error' AND status = 'unverifiable') AS blocking_unverifiable, count(*) FILTER (contains(upper(message), 'APPROVAL_REQUIRED')) AS approvals_required,
  coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FILTER ({formal} AND severity = 'error' AND {stops}), '') AS blocking_rules,
  coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FILTER ({formal} AND severity = 'error' AND {hidden}), '') AS suppressed_rules FROM f GROUP BY doc_id)
SELECT *, CASE WHEN blocking_rules <> '' THEN 'fail' WHEN suppressed_rules <> '' THEN 'degraded' ELSE 'pass' END AS gate_status, CASE WHEN blocking_rules <> '' THEN 2 ELSE 0 END::INT AS exit_code FROM g"""


@register("gate_report", gate_sql("strict"))
def gate_report(spark, sf_dir):
    return G.gate(D.findings(docs(spark, sf_dir)))


@register("gate_advisory", gate_sql("advisory"))
def gate_advisory(spark, sf_dir):
    return G.gate(D.findings(docs(spark, sf_dir)), "advisory")


LADDER = "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unverifiable' WHEN l.quality = 1 THEN 'pass' ELSE 'fail' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)"


@register("gate_modes", f"WITH f AS ({LADDER}) SELECT doc_id, CASE WHEN status = 'pass' THEN 'pass' ELSE 'fail' END AS strict, CASE status WHEN 'fail' THEN 'fail' WHEN 'unverifiable' THEN 'degraded' ELSE 'pass' END AS advisory FROM f")
def gate_modes(spark, sf_dir):
    f = required_missing_ladder(spark, sf_dir).withColumns({"rule_id": F.lit("LAB-01"), "layer": F.lit("script"), "severity": F.lit("error"), "message": F.lit("")})
    strict, advisory = (G.gate(f, mode).select("doc_id", F.col("gate_status").alias(mode)) for mode in ("strict", "advisory"))
    return strict.join(advisory, "doc_id")


@register("status_counts", f"""WITH {D.FINDINGS_SQL} SELECT doc_id, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'info') AS n_info,
count(*) FILTER (status = 'unverifiable') AS n_unverifiable, count(*) FILTER (status = 'not_applicable') AS n_not_applicable, count(*) FILTER (status = 'skipped') AS n_skipped,
coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FILTER (layer IN ('class', 'script', 'class+script') AND severity = 'error' AND status IN ('fail', 'unverifiable')), '') AS blocking_rules FROM f GROUP BY doc_id""")
def status_counts(spark, sf_dir):
    return G.status_counts(D.findings(docs(spark, sf_dir)))


@register("finding_order", f"""WITH {D.FINDINGS_SQL}, c AS (SELECT doc_id, rule_id, 'sha256:' || sha256('{{"evidence":[],"layer":"' || layer || '","message":' || to_json(message) || ',"rule_id":"' || rule_id || '","severity":"' || severity || '","status":"' || status || '"}}') AS fingerprint FROM f)
SELECT doc_id, rule_id, fingerprint, row_number() OVER (PARTITION BY doc_id ORDER BY fingerprint)::INT AS place FROM c""")
def finding_order(spark, sf_dir):
    """No document rule is in the rulebook, so order is by fingerprint alone here."""
    return G.order(D.findings(docs(spark, sf_dir)), B.rulebook(spark)).select("doc_id", "rule_id", "fingerprint", "place")


@register("union_stages", f"WITH {D.FINDINGS_SQL}, l AS ({LADDER}) SELECT doc_id, rule_id, status, 'formal' AS stage, 0 AS stage_no FROM f UNION ALL SELECT doc_id, 'LAB-01', status, 'labels', 1 FROM l")
def union_stages(spark, sf_dir):
    labels = required_missing_ladder(spark, sf_dir).withColumn("rule_id", F.lit("LAB-01"))
    return G.union_stages(("formal", D.findings(docs(spark, sf_dir)).select("doc_id", "rule_id", "status")), ("labels", labels.select("doc_id", "rule_id", "status")))


# ---- aggregations ----


@register("weighted_ratio", "SELECT source, round(coalesce(sum(n_chars) FILTER (lang = 'en'), 0) / sum(n_chars), 9) AS ratio FROM documents GROUP BY source")
def weighted_ratio(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.round(A.weighted_ratio(F.col("lang") == "en", F.col("n_chars")), 9).alias("ratio"))


@register("weighted_mode", "SELECT source, lang, weight::BIGINT AS weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, lang) AS n FROM (SELECT source, lang, sum(n_chars) AS weight FROM documents GROUP BY ALL)) WHERE n = 1")
def weighted_mode(spark, sf_dir):
    return A.weighted_mode(docs(spark, sf_dir), ["source"], "lang", F.col("n_chars"))


@register("dominant_size", "SELECT l_suppkey, size, weight FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, size) AS n FROM (SELECT l_suppkey, round_even(l_tax * 100 * 2, 0) / 2 AS size, count(*) AS weight FROM lineitem GROUP BY ALL)) WHERE n = 1")
def dominant_size(spark, sf_dir):
    """The most frequent value in half steps (banker's rounding), ties to the smallest."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.bround(F.col("l_tax") * 100 * 2, 0) / 2).alias("size"))
    return A.weighted_mode(rows, ["l_suppkey"], "size", F.lit(1))


@register("median_chars", "SELECT source, median(n_chars) AS median FROM documents GROUP BY source")
def median_chars(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.median("n_chars").alias("median"))


@register("repeated_lines", "SELECT sha256(line) AS line, n_units::BIGINT AS n_units, n_rows::BIGINT AS n_rows FROM (SELECT line, count(DISTINCT doc_id) AS n_units, count(*) AS n_rows FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY line) WHERE n_units >= 2")
def repeated_lines(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where("line <> ''").select("doc_id", F.sha2("line", 256).alias("line"))
    return A.repeated(lines, "line", "doc_id")


@register("recent_share", "SELECT o_custkey, avg((year(o_orderdate) >= 1996)::INT) AS share FROM orders GROUP BY o_custkey")
def recent_share(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(A.share(F.year("o_orderdate") >= 1996).alias("share"))


@register("citation_density", r"""SELECT doc_id, count(*) FILTER (words >= 30)::BIGINT AS long_lines, count(*) FILTER (words >= 30 AND NOT regexp_matches(line, '[0-9]'))::BIGINT AS bare_lines, greatest(1, sum(words) // 300)::BIGINT AS wanted
FROM (SELECT doc_id, line, len(regexp_extract_all(line, '[\p{L}\p{N}_]+')) AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY doc_id""")
def citation_density(spark, sf_dir):
    """Long lines, long lines without a number, and the references that the length asks for."""
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("words", T.word_count(F.col("line")))
    long = F.col("words") >= 30
    return lines.groupBy("doc_id").agg(F.count_if(long).alias("long_lines"), F.count_if(long & ~F.col("line").rlike("[0-9]")).alias("bare_lines"), F.greatest(F.lit(1), F.floor(F.sum("words") / 300)).alias("wanted"))


ANCHORS = ["<nav", "<article", "<footer", "<table", "<code", "<h1"]


@register("template_support", "SELECT page_id, ({}) AS support FROM pages".format(" + ".join(f"contains(html, '{a}')::INT" for a in ANCHORS)))
def template_support(spark, sf_dir):
    flags = [F.contains("html", F.lit(a)).cast("int") for a in ANCHORS]
    return table(spark, sf_dir, "pages").select("page_id", sum(flags[1:], flags[0]).alias("support"))


@register("bbox_union", "SELECT l_orderkey, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY l_orderkey")
def bbox_union(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("x0"), F.min("l_extendedprice").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_extendedprice").alias("y1"))


@register("line_spacing", "SELECT user_id, median(d) AS spacing FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) WHERE d > 0 GROUP BY user_id")
def line_spacing(spark, sf_dir):
    """The median distance of neighbours."""
    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").withColumn("d", gap).where("d > 0").groupBy("user_id").agg(F.median("d").alias("spacing"))


# ---- sets and order ----


@register("dedupe_fingerprint", "SELECT min(doc_id) AS doc_id, sha256(text) AS fingerprint FROM documents GROUP BY text")
def dedupe_fingerprint(spark, sf_dir):
    """The first document of each text; a narrow aggregation instead of a window over texts."""
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("fingerprint")).groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))


LINE_SETS = "s AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)"


@register("array_difference", f"WITH {LINE_SETS} SELECT doc_id, array_to_string(list_sort(list_filter(['the', 'and', 'of', 'de', 'la', 'und', 'los'], lambda x: NOT list_contains(w, x))), ',') AS missing FROM s")
def array_difference(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    wanted = F.array(*map(F.lit, ["the", "and", "of", "de", "la", "und", "los"]))
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(F.array_except(wanted, words)), ",").alias("missing"))


@register("array_intersection", f"WITH {LINE_SETS} SELECT doc_id, array_to_string(list_sort(list_filter(['the', 'and', 'of', 'de', 'la', 'und', 'los'], lambda x: list_contains(w, x))), ',') AS present FROM s")
def array_intersection(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    wanted = F.array(*map(F.lit, ["the", "and", "of", "de", "la", "und", "los"]))
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(F.array_intersect(wanted, words)), ",").alias("present"))


@register("topk_sources", "SELECT lang, source, weight::BIGINT AS weight, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, source) AS rank FROM (SELECT lang, source, sum(n_chars) AS weight FROM documents GROUP BY ALL)) WHERE rank <= 3")
def topk_sources(spark, sf_dir):
    sums = docs(spark, sf_dir).groupBy("lang", "source").agg(F.sum("n_chars").alias("weight"))
    return A.top_k(sums, ["lang"], [F.desc("weight"), F.asc("source")], 3).select("lang", "source", "weight", "rank")


# ---- windows ----


@register("running_offsets", f"WITH {LINES_SQL} SELECT doc_id, line_no::INT AS line_no, char_start FROM l")
def running_offsets(spark, sf_dir):
    return W.lines(docs(spark, sf_dir), "doc_id").select("doc_id", "line_no", "char_start")


@register("sections_from_lines", rf"""WITH {LINES_SQL}, h AS (SELECT doc_id, char_start, line, coalesce(nullif(substring(replace({TITLE_SQL.format("line")}, ' ', '-'), 1, 48), ''), 'section') AS base FROM l WHERE length(line) BETWEEN 1 AND 40)
SELECT h.doc_id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS section_id, char_start, char_end::INT AS char_end FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY char_start) AS n, lead(char_start) OVER (PARTITION BY doc_id ORDER BY char_start) AS nxt FROM h) h
JOIN documents d USING (doc_id), LATERAL (SELECT coalesce(nxt, length(text)) AS char_end)""")
def sections_from_lines(spark, sf_dir):
    """Short lines as headings: identifiers unique in a document, each section up to the next."""
    total = docs(spark, sf_dir).select("doc_id", F.length("text").alias("total"))
    heads = W.lines(docs(spark, sf_dir), "doc_id").where(F.length("line").between(1, 40)).join(total, "doc_id").withColumn("base", T.slug(F.col("line")))
    out = W.serial_ids(W.section_ends(heads, "doc_id", "char_start", F.col("total")), "doc_id", "base", "char_start", "section_id")
    return out.select("doc_id", "section_id", "char_start", "char_end")


@register("head_tail_chunks", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n <= 3 OR a <= 2 OR a > n - 1")
def head_tail_chunks(spark, sf_dir):
    return W.head_tail(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], 3)


ISLANDS = "i AS (SELECT event_type, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g, event_id FROM events), r AS (SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY event_type, g)"


@register("page_ranges", f"WITH {ISLANDS} SELECT event_type, first, last, n FROM r")
def page_ranges(spark, sf_dir):
    return W.islands(table(spark, sf_dir, "events"), ["event_type"], "event_id")


@register("page_range_text", "WITH i AS (SELECT conv_id, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g, turn FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, min(turn) AS f, max(turn) AS l FROM i GROUP BY conv_id, g) SELECT conv_id, string_agg(CASE WHEN f = l THEN f::VARCHAR ELSE f || '-' || l END, ',' ORDER BY f) AS ranges FROM r GROUP BY conv_id")
def page_range_text(spark, sf_dir):
    return W.range_text(W.islands(table(spark, sf_dir, "conversations").where("role = 'user'"), ["conv_id"], "turn"), ["conv_id"])


@register("neighbour_gap", "SELECT event_id, event_id - lag(event_id) OVER w AS before, lead(event_id) OVER w - event_id AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def neighbour_gap(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("before"), (F.lead("event_id").over(w) - F.col("event_id")).alias("after"))


@register("runs_vs_previous", "SELECT event_id, sum(c) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM (SELECT user_id, event_id, coalesce((event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id))::INT, 1) AS c FROM events)")
def runs_vs_previous(spark, sf_dir):
    return W.runs(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type").select("event_id", "run")


@register("chunk_lossless", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text <> ''")
def chunk_lossless(spark, sf_dir):
    """The new parts of a document's chunks, joined, are the document."""
    made = W.chunks(docs(spark, sf_dir), ["doc_id"], 200)
    new = F.substring("text", F.col("overlap_chars") + 1, F.length("text"))
    parts = F.array_sort(F.collect_list(F.struct("seq", new.alias("t"))))
    return made.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["t"]), ""), 256).alias("digest"))


@register("chunk_budget", "SELECT doc_id, 0::BIGINT AS over_budget, TRUE AS overlap_ok FROM documents WHERE text <> ''")
def chunk_budget(spark, sf_dir):
    made = W.chunks(docs(spark, sf_dir), ["doc_id"], 200)
    repeated = F.ceil(F.octet_length(F.substring("text", F.lit(1), F.col("overlap_chars"))) / 4)
    return made.groupBy("doc_id").agg(F.count_if(F.col("token_count") > 200).alias("over_budget"), F.bool_and(repeated <= 20).alias("overlap_ok"))


@register("ordered_subsequence", r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '<(title|style|script|nav|article|h1|footer)\b', 1) AS tags FROM pages)
SELECT page_id, list_reduce(list_prepend(0, list_transform(tags, lambda x: coalesce(list_position(['title', 'nav', 'article', 'h1', 'footer'], x), 0)::INT)), lambda i, m: CASE WHEN m = i + 1 THEN i + 1 ELSE i END)::INT AS met FROM t""")
def ordered_subsequence(spark, sf_dir):
    """How many of five tags a page has in order, others between them allowed."""
    tags = F.regexp_extract_all("html", F.lit(r"<(title|style|script|nav|article|h1|footer)\b"), F.lit(1))
    order = F.array(*map(F.lit, ["title", "nav", "article", "h1", "footer"]))
    sets = F.transform(tags, lambda t: F.array((F.array_position(order, t) - 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", W.in_order(sets).alias("met"))


# ---- evaluation and rulebook ----

OBSERVED = "o AS (SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'silent' ELSE 'detect' END AS expected, f.rule_id, f.status IN ('fail', 'warn') AS hit, f.status FROM labels l JOIN f ON f.doc_id = l.doc_id WHERE f.rule_id IN ('DOC-01', 'DOC-03', 'DOC-04'))"
COUNTS = "count(*) AS labeled_pairs, count(*) FILTER (expected <> 'silent' AND hit) AS tp, count(*) FILTER (expected = 'silent' AND hit) AS fp, count(*) FILTER (expected <> 'silent' AND NOT hit) AS fn, count(*) FILTER (expected = 'silent' AND NOT hit) AS tn"


def observed(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("fixture_id"), F.explode(F.array(*map(F.lit, ["DOC-01", "DOC-03", "DOC-04"]))).alias("rule_id"), F.when(F.col("quality") == 1, "silent").otherwise("detect").alias("expected"))
    return M.observe(labels, D.findings(docs(spark, sf_dir)))


def _metrics_sql(key: str) -> str:
    group = f"GROUP BY {key}" if key else ""
    return f"""WITH {D.FINDINGS_SQL}, {OBSERVED}, c AS (SELECT {key + ', ' if key else ''}{COUNTS} FROM o {group}), q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
SELECT {key + ', ' if key else ''}labeled_pairs, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM q"""


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "labeled_pairs", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@register("confusion_matrix", _metrics_sql(""))
def confusion_matrix(spark, sf_dir):
    return _rounded(M.confusion(observed(spark, sf_dir), []))


@register("per_rule_metrics", _metrics_sql("rule_id"))
def per_rule_metrics(spark, sf_dir):
    return _rounded(M.confusion(observed(spark, sf_dir), ["rule_id"]), "rule_id")


@register("rates_by_rule", "SELECT quality, round(avg((toxic = 1)::INT), 9) AS toxic_rate, round(coalesce(avg((toxic = 1)::INT) FILTER (doc_id % 2 = 0), 0), 9) AS even_rate FROM labels GROUP BY quality")
def rates_by_rule(spark, sf_dir):
    """A rate over all cases and one over the cases that qualify."""
    toxic = F.col("toxic") == 1
    return table(spark, sf_dir, "labels").groupBy("quality").agg(F.round(A.share(toxic), 9).alias("toxic_rate"), F.round(F.coalesce(A.share(F.when(F.col("doc_id") % 2 == 0, toxic)), F.lit(0.0)), 9).alias("even_rate"))


RULE_VALUES = ", ".join("({}, '{}', '{}', '{}', {})".format(n, i, layer, s, f"'{f}'" if f else "NULL") for n, i, layer, s, f in B.rule_rows())
RULES_SQL = f"r AS (SELECT * FROM (VALUES {RULE_VALUES}) v(rubric_index, id, layer, severity, severity_final))"


PROFILES = ["software", "research", "organizational"]
#: Every document has a profile by its id, and every second one is held against final severities.
PROFILED = f"""{RULES_SQL}, d AS (SELECT doc_id, ['software', 'research', 'organizational'][doc_id % 3 + 1] AS profile, doc_id % 2 = 0 AS final FROM documents),
e AS (SELECT doc_id, profile, id, CASE WHEN final THEN coalesce(severity_final, severity) ELSE severity END AS severity, NOT contains(CASE profile WHEN 'software' THEN '' WHEN 'research' THEN 'ARC,ALG,IMP' ELSE 'ARC,ALG,IMP,MTH' END, substring(id, 1, 3)) AS enabled,
  CASE layer WHEN 'script+llm' THEN 'script' ELSE layer END AS formal_layer, (contains(layer, 'class') OR contains(layer, 'script')) AS formal FROM d, r)"""


def profiled_rules(spark, sf_dir):
    """The rules as they hold for each document."""
    each = None
    for profile in PROFILES:
        for final in (True, False):
            one = B.effective(B.rulebook(spark), B.Settings(profile=profile, final=final)).select(F.lit(profile).alias("profile"), F.lit(final).alias("final"), "id", "severity", "enabled", "formal_layer", B.is_formal(F.col("capabilities")).alias("formal"))
            each = one if each is None else each.unionByName(one)
    chosen = docs(spark, sf_dir).select("doc_id", F.get(F.array(*map(F.lit, PROFILES)), (F.col("doc_id") % 3).cast("int")).alias("profile"), (F.col("doc_id") % 2 == 0).alias("final"))
    return chosen.join(F.broadcast(each), ["profile", "final"]).drop("final")


@register("effective_rules", f"WITH {PROFILED} SELECT doc_id, id, severity, enabled, formal_layer, formal FROM e")
def effective_rules(spark, sf_dir):
    return profiled_rules(spark, sf_dir).drop("profile")


@register("profile_rules", f"WITH {PROFILED} SELECT doc_id, profile, count(*) FILTER (enabled) AS n FROM e GROUP BY doc_id, profile")
def profile_rules(spark, sf_dir):
    return profiled_rules(spark, sf_dir).groupBy("doc_id", "profile").agg(F.count_if("enabled").alias("n"))


@register("severity_counts", f"WITH {PROFILED} SELECT doc_id, severity, count(*) AS n FROM e WHERE enabled GROUP BY doc_id, severity")
def severity_counts(spark, sf_dir):
    return profiled_rules(spark, sf_dir).where("enabled").groupBy("doc_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@register("semantic_rates", """
WITH c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS rule_id, quality = 1 AS schema_ok, toxic = 0 AS evidence_ok, quality = 1 AND toxic = 0 AS useful, doc_id % 3 = 0 AS actionable FROM labels)
SELECT rule_id, count(*) AS cases, round(coalesce(avg(schema_ok::INT), 0), 9) AS schema_rate, round(coalesce(avg(evidence_ok::INT), 0), 9) AS evidence_rate, round(coalesce(avg(useful::INT) FILTER (actionable), 0), 9) AS useful_rate FROM c GROUP BY ROLLUP (rule_id)""")
def semantic_rates(spark, sf_dir):
    """Rates by rule and over all, in one rollup."""
    cases = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 2 == 0, "EVEN").otherwise("ODD").alias("rule_id"), (F.col("quality") == 1).alias("schema_ok"), (F.col("toxic") == 0).alias("evidence_ok"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("useful"), (F.col("doc_id") % 3 == 0).alias("actionable"))
    out = M.semantic_rates(cases)
    return out.select("rule_id", "cases", *[F.round(c, 9).alias(c) for c in ("schema_rate", "evidence_rate", "useful_rate")])
