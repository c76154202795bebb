"""Rules over plain documents: the smallest complete run (scan, measure, rules, findings, gate).

Each rule is a status and a message by ``CASE``; all of them are evaluated in one projection and exploded,
so a document is read once however many rules there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import redaction as R
from ..functions import text as T

TOKEN_BUDGET, MIN_WORDS, MIN_LATIN = 2_000, 50, 0.6


def measure(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    holds = lambda pattern: R.may_match(F.lower(text), pattern) & F.regexp_like(text, F.lit(pattern))
    return docs.select(
        "doc_id", T.estimate_tokens(text).alias("tokens"), T.word_count(text).alias("words"), T.latin_ratio(text).alias("latin"),
        (holds(R.EMAIL) | holds(R.ASSIGN)).alias("private"), F.length(text).alias("chars"), "n_chars",
    )


def _row(rule: str, layer: str, severity: str, status: Column, message: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(layer).alias("layer"), F.lit(severity).alias("severity"), status.alias("status"), message.alias("message"))


def findings(docs: DataFrame) -> DataFrame:
    """Five rules: size, private data, length, script and declared length."""
    m = measure(docs)
    declared = F.when(F.col("n_chars").isNull(), "unverifiable").when(F.col("n_chars") == F.col("chars"), "pass").otherwise("fail")
    rows = F.array(
        _row("DOC-01", "script", "error", F.when(F.col("tokens") > TOKEN_BUDGET, "fail").otherwise("pass"), F.concat(F.lit("tokens: "), F.col("tokens").cast("string"))),
        _row("DOC-02", "script", "error", F.when(F.col("private"), "fail").otherwise("pass"), F.lit("private data")),
        _row("DOC-03", "script", "warn", F.when(F.col("words") < MIN_WORDS, "warn").otherwise("pass"), F.concat(F.lit("words: "), F.col("words").cast("string"))),
        _row("DOC-04", "llm", "warn", F.when(F.col("words") == 0, "unverifiable").when(F.col("latin") < MIN_LATIN, "warn").otherwise("pass"), F.lit("script of the text")),
        _row("DOC-05", "class+script", "error", declared, F.lit("declared length")),
    )
    empty = {"evidence": "array<struct<locator:string,description:string>>", "path": "string", "page": "int"}
    return m.select("doc_id", F.inline(rows)).withColumns({k: F.lit(None).cast(t) for k, t in empty.items()})


FINDINGS_SQL = r"""
m AS (SELECT doc_id, ceil(octet_length(encode(coalesce(text, ''))) / 4.0)::INT AS tokens, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) AS words,
        CASE WHEN length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) / length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) END AS latin,
        regexp_matches(coalesce(text, ''), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')
          OR regexp_matches(coalesce(text, ''), '(?i)\b(?:api[_-]?key|token|secret|password|authorization|llm_api_key)\b\s*[:=]\s*[''"]?[^\s,;''")}\]]+') AS private,
        length(coalesce(text, '')) AS chars, n_chars FROM documents),
f AS (SELECT doc_id, 'DOC-01' AS rule_id, 'script' AS layer, 'error' AS severity, CASE WHEN tokens > 2000 THEN 'fail' ELSE 'pass' END AS status, 'tokens: ' || tokens AS message FROM m
      UNION ALL SELECT doc_id, 'DOC-02', 'script', 'error', CASE WHEN private THEN 'fail' ELSE 'pass' END, 'private data' FROM m
      UNION ALL SELECT doc_id, 'DOC-03', 'script', 'warn', CASE WHEN words < 50 THEN 'warn' ELSE 'pass' END, 'words: ' || words FROM m
      UNION ALL SELECT doc_id, 'DOC-04', 'llm', 'warn', CASE WHEN words = 0 THEN 'unverifiable' WHEN latin < 0.6 THEN 'warn' ELSE 'pass' END, 'script of the text' FROM m
      UNION ALL SELECT doc_id, 'DOC-05', 'class+script', 'error', CASE WHEN n_chars IS NULL THEN 'unverifiable' WHEN n_chars = chars THEN 'pass' ELSE 'fail' END, 'declared length' FROM m)
"""
