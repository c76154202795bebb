"""Hashes, locators and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCATOR = r"^sha256:([0-9a-f]{64}):([0-9]+)-([0-9]+)$"


def source_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def locator(digest: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("sha256:"), digest, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def parse_locator(value: Column) -> Column:
    """Struct of ``hash``, ``start`` and ``end``; null unless well formed with start before end."""
    start, end = (F.regexp_extract(value, LOCATOR, i) for i in (2, 3))
    parsed = F.struct(F.regexp_extract(value, LOCATOR, 1).alias("hash"), start.try_cast("long").alias("start"), end.try_cast("long").alias("end"))
    return F.when(value.rlike(LOCATOR) & (parsed["start"] < parsed["end"]), parsed)


def json_string(value: Column) -> Column:
    """A JSON string literal, non-ASCII characters as they are."""
    s = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        s = F.replace(s, F.lit(raw), F.lit(shown))
    rare = s
    for code in (*range(8), 11, *range(14, 32)):  # what else JSON escapes, by rule
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    s = F.when(s.rlike(r"[\x00-\x1F]"), rare).otherwise(s)
    return F.concat(F.lit('"'), s, F.lit('"'))


def canonical_finding(f: str = "") -> Column:
    """A finding as JSON with sorted keys, no spaces and no null members."""
    c = lambda name: F.col(f + name)
    item = lambda e: F.concat(F.lit("{"), F.concat_ws(",", F.when(e["description"].isNotNull(), F.concat(F.lit('"description":'), json_string(e["description"]))), F.concat(F.lit('"locator":'), json_string(e["locator"]))), F.lit("}"))
    evidence = F.concat(F.lit('"evidence":['), F.array_join(F.transform(F.coalesce(c("evidence"), F.array().cast("array<struct<locator:string,description:string>>")), item), ","), F.lit("]"))
    text = lambda name: F.when(c(name).isNotNull(), F.concat(F.lit(f'"{name}":'), json_string(c(name))))
    page = F.when(c("page").isNotNull(), F.concat(F.lit('"page":'), c("page").cast("string")))
    return F.concat(F.lit("{"), F.concat_ws(",", evidence, text("layer"), text("message"), page, text("path"), text("rule_id"), text("severity"), text("status")), F.lit("}"))


def fingerprint(f: str = "") -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_finding(f), 256))


def cache_digest(*parts: Column) -> Column:
    """Key of a stage's inputs: SHA-256 of the parts joined by ``|``."""
    return F.sha2(F.concat_ws("|", *parts), 256)
