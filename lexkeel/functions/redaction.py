"""What published output must not hold: credentials, addresses, user paths, prompts, tracebacks.

Replacements run in a fixed order, since a later pattern may see what an earlier one left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Markers, lengths and patterns of the published contract.
MARK, PATH_MARK, TRACE_MARK, CUT_MARK, MAX_CHARS = "[REDACTED]", "[REDACTED_PATH]", "[REDACTED_TRACEBACK]", "[TRUNCATED]", 240
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
ASSIGN = r"""(?i)(\b(?:api[_-]?key|token|secret|password|authorization|llm_api_key)\b\s*[:=]\s*)(['"]?)[^\s,;'")}\]]+"""
API_KEY = r"\b(?:sk-[A-Za-z0-9_-]{8,}|AQVN[A-Za-z0-9_-]{8,})\b"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{8,}=*"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
WINDOWS_PATH = r"""(?i)(?<![A-Za-z0-9_])(?:[A-Z]:[\\/]|\\\\[^\\/\s]+[\\/])[^ \t\r\n,;:'"<>|?*]+"""
POSIX_PATH = r"""(?<![\p{L}\p{N}_:/])/[^/ \t\r\n,;:'"<>{}\[\]()]++(?:/[^/ \t\r\n,;:'"<>{}\[\]()]++)*+"""
HOME_PATH = r"""(?<![A-Za-z0-9_])~/[^ \t\r\n,;:'"<>{}\[\]()]+"""
PROMPT = r"""(?is)(\b(?:raw_prompt|prompt_text|system_prompt|llm_prompt)\b\s*[:=]\s*)(['"]).*?\2"""
TRACEBACK = r"(?ims)\s*^Traceback \(most recent call last\):.*\z"


#: What a text must hold, in lower case, for a pattern to match anywhere in it; far cheaper to look for than the pattern.
NEEDS = {ASSIGN: ("key", "token", "secret", "password", "authorization"), API_KEY: ("sk-", "aqvn"), BEARER: ("bearer",), EMAIL: ("@",), WINDOWS_PATH: (":/", "\\"), POSIX_PATH: ("/",), HOME_PATH: ("~/",), PROMPT: ("prompt",), TRACEBACK: ("traceback",)}


def may_match(lower: Column, pattern: str) -> Column:
    """Whether a text, given in lower case, holds what ``pattern`` needs."""
    out = F.lit(False)
    for part in NEEDS[pattern]:
        out = out | F.contains(lower, F.lit(part))
    return out


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def redact_text(text: Column) -> Column:
    """Replacements bring in none of ``NEEDS``, so what the text holds at first decides for all of them."""
    steps = [(ASSIGN, "$1" + MARK), (API_KEY, MARK), (BEARER, f"Bearer {MARK}"), (EMAIL, MARK), (WINDOWS_PATH, PATH_MARK), (POSIX_PATH, PATH_MARK), (HOME_PATH, PATH_MARK), (PROMPT, "$1" + MARK), (TRACEBACK, f" {TRACE_MARK}")]

    def gated(t: Column, low: Column, left: list) -> Column:
        if not left:
            return F.when(may_match(low, TRACEBACK), F.regexp_replace(t, rf"^\s+(?=\{TRACE_MARK[:-1]}\]$)", "")).otherwise(t)
        (pattern, shown), *rest = left
        return _let(F.when(may_match(low, pattern), F.regexp_replace(t, pattern, shown)).otherwise(t), lambda u: gated(u, low, rest))

    return _let(F.regexp_replace(text, CONTROL, ""), lambda t: _let(F.lower(t), lambda low: gated(t, low, steps)))


def truncate_public(text: Column) -> Column:
    """At most ``MAX_CHARS`` characters, and a mark where more were cut."""
    cut = F.regexp_replace(F.substring(text, 1, MAX_CHARS), r"\s+$", "")
    return F.when(F.length(text) <= MAX_CHARS, text).otherwise(F.concat(cut, F.lit("… " + CUT_MARK)))


def public_text(text: Column) -> Column:
    return _let(redact_text(text), truncate_public)


def evidence_text(text: Column) -> Column:
    """For Markdown reports: one line, redacted, cut, HTML and Markdown escaped."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, CONTROL, ""), r"\s+", " "))
    t = public_text(t)
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(raw), F.lit(shown))
    t = F.regexp_replace(t, r"([\\`*])", r"\\$1")
    t = F.regexp_replace(t, r"(!?)\[([^\]\r\n]*)\]\(", r"$1\\[$2\\](")
    return F.regexp_replace(t, r"(?<![\p{L}\p{N}_])_(?=\S)|(?<=\S)_(?![\p{L}\p{N}_])", r"\\_")


# ---- nested data ----

#: Names whose values never leave, whatever they hold, and names whose texts are cut.
SECRET_KEYS = ("api_key", "apikey", "authorization", "llm_api_key", "password", "secret", "token")
TRACE_KEYS = ("provider_traceback", "stack_trace", "traceback")
PROMPT_KEYS = ("raw_prompt", "prompt_text", "system_prompt", "llm_prompt")
CUT_KEYS = ("description", "message", "quote")


def _marker(key: str) -> str | None:
    name = key.casefold()
    return TRACE_MARK if name in TRACE_KEYS else MARK if name in (*PROMPT_KEYS, *SECRET_KEYS) else None


def _variant(value: Column, key: str) -> Column:
    """A value of unknown shape: a text is redacted, a number stays, anything that has names inside goes."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    held = F.when(kind == "STRING", _text(text, key)).when(kind.rlike("OBJECT|ARRAY"), F.lit(MARK))
    return F.when(held.isNotNull(), held.cast("variant")).otherwise(value)


def _text(value: Column, key: str) -> Column:
    return public_text(value) if key.casefold() in CUT_KEYS else redact_text(value)


def redact_value(value: Column, kind: T.DataType, key: str = "") -> Column:
    """``value`` without secrets at any depth: the transform follows its type. A struct's field of a secret name becomes a marker, whatever its type was.

    A map's entries of secret names become the marker if the map holds texts, else null.
    """
    if isinstance(kind, T.StringType):
        return _text(value, key)
    if isinstance(kind, T.StructType):
        fields = [(F.lit(mark) if (mark := _marker(f.name)) else redact_value(value[f.name], f.dataType, f.name)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_value(x, kind.elementType, key))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        name, texts = F.lower, isinstance(kind.valueType, T.StringType)

        def entry(k: Column, v: Column) -> Column:
            plain = redact_value(v, kind.valueType)
            if texts:
                plain = F.when(name(k).isin(*CUT_KEYS), public_text(v)).otherwise(plain)
            gone = (lambda mark: F.lit(mark)) if texts else (lambda mark: F.lit(None).cast(kind.valueType))
            return F.when(name(k).isin(*TRACE_KEYS), gone(TRACE_MARK)).when(name(k).isin(*PROMPT_KEYS, *SECRET_KEYS), gone(MARK)).otherwise(plain)

        return F.transform_values(value, entry)
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _k, v: redact_value(v, kind.valueType, key))
    return _variant(value, key) if isinstance(kind, T.VariantType) else value


def redact_frame(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every column but ``keep``, by its name and type."""
    named = [(f.name, F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return df.select(*[(c if n in keep else F.lit(mark) if (mark := _marker(n)) else redact_value(c, t, n)).alias(n) for n, c, t in named])


def json_shape(df: DataFrame, column: str) -> T.DataType:
    """The type that all JSON texts of a column fit, found in one aggregate; where they differ in kind it is VARIANT, null throughout is text."""
    told = df.select(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("s")).first()["s"] or "VOID"
    ddl = re.sub(r"\bOBJECT<", "STRUCT<", told)
    return T.StructType.fromDDL("value " + re.sub(r"\bVOID\b", "STRING", ddl))["value"].dataType


def redact_json(df: DataFrame, column: str, shape: T.DataType | None = None) -> DataFrame:
    """``df`` with ``column``, JSON texts without a declared schema, redacted by key at any depth. What is no JSON is redacted as text.

    Members that are null are left out, names come in order.
    """
    kind = shape or json_shape(df, column)
    text, parsed, value = F.col(column), F.col("__parsed"), F.col("__value")
    # Columns of their own, or every field would parse the text again.
    read = df.withColumn("__parsed", F.try_parse_json(text)).withColumn("__value", F.try_variant_get("__parsed", "$", kind.simpleString()))
    clean = redact_value(value, kind)
    shown = F.to_json(clean) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) else clean.cast("string")
    return read.withColumn(column, F.when(parsed.isNull(), redact_text(text)).when(value.isNull() & text.isNotNull(), F.lit("null") if isinstance(kind, T.StructType) else shown).otherwise(shown)).drop("__parsed", "__value")


#: Patterns and length of the log's contract.
LOG_KEY = r"\bsk-[A-Za-z0-9_-]{8,}\b"
LOG_ASSIGN = r"""(?i)(\b(?:api[_-]?key|token|secret|password|authorization)\b\s*[:=]\s*)(['"]?)[^\s,;'")}\]]+(['"]?)"""
LOG_BODY = r"""(?is)(\b(?:document_text|thesis_text|vkr_text)\b\s*[:=]\s*)(['"]).*?\2"""
LOG_CHARS = 500


def log_text(text: Column, limit: int | None = LOG_CHARS) -> Column:
    """For logs: no credentials, no text of a document, and a bounded length."""
    t = F.regexp_replace(F.regexp_replace(text, LOG_KEY, MARK), BEARER, f"Bearer {MARK}")
    t = F.regexp_replace(F.regexp_replace(t, LOG_ASSIGN, "$1" + MARK), LOG_BODY, "$1" + MARK)
    return t if limit is None else F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("...[TRUNCATED]"))).otherwise(t)
