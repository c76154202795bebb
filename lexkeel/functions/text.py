"""Scalar text functions as columns.

Java's regular expressions are ASCII by default, so word and letter classes are spelt out; the
same patterns then mean the same in RE2. Offsets are code points everywhere.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SPACES = r"[\s\x{85}\p{Z}]+"


def utf8(content: Column) -> Column:
    """Bytes as text; null where they are not UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def nfc(text: Column) -> Column:
    """Composed text; the JVM's functions have no normal forms, so it runs in Arrow batches, on text that isn't plain ASCII only."""

    @F.pandas_udf("string")
    def composed(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.when(text.rlike(r"[^\x00-\x7F]"), composed(text)).otherwise(text)


def estimate_tokens(text: Column) -> Column:
    """A token for every four UTF-8 bytes begun; none for an empty text."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def compound_word_count(text: Column) -> Column:
    """Words in which a hyphen or apostrophe between word characters does not end the word."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"{WORD}+(?:[-'’]{WORD}+)*+"), F.lit(0)))


def keep_only(text: Column, negated_class: str) -> Column:
    return F.length(F.regexp_replace(text, negated_class + "+", ""))


def latin_ratio(text: Column) -> Column:
    """Latin letters among letters; 0 without letters."""
    letters = keep_only(text, r"[^\p{L}]")
    return F.coalesce(F.try_divide(keep_only(text, "[^A-Za-z]"), letters), F.lit(0.0))


def first_year(text: Column) -> Column:
    """The first 19xx or 20xx in a text, else null."""
    return F.nullif(F.regexp_extract(text, r"((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def significant_chars(text: Column) -> Column:
    """Code points that are neither white space nor of a control, format or unassigned category."""
    return keep_only(text, r"[\s\p{Z}\p{C}]")


def repeated_key(text: Column) -> Column:
    """What running headers have in common: lower-case words whose digits are all ``#``."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.regexp_replace(F.array_join(words, " "), "[0-9]+", "#")


def plain_title(title: Column) -> Column:
    """A heading without numbering, case and punctuation."""
    t = F.translate(F.lower(title), "ё", "е")
    t = F.regexp_replace(t, r"^\s*(?:глава|раздел)\s+[0-9]+[.\s:—-]*", "")
    t = F.regexp_replace(t, r"^\s*+[0-9]++(?:\.[0-9]++(?=[.\s:—-]))*+[.\s:—-]++", "")
    return F.array_join(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), " ")


def slug(title: Column) -> Column:
    """An identifier of at most 48 characters; ``section`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(plain_title(title), rf"[^{WORD[1:-2]}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 48), F.lit("")), F.lit("section"))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_plain(text: Column) -> Column:
    """Line ends, blanks and blank lines in one form."""
    t = F.regexp_replace(text, r"\r\n|\r", "\n")
    t = F.regexp_replace(F.translate(t, " ", " "), r"[\t\f\x0B ]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def strip_comments(tex: Column) -> Column:
    """Drops ``%`` comments that an even number of backslashes precedes, up to the line's end."""
    return F.regexp_replace(tex, r"(?m)(?<!\\)((?:\\\\)*)%[^\n\r]*", "$1")


def code_score(text: Column) -> Column:
    """How much a line looks like code: keywords, and a bonus for each kind of code punctuation."""
    words = F.size(F.regexp_extract_all(F.lower(text), F.lit(r"\b(?:def|class|return|import|from|for|while|if|else|int|void|public|static|function|var|const)\b"), F.lit(0)))
    marks = [F.when(text.rlike(p), 1).otherwise(0) for p in (r"[{};]", r"\w\(.*\)", r"==|!=|<=|>=|->|:=", r"^\s*(?:#|//)")]
    return words + sum(marks[1:], marks[0])


def title_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity, as the standard library defines it; for distinct titles only."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()
