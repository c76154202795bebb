"""LaTeX as columns and, where a counter is needed, as plain functions.

Two readings of a source exist and rules differ in which one they take: ``visible`` drops comments but keeps
literal environments (their text is searched), ``structural`` hides literal environments as well.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import texscan

#: The commands and environments that the rules know.
CITE_NAMES = "cite|parencite|textcite|autocite|supercite|footcite|footcitet|footcitep|footcitetext|smartcite|cites"
CITE = rf"(?i)\\(?:{CITE_NAMES})\*?(?:\[[^\]]*+\])*+\{{([^}}]+)\}}"
CITE_OR_NOCITE = rf"(?i)\\(?:{CITE_NAMES}|nocite)\*?(?:\[[^\]]*+\])*+\{{[^}}]+\}}"
NOCITE = r"(?i)\\nocite\*?\{([^}]+)\}"
FLOAT = r"(?is)\\begin\{(figure|table|longtable)\*?\}(.*?)\\end\{\1\*?\}"
LABEL = r"\\label\{([^}]+)\}"
REF = r"(?i)\\(?:ref|pageref|autoref|eqref|cref|risref)\*?\{([^}]+)\}"
CAPTION = r"(?s)\\caption\*?(?:\[(?:[^{}\]]++|\{[^{}]*+\})*+\])?\{((?:[^{}]++|\{[^{}]*+\})*+)\}"
FOOTNOTE = r"(?is)\\footnote(?:\[[^\]]*\])?\{((?:[^{}]++|\{[^{}]*+\})*+)\}"
MANUAL_CITE = r"\[[0-9]++(?:-[0-9]++)?+(?:,\s*+[0-9]++(?:-[0-9]++)?+)*+\]"
BIBLIOGRAPHY = re.compile(r"\\(addbibresource|bibliography)\s*(?:\[[^\]]*\]\s*)?\{([^{}]*)\}", re.I)


def matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def trimmed(values: Column) -> Column:
    return F.transform(values, lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))


def keys(text: Column, pattern: str) -> Column:
    """Distinct keys of comma-separated arguments."""
    return F.array_distinct(F.filter(trimmed(F.flatten(F.transform(matches(text, pattern), lambda a: F.split(a, ",")))), lambda k: k != ""))


def floats(visible: Column) -> Column:
    """Environments in order: ``env``, ``label`` and ``caption`` (null if missing)."""
    first = lambda s, p: F.nullif(F.get(trimmed(matches(s, p)), F.lit(0)), F.lit(""))
    return F.zip_with(matches(visible, FLOAT, 1), matches(visible, FLOAT, 2), lambda e, b: F.struct(F.lower(e).alias("env"), first(b, LABEL).alias("label"), first(b, CAPTION).alias("caption")))


def references(visible: Column) -> Column:
    """Labels referred to outside floats: a range anti-join, by cutting the ranges out."""
    return F.array_distinct(trimmed(matches(F.regexp_replace(visible, FLOAT, " "), REF)))


def section_body(body: Column, title: Column) -> Column:
    """What stands between the first ``\\section`` whose argument holds a title and the next one; null without it."""
    pattern = F.concat(F.lit(r"(?isu)\\section\*?\{[^{}]*\Q"), F.replace(title, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E[^{}]*\}(.*?)(?=\\section\*?\{|\z)"))
    return F.get(F.regexp_extract_all(body, pattern, F.lit(1)), F.lit(0))


_SECTION = r"(?isu)\\section\*?\{([^{}]*)\}(.*?)(?=\\section\*?\{|\z)"


def section_list(body: Column) -> tuple[Column, Column]:
    """Arguments of all ``\\section`` commands that hold no braces, numbered, in one text for ``section_of``; and what stands behind each."""
    names = F.transform(matches(body, _SECTION, 1), lambda a, i: F.concat(i.cast("string"), F.lit("{"), a, F.lit("}")))
    return F.array_join(names, ""), matches(body, _SECTION, 2)


def section_of(names: Column, bodies: Column, body: Column, title: Column) -> Column:
    """``section_body`` from the ``section_list`` of ``body``: one short search for each title."""
    pattern = F.concat(F.lit(r"(?isu)([0-9]++)\{[^{}]*\Q"), F.replace(title, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E[^{}]*\}"))
    found = F.get(bodies, F.call_function("regexp_extract", names, pattern, F.lit(1)).try_cast("int"))
    # A brace in a title may be one of the source itself.
    return F.when(title.rlike("[{}]"), section_body(body, title)).otherwise(found)


# ---- plain functions, for the extractor ----


def mask_literals(text: str) -> tuple[str, list[str]]:
    """What stands outside literal environments, and those environments."""
    cut = list(texscan.pieces(text))
    return "".join(text[p.start : p.end] for p in cut if p.kind != "literal"), [text[p.start : p.end] for p in cut if p.kind == "literal"]


visible, structural = texscan.visible, texscan.structural


def plain(tex: str) -> str:
    return texscan.read(tex).text


def headings(tex: str, text: str | None = None) -> list[tuple[str, int, int]]:
    """Title, level and place in the plain text of each heading."""
    return [tuple(h) for h in texscan.read(tex).headings]


def expand(files: dict[str, str], main: str) -> tuple[str, list[str], str | None]:
    """A source with its includes put in, the files read in order, and what went wrong (a cycle, a missing file, a path that leaves the project)."""
    got = texscan.expand(files, main)
    return got.text, got.read, got.error


def bibliography_files(tex: str, main: str) -> list[str]:
    """Paths that bibliography commands of an expanded source name."""
    import posixpath

    out = []
    for m in BIBLIOGRAPHY.finditer(tex):
        for name in m[2].split(",") if m[1].lower() == "bibliography" else [m[2]]:
            if name.strip():
                path = posixpath.normpath(posixpath.join(posixpath.dirname(main), name.strip()))
                out.append(path if posixpath.splitext(path)[1] else path + ".bib")
    return list(dict.fromkeys(out))
