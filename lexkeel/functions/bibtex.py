"""BibTeX entries. Braces nest, so this is a scanner, not an expression."""

from __future__ import annotations

import re
from collections.abc import Iterator

_TOKEN = re.compile(r"[{}]")


def _balanced(text: str, at: int) -> int:
    """Place of the brace that closes the one at ``at``; -1 without one."""
    depth = 0
    for m in _TOKEN.finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return -1


def _value(body: str, at: int) -> tuple[str, int] | None:
    at += len(body[at:]) - len(body[at:].lstrip())
    if at >= len(body):
        return None
    if body[at] == "{":
        end = _balanced(body, at)
        return None if end < 0 else (body[at + 1 : end], end + 1)
    if body[at] == '"':
        m = re.compile(r'"((?:\\.|[^"\\])*)"', re.S).match(body, at)
        return (re.sub(r"\\(.)", r"\1", m[1], flags=re.S), m.end()) if m else None
    m = re.compile(r"[^,\n]*").match(body, at)
    return m[0].strip(), m.end()


def entries(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Key, type and fields of each entry; names in lower case, a cut-off entry ends the scan, one without a key is skipped."""
    at = 0
    while (at := text.find("@", at)) >= 0:
        brace = text.find("{", at)
        end = _balanced(text, brace) if brace >= 0 else -1
        if end < 0:
            return
        kind, body = text[at + 1 : brace].strip().casefold(), text[brace + 1 : end]
        at = end + 1
        key, comma, rest = body.partition(",")
        if not comma or not key.strip():
            continue
        fields: dict[str, str] = {}
        pos = 0
        while (equals := rest.find("=", pos)) >= 0:
            got = _value(rest, equals + 1)
            if got is None:
                break
            fields[rest[pos:equals].strip(" \t\r\n,").casefold()] = got[0].strip()
            pos = got[1]
        yield key.strip(), kind, fields
