"""YAML sources: protected-file policies, rulebooks, configurations, labelled catalogs.

YAML is strict here: a repeated key is an error. PyYAML is optional; without it these sources say so.
"""

from __future__ import annotations

import re
from pathlib import PurePosixPath
from re._parser import SubPattern  # the standard library's own parser of patterns
from re._parser import parse as parse_pattern
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rulebook import RulebookError

POLICY = "protected-files.yaml"


def parse(text: str) -> Any:
    """A YAML document; a key that occurs twice in a mapping is refused."""
    try:
        import yaml
    except ImportError as e:
        raise RulebookError("YAML sources need PyYAML") from e

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        out = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=True)
            if key in out:
                raise RulebookError(f"repeated key {key!r} in line {k.start_mark.line + 1}")
            out[key] = loader.construct_object(v, deep=True)
        return out

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    try:
        return yaml.load(text, Strict)
    except yaml.YAMLError as e:
        raise RulebookError("not valid YAML") from e


def merge(base: Any, over: Any) -> Any:
    """Mappings merge key by key, anything else is replaced by the later value."""
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: merge(base[k], over[k]) if k in base and k in over else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}
    return over


def load_config(read, path: str, above: tuple[str, ...] = ()) -> dict:
    """A configuration and those it includes, later ones over earlier; ``read(path)`` gives texts, a cycle is an error."""
    if path in above:
        raise RulebookError("configuration includes itself")
    own = parse(read(path)) or {}
    names = own.pop("include", [])
    out: dict = {}
    for name in [names] if isinstance(names, str) else names:
        out = merge(out, load_config(read, str(PurePosixPath(path).parent / name), (*above, path)))
    return merge(out, own)


def policies(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of protected files and of forbidden patterns from the policy file of each project; ``policy_faults`` has what is wrong with the others."""
    got = _policy_rows(files)
    protected = got.where("what = 'file'").select("doc_id", "pos", F.col("a").alias("path"), F.col("b").alias("sha256"))
    # A policy that cannot be used stands as a row without a pattern, so that its project is not passed.
    fault = F.col("what") == "fault"
    return protected, got.where("what <> 'file'").select("doc_id", "pos", F.when(~fault, F.col("a")).alias("pattern"), F.when(fault, F.col("a")).otherwise(F.col("b")).alias("message"))


def _rows_of(policy: Any) -> list[tuple[str, int, str, str]]:
    """What a policy holds; anything out of shape is an error. A pattern must compile, here and in Java's engine."""
    if not isinstance(policy, dict):
        raise RulebookError("a policy is a mapping")
    allowed = policy.get("allowed_renewcommand") or []
    if not isinstance(allowed, list) or not all(isinstance(x, str) and x.strip() for x in allowed):
        raise RulebookError("allowed_renewcommand is a list of names")
    out, paths = [], [x.get("path") for x in policy.get("class_files") or [] if isinstance(x, dict)]
    if len(set(map(str, paths))) != len(paths):
        raise RulebookError("class_files names a path twice")
    for what, part, names in (("file", "class_files", ("path", "sha256")), ("pattern", "forbidden_preamble", ("pattern", "message"))):
        for i, x in enumerate(policy.get(part) or []):
            if not isinstance(x, dict) or not all(isinstance(x.get(n), str) for n in names):
                raise RulebookError(f"{part} needs {' and '.join(names)} in each entry")
            row = [x[n] for n in names]
            if what == "file" and not re.fullmatch("[0-9a-f]{64}", x["sha256"]):
                raise RulebookError(f"not a SHA-256: {x['sha256'][:80]}")
            if what == "pattern":
                try:
                    re.compile(x["pattern"])
                except re.error as e:
                    raise RulebookError(f"not a valid pattern: {x['pattern']}") from e
                if _may_run_away(x["pattern"]):
                    raise RulebookError(f"a pattern repeats what itself varies: {x['pattern']}")
                if JAVA_DIFFERS.search(x["pattern"]):
                    raise RulebookError(f"not a portable pattern: {x['pattern']}")
                row[0] = LITERAL_BRACE.sub(r"\\{", x["pattern"])
            out.append((what, i, *row))
    return out


def _may_run_away(pattern: str) -> bool:
    """Whether a group without a bound holds a choice or another repetition.

    On such a group an engine that backtracks takes a stack frame a round, or exponential time: one project's pattern would end everybody's run.
    """

    def walk(items: Any, repeated: bool) -> bool:
        for op, arg in items:
            name = str(op)
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, inner = arg
                varies = high != low
                simple = len(inner) == 1 and str(inner[0][0]) in ("LITERAL", "NOT_LITERAL", "ANY", "IN", "CATEGORY")
                if repeated and varies:
                    return True
                if walk(inner, repeated or (not simple and high > MANY)):
                    return True
            elif name == "IN" and repeated and "|" in pattern:  # the parser makes a class of a choice between letters
                return True
            elif name == "BRANCH" and (repeated or any(walk(b, repeated) for b in arg[1])):
                return True
            elif name in ("SUBPATTERN", "ASSERT", "ASSERT_NOT", "ATOMIC_GROUP", "GROUPREF_EXISTS"):
                for inner in arg if isinstance(arg, tuple) else (arg,):
                    if isinstance(inner, SubPattern) and walk(inner, repeated):
                        return True
        return False

    return walk(parse_pattern(pattern), False)


#: Rounds of a group that need no thought about the stack.
MANY = 100


#: What Python's engine accepts and Java's does not, or reads otherwise: named groups and conditionals of Python, a bracket or ``&&`` inside a class, and escapes of letters.
JAVA_DIFFERS = re.compile(r"\(\?(?:P|\(|[aLu]*[aLu])|\[\^?\]|\[[^\]\\]*(?:\[|&&)|\\[NpPUQEGKR]|\\$")


#: A brace that counts nothing is a literal in Python and an error in Java.
LITERAL_BRACE = re.compile(r"(?<!\\)\{(?![0-9]+(?:,[0-9]*)?\}|,[0-9]+\})")


def _policy_rows(files: DataFrame) -> DataFrame:
    def rows(batches):
        for pdf in batches:
            out = []
            for doc, raw in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    out += [(doc, *row) for row in _rows_of(parse(bytes(raw).decode()) or {})]
                except UnicodeDecodeError:
                    out.append((doc, "fault", 0, "not UTF-8", None))
                except RulebookError as e:
                    out.append((doc, "fault", 0, str(e), None))
                except Exception as e:
                    out.append((doc, "fault", 0, f"not usable: {type(e).__name__}", None))
            yield pd.DataFrame(out, columns=["doc_id", "what", "pos", "a", "b"])

    return files.where(F.col("path") == POLICY).select("doc_id", "content").mapInPandas(rows, "doc_id string, what string, pos int, a string, b string")


def policy_faults(files: DataFrame) -> DataFrame:
    """``doc_id``, ``path`` and ``problem`` of the policies that cannot be used."""
    return _policy_rows(files).where("what = 'fault'").select("doc_id", F.lit(POLICY).alias("path"), F.col("a").alias("problem"))


def labels(spark: SparkSession, text: str) -> DataFrame:
    """A labelled catalog: ``fixture_id``, ``rule_id``, ``expected``."""
    rows = [(f["id"], rule, want) for f in parse(text)["fixtures"] for rule, want in (f.get("labels") or {}).items()]
    if bad := sorted({w for _, _, w in rows} - {"silent", "fail", "warn", "detect"}):
        raise RulebookError(f"unknown labels: {', '.join(bad)}")
    return spark.createDataFrame(rows, "fixture_id string, rule_id string, expected string")
