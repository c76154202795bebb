"""Digests that don't depend on the order of rows, on the composition of letters or on where a project lies.

``path_digests`` follows the stable order of paths (composed, case-folded); ``table_digest`` adds up the digests of rows in canonical form, so parts of a table
can be digested apart and in any order; ``bundle_digest`` is one over several tables.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .identity import json_string


def path_key(path: Column) -> Column:
    """A path composed (NFC) and case-folded; ASCII paths, which are most, stay in the JVM."""

    @F.pandas_udf("string")
    def folded(batch: pd.Series) -> pd.Series:
        return batch.map(lambda p: unicodedata.normalize("NFC", p).casefold(), na_action="ignore")

    return F.when(path.rlike(r"[^\x00-\x7F]"), folded(path)).otherwise(F.lower(path))


def unique_paths(files: DataFrame, by: str, order: str) -> DataFrame:
    """Of paths of one ``by`` that differ in composition or case only, the first in ``order``."""
    first = Window.partitionBy(by, "__key").orderBy(order, "path")
    return files.withColumn("__key", path_key(F.col("path"))).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__key", "__n")


def path_digests(files: DataFrame, by: str, mark: str = "\x00") -> DataFrame:
    """``by``, ``n_files`` and ``digest`` of files (``by``, ``path``, ``sha256``): paths and digests of contents in the stable order, each closed by ``mark``.

    A file's row is a path and a digest, so a bundle of a million files is some 100 MB in the task that orders it.
    """
    item = F.struct(path_key(F.col("path")).alias("key"), "path", "sha256")
    listed = files.select(by, item.alias("f")).groupBy(by).agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_list("f")).alias("f"))
    told = F.array_join(F.transform("f", lambda f: F.concat(f["path"], F.lit(mark), f["sha256"], F.lit(mark))), "")
    return listed.select(by, "n_files", F.sha2(told, 256).alias("digest"))


def canonical(value: Column, kind: T.DataType) -> Column:
    """JSON with sorted names, no spaces and no null members, at any depth; null is ``null``."""
    if isinstance(kind, T.StructType):
        parts = [F.when(value[f.name].isNotNull(), F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), canonical(value[f.name], f.dataType))) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), F.when(e["value"].isNotNull(), canonical(e["value"], kind.valueType)).alias("v"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.filter(entries, lambda e: e["v"].isNotNull()), lambda e: F.concat(json_string(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        text = json_string(value)
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit('"'), F.lower(F.hex(value)), F.lit('"'))
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("null"))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of the canonical form of a row; the order of columns doesn't count."""
    return F.sha2(canonical(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema), 256)


_LANES = 8


def _lanes(digest: Column) -> list[Column]:
    """A digest's 256 bits as eight numbers, whose sums stay exact."""
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)") for i in range(_LANES)]


def _sums(by: list[str], df: DataFrame) -> list[Column]:
    """Number of rows and sums of their digests: what digests of parts add up to."""
    lanes = _lanes(row_digest(df.drop(*by)))
    return [F.count(F.lit(1)).alias("n_rows"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(lanes)]]


def table_digest(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by``, ``n_rows`` and ``digest`` of the rows, whatever their order: a hash over how many there are and what their digests add up to."""
    sums = df.groupBy(*(by or [])).agg(*_sums(by or [], df))
    told = F.concat_ws(",", F.col("n_rows").cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(_LANES)])
    return sums.select(*(by or []), "n_rows", F.sha2(told, 256).alias("digest"))


def bundle_digest(tables: dict[str, DataFrame], by: str) -> DataFrame:
    """``by`` and ``digest`` of several tables together; one without rows of a key counts as an empty one."""
    every = None
    for name in sorted(tables):
        one = table_digest(tables[name], [by]).select(by, F.struct(F.lit(name).alias("name"), "digest").alias("d"))
        every = one if every is None else every.unionByName(one)
    listed = every.groupBy(by).agg(F.array_sort(F.collect_list("d")).alias("d"))
    return listed.select(by, F.sha2(F.array_join(F.transform("d", lambda d: F.concat(d["name"], F.lit("="), d["digest"])), ";"), 256).alias("digest"))


#: Folders that a path is told from where its root isn't known.
ANCHORS = ("tests", "src", "docs", "templates", "schemas")


def relative_path(path: Column, root: str | None = None) -> Column:
    """A path as seen from a project's root: that prefix goes whatever its case; of other absolute paths what stands from the first ``ANCHORS`` folder on, else the name. Slashes lean one way."""
    text = F.replace(path, F.lit("\\"), F.lit("/"))
    absolute = path.rlike(r"^[A-Za-z]:[\\/]") | text.startswith("/")
    parts = F.filter(F.split(text, "/"), lambda p: ~p.isin("", "."))
    found = F.coalesce(*[F.when(F.array_contains(parts, a), F.array_join(F.slice(parts, F.array_position(parts, a).cast("int"), F.size(parts)), "/")) for a in ANCHORS], F.element_at(parts, -1), text)
    out = F.when(absolute, found).otherwise(text)
    if root:
        base = root.replace("\\", "/").rstrip("/").lower() + "/"
        out = F.when(F.lower(text).startswith(base), F.substring(text, len(base) + 1, 2**31 - 1)).otherwise(out)
    return out
