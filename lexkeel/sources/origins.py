"""From locators in plain text back to the files: path, characters, bytes and the original words.

Every project carries its source map (``projects.PROJECT``): spans of its plain text and where in which file they come from, through
includes, removed commands and composed letters. Locators of a document are looked up together, by bisection in its map; files are
measured once for all that points into them. Only documents and files that something points into are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texscan
from ..functions.identity import parse_locator, source_hash

#: Fixed value: characters of a quote that is shown.
QUOTE_CHARS = 400
ORIGIN = "doc_id string, locator string, part int, path string, char_start int, char_end int, byte_start long, byte_end long, quote string"


def parts(locators: DataFrame, projects: DataFrame) -> DataFrame:
    """``doc_id``, ``locator``, ``part``, ``path``, ``char_start``, ``char_end``: the stretches of files that each distinct locator covers, in order.

    A locator of another text than the project's has a row without a path.
    """
    asked = locators.select("doc_id", "locator").where("locator IS NOT NULL").distinct().withColumn("at", parse_locator(F.col("locator")))
    own = projects.select("doc_id", source_hash(F.col("text")).alias("digest"), F.length("text").alias("total"), F.col("read").alias("files"), "source_map")
    many = asked.groupBy("doc_id").agg(F.collect_list(F.struct("locator", F.col("at.hash").alias("hash"), F.col("at.start").alias("lo"), F.col("at.end").alias("hi"))).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            maps, names = batch.column("source_map"), texscan.Span._fields
            every = maps.flatten()
            # Maps stay columns of numbers; spans are made of those that a locator meets.
            columns = [every.field(name).to_numpy(zero_copy_only=False) for name in names]
            ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(maps).to_pylist())])
            told = batch.select(["doc_id", "asked", "digest", "total", "files"]).to_pylist()
            for k, r in enumerate(told):
                at = columns[0][ends[k] : ends[k + 1]]
                for w in r["asked"]:
                    found = []
                    if w["hash"] == r["digest"] and w["hi"] is not None and w["hi"] <= r["total"]:
                        i, j = max(0, int(np.searchsorted(at, w["lo"], "right")) - 1), int(np.searchsorted(at, w["hi"], "left"))
                        spans = [texscan.Span(*s) for s in zip(*(c[ends[k] + i : ends[k] + j].tolist() for c in columns), strict=True)]
                        found = texscan.parts(spans, [s.at for s in spans], w["lo"], w["hi"])
                    rows += [(r["doc_id"], w["locator"], n, r["files"][no], lo, hi) for n, (no, lo, hi) in enumerate(found)] or [(r["doc_id"], w["locator"], 0, None, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array([row[c] for row in rows], t) for c, t in enumerate(made.types)], schema=made)

    made = pa.schema([("doc_id", pa.string()), ("locator", pa.string()), ("part", pa.int32()), ("path", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())])
    joined = many.join(own, "doc_id", "left")
    return joined.mapInArrow(run, "doc_id string, locator string, part int, path string, char_start int, char_end int")


def resolve(locators: DataFrame, projects: DataFrame, files: DataFrame, max_chars: int = QUOTE_CHARS) -> DataFrame:
    """``ORIGIN``: ``parts`` with the bytes of the file and its own words there, up to ``max_chars`` of them.

    ``locators`` (``doc_id``, ``locator``), ``files`` as ``read_files`` gives them: the words are those of the file as it is, whatever composition it is in.
    """
    found = parts(locators, projects)
    by_file = found.where("path IS NOT NULL").groupBy("doc_id", "path").agg(F.collect_list(F.struct("locator", "part", "char_start", "char_end")).alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, path, asked, content in pdf[["doc_id", "path", "asked", "content"]].itertuples(index=False):
                text = bytes(content).decode()
                points = np.frombuffer(text.encode("utf-32-le"), "<u4")
                upto = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
                for a in asked:
                    lo, hi = a["char_start"], a["char_end"]
                    rows.append((doc, a["locator"], a["part"], path, lo, hi, int(upto[lo]), int(upto[hi]), text[lo : min(hi, lo + max_chars)]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ORIGIN.split(", ")])

    return by_file.join(files.select("doc_id", "path", "content"), ["doc_id", "path"]).mapInPandas(run, ORIGIN)


def finding_origins(findings: DataFrame, projects: DataFrame, files: DataFrame) -> DataFrame:
    """``resolve`` of every locator that findings have as evidence."""
    return resolve(findings.select("doc_id", F.explode("evidence.locator").alias("locator")), projects, files)
