"""Window-shaped operators: sections, serial ids, offsets, islands, head and tail, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines of each text with their number and start offset (in code points), by one running sum."""
    parts = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("char_start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))


def section_ends(heads: DataFrame, key: str, start: str, total: Column) -> DataFrame:
    """Adds ``char_end``: where the next section starts, or the text ends."""
    return heads.withColumn("char_end", F.coalesce(F.lead(start).over(Window.partitionBy(key).orderBy(start)), total))


def serial_ids(rows: DataFrame, key: str, base: str, order: str, out: str) -> DataFrame:
    """Identifiers unique in a document: the base, and ``-N`` from its second use on."""
    n = F.row_number().over(Window.partitionBy(key, base).orderBy(order))
    return rows.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), n.cast("string"))))


def islands(rows: DataFrame, key: list[str], number: str) -> DataFrame:
    """Runs of consecutive integers: ``first``, ``last``, ``n`` of each."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(number))
    return rows.select(*key, number).distinct().withColumn("g", F.col(number) - at).groupBy(*key, "g").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n")).drop("g")


def range_text(ranges: DataFrame, key: list[str]) -> DataFrame:
    """Islands as text: ``1-3,7``."""
    piece = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    ordered = F.array_sort(F.collect_list(F.struct("first", piece.alias("t"))))
    return ranges.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ",").alias("ranges"))


def runs(rows: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Numbers maximal runs of equal labels, each row against the one before it."""
    by = Window.partitionBy(key).orderBy(*order)
    changed = F.coalesce((F.col(label) != F.lag(label).over(by)).cast("int"), F.lit(1))
    return rows.withColumn("__c", changed).withColumn("run", F.sum("__c").over(by)).drop("__c")


def head_tail(rows: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """The first ``ceil(limit / 2)`` and last ``floor(limit / 2)`` rows of each key, all if there are no more than ``limit``."""
    by = Window.partitionBy(key)
    n, at = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy(*order))
    head, tail = (limit + 1) // 2, limit // 2
    return rows.withColumns({"__n": n, "__at": at}).where((F.col("__n") <= limit) | (F.col("__at") <= head) | (F.col("__at") > F.col("__n") - tail)).drop("__n", "__at")


def in_order(found: Column) -> Column:
    """How many leading targets an array of match sets meets in order: each entry holds the targets that it matches."""
    return F.aggregate(found, F.lit(0), lambda i, m: F.when(F.array_contains(m, i), i + 1).otherwise(i))


# ---- chunks ----

CHUNK = "seq int, text string, token_count int, char_start int, content_start int, char_end int, overlap_chars int"
_BREAKS = (re.compile(r"\n\s*\n"), re.compile(r"[.!?…][\"'»)]*\s+"), re.compile(r"\s+"))


def _utf8_offsets(text: str) -> list[int] | range:
    """Byte offset of each code point; a range where every one takes a byte."""
    if text.isascii():
        return range(len(text) + 1)
    out, at = [0], 0
    for c in text:
        at += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
        out.append(at)
    return out


def chunk_text(text: str, budget: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """``(start, content start, end)`` of chunks within ``budget`` tokens, the first ``overlap`` of them repeated at most.

    A token is four bytes of UTF-8, so the furthest end within a budget follows from byte offsets
    by bisection. An end moves back to the last paragraph, sentence or word break in the last two thirds of
    the new content.
    """
    from bisect import bisect_left, bisect_right

    size, offsets, at = len(text), _utf8_offsets(text), 0
    while at < size:
        start = at
        if at and overlap:
            start = min(at, bisect_left(offsets, offsets[at] - 4 * overlap))
        end = min(size, max(start + 1, bisect_right(offsets, offsets[start] + 4 * budget) - 1))
        if end < size and end > at:
            least = max(1, (end - at) // 3)
            for pattern in _BREAKS:
                last = max((m.end() for m in pattern.finditer(text, at, end)), default=at)
                if last - at >= least:
                    end = last
                    break
        end = end if end > at else min(size, at + 1)
        yield start, at, end
        at = end


def chunks(sections: DataFrame, keys: list[str], budget: int = 800, overlap_ratio: float = 0.1) -> DataFrame:
    """Chunks of each row's ``text``: the columns of ``CHUNK`` beside ``keys``. One pass, no shuffle."""
    if budget < 1 or not 0 <= overlap_ratio <= 0.1:
        raise ValueError("the budget must be positive and the overlap at most a tenth")
    overlap = int(budget * overlap_ratio)
    names = [c.split()[0] for c in CHUNK.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int32() for c in CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                text = b.column(b.num_columns - 1)[row].as_py() or ""
                found = [(n, text[s:e], -(-len(text[s:e].encode()) // 4), s, c, e, c - s) for n, (s, c, e) in enumerate(chunk_text(text, budget, overlap), 1)]
                if found:
                    at = pa.array([row] * len(found), pa.int64())
                    cols = [pa.array(v, k) for v, k in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[:-1]], *cols], [*b.schema.names[:-1], *names])

    schema = sections.select(*keys, *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CHUNK.split(", ")]).schema
    return sections.select(*keys, F.col("text").alias("__text")).mapInArrow(run, schema)


def quote_spans(text: Column, limit: int = 4) -> Column:
    """Fragments of at most ``limit`` words that end at line ends and sentence marks, in order.

    The text is cut where a fragment must end; inside, words are taken ``limit`` at a time.
    """
    pieces = F.split(text, r"(?=\s)(?:(?<=[.!?;])\s+|\s*\n\s*)")
    words = F.lit(rf"(?:\S++\s*+){{1,{limit}}}")
    cut = lambda piece: F.transform(F.regexp_extract_all(piece, words, F.lit(0)), lambda w: F.rtrim(w))
    return F.filter(F.flatten(F.transform(pieces, cut)), lambda s: s != "")
