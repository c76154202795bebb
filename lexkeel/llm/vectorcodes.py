"""Vector code compression: product codes by integer k-means over columnar NumPy blocks.

1. ``blocks`` turns vectors into rows of a few thousand vectors each: components as integers ``floor(scale * x)``, cut into parts, each part a NumPy block stored
   dimension by dimension. The table of blocks is written once and read in every round.
2. ``train``: a round is one ``treeAggregate`` over the RDD of blocks. A task assigns a block's parts to their nearest entries (distances accumulate one dimension after the
   other), adds them up in ``int64`` tensors of sums and counts with ``np.add.at``, and the tensors, whose size is that of the codebooks, merge through a tree.
3. ``encode`` assigns all parts once more; ``with_label_error`` sums errors by label.

All arithmetic is in integers, so no order of tasks and no retry changes a result; a tile of 512 vectors by 256 entries is in memory at a time.

Edge cases: vectors that are null or hold null or non-finite components take no part; so don't those of another length than most (ties: the shorter one). A length that the parts don't divide
gives parts that differ by one. Integers beyond ``BOUND`` count as ``BOUND``, so that sums of squares fit; with fewer vectors than entries the codebooks are
smaller; repeated rows count each; of one id with several vectors the codebooks start with the smallest, a null id starts none; an unused entry stays, the lower of
equally near entries wins; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, materialize, table


@dataclass(frozen=True)
class Codes:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


BOUND = (1 << 28) - 1
_BLOCK_ROWS, _TILE = 4_096, 512


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``vector`` (double) and ``label`` of the vectors that take part."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label").where(F.col("vector").isNotNull() & F.forall("vector", real))
    sizes = kept.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("size"))).alias("m")).first()["m"]
    return kept.where(F.size("vector") == (most["size"] if most else -1))


def integers(vectors: np.ndarray, p: Codes) -> np.ndarray:
    return np.clip(np.floor(vectors * p.scale), -BOUND, BOUND).astype(np.int32)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // len(column))


def _cuts(dims: int, p: Codes) -> list[slice]:
    return [slice(i * dims // p.parts, (i + 1) * dims // p.parts) for i in range(p.parts)]


def blocks(rows: DataFrame, p: Codes = Codes()) -> DataFrame:
    """``ids``, ``labels`` and ``parts`` (little-endian ``int32``, dimension by dimension), a row for up to ``_BLOCK_ROWS`` vectors."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _BLOCK_ROWS):
                some = b.slice(at, _BLOCK_ROWS)
                x = integers(_matrix(some.column(1)), p)
                listed = [pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some.column(i)) for i in (0, 2)]
                parts = pa.array([[np.ascontiguousarray(x[:, cut].T).tobytes() for cut in _cuts(x.shape[1], p)]])
                yield pa.RecordBatch.from_arrays([*listed, parts], ["ids", "labels", "parts"])

    made = rows.select(F.col("vec_id").cast("long"), "vector", "label").mapInArrow(run, f"ids array<long>, labels array<{label}>, parts array<binary>")
    return materialize(made, "codes-blocks")


def first_codebooks(rows: DataFrame, p: Codes = Codes()) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids, in order: ``entries`` vectors at most come to the driver."""
    ids = rows.select("vec_id").where("vec_id IS NOT NULL").distinct().orderBy("vec_id").limit(p.entries)
    last = ids.agg(F.max("vec_id")).first()[0]
    if last is None:
        return []
    start = rows.where(F.col("vec_id") <= last).groupBy("vec_id").agg(F.min("vector").alias("v")).orderBy("vec_id").collect()
    x = integers(np.array([r["v"] for r in start], np.float64).reshape(len(start), len(start[0]["v"])), p).astype(np.int64)
    return [x[:, cut] for cut in _cuts(x.shape[1], p)]


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance for each column of ``part`` (dimensions by vectors)."""
    d, n = part.shape
    reach = max(int(np.abs(part).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.int32 if 4 * max(d, 1) * reach * reach < 1 << 31 else np.int64
    book = book.astype(kind)
    entry, far = np.empty(n, np.int64), np.empty(n, np.int64)
    for at in range(0, n, _TILE):
        tile = part[:, at : at + _TILE].astype(kind)
        dist = np.zeros((tile.shape[1], len(book)), kind)
        for j in range(d):
            gap = tile[j][:, None] - book[:, j]
            gap *= gap
            dist += gap
        entry[at : at + _TILE] = best = dist.argmin(axis=1)
        far[at : at + _TILE] = dist[np.arange(len(best)), best]
    return entry, far


def _parts(blobs: list[bytes], n: int) -> list[np.ndarray]:
    return [np.frombuffer(b, "<i4").reshape(len(b) // (4 * n), n) for b in blobs]


def train(made: DataFrame, books: list[np.ndarray], p: Codes = Codes()) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds over a table of blocks."""
    rdd = made.select(F.size("ids").alias("n"), "parts").rdd
    for _ in range(p.rounds if books else 0):
        held = rdd.context.broadcast(books)
        zero = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books]

        def add(acc, row, held=held):
            for (sums, counts), part, book in zip(acc, _parts(row["parts"], row["n"]), held.value, strict=True):
                entry, _ = nearest(part, book)
                np.add.at(sums, entry, part.T.astype(np.int64))
                np.add.at(counts, entry, 1)
            return acc

        def merge(a, b):
            return [(sa + sb, ca + cb) for (sa, ca), (sb, cb) in zip(a, b, strict=True)]

        total = rdd.treeAggregate(zero, add, merge)
        books = [np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], book) for (sums, counts), book in zip(total, books, strict=True)]
        held.unpersist()
    return books


def encode(made: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits a part) and ``error`` of every vector of a table of blocks."""
    label = made.schema["labels"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels = (b.column(c).slice(i, 1).flatten() for c in (0, 1))
                found = [nearest(part, book) for part, book in zip(_parts(b.column(2)[i].as_py(), len(ids)), books, strict=True)]
                raw = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                code = [raw[at : at + 2 * len(books)] for at in range(0, len(raw), 2 * len(books))]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code), pa.array(sum(far for _, far in found))], ["vec_id", "label", "code", "error"])

    return made.mapInArrow(run, f"vec_id long, label {label.simpleString()}, code string, error long")


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([book[entry] for book, entry in zip(books, bytes.fromhex(code), strict=True)])


def with_label_error(coded: DataFrame) -> DataFrame:
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n_rows")), "codes-labels")
    return attach(coded, sums, ["label"], "n_rows").drop("n_rows")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    made = blocks(rows)
    books = train(made, first_codebooks(rows))
    coded = with_label_error(materialize(encode(made, books), "codes-rows"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _op12_sql() -> str:
    """The rounds spelt out, since a recursive query can't aggregate its own rows."""
    near = """SELECT part, vec_id, label, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
        SELECT v.*, b.entry, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN b{i} b USING (part)) GROUP BY ALL"""
    step = """b{j} AS MATERIALIZED (SELECT b.part, b.entry, CASE WHEN m.s IS NULL THEN b.x ELSE m.s END AS x FROM b{i} b LEFT JOIN (
        SELECT part, entry, list(q ORDER BY pos) AS s FROM (SELECT part, entry, pos, floor(sum(x[pos])::DECIMAL(38,0) / count(*))::BIGINT AS q
        FROM a{i}, (SELECT unnest(range(1, 17)) AS pos) GROUP BY part, entry, pos) GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)"""
    rounds = ",\n".join(f"a{i} AS MATERIALIZED ({near.format(i=i)}),\n{step.format(i=i, j=i + 1)}" for i in range(4))
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS y FROM embeddings
     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
v AS MATERIALIZED (SELECT vec_id, label, part, y[16 * part + 1 : 16 * part + 16] AS x FROM k, (SELECT unnest(range(4)) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM v WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),
{rounds},
a4 AS MATERIALIZED ({near.format(i=4)}),
c AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY ALL),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, s"""


OP12_SQL = _op12_sql()
