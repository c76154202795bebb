"""SimHash near-dedup with pivot distance tables.

1. ``fingerprints``: 64-bit SimHash over 3-word shingles (XXH64, seed 42).
2. ``distances``: each distinct fingerprint gets its Hamming distances to the 64 ``PIVOTS`` once, a row of the pivot table.
   The pivots are the words of the Hadamard code: bit ``i`` of pivot ``k`` is the parity of ``k & i``.
3. ``cells``: pairs are listed by equal coordinates. Turning bit ``i`` on or off changes coordinate ``k`` by ``+1`` or ``-1``, by
   the parity of ``k & i``. So where two fingerprints differ in bits ``a`` and ``b`` the changes cancel in half of the coordinates, all
   ``k`` with one parity of ``k & (a ^ b)``, and where they differ in ``a`` alone all changes equal up to sign those of one coset of ``a``'s
   complement. The 21 four-dimensional spaces ``V`` of coordinates in ``SPACES`` are such that each ``a ^ b`` (and each ``a``)
   is orthogonal to exactly one (or, zero, to all). Three cosets of that one cover both parities, so a pair at two bits shares all
   16 coordinates of one of them, and a pair at one bit has 16 coordinates of ``V`` itself that all differ by +1 or all by -1.
   A cell is a coset and its 16 coordinates: 63 for each fingerprint, and 42 more for those of odd weight, which look one
   up and one down in ``V`` (a pair at one bit is of different parity). Fingerprints of one cell are told apart only by bits that cancel in
   sixteen groups of four, so a cell holds few but links, however dense a cluster is.
4. ``links``: a listed pair is discarded when any of its 64 coordinates differs by more than ``RADIUS`` (triangle inequality; over the Hadamard
   code that discards every pair at three bits, all but a few at four, and all beyond), and survivors are verified by their own distance.
5. ``components``: connected components (``graph.stars``), carried back to documents.

Copies collapse into one fingerprint before anything is joined. Nothing is collected, and no cell has another way.

Edge cases: a null text has no word, like an empty one: fingerprint zero, linked like any other; fewer than
three words are one shingle; repeated rows share their component; a component's id ignores null ids and is
null if it has no other; an empty table gives an empty result; only ``keep`` columns are carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, materialize, small_batches, spare, table
from .graph import stars

RADIUS = 2


def _parity(x: int) -> int:
    return x.bit_count() & 1


#: Reference fingerprints: the words of the Hadamard code of length 64.
PIVOTS = [sum(_parity(k & i) << i for i in range(64)) for k in range(64)]
PIVOTS = [p - (1 << 64) if p >> 63 else p for p in PIVOTS]


def _spaces() -> list[list[list[int]]]:
    """Of each of the 21 spaces ``V`` the three cosets that are used, ``V`` itself first, as 16 coordinates each.

    The nonzero six-bit numbers are the powers of a generator of the field of 64 elements; the multiples of its subfield of four are 21 planes
    which meet in zero only. ``V`` is what is orthogonal to a plane.
    """
    powers, x = [], 1
    for _ in range(63):
        powers.append(x)
        x = x << 1 ^ (0b1000011 if x & 32 else 0)
    out = []
    for j in range(21):
        plane = [powers[j], powers[j + 21]]
        own = lambda a, b, p=plane: [k for k in range(64) if (_parity(k & p[0]), _parity(k & p[1])) == (a, b)]
        out.append([own(0, 0), own(1, 0), own(0, 1)])
    return out


SPACES = _spaces()
#: Coordinates of the 63 cosets, and odd multipliers that hash the 16 coordinates of each.
_AT = np.array([c for v in SPACES for c in v])
_MIX = np.array([[xxhash.xxh64_intdigest(f"cell {i} {j}") | 1 for j in range(16)] for i in range(63)], np.uint64)
_BASE = np.array([xxhash.xxh64_intdigest(f"coset {i}") for i in range(63)], np.uint64)
_BITS = np.array([[_parity(k & i) for i in range(64)] for k in range(64)], np.int16)
_SLICE_BYTES = 1_000_000


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    w = text.lower().split()  # bytes: lower() changes A-Z only, split() knows ASCII white space only
    if not w:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, 42) for g in grams), np.uint64, max(1, len(w) - words + 1))


def simhash(text: bytes) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit integer."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        bits = np.unpackbits(h[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (by default all that have other names) plus ``fp`` long. Reads whole texts; no shuffle."""
    small_batches(docs.sparkSession)
    carried = kept(docs, keep, ["fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array((simhash(t) if t else 0 for t in (x.as_py() for x in b.column(b.num_columns - 1))), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], [*b.schema.names[:-1], "fp"])

    text = docs["text"].cast("binary").alias(spare(docs, "__text"))
    return docs.select(*carried, text).mapInArrow(run, docs.select(*carried, F.lit(0).cast("long").alias("fp")).schema)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def distances(fps: np.ndarray) -> np.ndarray:
    """The pivot table: the Hamming distances of each fingerprint to the 64 pivots."""
    bits = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int16)
    return bits.sum(axis=1, keepdims=True) + _BITS.sum(axis=1) - 2 * (bits @ _BITS.T)


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of fingerprints and the index of the fingerprint of each."""
    table = distances(fps).astype(np.uint64)
    keys = np.stack([table[:, at] @ mix + base for at, mix, base in zip(_AT, _MIX, _BASE, strict=True)], axis=1)
    odd = np.flatnonzero(table[:, 0] & np.uint64(1))  # the first pivot is zero, so this is the weight
    up = keys[odd][:, ::3], _MIX[::3].sum(axis=1)
    all_keys = np.concatenate([keys.ravel(), (up[0] + up[1]).ravel(), (up[0] - up[1]).ravel()])
    return all_keys, np.concatenate([np.repeat(np.arange(len(fps)), 63), np.repeat(odd, 21), np.repeat(odd, 21)])


def cells(nodes: DataFrame) -> DataFrame:
    """``cell`` and ``fp``: a row for each cell of each distinct ``fp`` of ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                fps = b.column(0).slice(at, 1_000).to_numpy(zero_copy_only=False)
                key, of = cells_of(fps)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[of])], ["cell", "fp"])

    # A fingerprint makes some 84 rows, so even few of them are dealt to all tasks.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.select("fp").repartition(parts, "fp").mapInArrow(run, "cell long, fp long")


def may_link(u: Column, v: Column) -> Column:
    """No coordinate of the pivot rows of two fingerprints differs by more than the radius.

    A row of the table costs 64 counts of bits, less than a join to look it up, so it is made again here.
    """
    return F.forall(F.lit(PIVOTS), lambda p: F.abs(distance(u, p) - distance(v, p)) <= RADIUS)


def listed(nodes: DataFrame) -> DataFrame:
    """Candidate pairs ``(u, v)`` of fingerprints that share a cell, once for each cell shared."""
    post = cells(nodes)
    a, b = (post.select("cell", F.col("fp").alias(x)) for x in "uv")
    return a.join(b, "cell").where("u < v").select("u", "v")


def links(nodes: DataFrame) -> DataFrame:
    """Edges ``(u, v)``: all pairs of distinct ``fp`` of ``nodes`` that lie within the radius."""
    return listed(nodes).where(may_link(F.col("u"), F.col("v")) & (distance(F.col("u"), F.col("v")) <= RADIUS)).distinct()


def tally(nodes: DataFrame) -> DataFrame:
    """One row: how many pairs the cells list, how many of them the pivot table discards, and how many are verified."""
    pair = listed(nodes).distinct().select(may_link(F.col("u"), F.col("v")).alias("may"), (distance(F.col("u"), F.col("v")) <= RADIUS).alias("near"))
    return pair.agg(F.count(F.lit(1)).alias("listed"), F.count_if(~F.col("may")).alias("discarded"), F.count_if("near").alias("verified"))


def components(fps: DataFrame) -> DataFrame:
    """Rows ``(doc_id, fp)`` plus ``component_id``, the smallest reachable ``doc_id``."""
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")), "simhash-nodes")
    star = stars(links(nodes), "simhash-stars")
    root = nodes.join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Only components of several fingerprints need another minimum.
    linked = star.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    least = linked.join(nodes, "fp").groupBy("root").agg(F.min("doc").alias("least"))
    own = root.join(least, "root", "left").select("fp", F.coalesce("least", "doc").alias("component_id"))
    return fps.join(own, "fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs``."""
    return components(materialize(fingerprints(docs, keep=["doc_id"]), "simhash-fingerprints"))


def one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """``docs`` with one row of each component: that of the component's id; rows without an id stay.

    Decisions are narrow rows; the texts move once, in the anti-join on the unique id.
    Of rows that repeat the surviving id one stays.
    """
    near = materialize(groups(docs).select("doc_id", "component_id"), "simhash-components")
    drop = near.where("doc_id <> component_id").select("doc_id").distinct()
    twice = near.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    gone = drop.unionByName(twice).distinct()
    single = docs.join(gone, "doc_id", "left_anti")
    repeated = docs.join(twice.join(drop, "doc_id", "left_anti"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(repeated).select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
