"""Spelling variants: words at one edit, by generating every word's full neighbourhood.

1. ``runs`` takes maximal letter runs of the texts, ``vocabulary`` counts them; words of enough letters and occurrences stay.
2. ``screen_of`` makes a bitmap of the vocabulary's hashes, ``SCREEN_BITS`` at most whatever the vocabulary: that bound is what makes it fit to send to every task.
3. ``neighbours`` makes all distinct deletions, replacements and insertions of each word over the observed alphabet: as hashes first, since the hash of an edited word
   follows from the sums of the word's beginnings, so a word of ``n`` letters costs no more than its ``2 n`` edits for each letter. Those whose bits are set are spelt out and
   hash-joined to the vocabulary. The screen loses nothing; a vocabulary beyond it only lets more strings through to the join.
4. A word's form is its most frequent neighbour, where that is frequent enough; ``roots`` follows forms by doubling steps.

Distinct edits follow from rules, not from sorting: of a run of equal letters only the first is deleted, a letter isn't replaced by itself or inserted behind itself.
A joined candidate is one edit away by construction, so nothing measures distances.

Words are dealt by their own hash; no key collects more rows than a word has edits, and copies of texts are counted before they are shuffled.

Edge cases: null and empty texts have no runs; a null ``doc_id`` counts as an empty one; a run of any length is a word like others; ties go to the word first in code-point order;
repeated rows count again; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

LETTERS = r"[A-Za-z\x{C0}-\x{FF}]"


@dataclass(frozen=True)
class Variants:
    min_letters: int = 6
    min_count: int = 5
    ratio: int = 5
    noise: int = 199


#: Bits of the screen at most (64 MB); it takes 16 bits a word up to there.
SCREEN_BITS = 1 << 29
_SLICE_BITS = 1 << 23
_PROBES = 4
#: Letters that are edited at once in a task.
_BLOCK = 1 << 17
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def without(run: Column, at: Column) -> Column:
    return F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))


def runs(docs: DataFrame, p: Variants = Variants()) -> DataFrame:
    """``word``, a row for each occurrence. Where the checksum of id and run is a multiple of ``noise``, the run loses a letter that the checksum names."""
    # Runs too short to be a word are not listed: losing a letter doesn't lengthen them.
    run = F.explode(F.regexp_extract_all(ascii_lower(docs["text"]), F.lit(f"{LETTERS}{{{p.min_letters},}}"), F.lit(0)))
    told = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), run.alias("run"))
    told = told.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    return told.select(F.when(F.col("h") % p.noise == 0, without(F.col("run"), at)).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, p: Variants = Variants()) -> DataFrame:
    """``word`` and its occurrences ``n``."""
    counted = runs(docs, p).where(F.length("word") >= p.min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= p.min_count)


# ---- hashes of words and of their edits ----


def _codes(points: np.ndarray) -> np.ndarray:
    """A mixed 64-bit number for each code point."""
    x = (points.astype(np.uint64) + np.uint64(1)) * _BASE
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]), dtype=np.uint64)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def hashes(points: np.ndarray) -> np.ndarray:
    return (_codes(points) * _powers(points.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def _bits(h: np.ndarray, probe: int, size: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(32))) * (_MIX + np.uint64(2 * probe))
    return (x >> np.uint64(24)) & np.uint64(size - 1)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and code points of words, equal lengths together, a block at a time."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        of = np.flatnonzero(sizes == n)
        step = max(1, _BLOCK // int(n))
        for at in range(0, len(of), step):
            some = of[at : at + step]
            yield some, _points([words[i] for i in some])


def _set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of hashes whose bits are all set."""
    of = np.arange(len(h))
    for probe in range(_PROBES):
        at = _bits(h, probe, 8 * len(bitmap))
        hit = (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
        of, h = of[hit], h[hit]
    return of


def edits(points: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """All words at one edit from words of one length: kind, code point, which of the places (a row a word) are distinct edits, and hashes of all places."""
    m, n = points.shape
    code, power = _codes(points), _powers(n)
    term = code * power[:n]
    upto = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(term, axis=1, dtype=np.uint64)], axis=1)
    rest = upto[:, -1:] - upto  # from each place to the end
    first = np.ones((m, n), bool)
    first[:, 1:] = points[:, 1:] != points[:, :-1]
    yield "delete", 0, first, upto[:, :-1] + rest[:, 1:] * _BACK
    less, moved = upto[:, -1:] - term, upto + rest * _BASE
    for c in alphabet:
        own = _codes(np.array([c]))[0] * power
        other = points != c
        yield "replace", int(c), other, less + own[:n]
        ahead = np.ones((m, n + 1), bool)
        ahead[:, 1:] = other
        yield "insert", int(c), ahead, moved + own


def spell(word: str, kind: str, at: int, c: int) -> str:
    return word[:at] + (chr(c) if kind != "delete" else "") + word[at + (kind != "insert") :]


# ---- the same, distributed ----


def alphabet_of(words: DataFrame) -> np.ndarray:
    """Code points that the words use; no more than the letters there are."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    return np.array(sorted(ord(r[0]) for r in letters.collect()), np.uint32)


def screen_of(words: DataFrame) -> np.ndarray:
    """The bitmap of the words' hashes; its slices are filled by tasks of their own."""
    spark, size = words.sparkSession, 1 << 13
    total = words.count()
    while size < min(16 * total, SCREEN_BITS):
        size *= 2
    step = min(size, _SLICE_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, points in _by_length(b.column(0).to_pylist()):
                h = hashes(points)
                at = np.unique(np.concatenate([_bits(h, i, size) for i in range(_PROBES)])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at // step), pa.array((at % step).astype(np.int32))], ["slice", "at"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # a slice is 1 MB and stands in one task only
        for b in batches:
            s, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(s):
                bits = held.setdefault(int(k), np.zeros(step // 8, np.uint8))
                mine = at[s == k]
                np.bitwise_or.at(bits, mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        for k, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([bits.tobytes()])], ["slice", "bits"])

    filled = words.select("word").mapInArrow(places, "slice long, at int").repartition(max(1, size // step), "slice").mapInArrow(fill, "slice long, bits binary")
    bitmap = np.zeros(size // 8, np.uint8)
    for r in filled.toLocalIterator():
        bitmap[r["slice"] * step // 8 : (r["slice"] + 1) * step // 8] = np.frombuffer(r["bits"], np.uint8)
    return bitmap


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n``: all pairs of ``words`` (``word``, ``n``, distinct) at one edit, from both sides."""
    spark = words.sparkSession
    held = spark.sparkContext.broadcast((alphabet_of(words), screen_of(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, bitmap = held.value
        for b in batches:
            own = b.column(0).to_pylist()
            for which, points in _by_length(own):
                for kind, c, distinct, h in edits(points, alphabet):
                    hit = _set(bitmap, h.ravel())
                    hit = hit[distinct.ravel()[hit]]
                    step = max(1, (1 << 24) // points.shape[1])  # long words leave in small batches
                    for at in range(0, len(hit), step):
                        pairs = [(own[which[i]], int(j)) for i, j in zip(*divmod(hit[at : at + step], h.shape[1]), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([spell(w, kind, j, c) for w, j in pairs], pa.string())], ["word", "near"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = words.select("word").repartition(parts, "word").mapInArrow(run, "word string, near string")
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def forms(words: DataFrame, near: DataFrame, p: Variants = Variants()) -> DataFrame:
    """``words`` plus ``n_near``, ``form`` and ``form_n``."""
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    takes = -F.col("best.less") >= p.ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words that have a form: each round takes steps twice as long, and counts rise fivefold a step, so there are few."""
    now = materialize(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after = materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        now = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, p: Variants = Variants()) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of the vocabulary of ``docs`` (``doc_id``, ``text``)."""
    words = materialize(vocabulary(docs, p), "variants-words")
    formed = materialize(forms(words, neighbours(words), p), "variants-forms")
    return formed.join(roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


#: CRC-32 by its table, made by rule; a pair of words is near if a deletion of one is the other, or the same place deleted from both leaves the same.
OP11_SQL = r"""
WITH RECURSIVE t0(t) AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL),
g AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS m FROM r GROUP BY 1, 2),
b AS (SELECT run, m, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 | (unicode(c)::BIGINT >> 6), 128 | (unicode(c)::BIGINT & 63)] END)) AS bs FROM g),
h AS (SELECT run, m, xor(list_reduce(bs, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM b, t0),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, m FROM h),
v AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT d.word, v.word AS near, v.n AS near_n FROM d JOIN v ON d.s = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.s = v.word
      UNION SELECT a.word, b.word, b.n FROM d a JOIN d b ON a.i = b.i AND a.s = b.s AND a.word <> b.word),
q AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(q.n_near, 0)::BIGINT AS n_near, CASE WHEN q.top >= 5 * v.n THEN q.top END::BIGINT AS form_n,
      CASE WHEN q.top >= 5 * v.n THEN (SELECT min(encode(near)) FROM p WHERE p.word = v.word AND p.near_n = q.top) END AS form FROM v LEFT JOIN q ON q.word = v.word),
e AS MATERIALIZED (SELECT word, n, n_near, form_n, decode(form) AS form FROM f),
z AS (SELECT word, word AS node, 0 AS steps FROM e UNION ALL SELECT z.word, e.form, z.steps + 1 FROM z JOIN e ON e.word = z.node WHERE e.form IS NOT NULL)
SELECT e.word, e.form, (SELECT arg_max(z.node, z.steps) FROM z WHERE z.word = e.word) AS root, e.n, e.n_near, e.form_n FROM e
"""
