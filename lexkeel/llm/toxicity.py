"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text becomes a set of hashed features: single words, adjacent pairs and skip-grams
(pairs with one or two words between). FTRL-proximal (McMahan et al., 2013) keeps
``z`` and ``n`` per coordinate: its own learning rate ``alpha / (beta + sqrt(n))`` and an
L1 soft threshold which leaves most weights exactly zero. The surviving weights are a
few thousand ``(index, weight)`` pairs, bounded by ``2 ** bits``, and travel in a Spark
broadcast; scoring is one Arrow pass without a shuffle.

Edge cases: a null text counts as empty; an empty text scores the bias alone; repeated
rows score alike; rows of an empty table give an empty result; without any labelled row
there is no model and every score is ``PRIOR``;
other columns of the input, whatever their names, are ignored unless named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, small_batches, spare, table

_WORD = re.compile(r"\w+")
_CACHE_WORDS = 200_000
_SLICE_CHARS = 300_000
#: Odd multipliers that mix the hashes of the words of a feature (golden-ratio constants of public hash functions).
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Score where there was nothing to learn from: no evidence, so not toxic.
PRIOR = 0.1


@dataclass(frozen=True)
class Ftrl:
    """Hyper-parameters.

    ``train_rows`` bounds the sample of labelled rows: at most that many rows of each
    class, those of the smallest hash of their id. The sample trains in one task.
    """

    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.5
    epochs: int = 4
    train_rows: int = 8_000
    seed: int = 7


class WordHashes:
    """64-bit hashes of words, remembered up to a fixed number of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > _CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def features(h: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature indexes of word hashes ``h`` and the document of each; no feature spans documents."""
    shift = np.uint64(64 - bits)
    out, of = [(h * _MIX[0]) >> shift], [doc]
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            pair = (h[:-gap] * _MIX[gap]) ^ ((h[gap:] * _MIX[0]) >> np.uint64(7))
            out.append(((pair * _MIX[gap]) >> shift)[same])
            of.append(doc[:-gap][same])
    return np.concatenate(out).astype(np.int64), np.concatenate(of)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of a bounded number of characters (or one longer text), to bound memory."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= _SLICE_CHARS:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run


def _hashed(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    words, counts = [], []
    for t in texts:
        w = _WORD.findall(t.lower())
        counts.append(len(w))
        words += w
    return hashes(words), np.repeat(np.arange(len(texts)), counts)


def text_features(texts: list[str], bits: int, hashes: WordHashes) -> list[np.ndarray]:
    """The distinct feature indexes of each text."""
    h, doc = _hashed(texts, hashes)
    idx, of = features(h, doc, bits)
    key = np.unique((of << bits) | idx)
    return np.split(key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(1, len(texts))))


def fit(rows: list[np.ndarray], labels: np.ndarray, p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and weights of the non-zero coordinates; the bias has index ``2 ** bits``."""
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
    bias = len(z) - 1  # the bias is a feature of every row; rows are not copied to hold it

    def weights(zi, ni):
        w = (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2)
        return np.where(np.abs(zi) <= p.l1, 0.0, w)

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs if rows else 0):
        for i in order.permutation(len(rows)):
            x = rows[i]
            zi, ni = z[x], n[x]
            w, wb = weights(zi, ni), weights(z[bias], n[bias])
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - labels[i]
            for at, wi, old in ((x, w, ni), (bias, wb, n[bias])):
                n[at] = old + g * g
                z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / p.alpha * wi
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at, w[at]


def score_texts(texts: list[str | None], weights: np.ndarray, bits: int, hashes: WordHashes) -> np.ndarray:
    """Probabilities; only features that have a weight are made distinct."""
    out = np.empty(len(texts))
    for start, run in _slices(texts):
        h, doc = _hashed(run, hashes)
        idx, of = features(h, doc, bits)
        hit = weights[idx] != 0
        key = np.unique((of[hit] << bits) | idx[hit])
        s = np.bincount(key >> bits, weights[key & ((1 << bits) - 1)], len(run)) + weights[-1]
        out[start : start + len(run)] = 1.0 / (1.0 + np.exp(-np.clip(s, -35, 35)))
    return out


def fold_of(doc_id: Column) -> Column:
    """``crc32`` of the id as text, modulo 5; fold 0 is held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from the labelled rows of ``docs`` outside fold 0.

    Several labels of one document count as toxic if any of them does. The sample of
    ids is narrow and bounded (``train_rows`` of a class), so its join may broadcast; the features of
    the sample meet in one task, which trains. Of rows that repeat an id one is used. Where the bound thins
    the classes unequally, the bias is shifted by the log of their sampling rates, so that scores mean the mix of all labels.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank = F.xxhash64("doc_id")
    sample = [known.where(F.col("toxic") == c).orderBy(rank, "doc_id").limit(p.train_rows) for c in (0, 1)]
    picked = sample[0].unionByName(sample[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    bits = p.bits

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            texts, ids, y = b.column("text").to_pylist(), b.column("doc_id"), b.column("toxic")
            for start, run in _slices(texts):
                rows = [r.astype(np.int32).tobytes() for r in text_features(run, bits, hashes)]
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(run)), y.slice(start, len(run)).cast(pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One row of each id, however often the corpus repeats it: that keeps the sample within its bound.
        held: dict[int, tuple[bytes, int]] = {}
        for b in batches:
            for i, x, y in zip(b.column("doc_id").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                if i not in held or x < held[i][0]:
                    held[i] = x, y
        order = sorted(held)
        at, w = fit([np.frombuffer(held[i][0], np.int32) for i in order], np.array([held[i][1] for i in order], float), p)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["i", "w"])

    got = texts.mapInArrow(extract, "doc_id long, y int, x binary").repartition(1).mapInArrow(learn, "i long, w double").toArrow()
    at, w = got.column("i").to_numpy(), got.column("w").to_numpy()
    rate = {r["toxic"]: min(1.0, p.train_rows / r["n"]) for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    shift = np.log(rate.get(0, 1.0) / rate.get(1, 1.0))
    if len(at) and shift:
        bias = 1 << bits
        own = at == bias
        at, w = np.append(at[~own], bias), np.append(w[~own], w[own].sum() + shift)
    return at, w


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], p: Ftrl = Ftrl(), keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (by default all that have other names) plus ``score`` double and ``predicted`` int."""
    spark = docs.sparkSession
    small_batches(spark)
    carried = kept(docs, keep, ["score", "predicted"])
    bits, sent = p.bits, spark.sparkContext.broadcast((np.asarray(model[0], np.int64), np.asarray(model[1], np.float64)))
    rest = docs.select(*carried, docs["text"].alias(spare(docs, "__scored_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        weights = np.zeros((1 << bits) + 1)
        weights[at] = w
        hashes = WordHashes()
        for b in batches:
            s = score_texts(b.column(b.num_columns - 1).to_pylist(), weights, bits, hashes) if len(at) else np.full(b.num_rows, PRIOR)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*b.schema.names[:-1], "score", "predicted"])

    schema = docs.select(*carried, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return rest.mapInArrow(run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
