"""Exact dedup of incoming batches against immutable snapshots.

1. ``prepare`` normalises whole texts and digests them (SHA-256); ``grouped`` groups a batch's own copies by digest, narrow rows only.
2. ``take_snapshot`` writes a snapshot once: its groups, one text a digest (the exact buckets) and ``filters``, a static binary-fuse filter (Graf and Lemire, 2022) for each
   bucket of digests: nine bits a key, three reads a question, no key of the snapshot denied.
3. ``screen`` sends the incoming distinct digests to the filters of their buckets. What a filter denies is new and goes no further.
4. ``confirm`` joins what is left to the exact buckets and compares texts byte by byte; false positives fall out there.
5. ``merged`` decides each group over both sides: most code points in the original, then the smallest id.

Buckets are ranges of the digest, so they are even whatever the texts; their number follows the snapshot, and a task holds one filter at a time while digests
stream past it. Copies collapse in partial aggregates before any shuffle, texts included: of a digest each task sends one text.

Edge cases: a null text counts as empty, and empty texts equal blank ones; a null id is beaten by any other; of rows that repeat the staying row's id and text one stays;
an empty snapshot has no filter and denies all; an empty batch gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPLIT, attach, materialize, small_batches, table

#: Keys of a filter at most, give or take the spread of a hash.
FILTER_KEYS = 1 << 16


# ---- binary-fuse filters over 64-bit keys, 8-bit fingerprints ----


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots a key, in three consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


@dataclass(frozen=True)
class Fuse:
    """A static filter: ``segments`` + 2 segments of ``segment`` slots."""

    seed: int
    segment: int
    segments: int
    slots: bytes

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        h, table = _mixed(keys.astype(np.uint64), self.seed), np.frombuffer(self.slots, np.uint8)
        return np.bitwise_xor.reduce(table[_slots(h, self.segment, self.segments)], axis=0) == _fingerprint(h)


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of keys that alone hold a slot, with that slot; None where keys are left that share all of theirs."""
    count = np.bincount(slots.ravel(), minlength=size)
    # The sum of the keys at a slot is the key itself once it is alone there.
    held = np.zeros(size, np.int64)
    np.add.at(held, slots.ravel(), np.tile(np.arange(slots.shape[1]), 3))
    rounds, left, free = [], slots.shape[1], np.flatnonzero(count == 1)
    while len(free):
        keys, at = np.unique(held[free], return_index=True)
        rounds.append((keys, free[at]))
        left -= len(keys)
        touched = slots[:, keys].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(held, touched, np.tile(keys, 3))
        touched = np.unique(touched)
        free = touched[count[touched] == 1]
    return None if left else rounds


def build_fuse(keys: np.ndarray) -> Fuse:
    """A filter of distinct or repeated 64-bit keys. A seed that doesn't peel is followed by the next, a little roomier every few."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(2, len(keys))
    segment = 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25))
    room = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n))
    for seed in range(1, 1_000):
        segments = max(1, math.ceil(n * room * 1.05 ** (seed // 8) / segment) - 2)
        size = (segments + 2) * segment
        h = _mixed(keys, seed)
        slots = _slots(h, segment, segments)
        if (rounds := _peel(slots, size)) is None:
            continue
        out, print_ = np.zeros(size, np.uint8), _fingerprint(h)
        for some, at in reversed(rounds):
            out[at] = 0
            out[at] = print_[some] ^ np.bitwise_xor.reduce(out[slots[:, some]], axis=0)
        return Fuse(seed, segment, segments, out.tobytes())
    raise ValueError("no seed of the filter peels")


# ---- batches and snapshots ----


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WORD_SPLIT, "")


def prepare(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_points`` (code points of the original), ``digest`` (binary) and ``norm``."""
    norm = normalised(docs["text"])
    return docs.select("doc_id", F.coalesce(F.length(docs["text"]), F.lit(0)).alias("n_points"), F.unhex(F.sha2(norm, 256)).alias("digest"), norm.alias("norm"))


def members(prepared: DataFrame, incoming: bool) -> DataFrame:
    """Narrow rows of a side, written once; ``incoming`` and ``row`` tell repeated rows apart."""
    return materialize(prepared.select("doc_id", "n_points", "digest", F.lit(incoming).alias("incoming"), F.monotonically_increasing_id().alias("row")), "snapshot-members")


def rank() -> Column:
    """Order in which rows of a group stay: most code points, then an id at all, then the smallest."""
    return F.struct((-F.col("n_points")).alias("fewer"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("incoming"), F.col("row"))


def grouped(batch: DataFrame) -> DataFrame:
    """``digest``, ``best`` (as ``rank``) and ``n`` rows."""
    return batch.groupBy("digest").agg(F.min(rank()).alias("best"), F.count(F.lit(1)).alias("n"))


def one_text_each(prepared: DataFrame) -> DataFrame:
    """``digest`` and ``norm`` of each group; partial aggregates leave one text a task and digest to be moved."""
    return prepared.groupBy("digest").agg(F.first("norm").alias("norm"))


def _key(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def _bucket(digest: Column, buckets: int) -> Column:
    return F.conv(F.hex(F.substring(digest, 9, 4)), 16, 10).cast("long") % buckets


@dataclass(frozen=True)
class Snapshot:
    """Tables of a snapshot: ``groups`` (``digest``, ``best``, ``n``), ``texts`` (``digest``, ``norm``), ``filters`` (a row a bucket)."""

    groups: DataFrame
    texts: DataFrame
    filters: DataFrame
    buckets: int


def filters_of(groups: DataFrame, buckets: int) -> DataFrame:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        f = build_fuse(rows["key"].to_numpy().view(np.uint64))
        return pd.DataFrame([{"bucket": rows["bucket"].iloc[0], "seed": f.seed, "segment": f.segment, "segments": f.segments, "slots": f.slots}])

    keys = groups.select(_bucket(F.col("digest"), buckets).alias("bucket"), _key(F.col("digest")).alias("key"))
    return materialize(keys.groupBy("bucket").applyInPandas(build, "bucket long, seed int, segment long, segments long, slots binary"), "snapshot-filters")


def take_snapshot(prepared: DataFrame, batch: DataFrame, filter_keys: int = FILTER_KEYS) -> Snapshot:
    """The snapshot of a batch: ``prepared`` and its ``members``."""
    groups = materialize(grouped(batch), "snapshot-groups")
    buckets = max(1, math.ceil(groups.count() / filter_keys))
    texts = materialize(one_text_each(prepared), "snapshot-texts")
    return Snapshot(groups, texts, filters_of(groups, buckets), buckets)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``digest`` of the incoming groups that the snapshot's filters don't deny.

    Each bucket's digests are dealt over as many tasks as they fill; its filter, of bounded size, goes to each of those as the first row.
    """
    small_batches(groups.sparkSession)
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deals = max(1, math.ceil(parts / snapshot.buckets))
    nothing = F.lit(None)
    asked = groups.select(_bucket(F.col("digest"), snapshot.buckets).alias("bucket"), F.pmod(F.xxhash64("digest"), F.lit(deals)).alias("deal"), F.lit(1).alias("kind"), "digest", *[nothing.cast(t).alias(c) for c, t in (("seed", "int"), ("segment", "long"), ("segments", "long"), ("slots", "binary"))])
    own = snapshot.filters.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("deal"), F.lit(0).alias("kind"), nothing.cast("binary").alias("digest"), "seed", "segment", "segments", "slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fuse = None, None
        for b in batches:
            place = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()], axis=1)
            edges = np.flatnonzero(np.any(place[1:] != place[:-1], axis=1)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(place)], strict=True):
                bucket, deal, kind = place[lo]
                if kind == 0:
                    r = b.slice(lo, 1).to_pylist()[0]
                    at, fuse = (bucket, deal), Fuse(r["seed"], r["segment"], r["segments"], r["slots"])
                elif at == (bucket, deal):  # else the snapshot has nothing in that bucket
                    digests = b.column(3).slice(lo, hi - lo)
                    keys = np.array([int.from_bytes(d[:8]) for d in digests.to_pylist()], np.uint64)
                    yield pa.RecordBatch.from_arrays([digests.filter(pa.array(fuse.may_hold(keys)))], ["digest"])

    rows = own.unionByName(asked).repartition(parts, "bucket", "deal").sortWithinPartitions("bucket", "deal", "kind")
    return rows.mapInArrow(run, "digest binary")


def confirm(positives: DataFrame, prepared: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``digest`` of the positives whose text, byte for byte, is in the snapshot's exact bucket."""
    own = one_text_each(prepared).join(positives, "digest", "left_semi")
    held = snapshot.texts.select("digest", F.col("norm").alias("held"))
    return own.join(held, "digest").where(F.col("norm") == F.col("held")).select("digest")


def merged(snapshot: Snapshot, groups: DataFrame, known: DataFrame) -> DataFrame:
    """``incoming`` boolean, ``digest``, ``best``, ``n`` over both sides and ``own``, the rows of the side itself."""
    both = snapshot.groups.join(known, "digest").join(groups.select("digest", F.col("best").alias("best_in"), F.col("n").alias("n_in")), "digest")
    both = materialize(both.select("digest", F.least("best", "best_in").alias("best"), (F.col("n") + F.col("n_in")).alias("n"), F.col("n").alias("own"), F.col("n_in").alias("own_in")), "snapshot-both")

    def side(all_groups: DataFrame, incoming: bool, own: str) -> DataFrame:
        alone = all_groups.join(both, "digest", "left_anti").select("digest", "best", "n", F.col("n").alias("own"))
        return alone.unionByName(both.select("digest", "best", "n", F.col(own).alias("own"))).withColumn("incoming", F.lit(incoming))

    return side(snapshot.groups, False, "own").unionByName(side(groups, True, "own_in"))


def exact_duplicates(published: DataFrame, incoming: DataFrame, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """Rows of both sides with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``: a batch of documents against a snapshot of those before it."""
    old, new = prepare(published), prepare(incoming)
    old_rows, new_rows = members(old, False), members(new, True)
    snapshot = take_snapshot(old, old_rows, filter_keys)
    groups = materialize(grouped(new_rows), "snapshot-batch")
    known = materialize(confirm(screen(groups, snapshot), new, snapshot), "snapshot-known")
    decided = materialize(merged(snapshot, groups, known), "snapshot-decided")
    stays = (F.col("row") == F.col("best.row")) & (F.col("incoming") == F.col("best.incoming"))
    out = attach(old_rows.unionByName(new_rows), decided, ["incoming", "digest"], "own")
    return out.select("incoming", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id hashes even are the published snapshot, the others the incoming batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return exact_duplicates(docs.where(even), docs.where(~even)).drop("incoming")


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS p, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER g AS keep_id, row_number() OVER g = 1 AS kept, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
      WINDOW g AS (PARTITION BY text_sha256 ORDER BY p DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM w
"""
