"""Near copies by exact Jaccard similarity of 5-word shingles, beside SimHash.

Two texts are linked where the sets of their 5-word shingles (XXH64, seed 42) have a Jaccard similarity of 4/5 or more, or
where ``simhash.links`` links their fingerprints. No pair is lost before it is verified:

1. Under any one order of all shingles, let the first that two sets of ``n`` and ``m`` share stand at places ``i`` and ``j`` (from 0). They share at
   most ``min(n - i, m - j)``, and at 4/5 they share ``4 (n + m) / 9`` or more. So a set of ``n`` posts its first ``n - ceil(4n / 5) + 1``
   shingles with their places, and two sets need comparing only where the places of a shared post leave room for that (``_reach``).
2. The order puts shingles that a sample finds in many texts last and goes by hash otherwise, so common lines make few
   posts. The sample decides the cost only; any order gives the same links.
3. Each bucket first compares its members with one hub, the set of which most posts are shared. Members that are by then in
   the hub's component need no comparison with each other; every other member is compared with all. An edited copy's own
   shingles come first in the order, so one with too many edits to be a link has its common posts too late to reach others.
4. A set's bitmap has 512 bits, each the parity of the number of its shingles that hash there. Bits in which two bitmaps differ are at most
   the shingles that are in one of the sets only, which at 4/5 are at most ``(n + m) / 9``; the join itself discards the other pairs.
5. Survivors of a bound by all their posts are verified by the intersection of the whole sets.

Edge cases: null, empty and blank texts have no shingle and meet by their fingerprint, which is zero; fewer than five words are one shingle; very long texts
are read whole; repeated rows and texts are one node, and their component's id is the smallest non-null ``doc_id``; rows without an id are never dropped; an empty
table gives an empty result; other columns are carried by ``one_of_each`` and seen by nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, small_batches
from .graph import stars

WORDS = 5
#: Documents of the sample that tells common shingles, how many of them make a shingle common, and how many such are told at most.
SAMPLE, COMMON, TOLD = 10_000, 2, 100_000
#: Slots of document ids, the bound of a broadcast; the more ids are wanted, the less it holds back.
SLOTS = 1 << 18


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, ascending."""
    return np.unique(simhash.shingle_hashes(text or b"", WORDS))


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh64_intdigest(s.astype("<u8").tobytes(), 42) - (1 << 63)


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of a set that a set at 4/5 can't all miss; ``common`` ones come last in the order."""
    late = np.isin(s, common, assume_unique=True)
    return np.concatenate([s[~late], s[late]])[: len(s) - (4 * len(s) + 4) // 5 + 1 if len(s) else 0]


def bitmap(s: np.ndarray) -> np.ndarray:
    """512 bits: the parity of the number of hashes in each 512th of their range."""
    return np.packbits(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512) & 1, bitorder="little").view("<i8")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``node`` and ``members`` of each text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = [shingles(x.as_py()) for x in b.column(0).slice(at, 64)]
                yield pa.RecordBatch.from_arrays([pa.array(map(node_of, rows), pa.int64()), _lists(rows)], ["node", "members"])

    return docs.select(docs["text"].cast("binary").alias("text")).mapInArrow(run, "node long, members array<long>")


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes of the shingles that many of a bounded sample of texts hold, ascending."""
    share = max(1, docs.count() // SAMPLE)
    some = shingle_sets(docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)).dropDuplicates(["node"])
    counts = some.select(F.explode("members").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    told = counts.orderBy(F.desc("n"), "key").limit(TOLD).select("key").toArrow()
    return np.sort(told.column("key").to_numpy().astype(np.int64).view(np.uint64))


def features(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """``doc_id``, fingerprint ``fp``, ``node``, its size ``n``, its ``bitmap`` and its ``posts``. Reads whole texts once; no shuffle."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [x.as_py() for x in part.column(1)]
                rows = [shingles(t) for t in texts]
                cols = [pa.array((simhash.simhash(t) if t else 0 for t in texts), pa.int64()), pa.array(map(node_of, rows), pa.int64()), pa.array(map(len, rows), pa.int32()), _lists([bitmap(r) for r in rows])]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, _lists([prefix(r, sent.value) for r in rows])], ["doc_id", "fp", "node", "n", "bitmap", "posts"])

    schema = docs.select("doc_id", F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("node"), F.lit(0).alias("n"), *[F.array(F.lit(0).cast("long")).alias(c) for c in ("bitmap", "posts")]).schema
    return docs.select("doc_id", docs["text"].cast("binary").alias("text")).mapInArrow(run, schema)


def _reach(a: str, i: str, b: str, j: str):
    """Whether sets of sizes ``a`` and ``b`` whose first shared shingle stands at places ``i`` and ``j`` can be at 4/5."""
    return 9 * F.least(F.col(a) - F.col(i), F.col(b) - F.col(j)) >= 4 * (F.col(a) + F.col(b))


def _may(a: str, x: str, b: str, y: str):
    """Whether sets of sizes ``a`` and ``b`` with bitmaps ``x`` and ``y`` can be at 4/5."""
    apart = reduce(Column.__add__, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(8)])
    return 9 * apart <= F.col(a) + F.col(b)


def _verified(pairs: DataFrame, posts: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs ``(u, v)`` whose sets have a Jaccard similarity of 4/5 or more.

    Of the set whose posts end first in the order, no post that isn't shared is in the other set, which bounds what
    the sets can share. The whole sets are made again for pairs within that bound only.
    """
    a, b = (posts.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("posts").alias(f"p{x}"), F.col("doc_id").alias(f"d{x}")) for x in "uv")
    most = F.size(F.array_intersect("pu", "pv")) + F.greatest(F.col("nu") - F.size("pu"), F.col("nv") - F.size("pv"))
    likely = materialize(pairs.join(a, "u").join(b, "v").where(9 * most >= 4 * (F.col("nu") + F.col("nv"))).select("u", "v", "du", "dv"), f"{name}-likely")

    # Ids may be null or repeated with other texts, so a row is recognised by its node once its set is made.
    wanted = materialize(likely.select(F.explode(F.array("u", "v")).alias("node")).distinct(), f"{name}-wanted")
    ids = materialize(likely.select(F.explode(F.array("du", "dv")).alias("doc_id")).distinct(), f"{name}-ids")
    # Texts are let through by the slots of the wanted ids first, so that few of the others are shuffled.
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    slots = ids.select(slot("doc_id").alias("slot")).distinct()
    some = docs.withColumn("__slot", slot("doc_id")).join(F.broadcast(slots), F.col("__slot") == F.col("slot"), "left_semi").drop("__slot")
    rows = some.join(ids, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    sets = materialize(shingle_sets(rows).join(wanted, "node", "left_semi").dropDuplicates(["node"]), f"{name}-sets")
    a, b = (sets.select(F.col("node").alias(x), F.col("members").alias(f"m{x}")) for x in "uv")
    shared = F.size(F.array_intersect("mu", "mv"))
    return likely.join(a, "u").join(b, "v").where(9 * shared >= 4 * (F.size("mu") + F.size("mv"))).select("u", "v")


def links(docs: DataFrame, feats: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` between nodes which connect all pairs at a similarity of 4/5 or more."""
    least = feats.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    posts = materialize(feats.where("n > 0").select("node", "n", "bitmap", "posts").dropDuplicates(["node"]).join(least, "node"), "near-posts")
    placed = posts.select("node", "n", F.posexplode("posts").alias("at", "key"))
    met = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    shared = materialize(placed.join(met, "key"), "near-shared")
    degree = shared.groupBy("node").agg((F.count(F.lit(1)) / (F.first("n") + 1 - F.ceil(F.first("n") * 4 / 5))).alias("degree"))

    hubs = shared.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node", "n", "at")).alias("hub"))
    hubs = materialize(hubs.select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.at").alias("hub_at")), "near-hubs")
    first = shared.join(hubs, "key").where((F.col("node") != F.col("hub")) & _reach("n", "at", "hub_n", "hub_at"))
    first = first.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
    near = materialize(_verified(first, posts, docs, "near-first"), "near-first")

    star = stars(near, "near-stars").select(F.col("u").alias("node"), F.col("v").alias("root"))
    known = posts.select("node", "bitmap").join(star, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(shared.join(known, "node"), "near-rooted")
    of_hub = hubs.join(star.withColumnsRenamed({"node": "hub", "root": "hub_root"}), "hub", "left").select("key", "hub", F.coalesce("hub_root", "hub").alias("hub_root"))
    apart = rooted.join(of_hub, "key").where("root <> hub_root").select("key", "hub", F.col("node").alias("a"), F.col("n").alias("an"), F.col("at").alias("ai"), F.col("root").alias("ar"), F.col("bitmap").alias("am"))
    other = rooted.select("key", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("at").alias("bi"), F.col("root").alias("br"), F.col("bitmap").alias("bm"))
    # The hub itself has been compared with all of the bucket that it can reach there.
    second = apart.join(other, "key").where((F.col("ar") != F.col("br")) & (F.col("b") != F.col("hub")) & _reach("an", "ai", "bn", "bi") & _may("an", "am", "bn", "bm"))
    second = second.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    return near.unionByName(materialize(_verified(second, posts, docs, "near-second"), "near-second"))


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``component_id``, the smallest ``doc_id`` that links reach, of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    feats = materialize(features(docs, common_shingles(docs)), "near-features")
    nodes = feats.groupBy("node").agg(F.min("doc_id").alias("doc"))
    fps = materialize(feats.groupBy("fp", "node").agg(F.min("doc_id").alias("doc")), "near-fingerprints")
    reps = fps.groupBy("fp").agg(F.min("node").alias("rep"))
    same = fps.join(reps, "fp").where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    close = simhash.links(fps.select("fp").distinct())
    close = close.join(reps.withColumnsRenamed({"fp": "u", "rep": "ru"}), "u").join(reps.withColumnsRenamed({"fp": "v", "rep": "rv"}), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    star = stars(links(docs, feats).unionByName(same).unionByName(close), "near-components")
    root = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    root = root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
    least = root.join(nodes, "node").groupBy("root").agg(F.min("doc").alias("least"))
    linked = root.join(least, "root").select("node", "least")
    own = nodes.join(linked, "node", "left").select("node", F.coalesce("least", "doc").alias("component_id"))
    return feats.select("doc_id", "node").join(own, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, as ``simhash.one_of_each`` has it."""
    return simhash.one_of_each(docs, near_copies)
