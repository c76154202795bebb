"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are dealt over shards by a hash of their vector; each shard builds its own graph (Malkov and Yashunin,
2018) and stores it as flat arrays: nodes are ordered by level, so layer ``l`` is the first ``n_l`` nodes and one
``int32`` array of ``n_l x width`` neighbours. Queries travel in blocks to every shard's task, which reads its index once, as the first
of its rows, and answers each block as it passes; the results of all shards are merged by score.

Construction inserts in batches whose size doubles with the graph; a batch searches
the graph as it stands by one beam search for all its nodes at once, picks diverse neighbours and links back.

Equal vectors are one node: a node carries the smallest ``k + 1`` ids of its vector, which is all that the
``k`` nearest of any query can need, so copies neither crowd a shard nor hide each other.

Scores are cosines of the original vectors in double precision; the graph itself works on unit vectors in single precision.

Edge cases: vectors that are null, zero, of another dimension than their
shard's queries or holding null or non-finite components take no part; a query with fewer candidates returns them all; ties go to the smaller id;
rows with the query's id are its own row; repeated rows count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table


@dataclass(frozen=True)
class Hnsw:
    m: int = 16
    ef_build: int = 64
    ef_search: int = 128
    shard_rows: int = 16_384
    block: int = 512
    beam: int = 4
    seed: int = 11


# ---- the graph of one shard ----


def _beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``ef`` nodes of one layer for each query, nearest first; -1 where there are fewer. All queries advance together."""
    b, n = len(q), len(links)
    ids = np.full((b, ef), -1, np.int32)
    sim = np.full((b, ef), -np.inf, np.float32)
    done = np.ones((b, ef), bool)
    e = entry[:, :ef]
    ids[:, : e.shape[1]] = e
    sim[:, : e.shape[1]] = np.where(e >= 0, np.einsum("bd,bkd->bk", q, x[e]), -np.inf)
    done[:, : e.shape[1]] = e < 0
    seen = np.zeros((b, n + 1), bool)
    seen[np.arange(b)[:, None], e] = True  # -1 marks the spare column
    order = np.argsort(-sim, axis=1, kind="stable")
    ids, sim, done = (np.take_along_axis(a, order, 1) for a in (ids, sim, done))
    live = np.flatnonzero(~done.all(axis=1))
    while len(live):
        d = done[live]
        rank = np.cumsum(~d, axis=1)
        pick = ~d & (rank <= beam)
        at = np.argsort(~pick, axis=1, kind="stable")[:, :beam]
        chosen = np.where(np.take_along_axis(pick, at, 1), np.take_along_axis(ids[live], at, 1), -1)
        done[live] = d | pick
        near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        new = (near >= 0) & ~seen[live[:, None], near]
        near = np.where(new, near, -1)
        width = int(new.sum(axis=1).max(initial=0))
        if width:
            near = np.take_along_axis(near, np.argsort(~new, axis=1, kind="stable")[:, :width], 1)
            seen[live[:, None], near] = True
            s = np.where(near >= 0, np.einsum("bd,bkd->bk", q[live], x[near]), -np.inf).astype(np.float32)
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_sim = np.concatenate([sim[live], s], axis=1)
            all_done = np.concatenate([done[live], near < 0], axis=1)
            order = np.argsort(-all_sim, axis=1, kind="stable")[:, :ef]
            ids[live], sim[live], done[live] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_sim, all_done))
        live = live[~done[live].all(axis=1)]
    return ids, sim


def _diverse(x: np.ndarray, ids: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Of candidates, nearest first, up to ``m`` that are nearer to their node than to one another; then the nearest others."""
    c = x[ids]
    among = np.einsum("bid,bjd->bij", c, c)
    b, k = ids.shape
    kept = np.zeros((b, k), bool)
    for j in range(k):
        clear = ~((among[:, j, :j] > sim[:, j : j + 1]) & kept[:, :j]).any(axis=1)
        kept[:, j] = (ids[:, j] >= 0) & clear & (kept[:, :j].sum(axis=1) < m)
    rank = np.where(kept, 0, np.where(ids >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(ids, order, 1)
    return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Adds the reverse of the links of nodes ``new``; a full node chooses again among its nearest."""
    width = links.shape[1]
    to = links[new]
    src = np.repeat(new, width)[to.ravel() >= 0]
    dst = to.ravel()[to.ravel() >= 0]
    node, inverse = np.unique(dst, return_inverse=True)
    old = links[node]
    cand = np.concatenate([src, old.ravel()])
    of = np.concatenate([inverse, np.repeat(np.arange(len(node)), width)])
    ok = cand >= 0
    cand, of = cand[ok], of[ok]
    key = np.unique(of.astype(np.int64) << 32 | cand)  # a pair may already be linked
    of, cand = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
    sim = np.einsum("ed,ed->e", x[node[of]], x[cand])
    order = np.lexsort((-sim, of))
    of, cand, sim = of[order], cand[order], sim[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    deep = rank < 2 * width
    grid = np.full((len(node), 2 * width), -1, np.int32)
    gsim = np.full(grid.shape, -np.inf, np.float32)
    grid[of[deep], rank[deep]], gsim[of[deep], rank[deep]] = cand[deep], sim[deep]
    for at in range(0, len(node), 512):
        g, s = grid[at : at + 512], gsim[at : at + 512]
        full = (g[:, width:] >= 0).any(axis=1)
        part = g[:, :width].copy()
        if full.any():
            part[full] = _diverse(x, g[full], s[full], width)
        links[node[at : at + 512]] = part


def build(x: np.ndarray, p: Hnsw) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the rows of unit vectors ``x`` and the neighbours of each layer, bottom first, over that order."""
    rng = np.random.default_rng(p.seed)
    level = np.floor(-np.log(1.0 - rng.random(len(x))) / np.log(p.m)).astype(int)
    order = np.argsort(-level, kind="stable")
    x, level = x[order], level[order]
    sizes = [int((level >= l).sum()) for l in range(int(level.max(initial=0)) + 1)]
    layers: list[np.ndarray] = [np.empty((0, 0), np.int32)] * len(sizes)
    for l in reversed(range(len(sizes))):
        n, width = sizes[l], p.m * (2 if l == 0 else 1)
        links = np.full((n, width), -1, np.int32)
        first = min(n, width + 1)
        for i in range(first):
            others = np.array([j for j in range(first) if j != i], np.int32)
            links[i, : len(others)] = others
        done = first
        while done < n:
            batch = np.arange(done, min(n, done + min(done, p.block)))
            entry = _descend(x, layers, sizes, x[batch], l, p)
            entry = np.where(entry < done, entry, -1)
            entry = np.where((entry >= 0).any(axis=1, keepdims=True), entry, np.zeros_like(entry))
            ids, sim = _beam_search(x, links[:done], x[batch], entry, p.ef_build, p.beam)
            # Nodes of one batch don't see each other in the graph, so they are candidates by themselves.
            own = x[batch] @ x[batch].T
            np.fill_diagonal(own, -np.inf)
            k = min(p.m, len(batch) - 1)
            if k > 0:
                top = np.argpartition(-own, k - 1, axis=1)[:, :k]
                ids = np.concatenate([ids, batch[top].astype(np.int32)], axis=1)
                sim = np.concatenate([sim, np.take_along_axis(own, top, 1)], axis=1)
                by = np.argsort(-sim, axis=1, kind="stable")
                ids, sim = np.take_along_axis(ids, by, 1), np.take_along_axis(sim, by, 1)
            links[batch] = _diverse(x, ids, sim, width)
            _link_back(x, links, batch)
            done = batch[-1] + 1
        layers[l] = links
    return order, layers


def _descend(x: np.ndarray, layers: list[np.ndarray], sizes: list[int], q: np.ndarray, to: int, p: Hnsw) -> np.ndarray:
    """Entry nodes of layer ``to``: the nearest nodes found in the layers above it."""
    entry = np.zeros((len(q), 1), np.int32)
    for l in reversed(range(to + 1, len(sizes))):
        entry, _ = _beam_search(x, layers[l], q, entry, 8, p.beam)
    return entry


def search(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, p: Hnsw) -> np.ndarray:
    """The nodes found for each query, nearest first, -1 where there are fewer."""
    out = [np.empty((0, p.ef_search), np.int32)]
    for at in range(0, len(q), p.block):
        part = q[at : at + p.block]
        entry = _descend(x, layers, [len(a) for a in layers], part, 0, p)
        out.append(_beam_search(x, layers[0], part, entry, p.ef_search, p.beam)[0])
    return np.concatenate(out)


# ---- Spark ----

INDEX = "shard int, dim int, ids binary, counts binary, vectors binary, sizes array<int>, neighbours array<binary>"
BLOCKS = "block long, dim int, ids binary, vectors binary"


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda c: c != 0)


def build_index(rows: DataFrame, k: int, p: Hnsw = Hnsw()) -> DataFrame:
    """``rows`` (vec_id, embedding) as shards: a row of ``INDEX`` each, stored in the shared folder."""
    v = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", "embedding").distinct()
    v = v.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    v = materialize(v, "hnsw-vectors")
    shards = max(1, -(-v.count() // p.shard_rows))
    dealt = v.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")).withColumn("dim", F.size("embedding"))

    def run(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        ids = t.column("vec_id").to_numpy()
        x = np.asarray(t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)]) if len(x) else np.empty(0, int)
        counts = np.diff(np.r_[first, len(x)])
        own = [ids[a : a + c] for a, c in zip(first, counts, strict=True)]
        x = x[first]
        order, layers = build(_unit(x), p)
        row = {
            "shard": [t.column("shard")[0].as_py()], "dim": [dim], "ids": [np.concatenate([own[i] for i in order]).astype("<i8").tobytes()], "counts": [counts[order].astype("<i4").tobytes()],
            "vectors": [x[order].astype("<f8" if (x != x.astype(np.float32)).any() else "<f4").tobytes()], "sizes": [[len(a) for a in layers]], "neighbours": [[a.astype("<i4").tobytes() for a in layers]],
        }
        return pa.Table.from_pydict(row, _schema(INDEX))

    # Ranges give each shard a task of its own, where hashes of the numbers would put some together.
    return materialize(dealt.repartitionByRange(shards, "shard").groupBy("shard", "dim").applyInArrow(run, INDEX), "hnsw-index")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first so that tiny or huge components don't vanish or overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return (x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x).astype(np.float32)


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    kind = "<f4" if len(raw) == 4 * n * dim else "<f8"
    return np.frombuffer(raw, kind).reshape(n, dim).astype(np.float64)


def query_blocks(queries: DataFrame, p: Hnsw = Hnsw()) -> DataFrame:
    """Queries (vec_id, embedding) as rows of up to ``4 * block`` vectors of one dimension."""
    most = 4 * p.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def pack(dim: int) -> pa.RecordBatch:
            rows = waiting.pop(dim)
            row = {"block": [0], "dim": [dim], "ids": [np.array([r[0] for r in rows], "<i8").tobytes()], "vectors": [np.array([r[1] for r in rows], "<f8").tobytes()]}
            return pa.RecordBatch.from_pydict(row, _schema(BLOCKS))

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                waiting.setdefault(len(v), []).append((i, v))
                if len(waiting[len(v)]) >= most:
                    yield pack(len(v))
        for dim in list(waiting):
            yield pack(dim)

    valid = queries.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    return materialize(valid.mapInArrow(run, BLOCKS), "hnsw-queries")


def nearest(index: DataFrame, blocks: DataFrame, k: int, p: Hnsw = Hnsw()) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found for each query."""
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    own = index.select("shard", "dim", F.lit(0).alias("kind"), "ids", "counts", "vectors", "sizes", "neighbours")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))  # each block goes to every shard: a stated query set against all rows
    missing = {c: F.lit(None).cast(own.schema[c].dataType) for c in ("counts", "sizes", "neighbours")}
    asked = blocks.select(every.alias("shard"), "dim", F.lit(1).alias("kind"), "ids", "vectors").withColumns(missing)
    rows = own.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "kind")
    out = "query_id long, vec_id long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            for row in range(b.num_rows):
                r = {c: b.column(c)[row].as_py() for c in b.schema.names}
                if r["kind"] == 0:
                    at, dim = (r["shard"], r["dim"]), r["dim"]
                    counts = np.frombuffer(r["counts"], "<i4")
                    x = _matrix(r["vectors"], len(counts), dim)
                    layers = [np.frombuffer(a, "<i4").reshape(n, -1) for a, n in zip(r["neighbours"], r["sizes"], strict=True)]
                    held = np.frombuffer(r["ids"], "<i8"), counts, np.r_[0, np.cumsum(counts)], x, _unit(x), layers
                elif at == (r["shard"], r["dim"]):  # else the shard holds no vector of that dimension
                    ids, counts, starts, x, unit, layers = held
                    qid = np.frombuffer(r["ids"], "<i8")
                    qv = np.frombuffer(r["vectors"], "<f8").reshape(len(qid), -1)
                    found = search(unit, layers, _unit(qv), p)[:, : 4 * (k + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in _answers(qid, qv, found, ids, counts, starts, x, k)], ["query_id", "vec_id", "score"])

    got = rows.mapInArrow(run, out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(qid, qv, found, ids, counts, starts, x, k):
    """The ``k`` best rows of a shard for each query, by cosine in double precision."""
    norm = np.linalg.norm(x, axis=1)
    rows_q, rows_v, rows_s = [], [], []
    for i in range(len(qid)):
        near = found[i][found[i] >= 0]
        s = (x[near] @ qv[i]) / (norm[near] * np.linalg.norm(qv[i]))
        all_ids = np.concatenate([ids[starts[j] : starts[j + 1]] for j in near]) if len(near) else np.empty(0, np.int64)
        all_s = np.repeat(s, counts[near])
        other = all_ids != qid[i]
        all_ids, all_s = all_ids[other], all_s[other]
        top = np.lexsort((all_ids, -all_s))[:k]
        rows_q.append(np.full(len(top), qid[i]))
        rows_v.append(all_ids[top])
        rows_s.append(all_s[top])
    cat = lambda a, t: np.concatenate(a).astype(t) if a else np.empty(0, t)
    return cat(rows_q, np.int64), cat(rows_v, np.int64), cat(rows_s, np.float64)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = rows.where(F.col("vec_id") % 50 == 0)
    return nearest(build_index(rows, 5), query_blocks(queries), 5)
