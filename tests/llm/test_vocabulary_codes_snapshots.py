"""Spelling variants, vector codes and exact dedup, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexkeel.llm import common, snapshots, variants, vectorcodes

from .conftest import SCHEMA


def burdened(df):
    """Further columns under names that the operators use themselves."""
    names = ("word", "n", "id", "run", "h", "near", "root", "vector", "parts", "labels", "error", "norm", "digest", "best", "row", "incoming", "own", "bucket", "deal", "kind", "held", "size")
    return df.select("*", *[F.lit(f"<{c}>").alias(c) for c in names])


# ---- spelling variants ----


def brute_vocabulary(rows, p=variants.Variants()):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % p.noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= p.min_letters and c >= p.min_count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows, p=variants.Variants()):
    n = brute_vocabulary(rows, p)
    form, out = {}, {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= p.ratio * n[w] else None
        out[w] = len(near)
    res = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        res.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] is not None else None))
    return res


def variant_rows():
    rng = random.Random(3)
    base = ["running", "planète", "aabbcc", "straße", "colour", "neighbour"]
    letters = "abcenorugléßÖ"
    rows = []
    for i in range(240):
        words = []
        for _ in range(12):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            words.append(rng.choice([w, w.capitalize(), w.upper() if w.isascii() else w]))
        rows.append((i, rng.choice([" ", "-", "1", "œ"]).join(words)))
    long = "ab" * 9_000
    rows += [(1_000 + i, f"{long} {long[:-1] if i % 2 else long[1:]}x") for i in range(12)]
    rows += [(None, "running colours"), (None, None), (7, ""), (8, "..."), rows[3], rows[3], (2_000, "aaaaaaa " * 40 + "aaaaaab " * 6 + "aaaaaa " * 7), (2_001, "chainaxx " * 6 + "chainaxy " * 40 + "chainazy " * 220)]
    return rows


def test_variants_against_brute_force(spark, write):
    rows = variant_rows()
    docs = burdened(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = variants.op11(spark, write(documents=docs)).collect()
    want = brute_variants(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    chains = {w: root for w, form, root, *_ in want if form not in (None, root)}
    assert chains, "no word reaches its root by several steps"


def test_variants_of_nothing(spark, write, empty):
    assert variants.op11(spark, write(documents=empty)).collect() == []
    none = spark.createDataFrame([(1, None, "e", "s", 0), (2, "", "e", "s", 0), (None, "one two", "e", "s", 0)], SCHEMA)
    assert variants.op11(spark, write(documents=none)).collect() == []


@pytest.mark.parametrize("word", ["aabbcc", "aaaaaa", "abcdef", "ééßabé"])
def test_edits_are_the_whole_neighbourhood(word):
    """All words at one edit, each once, under the hash that the word itself has."""
    alphabet = sorted(set(word) | set("axÿ"))
    want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    want |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet} - {word}
    got = []
    for kind, c, distinct, h in variants.edits(variants._points([word]), np.array([ord(c) for c in alphabet], np.uint32)):
        for at in np.flatnonzero(distinct[0]):
            made = variants.spell(word, kind, int(at), c)
            assert h[0, at] == variants.hashes(variants._points([made]))[0]
            got.append(made)
    assert len(got) == len(set(got)) and set(got) == want


def test_a_full_screen_loses_nothing(spark, monkeypatch):
    """Where the bound of the screen is far too small for the vocabulary, more candidates reach the join and the result is the same."""
    words = spark.createDataFrame([("w" + "".join(t), 5 + i) for i, t in enumerate(itertools.product("abcd", repeat=5))], "word string, n long")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(variants.neighbours(words))
    monkeypatch.setattr(variants, "SCREEN_BITS", 1)
    assert len(want) == 1024 * 15 and key(variants.neighbours(words)) == want


# ---- vector codes ----


def brute_codes(rows, p=vectorcodes.Codes()):
    kept = [(i, [math.floor(p.scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = len(kept[0][1])
    cut = lambda v, j: v[j * dims // p.parts : (j + 1) * dims // p.parts]
    start = sorted({i: v for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]), reverse=True) if i is not None}.items())[: p.entries]
    books = [[list(cut(v, j)) for _, v in start] for j in range(p.parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(p.rounds):
        for j in range(p.parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(cut(v, j), books[j])[1]].append(cut(v, j))
            books[j] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[j])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        found = [near(cut(v, j), books[j]) for j in range(p.parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    total = Counter()
    for _, _, e, lab in out:
        total[lab] += e
    return Counter((i, c, e, total[lab], sha) for i, c, e, lab in out)


def code_rows(n, dims, spread=1.0):
    rng = np.random.default_rng(n + dims)
    centres = rng.normal(size=(9, dims))
    rows = [(i, (centres[i % 9] + 0.1 * rng.normal(size=dims)).astype("f4").astype(float) * spread, None if i % 7 == 0 else i % 3) for i in range(n)]
    return [(i, v.tolist(), lab) for i, v, lab in rows]


@pytest.mark.parametrize(("n", "dims", "spread"), [(300, 8, 1.0), (40, 8, 1.0), (300, 6, 40_000.0), (1, 4, 1.0)])
def test_codes_against_brute_force(spark, write, n, dims, spread):
    rows = code_rows(n, dims, spread)
    if n == 300:
        odd = [(900, None, 1), (901, [1.0] * (dims - 1) + [None], 1), (902, [float("nan")] * dims, 1), (903, [1.0] * (dims - 1) + [float("inf")], None), (5, rows[5][1], 2), (5, rows[6][1], 2), rows[9]]
        null_id = (None, rows[8][1], 1)
        rows = [*rows, *odd, null_id]
    made = burdened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    got = Counter(map(tuple, vectorcodes.op12(spark, write(embeddings=made)).collect()))
    assert got == brute_codes(rows)


def test_codes_of_odd_tables(spark, write):
    schema = "vec_id long, embedding array<double>, label int"
    assert vectorcodes.op12(spark, write(embeddings=spark.createDataFrame([], schema))).collect() == []
    assert vectorcodes.op12(spark, write(embeddings=spark.createDataFrame([(1, None, 1)], schema))).collect() == []
    # Vectors shorter than there are parts, and without any component.
    for v in ([0.5, 1.0], []):
        got = vectorcodes.op12(spark, write(embeddings=spark.createDataFrame([(1, v, 1), (2, v, None)], schema))).collect()
        assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in sorted(got)] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    # Another length than most takes no part; huge components count as the bound.
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0] * 4, 1), (3, [1.0] * 8, 1), (4, [1e300, -1e300, 0.0, 0.0], None)]
    got = {r["vec_id"]: r for r in vectorcodes.op12(spark, write(embeddings=spark.createDataFrame(rows, schema))).collect()}
    assert set(got) == {1, 2, 4} and got[4]["error"] == 0


def test_blocks_and_tiles_give_one_result(spark, monkeypatch):
    rows = vectorcodes.usable(spark.createDataFrame(code_rows(500, 8), "vec_id long, embedding array<double>, label int"))

    def run():
        made = vectorcodes.blocks(rows)
        books = vectorcodes.train(made, vectorcodes.first_codebooks(rows))
        coded = vectorcodes.encode(made, books).collect()
        return books, sorted(map(tuple, coded))

    books, coded = run()
    vectors = {r["vec_id"]: vectorcodes.integers(np.array(r["vector"]), vectorcodes.Codes()) for r in rows.collect()}
    for i, _, code, error in coded:
        assert ((vectorcodes.decode(code, books) - vectors[i]) ** 2).sum() == error
    monkeypatch.setattr(vectorcodes, "_BLOCK_ROWS", 7)
    monkeypatch.setattr(vectorcodes, "_TILE", 3)
    again, coded_again = run()
    assert coded == coded_again and all((a == b).all() for a, b in zip(books, again, strict=True))


# ---- exact dedup ----


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 999, 70_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 64, n, np.uint64)
    f = snapshots.build_fuse(np.concatenate([keys, keys[: n // 2]]))
    assert f.may_hold(keys).all()
    if n > 900:
        others = np.setdiff1d(rng.integers(0, 1 << 64, 100_000, np.uint64), keys)
        assert f.may_hold(others).mean() < 0.006
        assert len(f.slots) < 1.6 * n
    if n == 70_000:
        assert len(f.slots) < 1.2 * n


def brute_exact(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i, doc))
    out = Counter()
    for norm, own in groups.items():
        best = min(own, key=lambda r: r[:4])
        for r in own:
            out[(r[4], best[4], len(own), r is best, hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


def exact_rows():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab \n\t") for _ in range(rng.randrange(9))) for _ in range(500)]
    rows = list(enumerate(texts))
    rows += [(600 + i, "the very same text " + " " * (i % 4)) for i in range(300)]
    rows += [(1_000, None), (1_001, "  "), (None, "a b"), (None, None), (None, "only here"), (None, "only here"), (5, texts[5]), (5, texts[5]), (5, texts[5] + " ")]
    return [*rows, (2_000, "z" * 200_000), (2_001, "z" * 200_000 + "\n"), (2_002, "non breaking \x85space"), (2_003, "nonbreakingspace")]


@pytest.mark.parametrize("filter_keys", [1 << 16, 10])
def test_dedup_against_brute_force(spark, write, monkeypatch, filter_keys):
    rows = exact_rows()
    docs = burdened(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    docs = docs.select("doc_id", "text")
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = snapshots.exact_duplicates(docs.where(even), docs.where(~even), filter_keys).drop("incoming").collect()
    assert Counter(map(tuple, got)) == brute_exact(rows)
    if filter_keys == 1 << 16:
        assert Counter(map(tuple, snapshots.op13(spark, write(documents=burdened(docs))).collect())) == brute_exact(rows)


def test_dedup_of_empty_sides(spark, write, empty):
    assert snapshots.op13(spark, write(documents=empty)).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    want = brute_exact([(1, "a b"), (2, "ab"), (3, "c")])
    for old, new in ((docs, docs.limit(0)), (docs.limit(0), docs)):
        assert Counter(map(tuple, snapshots.exact_duplicates(old, new).drop("incoming").collect())) == want


def test_byte_check_decides_over_digests(spark):
    """A digest that the snapshot holds for another text is a group of its own."""
    one, two = (snapshots.prepare(spark.createDataFrame([(i, t)], "doc_id long, text string")) for i, t in ((1, "old text"), (2, "new text")))
    two = two.drop("digest").crossJoin(one.select("digest"))
    snap = snapshots.take_snapshot(one, snapshots.members(one, False))
    rows = snapshots.members(two, True)
    positives = snapshots.screen(snapshots.grouped(rows), snap)
    assert positives.count() == 1 and snapshots.confirm(positives, two, snap).count() == 0


def test_attach_deals_crowds_and_nulls(spark):
    rows = spark.createDataFrame([(i, "big" if i % 2 else (None if i % 3 else f"k{i}"), i) for i in range(5_000)], "i long, key string, v long")
    groups = rows.groupBy("key").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
    got = common.attach(rows, groups, ["key"], "n")
    sums = Counter()
    for r in rows.collect():
        sums[r["key"]] += r["v"]
    out = got.collect()
    assert len(out) == 5_000 and all(r["total"] == sums[r["key"]] for r in out)


@pytest.mark.parametrize("name", ["op11_spelling", "op12_vector_codes", "op13_exact_dedup"])
def test_sql(spark, name):
    from lexkeel.llm import entries

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    df = entries.queries()[name](spark, at)
    res = con.execute(entries.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(res.fetchall())
