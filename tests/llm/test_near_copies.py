"""The pipeline's near-dedup stage against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
from lexkeel.llm import nearcopies

from .conftest import SCHEMA
from .test_corpus_operators import brute_fingerprint


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(11)
    made = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    line = made(12)
    texts = [made(rng.randrange(20, 300)) for _ in range(40)]
    texts += [edited(rng, t, rng.randrange(1, 9)) for t in texts for _ in range(2)]
    base = made(150)  # one large group, some of it linked through others only
    texts += [edited(rng, base, rng.randrange(1, 5)) for _ in range(60)]
    texts += [f"{line} {made(30)}" for _ in range(40)]  # a common line alone makes no copy
    texts += [f"{line} {t}" for t in texts[:10]] + [texts[0], "", None, "a b", "a b"]
    rng.shuffle(texts)
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def brute(rows):
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    sets, fps = [grams(r[1]) for r in rows], [brute_fingerprint(r[1]) for r in rows]
    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = 9 * both >= 4 * (len(sets[i]) + len(sets[j]))
            pairs += alike
            if alike or bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in range(len(rows))}, pairs


def test_near_copies_equal_all_pairs(spark, monkeypatch):
    rows = corpus()
    want, pairs = brute(rows)
    assert pairs > 200
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for common in (nearcopies.COMMON, 10**9):  # the sample decides the cost only
        monkeypatch.setattr(nearcopies, "COMMON", common)
        assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == want


def test_stage_drops_edited_copies(spark):
    rows = corpus()
    want, _ = brute(rows)
    kept = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, c in want.items() if i == c)


def test_rows_without_an_id(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(100))
    rows = [(None, edited(rng, text, 1), "en", "s", 1), (4, edited(rng, text, 1), "en", "s", 1), (3, text, "en", "s", 1), (3, "another text altogether of six words", "en", "s", 1)]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in nearcopies.near_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 3), (3, 3), (3, 3), (4, 3)]
