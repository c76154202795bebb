"""Extra columns under names that operators use themselves, and where intermediate tables go."""

from __future__ import annotations

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lexkeel.llm import chat, common, hnsw, quality, toxicity, warc

from .conftest import SCHEMA, sample_texts

CLASH = ("path", "part", "ord", "node", "payload", "payload_digest", "refers_to", "n", "shard", "dim", "block", "ids", "vectors", "counts", "kind", "rank", "score", "row", "key", "k", "w", "__w", "__l", "__text")


def burdened(df):
    return df.select("*", *[F.lit(f"<{c}>").alias(c) for c in CLASH])


def test_quality_carries_all_columns(clashing):
    led = quality.ledger(clashing)
    made = {*quality.MEASURED, "failed"}
    assert set(led.columns) == {*clashing.columns, *made}
    for c in set(clashing.columns) - made - {"doc_id", "text"}:
        assert {r[0] for r in led.select(f"`{c}`").distinct().collect()} == {f"<{c}>"}


def test_warc_with_clashing_columns(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * 150 if i % 2 else f"page {i}") for i in range(8)], "page_id long, url string, html string")
    key = lambda df: sorted((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())
    assert key(warc.round_trip(burdened(pages))) == key(warc.round_trip(pages))


@pytest.mark.parametrize("dims", [(4,), (3, 5, 8)])
def test_nearest_of_each_dimension(spark, dims):
    """Vectors of several dimensions in one table, with clashing columns, against all pairs."""
    rng = np.random.default_rng(len(dims))
    rows = [(i, rng.normal(size=dims[i % len(dims)]).tolist()) for i in range(90)]
    made = burdened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    p = hnsw.Hnsw(shard_rows=40)
    got = hnsw.nearest(hnsw.build_index(made, 3, p), hnsw.query_blocks(made.where("vec_id % 9 = 0"), p), 3, p).collect()
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = set()
    for i, v in rows[::9]:
        near = sorted(((-cos(v, u), j) for j, u in rows if j != i and len(u) == len(v)))[:3]
        want |= {(i, r + 1, j) for r, (_, j) in enumerate(near)}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == want


def test_chat_with_clashing_columns(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 2 else f"turn {c} {t}") for c in range(6) for t in range(4)]
    made = burdened(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = chat.read_back(chat.attention(*chat.tree(made))).collect()
    assert {r["conv_id"]: [(x["role"], x["text"]) for x in r["turns"]] for r in back} == {c: [(r, t) for i, _, r, t in rows if i == c] for c in range(6)}


def test_stages_with_clashing_columns(spark, write):
    texts = [*sample_texts(20), None, "", "word " * 60]
    docs = burdened(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA))
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(20)], "doc_id long, quality int, toxic int")
    at = write(documents=docs, labels=labels)
    for name, stage in pipeline.STAGES:
        plain = stage(spark, docs.select(*pipeline.COLUMNS), at)
        got = stage(spark, docs, at)
        assert got.columns == plain.columns, name
        if name != "packing":  # numbers of sequences depend on the layout of the input
            assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect())), name


def test_no_folder_on_a_cluster():
    spark = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    assert common.shared_dir(spark("local[4]")).startswith("file:///")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://host"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(spark(master))


def test_schemes_of_spark_and_arrow(tmp_path):
    store, path = common.file_system(f"file://{tmp_path}")
    assert path == str(tmp_path) and store.type_name == "local"
    for scheme in ("s3", "s3a", "s3n"):
        store, path = common.file_system(f"{scheme}://bucket/a/b?region=eu-west-1")
        assert (store.type_name, path) == ("s3", "bucket/a/b")


def brute_ftrl(rows, labels, p):
    """FTRL-proximal, one coordinate at a time, straight from its definition."""
    z, n = {}, {}
    bias = 1 << p.bits

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= p.l1 else -(zi - (p.l1 if zi > 0 else -p.l1)) / ((p.beta + ni**0.5) / p.alpha + p.l2)

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for t in order.permutation(len(rows)):
            active = [*rows[t].tolist(), bias]
            w = {i: weight(i) for i in active}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[t]
            for i in active:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / p.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_fit_is_ftrl_proximal():
    rng = np.random.default_rng(5)
    p = toxicity.Ftrl(bits=8, l1=0.3, epochs=3)
    rows = [np.unique(rng.integers(0, 256, rng.integers(0, 12))) for _ in range(120)]
    labels = np.array([float(7 in r or rng.random() < 0.1) for r in rows])
    at, w = toxicity.fit(rows, labels, p)
    want = brute_ftrl(rows, labels, p)
    assert set(at.tolist()) == set(want) and 0 < len(want) < 257
    assert np.allclose(w, [want[i] for i in at.tolist()])


def test_scores_of_the_learnt_weights():
    """The score of a text is the logistic function of the weights of its distinct features and the bias."""
    p = toxicity.Ftrl(bits=10)
    texts = ["a b c d a b", "", "Vile vile words here", "a " * 50]
    weights = np.random.default_rng(1).normal(size=(1 << 10) + 1)
    rows = toxicity.text_features(texts, 10, toxicity.WordHashes())
    want = [1 / (1 + np.exp(-(weights[r].sum() + weights[-1]))) for r in rows]
    assert np.allclose(toxicity.score_texts(texts, weights, 10, toxicity.WordHashes()), want)
    assert p.bits == 10
