"""The pipeline's stages, each judged on its own input."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from lexkeel.llm import packing, pii, toxicity

from .conftest import SCHEMA, sample_texts
from .test_near_copies import brute
from .test_text_operators import measured


@pytest.fixture(scope="module")
def sf(spark, write):
    texts = sample_texts(160)
    texts = [t + (" Vile vermin" if i % 7 == 0 else "") for i, t in enumerate(texts)]
    texts += [texts[3], texts[3], "", None, "# " * 200, "copy " * 100, texts[5] + " write to a.b@c.example.com or +1 (017) 555-7713"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int("Vile" in (t or ""))) for i, t in enumerate(texts)]
    return write(documents=spark.createDataFrame(rows, SCHEMA), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), rows


def test_stages_one_by_one(spark, sf):
    at, rows = sf
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{at}/labels.parquet"))
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    for name, stage in pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, at)
        after = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS)
        if name == "toxicity":
            assert Counter(after) == Counter(r for r in before if not scores[r[0]])
            assert sum("Vile" in (r[1] or "") for r in after) <= 2
        elif name == "quality rules":

            def good(t):
                n, chars, symbols, dup, rep, lines = measured(t)
                return not (n < 50 or 100 * rep > 50 * n or 100 * symbols > 10 * n or 100 * dup > 50 * lines or not 2 * n <= chars <= 14 * n)

            assert Counter(after) == Counter(r for r in before if good(r[1]))
        elif name == "SimHash near-dedup":
            # The stage's own contract: 5-word similarity of 0.8 or more, beside op4's radius.
            order = sorted(before)
            comp, _ = brute(order)
            assert Counter(after) == Counter(r for i, r in enumerate(order) if comp[i] == i)
            assert len(after) < len(before)
        elif name == "PII":
            assert sorted(r[0] for r in after) == sorted(r[0] for r in before)
            assert all(r[4] == len(r[1]) for r in after)
            assert not any(re.search(pii.PLAIN["email"], r[1]) for r in after)
        else:
            words = packing._words(packing.default_tokenizer())
            want = {r[0]: words.ids(r[1]) + np.array([2], "<u4").tobytes() for r in before}
            got = {}
            for r in sorted(docs.collect(), key=lambda r: (r["doc_id"], r["start"])):
                got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
            assert got == want


def test_run_equals_the_stages(spark, sf):
    at, _ = sf
    out = pipeline.run(spark, at)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, at)
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket")
    assert Counter(tuple(r[k] for k in key) for r in out.collect()) == Counter(tuple(r[k] for k in key) for r in docs.collect())


def test_empty_documents(spark, write):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pipeline.run(spark, write(documents=none, labels=labels)).collect() == []
