"""The bound on the training sample must not change the class mix that scores mean."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lexkeel.llm import toxicity

from .test_text_operators import toxic_corpus


def test_bias_follows_the_sampling_rates(spark):
    docs, labels, _ = toxic_corpus(spark, 300)
    p = toxicity.Ftrl(train_rows=40, l1=0.1)
    known = labels.where(toxicity.fold_of(F.col("doc_id")) != 0)
    n = {c: known.where(F.col("toxic") == c).count() for c in (0, 1)}
    assert n[0] > n[1] > 40
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(40) for c in (0, 1)]
    plain, bound = (dict(zip(*map(list, toxicity.train(docs, x, p)), strict=True)) for x in (parts[0].unionByName(parts[1]), labels))
    bias = 1 << p.bits
    assert np.isclose(bound.pop(bias) - plain.pop(bias, 0.0), np.log(n[1] / n[0]))
    assert bound == plain
