"""Seams of chunked texts behind runs of white space, at every small chunk size."""

from __future__ import annotations

import numpy as np
import pytest

from lexkeel.llm import bpe

from .conftest import SCHEMA

TEXTS = ["It comes to an end.\n\nNext\n\nWord " * 4, "a\t\tword and\t\tword more \n\n\nlines  of it " * 4, "x \t\n y\n\n\n\nz  \n\tw " * 8]


def test_seams_behind_white_space(spark):
    enc = bpe.encoding(bpe.default_ranks())
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)], SCHEMA)
    want = {i: enc.encode_ordinary(t) for i, t in enumerate(TEXTS)}
    for chunk in range(24, 57):
        got = bpe.encode(docs, keep=["doc_id"], chunk=chunk, overlap=16)
        assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in got.collect()} == want, chunk


SCRIPTS = {
    "chinese": "".join(chr(0x4E00 + i * 37 % 5000) + ("，" if i % 9 == 8 else "") + ("。\n" if i % 40 == 39 else "") for i in range(60_000)),
    "cyrillic": " ".join("".join(chr(0x430 + (i * 7 + j * 3) % 32) for j in range(1 + i % 9)) for i in range(20_000)),
    "arabic": " ".join("".join(chr(0x627 + (i * 5 + j) % 20) for j in range(1 + i % 6)) for i in range(20_000)),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_long_texts_of_any_script_stitch(spark, script):
    text = (SCRIPTS[script] * 3)[:110_000]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    report = bpe.stitching(docs).first()
    assert report["texts"] == 1 and report["chunks"] == 4 and report["borders_without"] == 0
    assert np.frombuffer(bpe.encode(docs).first()["ids"], "<u4").tolist() == bpe.encoding(bpe.default_ranks()).encode_ordinary(text)


def test_a_giant_token_merges_its_own_chunks_only(spark):
    text = "word and word " * 5_000 + "漢" * 80_000 + " again and again" * 5_000
    docs = spark.createDataFrame([(1, text), (2, text[:100_000])], "doc_id long, text string")
    report = bpe.stitching(docs).first()
    assert 0 < report["borders_without"] < report["seams"] + report["borders_without"]
    for r in bpe.encode(docs).collect():
        want = bpe.encoding(bpe.default_ranks()).encode_ordinary(text if r["doc_id"] == 1 else text[:100_000])
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
