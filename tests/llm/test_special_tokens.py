"""Texts that hold strings of special tokens, against a tokenizer that this library has not touched."""

from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexkeel.llm import packing


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|><|ENDOFTEXT|> é", "<|endof text|> a", "漢 <|endoftext|> 字"])
def test_special_tokens_equal_a_fresh_tokenizer(text):
    want = Tokenizer.from_file(packing.default_tokenizer()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Words(packing.default_tokenizer()).ids(text), "<u4").tolist() == want


def other_file(tmp_path, change):
    import json
    from pathlib import Path

    told = json.loads(Path(packing.default_tokenizer()).read_text())
    change(told)
    at = tmp_path / "other.json"
    at.write_text(json.dumps(told))
    return str(at)


@pytest.mark.parametrize(
    "change",
    [
        lambda t: t["normalizer"]["normalizers"].pop(), lambda t: t["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]+"), lambda t: t["model"].update(end_of_word_suffix=""), lambda t: t.update(pre_tokenizer=None),
    ],
)
def test_files_that_split_otherwise_go_whole(tmp_path, change):
    """Ids of any file are those of a fresh tokenizer, whatever its normalizer, pattern and model."""
    at = other_file(tmp_path, change)
    for text in ("Hello World 2024 it's", "ÀÉ café x1y2", "A  b\n\nC"):
        want = Tokenizer.from_file(at).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packing.Words(at).ids(text), "<u4").tolist() == want
    assert packing.Words(packing.default_tokenizer()).wordwise and not packing.Words(at).wordwise


@pytest.mark.parametrize("longest", [0, 3, 1 << 16])
def test_longest_is_bounded(spark, longest):
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"), longest=longest)
