"""Redaction by key at any depth, against a plain walk."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexkeel.functions import redaction as R

LONG = "long text " * 40
CUT = R.MAX_CHARS


def walk(value, key=""):
    """The contract, one value at a time; texts with patterns are left to ``redact_text``'s own tests."""
    if isinstance(value, str):
        text = value.replace("a@b.example", R.MARK)
        return f"{text[:CUT].rstrip()}… {R.CUT_MARK}" if key in R.CUT_KEYS and len(text) > CUT else text
    if isinstance(value, list):
        return [walk(v, key) for v in value]
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            low = k.casefold()
            out[k] = R.TRACE_MARK if low in R.TRACE_KEYS else R.MARK if low in (*R.SECRET_KEYS, *R.PROMPT_KEYS) else walk(v, low)
        return out
    return value


DOCS = [
    {"a": 1, "token": "t", "note": "mail a@b.example", "deep": {"Password": "p", "list": [{"traceback": "x", "message": LONG, "n": 2}, {"n": 3, "message": "ok"}]}},
    {"a": 2, "token": "u", "note": LONG, "deep": {"Password": "q", "list": []}},
]


def test_structs_arrays_and_maps(spark):
    kind = "a int, token string, note string, deep struct<Password:string,list:array<struct<traceback:string,message:string,n:int>>>"
    df = spark.createDataFrame([tuple(d.values()) for d in [{k: (v if k != "deep" else (v["Password"], [(x.get("traceback"), x["message"], x["n"]) for x in v["list"]])) for k, v in d.items()} for d in DOCS]], kind)
    got = [json.loads(r[0]) for r in R.redact_frame(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    want = [walk(d) for d in DOCS]
    want[0]["deep"]["list"][1]["traceback"] = R.TRACE_MARK  # a column has the field in every row
    assert got == want
    maps = spark.createDataFrame([({"Token": "t", "message": LONG, "x": "a@b.example", "prompt_text": "p"}, {"secret": 5, "n": 6}, [{"a": {"api_key": "k"}}])], "m map<string,string>, n map<string,int>, l array<map<string,map<string,string>>>")
    row = R.redact_frame(maps).first()
    assert row["m"] == walk({"Token": "t", "message": LONG, "x": "a@b.example", "prompt_text": "p"})
    assert row["n"] == {"secret": None, "n": 6} and row["l"] == [{"a": {"api_key": R.MARK}}]


def test_secret_columns_of_any_type(spark):
    df = spark.createDataFrame([(1, [1, 2], None, "x")], "doc_id int, token array<int>, traceback string, quote string")
    assert tuple(R.redact_frame(df).first()) == (1, R.MARK, R.TRACE_MARK, "x")
    assert tuple(R.redact_frame(df, keep=("token",)).first()) == (1, [1, 2], R.TRACE_MARK, "x")


@pytest.mark.parametrize("deep", [0, 1, 5])
def test_json_without_a_schema(spark, deep):
    def nest(d):
        for _ in range(deep):
            d = {"inner": [d, {"message": LONG}]}
        return d

    docs = [nest(d) for d in DOCS]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("not json token=abcdefgh",), (None,)], "props string")
    got = [r[0] for r in R.redact_json(df, "props").collect()]
    assert got[-1] is None and got[-2] == f"not json token={R.MARK}"

    def filled(d):
        """Fields that a sibling has are there as markers where they are secret."""
        if isinstance(d, dict):
            return {k: filled(v) for k, v in d.items() if not (isinstance(v, str) and v in (R.MARK, R.TRACE_MARK))}
        return [filled(x) for x in d] if isinstance(d, list) else d

    assert [filled(json.loads(g)) for g in got[:-2]] == [filled(walk(d)) for d in docs]
    for g, d in zip(got, docs, strict=False):
        assert not any(f'"{v}"' in g for v in ("t", "u", "p", "q", "x"))
        assert g.count(R.MARK) >= json.dumps(walk(d)).count(R.MARK)


def test_values_that_differ_in_kind(spark):
    rows = ['{"v": 1, "message": "m"}', '{"v": "a@b.example"}', '{"v": {"token": "secret value"}}', '{"v": ["x"]}']
    df = spark.createDataFrame([(r,) for r in rows], "props string")
    assert isinstance(R.json_shape(df, "props")["v"].dataType, T.VariantType)
    got = [json.loads(r[0])["v"] for r in R.redact_json(df, "props").collect()]
    assert got == [1, R.MARK, R.MARK, R.MARK]
    assert R.redact_json(df.limit(0), "props").count() == 0


def test_log_texts(spark):
    df = spark.createDataFrame([("x" * 600,), ("password: 'abc' sk-123456789 Bearer abcdefghij",), ("thesis_text = 'all of it' end",), (None,)], "t string")
    got = [r[0] for r in df.select(R.log_text(F.col("t"))).collect()]
    assert got == ["x" * 500 + "...[TRUNCATED]", f"password: {R.MARK} {R.MARK} Bearer {R.MARK}", f"thesis_text = {R.MARK} end", None]
