"""Needles wherever they stand in a text, against all pairs."""

from __future__ import annotations

from collections import Counter

from lexkeel.operators import joins as J

TEXTS = [
    "he was a smart of the deal maker, they said, and went home at once",
    "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜",
    "x" * 80 + " end",
    "before -------------------------------- after " + "\U00020000" * 60,
    "Pneumonoultramicroscopicsilicovolcanoconiosis, word. And the next one begins here, plainly.",
    "one two three four five six seven eight nine ten eleven twelve thirteen",
    "",
]


def test_needles_at_every_position(spark):
    cuts = {t[i : i + n] for t in TEXTS for n in (1, 5, 11, 12, 13, 23, 24, 25, 30, 37, 48) for i in range(len(t) - n + 1)}
    needles = [*cuts, "not there at all but long enough to be looked up", "", None]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id int, text string")
    got = J.contains_any(texts, spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    assert Counter((r["doc_id"], r["needle"]) for r in got) == Counter((i, n) for i, t in enumerate(TEXTS) for n in needles if n is not None and n in t)


def test_repeated_texts_needles_and_other_columns(spark):
    texts = spark.createDataFrame([(1, "a short text"), (1, "a short text"), (2, "a short text"), (3, None)], "doc_id int, text string")
    needles = spark.createDataFrame([("x", "short"), ("y", "short"), ("z", None), ("e", "")], "tag string, needle string")
    got = J.contains_any(texts, needles)
    assert got.columns == ["doc_id", "text", "tag", "needle"]
    assert Counter((r["doc_id"], r["tag"]) for r in got.collect()) == Counter({(1, "x"): 2, (1, "y"): 2, (2, "x"): 1, (2, "y"): 1, (1, "e"): 2, (2, "e"): 1})


def test_no_product_of_texts_and_needles(spark):
    texts = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    plan = J.contains_any(texts, spark.createDataFrame([("b",), ("c" * 40,)], "needle string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and all("(" in line for line in plan.splitlines() if "Join Inner" in line)


def test_quotes_of_other_composition(spark):
    from lexkeel.plans import advisory

    text = "Вступление и йод"
    quotes = spark.createDataFrame([("d", "R", 1, "c", "и йод"), ("d", "R", 2, "c", "и йод"), ("d", "R", 3, "c", "нет")], "doc_id string, rule_id string, pos int, chunk_id string, quote string")
    shown = spark.createDataFrame([("d", "R", "c", text, 100, "a" * 64)], "doc_id string, rule_id string, chunk_id string, text string, char_start int, digest string")
    got = {r["pos"]: (r["error"], r["locator"]) for r in advisory.verify(quotes, shown).collect()}
    at = 100 + text.index("и йод")
    assert got == {1: (None, f"sha256:{'a' * 64}:{at}-{at + 5}"), 2: ("duplicate_evidence", None), 3: ("quote_not_found", None)}
