from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexkeel.plans import page_lines
from lexkeel.plans import thesis as T
from lexkeel.plans import typography as Y
from lexkeel.plans.rulebook import Settings
from lexkeel.schemas import PDF_PAGES, SPANS
from lexkeel.sources import projects as P

FONT = "ABCDEF+TimesNewRomanPSMT"


def span(page, y, text="Обычный текст абзаца работы", font=FONT, size=14.0, x=90.0, width=300.0, flags=0):
    return text, page, font, float(size), flags, tuple(map(float, (x, y, x + width, y + size)))


def document(lines=12, pages=2, gap=21.0):
    out = []
    for p in range(1, pages + 1):
        out += [span(p, 80 + gap * i) for i in range(lines)]
        out.append(span(p, 800, str(p), width=10, x=290))
        out.append(span(p, 20, f"Работа, лист {p}", size=10))
    out.append(span(1, 400, "Введение", flags=16, size=16))
    return out


def replaced(doc, at, **change):
    text, page, font, size, flags, box = doc[at]
    row = {"text": text, "page": page, "font": font, "size": size, "flags": flags, "box": box} | change
    return [*doc[:at], tuple(row.values()), *doc[at + 1 :]]


def every(doc, **change):
    for i in range(len(doc)):
        doc = replaced(doc, i, **change)
    return doc


CASES = {
    "pass": (document(), {}),
    "font": (every(document(), font="Arial"), {"FMT-01": "fail"}),
    "size": (every(document(), size=13.3), {"FMT-01": "fail"}),
    "thin": ([s for s in document() if s[3] != 16] + [span(1, 420, "Большой заголовок", size=18)] + [span(2, 420, "Большой заголовок", size=18)], {"FMT-02": "fail"}),
    "spacing": (document(gap=14.0), {"FMT-03": "fail"}),
    "margin": (document() + [span(2, 500, width=500)], {"FMT-05": "fail"}),
    "edge": (document() + [span(2, 500, x=Y.LEFT * Y.POINT - Y.SLACK * Y.POINT - 0.5)], {}),
    "over": (document() + [span(2, 500, x=Y.LEFT * Y.POINT - Y.SLACK * Y.POINT - 0.6)], {"FMT-05": "fail"}),
    "doubt": (document() + [("Текст без площади", 1, FONT, 14.0, 0, (100.0, 300.0, 100.0, 300.0))], {"FMT-01": "unverifiable", "FMT-05": "unverifiable"}),
}


@pytest.fixture(scope="module")
def tables(spark):
    rows, pages = [], []
    for name, (spans, _) in CASES.items():
        shuffled = spans[:]
        random.Random(1).shuffle(shuffled)
        rows += [(name, i, t, p, 0, len(t), f, s, flags, b) for i, (t, p, f, s, flags, b) in enumerate(shuffled)]
        pages += [(name, p, 595.0, 842.0, 0) for p in (1, 2)]
    return spark.createDataFrame(rows, SPANS), spark.createDataFrame(pages, PDF_PAGES)


def test_rules_on_pdf_alone(spark, tables):
    spans, pages = tables
    projects = spark.createDataFrame([], P.PROJECT)
    facts = T.facts(spark, projects, P.sections(spark, projects), pages=pages, typography=Y.facts(spans, pages))
    rows = T.evaluate(spark, facts, Settings(only=("FMT",))).collect()
    for name, (_, want) in CASES.items():
        got = {r["rule_id"]: r["status"] for r in rows if r["doc_id"] == name and r["rule_id"] != "FMT-04"}
        assert {k: v for k, v in got.items() if v != "pass"} == want, name
        assert len(got) == 4


def test_kinds_do_not_depend_on_span_order(spark, tables):
    spans, pages = tables
    key = lambda df: sorted((r["doc_id"], r["page"], r["text"], r["kind"]) for r in df.collect())
    assert key(Y.classify(spans, pages)) == key(Y.classify(spans.withColumn("span_idx", 1000 - F.col("span_idx")).repartition(5), pages))


def item(idx, text, x0, y0, size=14.0, font="Times", **flags):
    kind = {"bold": False, "mono": False, "math": False, "roman": False} | flags
    return {"idx": idx, "text": text, "font": font, "key": font.lower(), "size": size, "chars": len("".join(text.split())), "x0": x0, "x1": x0 + 6.0 * len(text), "y0": y0, "y1": y0 + size, **kind}


def test_listings_tables_formulas_captions_and_headings():
    spans = [item(i, f"Строка текста номер {i}", 90, 80 + 21 * i) for i in range(5)]
    spans += [item(10 + i, f"def f{i}(x): return x = {i};", 90, 200 + 14 * i, 10, "Courier", mono=True) for i in range(3)]
    spans += [item(20 + 2 * i + j, str(10 * i + j), 90 + 150 * j, 300 + 20 * i) for i in range(3) for j in range(2)]
    spans += [item(30, "x", 90, 400, math=True), item(31, "=", 110, 400), item(32, "y", 130, 400, math=True)]
    spans += [item(40, "Рисунок 1 — Схема", 90, 450), item(41, "Заголовок", 90, 520, 18.0)]
    spans += [item(50, "code", 300, 80, 14.0, "Courier", mono=True)]  # a word of code inside a line stays body
    columns = {c: np.array([s[c] for s in spans], object if c in ("text", "font", "key") else None) for c in spans[0]}
    got = {i: k for i, k in zip(columns["idx"].tolist(), page_lines.kinds(columns, 14.0).tolist(), strict=True) if k != "body"}
    assert {got.get(i) for i in range(5)} == {None}
    assert {got.get(i) for i in (10, 11, 12)} == {"listing"}
    assert {got.get(i) for i in range(20, 26)} == {"table"}
    assert {got.get(i) for i in (30, 31, 32)} == {"formula"}
    assert got.get(40) == "caption"
    assert got.get(41) == "heading"
    assert got.get(50) is None


def test_repeated_objects_are_margins(spark, tables):
    spans, pages = tables
    objects = spark.createDataFrame([(d, p, (0.0, 5.0, 595.0, 15.0), "image", "logo") for d in ("pass",) for p in (1, 2)] + [("edge", 1, (0.0, 300.0, 595.0, 400.0), "vector", "wide")], "doc_id string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, kind string, signature string")
    got = {r["doc_id"]: r["margins_ok"] for r in Y.margin_facts(spans, pages, objects, 0.5).collect()}
    assert got["pass"] is True
    assert got["edge"] is False


def test_figure_pages(spark):
    rows = [("d", i, t, p, 0, 1, FONT, 14.0, 0, (0.0, 0.0, 1.0, 1.0)) for i, (t, p) in enumerate([("см. рисунок 1", 1), ("Рисунок\u00a01 — A", 4), ("на рисунке 2", 3), ("Рисунок 2 — B", 3)])]
    figures = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, no int")
    got = {r["no"]: (r["caption_page"], r["ref_page"]) for r in Y.figure_pages(figures, spark.createDataFrame(rows, SPANS)).collect()}
    assert got[2] == (3, 3)
    assert got[1][1] == 1


def test_top_fonts_sizes_and_mismatches(spark, tables):
    classified = Y.classify(*tables).cache()
    fonts = {(r["doc_id"], r["rank"]): r["name"] for r in Y.top_fonts(classified).collect()}
    assert fonts[("font", 1)] == "Arial"
    assert fonts[("pass", 1)] == "TimesNewRomanPSMT"
    assert {r["size"] for r in Y.top_sizes(classified).where("doc_id = 'size'").collect()} == {13.3}
    assert {r["doc_id"] for r in Y.mismatches(classified, 14.0).collect()} == {"font", "size"}
    got = Y.samples(classified, 14.0, 2).where("doc_id = 'font'").collect()
    assert [r["rank"] for r in got] == [1, 2]
    assert all(len(r["sample"]) == 12 for r in got)


def test_two_column_reading_order(spark):
    from lexkeel.sources import pdf

    boxes = {"head": (50, 50, 550, 70), "l1": (50, 100, 280, 200), "l2": (50, 300, 280, 400), "mid": (50, 220, 550, 280), "r1": (320, 100, 550, 200), "foot": (50, 500, 550, 520)}
    rows = [("d", 1, tuple(map(float, b)), 600.0, name) for name, b in boxes.items()]
    df = spark.createDataFrame(rows, "doc_id string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, width double, text string")
    ordered = pdf.with_offsets(pdf.reading_order(df)).orderBy("place").collect()
    assert [r["text"] for r in ordered] == ["head", "l1", "l2", "mid", "r1", "foot"]
    assert [r["char_start"] for r in ordered] == [0, 5, 8, 11, 15, 18]
    single = pdf.reading_order(df.where("text in ('l1', 'l2')")).orderBy("place").collect()
    assert [r["text"] for r in single] == ["l1", "l2"]
