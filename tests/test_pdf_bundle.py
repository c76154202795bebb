"""PDF spans as documents, against plain loops."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lexkeel.sources import pdf_bundle as B

BOX = "bbox struct<x0:double,y0:double,x1:double,y1:double>"
SPAN = f"doc_id string, place int, block int, line int, page int, text string, font string, font_size double, flags int, {BOX}"
PAGE = "doc_id string, number int, width double, height double, rotation int"


def brute_ranges(intervals, spans):
    out = {}
    for doc, name, lo, hi in intervals:
        pages = [p for d, a, b, p in spans if d == doc and b > lo and a < hi]
        out[(doc, name)] = (min(pages), max(pages)) if pages else (None, None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_page_ranges(spark, seed):
    """Touching, nested, empty and outlying intervals; empty spans; gaps between spans."""
    rng = random.Random(seed)
    spans, intervals = [], []
    for doc in ("a", "b", "c"):
        at, page = rng.randrange(3), 1
        for _ in range(40 if doc != "c" else 0):
            n = rng.choice([0, 1, 1, 2, 5])
            spans.append((doc, at, at + n, page))
            at += n + rng.choice([0, 0, 1, 2])
            page += rng.random() < 0.2
        for i in range(120):
            lo = rng.randrange(at + 4)
            intervals.append((doc, f"{doc}{i}", lo, lo + rng.choice([0, 1, 2, 7, 30])))
    got = B.page_ranges(spark.createDataFrame(intervals, "doc_id string, name string, char_start int, char_end int"), spark.createDataFrame(spans, "doc_id string, char_start int, char_end int, page int"), ["name"])
    assert {(r["doc_id"], r["name"]): (r["page_start"], r["page_end"]) for r in got.collect()} == brute_ranges(intervals, spans)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def span(doc, place, text, page=1, size=10.0, y=400.0, block=None, line=0):
    return (doc, place, place if block is None else block, line, page, text, "F", size, 0, (0.0, y, 9.0, y + 8))


def pages(spark, *rows):
    return spark.createDataFrame([(d, n, 600.0, 800.0, 0) for d, n in rows], PAGE)


def test_offsets_follow_lines_and_blocks(spark):
    rows = [span("d", 0, "ab", block=0, line=0), span("d", 1, "c", block=0, line=0), span("d", 2, "de", block=0, line=1), span("d", 3, "", block=1), span("d", 4, "f", block=2), span("e", 9, "x")]
    spans = B.with_offsets(spark.createDataFrame(rows, SPAN))
    assert {r["doc_id"]: r["text"] for r in B.texts(spans).collect()} == {"d": "abc\nde\n\nf", "e": "x"}
    text = {"d": "abc\nde\n\nf", "e": "x"}
    assert all(text[r["doc_id"]][r["char_start"] : r["char_end"]] == r["text"] for r in spans.collect())


def brute_headings(rows, height=800.0):
    named = [(r[5].strip(), r[7], r[9][1] / height, r[4]) for r in rows if len(r[5].strip()) >= 2]
    body = statistics.median(s for _, s, _, _ in named if s > 0)
    out = []
    for title, size, y, page in named:
        again = [(p, b) for t, _, b, p in named if " ".join(t.lower().split()) == " ".join(title.lower().split())]
        header = len({p for p, _ in again}) >= 2 and (y < 0.15 or y > 0.85) and max(b for _, b in again) - min(b for _, b in again) < 0.03
        if size >= body * 1.18 and len(title) <= 160 and not header:
            out.append((title, page))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_headings_by_font(spark, seed):
    rng = random.Random(seed)
    rows = []
    for place in range(80):
        title = rng.choice(["Intro", "intro", "Part", "x", " ", "body text", "b" * 200, "Running head"])
        rows.append(span("d", place, title, page=place // 20 + 1, size=rng.choice([10.0, 10.0, 10.0, 11.8, 14.0, 0.0]), y=rng.choice([40.0, 41.0, 300.0, 700.0])))
    got = B.font_headings(B.with_offsets(spark.createDataFrame(rows, SPAN)), pages(spark, *[("d", n) for n in range(1, 5)])).collect()
    assert sorted((r["title"], r["page"]) for r in got) == brute_headings(rows)


def test_outline_counts_before_fonts(spark):
    rows = [span("d", 0, "Erstes Kapitel", size=20.0), *[span("d", i, "body text here") for i in range(1, 6)], span("d", 6, "ZWEITES kapitel", page=2, size=20.0), *[span("e", i, "body") for i in range(5)], span("e", 5, "Only font", size=20.0)]
    spans = B.with_offsets(spark.createDataFrame(rows, SPAN))
    outline = spark.createDataFrame([("d", 1, "Zweites Kapitel", 2), ("d", 0, " Anhang ", 2), ("d", 3, "lost", 9), ("d", 1, " ", 1)], "doc_id string, level int, title string, page int")
    docs = B.documents(spans, pages(spark, ("d", 1), ("d", 2), ("e", 1)), outline)
    heads = {r["doc_id"]: [(h["title"], h["level"], h["origin"]) for h in r["headings"]] for r in docs.collect()}
    # Of the two that the outline puts at one place the first in order stays.
    assert heads == {"d": [("Anhang", 1, "pdf_outline")], "e": [("Only font", 1, "pdf_heading")]}


def brute_collapse(heads):
    out = []
    for h in sorted(heads):
        if out and (abs(out[-1][0] - h[0]) <= 2 or (out[-1][3].lower() == h[3].lower() and out[-1][4] == h[4])):
            if h[1] < out[-1][1]:
                out[-1] = h
            continue
        out.append(h)
    return out


def test_collapsing_prefers_the_better_source(spark):
    rng = random.Random(5)
    cases = [[(rng.randrange(40), rng.randrange(3), rng.choice([1, 2]), rng.choice(["A", "a", "B"]), rng.choice([1, 2, None]), "o") for _ in range(rng.randrange(12))] for _ in range(200)]
    rows = [(i, sorted(c, key=lambda h: tuple((x is not None, x) for x in h))) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, h array<{B.HEADING}>")
    got = {r["i"]: [tuple(h) for h in r["k"]] for r in df.select("i", B.collapsed(F.array_sort("h")).alias("k")).collect()}
    key = lambda h: tuple((x is not None, x) for x in h)

    class Sortable(tuple):
        def __lt__(self, other):
            return key(self) < key(other)

    assert got == {i: [tuple(h) for h in brute_collapse([Sortable(h) for h in c])] for i, c in enumerate(cases)}


def test_sections_and_chunks_fall_back(spark):
    rows = [span("d", 0, "Введение", size=20.0), *[span("d", i, f"текст номер {i}", page=1 + i // 4) for i in range(1, 9)], span("d", 9, "Заключение", page=4, size=20.0), *[span("n", i, "text", page=2 + i) for i in range(4)]]
    spans = B.with_offsets(spark.createDataFrame(rows, SPAN))
    page = pages(spark, *[("d", n) for n in range(1, 5)], *[("n", n) for n in range(1, 7)])
    docs = B.documents(spans, page)
    found = B.sections(spark, docs, spans, page)
    got = {(r["doc_id"], r["section_id"]): (r["page_start"], r["page_end"]) for r in found.collect()}
    assert got == {("d", "introduction"): (1, 3), ("d", "conclusion"): (4, 4), ("n", "document"): (1, 6)}
    whole = docs.where("doc_id = 'd'").first()["text"]
    chunks = spark.createDataFrame([("d", "introduction", "c1", 0, 9), ("d", "introduction", "c2", whole.index("номер 5"), whole.index("номер 8")), ("d", "introduction", "gap", len("Введение"), len("Введение") + 2), ("d", "conclusion", "c3", len(whole) - 3, len(whole))], "doc_id string, section_id string, chunk_id string, char_start int, char_end int")
    assert {r["chunk_id"]: (r["page_start"], r["page_end"]) for r in B.chunk_pages(chunks, spans, found).collect()} == {"c1": (1, 1), "c2": (2, 3), "gap": (1, 3), "c3": (4, 4)}


def test_introduction_page_by_section_heading_or_span(spark):
    body = lambda d, k, n: [span(d, k + i, f"слова {i}", page=n) for i in range(6)]
    rows = [*body("s", 0, 1), span("s", 10, "Введение", page=2, size=20.0), *body("s", 11, 2)]
    rows += [span("c", 0, "Содержание", page=1, size=20.0), span("c", 1, "Введение", page=1, size=20.0), *body("c", 2, 1), *body("c", 10, 2)]
    rows += [*body("p", 0, 1), span("p", 10, "Введение", page=3, size=11.0, y=100.0), *body("p", 11, 3)]
    spans = B.with_offsets(spark.createDataFrame(rows, SPAN))
    page = pages(spark, *[(d, n) for d in "scp" for n in range(1, 4)])
    docs = B.documents(spans, page)
    sections = B.sections(spark, docs, spans, page)
    got = {r["doc_id"]: r["main_start"] for r in B.introduction_page(spans, page, sections.where("doc_id <> 'c'"), docs).collect()}
    assert got == {"s": 2, "c": None, "p": 3}


def test_printed_pages_meet_source_sections_in_order(spark):
    cols = "doc_id string, section_id string, norm string, char_start int"
    source = spark.createDataFrame([("d", "a", "intro", 0), ("d", "b", "part", 10), ("d", "c", "part", 20), ("d", "e", "gone", 30)], cols)
    there = spark.createDataFrame([("d", "x", "intro", 5, 1, 2), ("d", "y", "part", 50, 3, 3), ("d", "z", "part", 90, 4, 6), ("d", "w", "", 0, 9, 9)], cols + ", page_start int, page_end int")
    assert {r["section_id"]: (r["page_start"], r["page_end"]) for r in B.with_pages(source, there).collect()} == {"a": (1, 2), "b": (3, 3), "c": (4, 6), "e": (None, None)}


# ---- from a decoder's objects to tables ----


class Rect:
    width, height = 600.0, 800.0


class Leaf:
    """A page as the decoder shows it: two columns below a title, an image, two drawings, one of them a hairline."""

    rect, rotation = Rect(), 0

    def get_text(self, _kind):
        def block(x0, y0, x1, *lines):
            return {"lines": [{"spans": [{"text": t, "font": "F", "size": 20.0 if t.startswith("Ti") else 10.0, "flags": 0, "bbox": (x0, y0 + 10 * i, x1, y0 + 10 * i + 9)} for t in line]} for i, line in enumerate(lines)]}

        return {"blocks": [block(320, 100, 560, ["right \ufb01rst"]), block(40, 100, 280, ["left ", "one"], ["left two"]), block(40, 20, 560, ["Titel\xa0hier"]), {"image": b""}]}

    def get_image_info(self, hashes):
        return [{"bbox": (1, 2, 30, 40), "digest": b"\x01\xff"}, {"bbox": (1, 2, 30, 40)}, {"bbox": (5, 5, 5, 9)}]

    def get_drawings(self):
        return [{"rect": (0, 0, 100, 50), "items": [1, 2]}, {"rect": (0, 0, 100, 1), "items": []}]


class Book(list):
    def get_toc(self, simple):
        return [[1, "Titel hier", 1], [2, "x"]]


def test_decoded_pages_become_documents(spark):
    from lexkeel.sources import pdf

    rows = pdf.rows_of("d", Book([Leaf(), Leaf()]))
    t = pdf.tables(spark.createDataFrame(rows, pdf.DECODED))
    spans = B.with_offsets(t["spans"])
    docs = B.documents(spans, t["pages"], t["outline"]).first()
    page = "Titel hier\n\nleft one\nleft two\n\nright first"
    assert docs["text"] == f"{page}\n\n{page}"
    assert [(h["title"], h["char_start"], h["origin"]) for h in docs["headings"]] == [("Titel hier", 0, "pdf_outline")]
    objects = sorted((r["page"], r["kind"], r["signature"]) for r in t["objects"].collect())
    assert objects == [(n, k, s) for n in (1, 2) for k, s in (("image", "01ff"), ("image", "29.0x38.0"), ("vector", "100.0x50.0:2"))]
    assert t["pages"].count() == 2


def test_a_run_with_spans_knows_pages(spark, tmp_path):
    from lexkeel.plans.run import run

    from .test_faults import put

    put(tmp_path, "d", {"main.tex": "\\begin{document}\n\\section{Введение}\nтекст\n\\section{Заключение}\nтекст\n\\end{document}"})
    rows = [span("d", 0, "Введение", size=20.0), *[span("d", i, "слова", page=1 + i // 3) for i in range(1, 12)], span("d", 12, "Заключение", page=5, size=20.0), *[span("d", i, "слова", page=5) for i in range(13, 16)]]
    spans = spark.createDataFrame(rows, SPAN).withColumn("span_idx", F.col("place"))
    got = run(spark, f"file://{tmp_path}", spans=spans, pages=pages(spark, *[("d", n) for n in range(1, 6)]))
    found = {r["rule_id"]: (r["status"], r["message"], r["page"]) for r in got.findings.where("rule_id IN ('STR-03', 'STR-04')").collect()}
    assert found == {"STR-03": ("pass", "subsections fill a page", None), "STR-04": ("warn", "Введение: 4 pages", 1)}
    assert {r["title"]: (r["page_start"], r["page_end"]) for r in got.sections.collect()} == {"Введение": (1, 4), "Заключение": (5, 5)}
