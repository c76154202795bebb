from __future__ import annotations

import pytest

from lexkeel.plans import page_roles as R
from lexkeel.plans import typography as Y
from lexkeel.schemas import PDF_PAGES, SPANS

FONT = "TimesNewRomanPSMT"
PAGES = {
    "d": [
        [("Министерство науки", 0), ("Выпускная квалификационная работа", 16), ("Направление подготовки", 0)],
        [("Задание", 16), ("Студент Иванов", 0), ("Руководитель Петров", 0), ("подпись", 0)],
        [("Календарный план", 0), ("Этапы выполнения", 0)],
        [("Содержание", 16), ("Введение", 0)],
        [("Введение", 16), ("Текст о задании студента, руководитель, подпись, дата", 0)],
        [("Обычный текст", 0)],
        [("Список литературы", 16)],
        [("Отзыв", 16), ("Руководитель", 0), ("Оценка", 0)],
    ],
    "s": [[("Утверждаю", 0), ("Университет", 0), ("дата", 0)]],
    "m": [[("Методические рекомендации", 0)]],
    "u": [[("Текст", 0)]],
}


@pytest.fixture(scope="module")
def tables(spark):
    spans, pages = [], []
    for doc, content in PAGES.items():
        for n, lines in enumerate(content, 1):
            pages.append((doc, n, 595.0, 842.0, 0))
            spans += [(doc, len(spans) + i, t, n, 0, len(t), FONT, 14.0, flags, (90.0, 80.0 + 21.0 * i, 400.0, 94.0 + 21.0 * i)) for i, (t, flags) in enumerate(lines)]
    return spark.createDataFrame(spans, SPANS), spark.createDataFrame(pages, PDF_PAGES)


def test_roles_and_kinds(tables):
    got = R.roles(*tables).cache()
    by = {(r["doc_id"], r["page"]): r["role"] for r in got.collect()}
    assert [by[("d", n)] for n in range(1, 9)] == ["title", "assignment", "calendar_plan", "contents", "main_text", "main_text", "bibliography", "review"]
    assert (by[("s", 1)], by[("m", 1)], by[("u", 1)]) == ("approval", "unknown", "unknown")
    kinds = {r["doc_id"]: (r["kind"], r["main_start"], r["service_pages"]) for r in R.kinds(got).collect()}
    assert kinds == {"d": ("thesis", 5, "1-3,8"), "s": ("service_document", None, "1"), "m": ("methodical_document", None, "none"), "u": ("unknown", None, "none")}


def test_service_pages_do_not_count(spark, tables):
    spans, pages = tables
    kind = {(r["doc_id"], r["page"]): r["kind"] for r in Y.classify(spans, pages, R.excluded(R.roles(spans, pages))).collect()}
    assert kind[("d", 1)] == kind[("d", 8)] == "service_page"
    assert kind[("d", 6)] != "service_page"
    facts = {r["doc_id"] for r in Y.facts(spans, pages, excluded=R.excluded(R.roles(spans, pages))).collect()}
    assert facts == set(PAGES)
