"""Roles of PDF pages, so that service pages (title, assignment, approval, plan, review) don't count in metrics.

Only a page recognised with high confidence is left out; any other role is a note. A wrong role must not silence a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD
from ..operators.windows import islands, range_text
from .typography import bold

#: Titles and anchors by which pages are known.
INTRODUCTION = ["введение", "introduction"]
CONTENTS = ["содержание", "оглавление", "contents", "table of contents"]
NOTED = {"abstract": ["аннотация", "реферат", "abstract"], "contents": CONTENTS, "bibliography": ["библиография", "список литературы", "references"], "appendix": ["приложение", "appendix"]}
FORM = [["студент", "обучающийся", "исполнитель"], ["руководитель", "научный руководитель"], ["исходные данные", "исходная информация"], ["срок выполнения", "дата выдачи", "дата"], ["подпись", "подписи"], ["оценка", "отметка", "рецензент"]]
THESIS = ["выпускная квалификационная работа", "graduate qualification work", "bachelor thesis"]
PROGRAM = ["направление подготовки", "квалификация", "бакалавр"]
INSTITUTION = ["министерство", "университет", "институт", "академия"]
SERVICE = ("title", "approval", "assignment", "calendar_plan", "review")


def words(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.translate(F.lower(text), "ё", "е"), F.lit(WORD), F.lit(0)), " ")


def _any(text: Column, anchors: list[str]) -> Column:
    out = F.lit(False)
    for a in anchors:
        out = out | F.contains(text, F.lit(a))
    return out


def support(text: Column) -> Column:
    """How many of the six fields of a form a page has."""
    flags = [_any(text, g).cast("int") for g in FORM]
    return sum(flags[1:], flags[0])


def page_texts(spans: DataFrame) -> DataFrame:
    """Words of each page in reading order."""
    item = F.struct(F.col("bbox.y0").alias("a"), F.col("bbox.x0").alias("b"), F.col("bbox.y1").alias("c"), F.col("bbox.x1").alias("d"), F.col("text").alias("t"))
    return spans.groupBy("doc_id", "page").agg(words(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), " ")).alias("text"))


def heading_titles(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Titles on the upper part of each page: bold, or larger than the document's median size by a tenth."""
    size = spans.where("font_size IS NOT NULL AND trim(text) <> ''").groupBy("doc_id").agg(F.median("font_size").alias("median"))
    at = spans.join(pages.withColumnRenamed("number", "page"), ["doc_id", "page"]).join(size, "doc_id", "left").where(F.col("bbox.y0") <= F.col("height") * 0.45)
    large = F.coalesce(F.col("font_size") >= F.col("median") * 1.1, F.lit(False))
    found = at.where(bold(F.col("flags"), F.col("font")) | large).select("doc_id", "page", words(F.col("text")).alias("title")).where("title <> ''")
    return found.groupBy("doc_id", "page").agg(F.collect_set("title").alias("titles"))


def introduction(titles: DataFrame, texts: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """First page of the main text: from sections if they tell, else from a heading that isn't an entry of the contents."""
    heads = titles.where(F.arrays_overlap("titles", F.array(*map(F.lit, INTRODUCTION)))).join(texts.where(~_any(F.col("text"), CONTENTS)).select("doc_id", "page"), ["doc_id", "page"])
    out = heads.groupBy("doc_id").agg(F.min("page").alias("from_heads"))
    if sections is None:
        return out.select("doc_id", F.col("from_heads").alias("main_start"))
    told = sections.where("kind = 'introduction' AND page_start IS NOT NULL").groupBy("doc_id").agg(F.min("page_start").alias("from_sections"))
    return out.join(told, "doc_id", "full").select("doc_id", F.coalesce("from_sections", "from_heads").alias("main_start"))


def service_role(text: Column, titles: Column, front: Column) -> Column:
    """Role of a service page, null for any other; ``front``: it lies before the main text, or there is none."""
    n = support(text)
    heading = F.exists(titles, lambda t: t.isin("задание", "assignment") | t.startswith("задание на выполнение") | t.startswith("assignment for"))
    phrase = _any(text, ["задание на выполнение"]) & _any(text, ["выпускной квалификационной работы"])
    review = F.arrays_overlap(titles, F.array(*map(F.lit, ["отзыв", "рецензия", "review"])))
    role = (
        F.when(((phrase | heading) & (n >= 2)) | (_any(text, ["задани", "assignment"]) & (n >= 3)), "assignment")
        .when(_any(text, ["календарный план"]) & _any(text, ["срок выполнения", "этапы выполнения"]), "calendar_plan")
        .when(_any(text, ["утверждаю"]) & _any(text, INSTITUTION) & (n >= 1), "approval")
        .when(_any(text, THESIS) & _any(text, PROGRAM) & _any(text, INSTITUTION), "title")
    )
    return F.when(review & (n >= 2), "review").when(front, role)


def roles(spans: DataFrame, pages: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``page``, ``role``, ``service`` and ``main_start`` of every page."""
    texts, titles = page_texts(spans), heading_titles(spans, pages)
    out = pages.select("doc_id", F.col("number").alias("page")).join(texts, ["doc_id", "page"], "left").join(titles, ["doc_id", "page"], "left").join(introduction(titles, texts, sections), "doc_id", "left")
    out = out.withColumns({"text": F.coalesce("text", F.lit("")), "titles": F.coalesce("titles", F.array().cast("array<string>"))})
    front = F.col("main_start").isNull() | (F.col("page") < F.col("main_start"))
    out = out.withColumn("found", service_role(F.col("text"), F.col("titles"), front))
    noted = F.coalesce(*[F.when(F.arrays_overlap("titles", F.array(*map(F.lit, t))), role) for role, t in NOTED.items()])
    role = F.coalesce("found", noted, F.when(F.col("page") >= F.col("main_start"), "main_text"), F.lit("unknown"))
    guide = _any(F.col("text"), ["методические рекомендации"])
    return out.select("doc_id", "page", role.alias("role"), F.col("found").isNotNull().alias("service"), "main_start", guide.alias("guide"))


def kinds(assessed: DataFrame) -> DataFrame:
    """Kind of each document and the ranges of its service pages."""
    out = assessed.groupBy("doc_id").agg(F.max("main_start").alias("main_start"), F.bool_and("service").alias("all_service"), F.bool_or("guide").alias("guide"))
    kind = F.when(F.col("main_start").isNotNull(), "thesis").when(F.col("all_service"), "service_document").when(F.col("guide"), "methodical_document").otherwise("unknown")
    ranges = range_text(islands(assessed.where("service"), ["doc_id"], "page"), ["doc_id"])
    return out.join(ranges, "doc_id", "left").select("doc_id", kind.alias("kind"), "main_start", F.coalesce("ranges", F.lit("none")).alias("service_pages"))


def excluded(assessed: DataFrame) -> DataFrame:
    """Pages that metrics leave out, as ``typography`` takes them."""
    return assessed.where("service").select("doc_id", "page")
