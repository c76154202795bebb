"""A PDF's spans as a document: text with offsets, headings, sections, and the pages that each interval of the text lies on.

Every step groups or sorts by document and carries spans, never pairs of them: a page range is found by one sweep over starts and ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, WORD
from ..storage import keep
from . import projects as P

#: How much larger than the body a heading is, its longest title, the margins of running headers and how little these move.
LARGER, LONGEST, TOP, BOTTOM, DRIFT = 1.18, 160, 0.15, 0.85, 0.03
#: Which headings win where several sources tell of one: smaller is better.
ORIGINS = {"latex_ast": 0, "pdf_outline": 1, "pdf_heading": 2}
#: Two characters or more are left without the spaces around them.
NAMED = rf"[^{SPACES[1:-2]}][{SPACES[1:-2]}]*+[^{SPACES[1:-2]}]"
HEADING = "struct<char_start:int,priority:int,level:int,title:string,page:int,origin:string>"


def with_offsets(spans: DataFrame) -> DataFrame:
    """Spans (``doc_id``, ``place``, ``block``, ``line``, ``text``) with running offsets: a line break behind each line and another behind each block. Empty spans go."""
    spans = spans.where("text <> ''")
    by = Window.partitionBy("doc_id").orderBy("place")
    block, line = F.lead("block").over(by), F.lead("line").over(by)
    gap = F.when(block.isNull(), 0).when(block != F.col("block"), 2).when(line != F.col("line"), 1).otherwise(0)
    out = spans.withColumn("gap", gap)
    start = F.coalesce(F.sum(F.length("text") + F.col("gap")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return out.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("text"))


def texts(spans: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of spans with offsets (and ``gap``)."""
    piece = F.struct("char_start", F.concat("text", F.repeat(F.lit("\n"), F.col("gap"))).alias("t"))
    return spans.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), "").alias("text"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACES}|{SPACES}$", "")


def font_headings(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id`` and a heading (``HEADING`` as columns) for each span that is larger than the document's median, running headers left out.

    A running header stands at the top or bottom of a page, on two pages or more, at nearly the same height. Spans are shuffled once: medians come from
    counts of sizes, and only spans whose first word may be that of a large span of their document are read in full.
    """
    named = spans.where(F.col("text").rlike(NAMED))
    there = pages.select("doc_id", F.col("number").alias("page"), "height")
    sizes = named.groupBy("doc_id", "page", "font_size").agg(F.count(F.lit(1)).alias("n")).join(there, ["doc_id", "page"])
    body = sizes.groupBy("doc_id").agg(F.percentile(F.when(F.col("font_size") > 0, F.col("font_size")), 0.5, F.col("n")).alias("median"))
    first = named.select("doc_id", "page", "char_start", "font_size", F.col("bbox.y0").alias("y0"), "text", F.regexp_extract(F.lower("text"), WORD, 0).alias("word"))
    bit = first.withColumn("bit", F.expr("shiftleft(1L, pmod(hash(word), 64))")).drop("word").join(body, "doc_id")
    judged = bit.withColumn("large", F.coalesce(F.col("font_size") >= F.col("median") * LARGER, F.lit(False))).drop("median", "font_size")
    judged = judged.withColumn("bits", F.bit_or(F.when(F.col("large"), F.col("bit"))).over(Window.partitionBy("doc_id"))).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    sized = judged.drop("bits", "bit").join(there, ["doc_id", "page"]).withColumn("title", _stripped(F.col("text")))
    sized = sized.withColumns({"y": F.col("y0") / F.col("height"), "norm": F.array_join(F.regexp_extract_all(F.lower("title"), F.lit(WORD), F.lit(0)), " ")}).drop("text")
    # Repetitions count smaller spans as well.
    same = Window.partitionBy("doc_id", "norm")
    again = sized.withColumns({"paged": F.min("page").over(same) != F.max("page").over(same), "drift": F.max("y").over(same) - F.min("y").over(same)})
    header = (F.col("norm") != "") & F.col("paged") & ((F.col("y") < TOP) | (F.col("y") > BOTTOM)) & (F.col("drift") < DRIFT)
    kept = again.where(F.col("large") & (F.length("title") <= LONGEST) & ~F.coalesce(header, F.lit(False)))
    return kept.select("doc_id", "char_start", F.lit(ORIGINS["pdf_heading"]).alias("priority"), F.lit(1).alias("level"), "title", "page", F.lit("pdf_heading").alias("origin"))


def outline_headings(outline: DataFrame, spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Headings of a PDF's outline (``doc_id``, ``level``, ``title``, ``page``): where their words stand on their page, else at its start."""
    ranges = spans.groupBy("doc_id", "page").agg(F.min("char_start").alias("lo"), F.max("char_end").alias("hi"))
    named = outline.withColumn("title", _stripped(F.col("title"))).where("title <> ''").join(ranges, ["doc_id", "page"]).join(documents.select("doc_id", "text"), "doc_id")
    at = F.expr("locate(lower(title), lower(substring(text, lo + 1, hi - lo)))")
    start = F.when(at > 0, F.col("lo") + at - 1).otherwise(F.col("lo"))
    return named.select("doc_id", start.cast("int").alias("char_start"), F.lit(ORIGINS["pdf_outline"]).alias("priority"), F.greatest(F.col("level"), F.lit(1)).alias("level"), "title", "page", F.lit("pdf_outline").alias("origin"))


def collapsed(headings: Column) -> Column:
    """Of headings (sorted, as ``HEADING``) at most two characters apart, or with one title on one page, the one of the better source.

    Each is held against the last that stayed, so this is a fold, not a window.
    """
    same_title = lambda a, b: P.plain_title(a["title"]) == P.plain_title(b["title"])

    def step(kept: Column, h: Column) -> Column:
        last = F.element_at(kept, -1)
        twin = (F.size(kept) > 0) & ((F.abs(h["char_start"] - last["char_start"]) <= 2) | (same_title(h, last) & h["page"].eqNullSafe(last["page"])))
        better = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(h))
        return F.when(~F.coalesce(twin, F.lit(False)), F.concat(kept, F.array(h))).when(h["priority"] < last["priority"], better).otherwise(kept)

    return F.aggregate(headings, F.array().cast(f"array<{HEADING}>"), step)


def documents(spans: DataFrame, pages: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``text`` and ``headings`` of PDFs, given spans with offsets. An outline counts before fonts; a document without any has no heading."""
    whole = texts(spans)
    found = font_headings(spans, pages)
    if outline is not None:
        told = outline_headings(outline, spans, whole)
        found = told.unionByName(found.join(told.select("doc_id").distinct(), "doc_id", "left_anti"))
    fields = [f.split(":")[0] for f in HEADING[7:-1].split(",")]
    heads = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).cast(f"array<{HEADING}>").alias("headings"))
    out = whole.join(heads, "doc_id", "left")
    return out.select("doc_id", "text", collapsed(F.coalesce("headings", F.array().cast(f"array<{HEADING}>"))).alias("headings"))


def page_ranges(intervals: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """``doc_id``, ``key``, ``page_start`` and ``page_end`` of intervals ``[char_start, char_end)``: pages of the spans that share a character with them.

    One union of the spans' starts with the intervals' starts and ends, sorted once for each document and read once: the last span that starts before
    an interval's end tells one page; the last that starts no later than its start, or the next if that has ended by then, the other, as spans follow
    one another and pages don't fall along the text. Null where no span lies inside.
    """
    none = {c: F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in key}
    empty = [F.lit(None).cast("int").alias(c) for c in ("page", "until")]
    inside = lambda at, side: intervals.select("doc_id", F.col(at).alias("at"), F.lit(side).alias("side"), *key, *empty)
    # At one place: intervals' ends before spans, and spans before intervals' starts.
    placed = spans.select("doc_id", F.col("char_start").alias("at"), F.lit(1).alias("side"), *none.values(), "page", F.col("char_end").alias("until"))
    every = inside("char_end", 0).unionByName(placed).unionByName(inside("char_start", 2)).withColumn("span", F.when(F.col("side") == 1, F.struct("at", "until", "page")))
    by = Window.partitionBy("doc_id").orderBy("at", "side", "until", "page")
    # Over a frame that ends with the document each row would start anew; this looks ahead once.
    after = F.expr("lead(span) IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY at, side, until, page)")
    seen = every.withColumns({"before": F.last("span", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), "after": after}).where("side <> 1")
    opened = F.when(F.col("before.until") > F.col("at"), F.col("before")).otherwise(F.col("after"))
    both = seen.groupBy("doc_id", *key).agg(F.max(F.when(F.col("side") == 2, F.struct("at", opened.alias("span")))).alias("a"), F.max(F.when(F.col("side") == 0, F.struct("at", F.col("before").alias("span")))).alias("b"))
    shares = (F.col("a.span.at") < F.col("b.at")) & (F.col("b.span.until") > F.col("a.at"))
    return both.select("doc_id", *key, F.when(shares, F.col("a.span.page")).alias("page_start"), F.when(shares, F.col("b.span.page")).alias("page_end"))


def sections(spark: SparkSession, docs: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections of PDFs (``documents``) with ``page_start`` and ``page_end``: pages of their spans, else that of their heading; without headings all pages."""
    found = keep(P.sections(spark, docs, collapse=False), "pdf-sections")
    ranged = found.join(page_ranges(found, spans, ["section_id"]), ["doc_id", "section_id"], "left")
    heads = docs.select("doc_id", F.explode("headings").alias("h")).select("doc_id", F.col("h.char_start").alias("char_start"), F.col("h.page").alias("heading_page")).groupBy("doc_id", "char_start").agg(F.min("heading_page").alias("heading_page"))
    ends = pages.groupBy("doc_id").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    out = ranged.join(heads, ["doc_id", "char_start"], "left").join(ends, "doc_id", "left")
    alone = F.col("section_id") == "document"
    start = F.when(alone, F.col("first")).otherwise(F.coalesce("page_start", "heading_page"))
    end = F.when(alone, F.col("last")).otherwise(F.coalesce("page_end", "heading_page"))
    return out.withColumns({"page_start": start, "page_end": end}).drop("heading_page", "first", "last")


def chunk_pages(chunks: DataFrame, spans: DataFrame, of: DataFrame) -> DataFrame:
    """``chunks`` (``doc_id``, ``section_id``, ``chunk_id``, offsets) with pages: those of their spans, else those of their section (``of``)."""
    own = page_ranges(chunks, spans, ["chunk_id"])
    section = of.select("doc_id", "section_id", F.col("page_start").alias("s0"), F.col("page_end").alias("s1"))
    out = chunks.join(own, ["doc_id", "chunk_id"], "left").join(section, ["doc_id", "section_id"], "left")
    return out.withColumns({"page_start": F.coalesce("page_start", "s0"), "page_end": F.coalesce("page_end", "s1")}).drop("s0", "s1")


def with_pages(sections_: DataFrame, printed: DataFrame) -> DataFrame:
    """Sections of a LaTeX source with the pages of the PDF's sections of the same name, the first with the first and so on."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "norm").orderBy("char_start"))
    there = printed.where("norm <> ''").withColumn("nth", nth).select("doc_id", "norm", "nth", "page_start", "page_end")
    return sections_.drop("page_start", "page_end").withColumn("nth", nth).join(there, ["doc_id", "norm", "nth"], "left").drop("nth")


def introduction_page(spans: DataFrame, pages: DataFrame, sections_: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``main_start``: the first introduction among sections, else among headings, else among spans that look like one; entries of a contents page don't count."""
    from ..plans import page_roles as R

    page_texts = R.page_texts(spans)
    body = page_texts.where(~R._any(F.col("text"), R.CONTENTS)).select("doc_id", "page")
    told = sections_.where("kind = 'introduction' AND page_start IS NOT NULL").groupBy("doc_id").agg(F.min("page_start").alias("a"))
    heads = docs.select("doc_id", F.explode("headings").alias("h")).select("doc_id", F.col("h.page").alias("page"), R.words(F.col("h.title")).alias("title"))
    named = heads.where(F.col("title").isin(*R.INTRODUCTION)).join(body, ["doc_id", "page"], "left_semi").groupBy("doc_id").agg(F.min("page").alias("b"))
    seen = R.introduction(R.heading_titles(spans, pages), page_texts).withColumnRenamed("main_start", "c")
    out = docs.select("doc_id").join(told, "doc_id", "left").join(named, "doc_id", "left").join(seen, "doc_id", "left")
    return out.select("doc_id", F.coalesce("a", "b", "c").alias("main_start"))
