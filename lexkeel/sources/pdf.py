"""PDF files as spans, pages and layout objects, where PyMuPDF is installed; reading order as columns.

The decoder is optional: without it rules take these tables from elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ligatures that are read as letters, and the least size of a drawing that counts.
LIGATURES = str.maketrans({"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"})
LEAST_DRAWING = 2.0
DECODED = "doc_id string, kind string, page int, n int, block int, line int, text string, font string, font_size double, flags int, box struct<x0:double,y0:double,x1:double,y1:double>, extra string"


def _box(raw) -> tuple[float, float, float, float]:
    return tuple(map(float, raw)) if raw is not None and len(raw) == 4 else (0.0, 0.0, 0.0, 0.0)


def _sound(box: tuple[float, float, float, float]) -> bool:
    return all(math.isfinite(v) for v in box) and box[0] < box[2] and box[1] < box[3]


def rows_of(doc: str, book) -> list[tuple]:
    """Rows of ``DECODED`` of one opened PDF: pages, spans, images and drawings as objects, and entries of the outline."""
    rows = []
    for n, page in enumerate(book, 1):
        rows.append((doc, "page", n, 0, None, None, None, None, None, None, (0.0, 0.0, float(page.rect.width), float(page.rect.height)), str(page.rotation)))
        spans = [(i, j, s) for i, b in enumerate(page.get_text("dict")["blocks"]) for j, line in enumerate(b.get("lines", [])) for s in line["spans"]]
        rows += [(doc, "span", n, k, i, j, s["text"].replace("\xa0", " ").translate(LIGATURES), s["font"], float(s["size"]), s["flags"], _box(s["bbox"]), None) for k, (i, j, s) in enumerate(spans)]
        told = [(_box(o.get("bbox")), "image", (o.get("digest") or b"").hex()) for o in page.get_image_info(hashes=True)]
        told += [(box, "vector", str(len(o.get("items", [])))) for o in page.get_drawings() if (box := _box(o.get("rect")))[2] - box[0] > LEAST_DRAWING and box[3] - box[1] > LEAST_DRAWING]
        for k, (box, kind, mark) in enumerate((b, kind, mark) for b, kind, mark in told if _sound(b)):
            size = f"{box[2] - box[0]:.1f}x{box[3] - box[1]:.1f}"
            rows.append((doc, "object", n, k, None, None, kind, None, None, None, box, f"{size}:{mark}" if kind == "vector" else mark or size))
    rows += [(doc, "outline", int(entry[2]), k, int(entry[0]), None, str(entry[1]), None, None, None, None, None) for k, entry in enumerate(book.get_toc(simple=True) or []) if len(entry) >= 3]
    return rows


def decode(files: DataFrame) -> DataFrame:
    """Rows ``kind`` (page, span, object, outline or error) of ``doc_id`` and binary ``content``, one file a row at a time; a file that can't be read is an error of its own."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise RuntimeError("decoding PDF files needs PyMuPDF; give tables of spans and pages instead") from e

    def run(batches):
        import fitz
        import pandas as pd

        for pdf in batches:
            for doc, raw in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    with fitz.open(stream=bytes(raw), filetype="pdf") as book:
                        rows = rows_of(doc, book)
                except Exception as e:
                    rows = [(doc, "error", None, 0, None, None, type(e).__name__, None, None, None, None, None)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in DECODED.replace("struct<x0:double,y0:double,x1:double,y1:double>", "x").split(", ")])

    return files.mapInPandas(run, DECODED)


def tables(decoded: DataFrame) -> dict[str, DataFrame]:
    """``pages``, ``spans`` (in reading order, as ``pdf_bundle`` takes them), ``objects`` and ``outline`` of decoded rows."""
    pages = decoded.where("kind = 'page'").select("doc_id", F.col("page").alias("number"), F.col("box.x1").alias("width"), F.col("box.y1").alias("height"), F.col("extra").cast("int").alias("rotation"))
    spans = decoded.where("kind = 'span'").select("doc_id", "page", "n", "block", "line", "text", "font", "font_size", "flags", F.col("box").alias("bbox"))
    edges = [f("bbox." + c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    blocks = spans.groupBy("doc_id", "page", "block").agg(*edges).select("doc_id", "page", "block", F.struct("x0", "y0", "x1", "y1").alias("bbox"))
    blocks = reading_order(blocks.join(pages.select("doc_id", F.col("number").alias("page"), "width"), ["doc_id", "page"])).select("doc_id", "page", "block", F.col("place").alias("order"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "order", "line", "n")) - 1
    # A block of one page isn't that of another.
    read = spans.join(blocks, ["doc_id", "page", "block"]).withColumn("place", place).withColumn("block", F.col("page") * 100_000 + F.col("block")).drop("n", "order")
    objects = decoded.where("kind = 'object'").select("doc_id", "page", F.col("box").alias("bbox"), F.col("text").alias("kind"), F.col("extra").alias("signature"))
    outline = decoded.where("kind = 'outline'").select("doc_id", F.col("block").alias("level"), F.col("text").alias("title"), "page")
    return {"pages": pages, "spans": read, "objects": objects, "outline": outline}


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds ``place`` to blocks (``doc_id``, ``page``, ``bbox``, ``width`` of the page): a full-width block ends the columns above it.

    Blocks narrower than 65 % of the page lie in the left or right column by their centre. Order: what is above the columns, left, full-width
    blocks between, right, what is below.
    """
    page = Window.partitionBy("doc_id", "page")
    b = F.col("bbox")
    narrow = (b["x1"] - b["x0"]) < 0.65 * F.col("width")
    left = narrow & ((b["x0"] + b["x1"]) / 2 < F.col("width") / 2)
    right = narrow & ~left
    out = blocks.withColumns({"narrow": narrow, "left": left, "right": right})
    both = F.max(F.col("left").cast("int")).over(page) + F.max(F.col("right").cast("int")).over(page) == 2
    top, bottom = F.min(F.when(F.col("narrow"), b["y0"])).over(page), F.max(F.when(F.col("narrow"), b["y1"])).over(page)
    zone = F.when(~both, 0).when(F.col("left"), 1).when(F.col("right"), 3).when(b["y1"] <= top, 0).when(b["y0"] >= bottom, 4).otherwise(2)
    out = out.withColumn("zone", zone)
    return out.withColumn("place", F.row_number().over(page.orderBy("zone", F.col("bbox.y0"), F.col("bbox.x0")))).drop("narrow", "left", "right", "zone")


def with_offsets(spans: DataFrame) -> DataFrame:
    """Spans (``doc_id``, ``place``, ``text``) with running character offsets, a line break between spans."""
    before = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return spans.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("text"))

