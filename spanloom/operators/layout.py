"""Pages: table geometry, reading order, routing, joining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import COLUMN_ROWS, COLUMN_TOLERANCE, IMAGE_AREA, LOW_OCR, TABLE_COLUMNS, TEXT_LAYER_CHARS

#: Fixed value: what stands before recognised text on a page with text of its own.
PICTURE_ON_PAGE = "\n\n[本页另含图片内容,以下为该图片的 OCR 识别结果]\n"


def table_like(lefts: Column) -> Column:
    """Whether left edges (array<double>) form at least two columns of three. Sorted edges belong together while they are within the tolerance of the
    group's first; a gap test between neighbours would chain."""
    zero = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("n"), F.lit(0).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["first"].isNotNull() & (F.abs(x - acc["first"]) <= COLUMN_TOLERANCE)
        n = F.when(same, acc["n"] + 1).otherwise(1)
        return F.struct(F.when(same, acc["first"]).otherwise(x).alias("first"), n.alias("n"), (acc["full"] + (n == COLUMN_ROWS).cast("int")).alias("full"))

    return (F.size(lefts) >= COLUMN_ROWS) & F.aggregate(F.array_sort(lefts), zero, step, lambda acc: acc["full"] >= TABLE_COLUMNS)


def table_pages(boxes: DataFrame) -> DataFrame:
    """(page_id, possible_table) over boxes (page_id, left)."""
    return boxes.groupBy("page_id").agg(F.collect_list("left").alias("_lefts")).select("page_id", table_like(F.col("_lefts")).alias("possible_table"))


def reading_order(lines: Column) -> Column:
    """Text of OCR lines (array<struct<text,confidence,left,bottom,...>>, origin at the bottom left), from the top down and from the left."""
    keyed = F.array_sort(F.transform(lines, lambda x, i: F.struct((-F.bround(x["bottom"], 3)).alias("y"), x["left"].alias("x"), i.alias("i"), x["text"].alias("text"))))
    return F.array_join(F.transform(keyed, lambda x: x["text"]), "\n")


def low_confidence(lines: Column) -> Column:
    return F.filter(lines, lambda x: x["confidence"] < LOW_OCR)


def page_route(text_layer: Column, areas: Column) -> Column:
    """text_layer, mixed or ocr: a page is taken at its text only if that is long enough and no image on it (pixel counts) is large."""
    enough = F.length(strip(text_layer)) >= TEXT_LAYER_CHARS
    image = F.exists(areas, lambda a: a >= IMAGE_AREA)
    return F.when(enough & ~image, "text_layer").when(enough, "mixed").otherwise("ocr")


def routed_text(route: Column, text_layer: Column, ocr_text: Column) -> Column:
    both = F.concat(F.regexp_replace(text_layer, r"\s+$", ""), F.lit(PICTURE_ON_PAGE), ocr_text)
    return F.when(route == "text_layer", text_layer).when(route == "mixed", both).otherwise(ocr_text)


def joined_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text) over pages (doc_id, page_number, text, source)."""
    tag = F.when(F.col("source") == "ocr", "(OCR)").when(F.col("source") == "mixed", "(含OCR)").otherwise("")
    part = F.concat(F.lit("\n\n=== 第 "), F.col("page_number").cast("string"), F.lit(" 页"), tag, F.lit(" ===\n"), "text")
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", part.alias("part")))), lambda p: p["part"]), "").alias("text"))


def normalised_boxes(tsv: Column) -> Column:
    """array<double>: left edges, as parts of the page width, of the lines (level 5) in a TSV listing whose page row (level 1) comes before them."""
    rows = F.filter(F.transform(F.slice(F.split(tsv, "\n"), 2, 1 << 30), lambda r: F.split(r, "\t")), lambda c: F.size(c) >= 11)
    zero = F.struct(F.lit(None).cast("double").alias("w"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        left, width = F.get(c, 6).try_cast("double"), F.get(c, 8).try_cast("double")
        good = left.isNotNull() & width.isNotNull() & F.get(c, 7).try_cast("double").isNotNull() & F.get(c, 9).try_cast("double").isNotNull()
        keep = good & (F.get(c, 0) == "5") & (acc["w"] > 0)
        return F.struct(F.when(good & (F.get(c, 0) == "1"), width).otherwise(acc["w"]).alias("w"), F.when(keep, F.concat(acc["out"], F.array(left / acc["w"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, zero, step, lambda acc: acc["out"])
