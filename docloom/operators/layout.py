"""Column splits of recognised pages from tables of word boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import wrapped
from ..functions.text import let, strip, text_of

#: A4 report pages in points (fixed values): height, margin, space kept at the foot, line height.
PAGE_HEIGHT, MARGIN, FOOT, LINE_HEIGHT = 841.89, 50, 20, 16


def lines_per_page() -> int:
    return int((PAGE_HEIGHT - MARGIN - (MARGIN + FOOT)) // LINE_HEIGHT) + 1


def report_pages(reports: DataFrame, text: str = "report", doc_id: str = "doc_id", width: int = 95) -> DataFrame:
    """(doc_id, page, lines): a report's wrapped lines on pages (W7, S15). All lines are of one height, so a page holds a fixed number."""
    n = lines_per_page()

    def pages(lines: Column) -> Column:
        numbers = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.ceil(F.size(lines) / n).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda k: F.struct(k.alias("page"), F.slice(lines, (k - 1) * n + 1, F.lit(n)).alias("lines")))

    rows = reports.select(F.col(doc_id).alias("doc_id"), let(wrapped(F.col(text), width), pages).alias("p"))
    return rows.select("doc_id", F.explode_outer("p").alias("p")).where("p IS NOT NULL").select("doc_id", "p.*")


def scale_of(width: Column, height: Column) -> Column:
    """How much an image is enlarged before recognition."""
    n = width.cast("long") * height
    return F.when(n < 1_500_000, 3).when(n < 4_000_000, 2).otherwise(1)


def better_reading(first: Column, second: Column, least: int = 30) -> Column:
    """The first reading of a page, unless it is short and the second is longer."""
    a, b = strip(text_of(first)), strip(text_of(second))
    return F.when((F.length(a) < least) & (F.length(b) > F.length(a)), b).otherwise(a)


def column_splits(boxes: DataFrame, widths: DataFrame) -> DataFrame:
    """(image_id, split): where two columns part, null if they do not.

    boxes: image_id, text, conf, left, width of words. widths: image_id, image_width.
    """
    used = boxes.where((F.coalesce("conf", F.lit(-1)) >= 20) & (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("width") > 0))
    used = used.select("image_id", (F.col("left") + F.col("width") / 2).alias("x"))
    own = Window.partitionBy("image_id").orderBy("x")
    gaps = used.withColumn("next", F.lead("x").over(own)).withColumn("gap", F.col("next") - F.col("x"))
    best = gaps.groupBy("image_id").agg(F.count("*").alias("n"), F.max_by(F.struct("x", "next", "gap"), F.struct("gap", (-F.col("x")).alias("o"))).alias("b"))
    at = (F.col("b.x") + F.col("b.next")) / 2
    fits = (F.col("n") >= 8) & (F.col("b.gap") > 0) & (at / F.col("image_width")).between(0.30, 0.70) & (F.col("b.gap") >= F.col("image_width") * 0.05)
    return widths.join(best, "image_id", "left").select("image_id", F.when(fits, at.cast("int")).alias("split"))


def complex_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, complex): pages whose text layer is poor or set in columns.

    pages: page_id, text, page_width. blocks: page_id, x0, x1, text.
    """
    from ..functions.extract import quality

    sides = blocks.where(F.trim("text") != "").select("page_id", ((F.col("x0") + F.col("x1")) / 2).alias("x")).join(pages.select("page_id", "page_width"), "page_id")
    n = sides.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("x") < F.col("page_width") * 0.46).alias("l"), F.count_if(F.col("x") > F.col("page_width") * 0.54).alias("r"))
    text = F.coalesce(pages["text"], F.lit(""))
    two = (F.col("n") >= 4) & (F.col("l") >= 2) & (F.col("r") >= 2)
    return pages.join(n, "page_id", "left").select("page_id", ((text == "") | (quality(text) < 0.72) | F.coalesce(two, F.lit(False))).alias("complex"))
