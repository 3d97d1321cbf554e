"""Recognition of page images: which readings are asked for, and how they are put together.

The engine is a parameter, as pixels are none of Spark's business: words(image)
gives (width of the image, [(text, confidence, left, width) of words]), read(image,
mode, span) the text between two edges (None: all of it). Each reading is a
column of its own, asked for only where the ones before are not good enough.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_scan, strip, text_of
from .layout import better_reading, column_splits

#: Engine modes (fixed values): one block of text, and sparse text. Least characters of a reading that is good enough.
BLOCK, SPARSE, LEAST = 6, 11, 30


def edges(width: Column, split: Column) -> Column:
    """(left, right): where the left column ends and the right one begins, with a margin of 1.5 % of the width."""
    margin = F.floor(width * 0.015).cast("int")
    return F.struct(F.greatest(F.lit(1), split - margin).alias("left"), F.least(width - 1, split + margin).alias("right"))


def joined_columns(left: Column, right: Column) -> Column:
    """The cleaned texts of two columns, one after the other; empty if there is too little."""
    enough = F.length(left) + F.length(right) >= LEAST
    return F.when(enough, strip(F.concat_ws("\n\n", F.nullif(left, F.lit("")), F.nullif(right, F.lit(""))))).otherwise(F.lit(""))


def page_text(two: Column, block: Column, sparse: Column) -> Column:
    """The text of a page: its columns if they were read, else the better of two readings of the whole page."""
    return clean_scan(F.when(F.length(two) >= LEAST, two).otherwise(better_reading(block, sparse, LEAST)))


def recognise(images: DataFrame, words: Callable, read: Callable, image_id: str = "image_id", image: str = "image") -> DataFrame:
    """(image_id, text) for every image, by unique ids; what an engine fails on is empty text."""

    @F.pandas_udf("width int, words array<struct<text:string,conf:double,left:int,width:int>>")
    def boxes(column: pd.Series) -> pd.DataFrame:
        out = []
        for x in column:
            try:
                w, found = words(x)
                out.append((w, [dict(zip(("text", "conf", "left", "width"), b, strict=True)) for b in found]))
            except Exception:  # noqa: BLE001  an engine's failure is a page without columns
                out.append((None, []))
        return pd.DataFrame(out, columns=["width", "words"])

    def reading(mode: int):
        @F.pandas_udf("string")
        def text(column: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            out = []
            for x, low, high in zip(column, a, b, strict=True):
                try:
                    out.append("" if x is None else read(x, mode, None if pd.isna(low) else (int(low), None if pd.isna(high) else int(high))))
                except Exception:  # noqa: BLE001  as above
                    out.append("")
            return pd.Series(out, dtype=object)

        return text

    none = F.lit(None).cast("int")
    block, sparse = reading(BLOCK), reading(SPARSE)
    rows = images.select(F.col(image_id).alias("image_id"), F.col(image).alias("image")).withColumn("b", boxes("image"))
    listed = rows.select("image_id", F.explode("b.words").alias("w")).select("image_id", "w.*")
    found = column_splits(listed, rows.select("image_id", F.col("b.width").alias("image_width")))
    rows = rows.join(found, "image_id").withColumn("e", edges(F.col("b.width"), F.col("split")))
    own = F.when(F.col("split").isNotNull(), F.col("image"))
    rows = rows.withColumn("l", clean_scan(block(own, F.lit(0), F.col("e.left")))).withColumn("r", clean_scan(block(own, F.col("e.right"), none)))
    rows = rows.withColumn("two", joined_columns(text_of(F.col("l")), text_of(F.col("r"))))
    rows = rows.withColumn("block", clean_scan(block(F.when(F.length("two") < LEAST, F.col("image")), none, none)))
    rows = rows.withColumn("sparse", clean_scan(sparse(F.when((F.length("two") < LEAST) & (F.length("block") < LEAST), F.col("image")), none, none)))
    return rows.select("image_id", page_text(F.col("two"), F.col("block"), F.col("sparse")).alias("text"))
