"""SRC3: blocks and table rows from the spans and cells that a page reader gives, by columns alone. Any PDF reader can stand before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivel.functions.text import is_form_label, is_noise

BOLD_FLAG = 16


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blocks(spans: DataFrame) -> DataFrame:
    """doc_id, block_no, page, x0, y0, x1, y1, text, is_bold, font_size, from spans of blocks.

    spans: doc_id, page, block, line, span (places), kind (0 for text), x0, y0, x1, y1 (of the block), text, font, flags,
    size. The spans of a line follow each other, lines are joined by line breaks. A block is bold if any span's font says
    so or its flag does, and as large as its largest span. Blank blocks and noise are left out; places count from 0.
    """
    c = F.col
    bold = F.coalesce(F.lower("font").contains("bold"), F.lit(False)) | F.coalesce(c("flags").bitwiseAND(BOLD_FLAG) != 0, F.lit(False))
    held = F.array_sort(F.collect_list(F.struct("line", "span", F.coalesce("text", F.lit("")).alias("t"))))
    by = spans.where("kind = 0").groupBy("doc_id", "page", "block").agg(*(F.first(k).alias(k) for k in ("x0", "y0", "x1", "y1")), held.alias("s"), F.bool_or(bold).alias("is_bold"), F.max("size").alias("font_size"))
    start = F.struct(F.lit(None).cast(spans.schema["line"].dataType).alias("line"), F.lit("").alias("t"))
    joined = F.aggregate("s", start, lambda acc, x: F.struct(x["line"].alias("line"), F.concat(acc["t"], F.when(acc["line"] != x["line"], "\n").otherwise(""), x["t"]).alias("t")))["t"]
    out = by.withColumn("text", _strip(joined)).where(~is_noise(c("text")))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block")) - 1
    return out.select("doc_id", at.alias("block_no"), "page", "x0", "y0", "x1", "y1", "text", "is_bold", "font_size")


def table_rows(rows: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, cells: rows with a cell that is data; null cells are empty ones."""
    trimmed = F.transform("cells", lambda x: F.coalesce(_strip(x), F.lit("")))
    data = F.exists("cells", lambda x: ~is_noise(x) & ~is_form_label(x))
    return rows.withColumn("cells", trimmed).where(data).select("doc_id", "table_no", "row_no", "cells")
