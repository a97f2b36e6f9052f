"""Reading order and neighbours of positioned text blocks (doc_id, block_no, page, x0, y0, x1, y1, text, is_bold, font_size).

Ties of geometry go by block_no. Null texts are left out of joined text, null geometry makes no column and no neighbour. Empty tables
give no rows. Further columns are ignored, but columns() keeps them and adds two and col.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivel.functions.text import is_form_label, is_name, is_noise, strip


def columns(blocks: DataFrame) -> DataFrame:
    """LAY1: adds col, 0 or 1. A page has two columns if each side has 3 blocks or more and the gap is over 20."""
    page = Window.partitionBy("doc_id", "page")
    left = (F.col("x0") + F.col("x1")) / 2 < 0.85 * F.max("x1").over(page) / 2
    marked = blocks.withColumn("is_left", left)
    side = lambda want: F.count(F.when(F.col("is_left") == want, 1)).over(page)
    gap = F.min(F.when(~F.col("is_left"), F.col("x0"))).over(page) - F.max(F.when(F.col("is_left"), F.col("x1"))).over(page)
    two = (side(True) >= 3) & (side(False) >= 3) & (gap > 20)
    return marked.withColumn("two", two).withColumn("col", F.when(F.col("two") & ~F.col("is_left"), 1).otherwise(0)).drop("is_left")


def reading_order(blocks: DataFrame) -> DataFrame:
    """LAY2, LAY3: doc_id, layout_text (pages, then columns, then from the top; bold or large blocks marked) and raw_text (block order)."""
    marked = F.when(F.col("is_bold") | (F.col("font_size") > 12), F.concat(F.lit("\n[SECTION] "), F.col("text"))).otherwise(F.col("text"))
    key = F.struct("page", "col", "y0", F.when(F.col("two"), F.lit(0.0)).otherwise(F.col("x0")).alias("tie"), "block_no", marked.alias("t"))
    by = columns(blocks).groupBy("doc_id").agg(F.array_sort(F.collect_list(key)).alias("b"), F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("r"))
    return by.select("doc_id", F.array_join(F.col("b.t"), "\n").alias("layout_text"), F.array_join(F.col("r.text"), "\n").alias("raw_text"))


def adjacent(blocks: DataFrame) -> DataFrame:
    """LAY4: doc_id, pos, label, value from neighbours in (page, y0, x0) order on one line."""
    order = Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "block_no")
    nxt = lambda c: F.lead(c).over(order)
    b = blocks.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "y0", "x1", strip(F.regexp_replace("text", ":+$", "")).alias("label"), strip(nxt("text")).alias("value"), nxt("y0").alias("y"), nxt("x0").alias("x"))
    ok = (F.abs(F.col("y0") - F.col("y")) < 5) & (F.col("x1") < F.col("x")) & (F.col("label") != "") & (F.length("label") < 60)
    return b.where(ok & ~is_form_label(F.col("label")) & ~is_noise(F.col("value")) & ~is_form_label(F.col("value"))).select("doc_id", "pos", "label", "value")


def prominent_name(blocks: DataFrame) -> DataFrame:
    """LAY5: doc_id, name: of the 15 largest blocks of the first page the first whose first line is a name in large or bold type."""
    order = Window.partitionBy("doc_id").orderBy(F.col("font_size").desc(), "y0", "block_no")
    line = strip(F.substring_index("text", "\n", 1))
    top = blocks.where("page = 0").withColumn("rank", F.row_number().over(order)).where("rank <= 15").withColumn("name", line)
    large = (F.col("font_size") >= 13) | (F.col("is_bold") & (F.col("font_size") >= 11))
    return top.where(large & is_name(F.col("name"))).groupBy("doc_id").agg(F.min_by("name", "rank").alias("name"))


def classify(docs: DataFrame, blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """MTH1, MTH2, AGG4 to AGG6, AGG17: form or free text by six signals, of docs (doc_id, raw_text), blocks and tables (doc_id, table_no, row_no, cells)."""
    from functools import reduce

    from scrivel.functions import rules as R

    b = blocks.groupBy("doc_id").agg((F.max(F.when(F.col("font_size") > 0, F.round("font_size", 1))) - F.min(F.when(F.col("font_size") > 0, F.round("font_size", 1)))).alias("fonts"), F.count_distinct("page").alias("pages"))
    t = tables.groupBy("doc_id").agg(F.sum(F.size("cells")).alias("cells"), F.count_distinct("table_no").alias("tables"))
    low = F.lower("raw_text")
    hits = reduce(lambda x, y: x + y, [low.contains(k).cast("int") for k in R.FORM_KEYWORDS])
    one = lambda x: F.least(x, F.lit(1.0))
    d = docs.join(b, "doc_id", "left").join(t, "doc_id", "left").select(
        "doc_id",
        one(F.coalesce("cells", F.lit(0)) / 100).alias("table_density"),
        one((F.length("raw_text") - F.length(F.replace("raw_text", F.lit("*"), F.lit("")))) / 10).alias("asterisk_labels"),
        one(hits / 3).alias("form_keywords"),
        F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("fonts") / 10), F.lit(0.5)).alias("font_variance"),
        one(F.size(F.regexp_extract_all("raw_text", F.lit(R.PICKLIST_ID), F.lit(0))) / 5).alias("picklist_ids"),
        one(F.coalesce("tables", F.lit(0)) / F.greatest(F.coalesce("pages", F.lit(0)), F.lit(1)) / 2).alias("multi_page_tables"),
    )
    score = reduce(lambda x, y: x + y, [F.col(k) * w for k, w in R.SIGNAL_WEIGHTS.items()])
    d = d.withColumn("form_score", score)
    form = F.col("form_score") >= 0.35
    return d.withColumn("kind", F.when(form, "structured_form").otherwise("free_form")).withColumn("confidence", one(F.when(form, F.col("form_score")).otherwise(1 - F.col("form_score")) / 0.5))
