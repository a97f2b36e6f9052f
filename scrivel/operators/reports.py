"""Reviews, jobs and what is told about them: verdict rows, resumed work, progress, console values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivel.functions.text import bound
from scrivel.operators.records import MARKS, verdicts, with_accuracy


def verdict_rows(reviews: DataFrame) -> DataFrame:
    """SRC11: file, section (null at the top level), entry, field, verdict from reviews (file, review: JSON text).

    A review has verdicts by field, and by section the one of its entry count (field _count) and those of its entries by field.
    Texts that are no such JSON give no rows; the same verdict twice is two rows.
    """
    flat, deep = "map<string,string>", "map<string,map<string,string>>"
    none = F.lit(None).cast("string")
    row = lambda section, entry, field, verdict: F.struct(section.alias("section"), entry.alias("entry"), field.alias("field"), verdict.alias("verdict"))
    empty = F.array().cast("array<struct<section:string,entry:string,field:string,verdict:string>>")
    each = lambda members, f: F.coalesce(F.transform(F.map_entries(members), f), empty)
    all_of = lambda members, f: F.coalesce(F.flatten(F.transform(F.map_entries(members), f)), empty)
    fields = lambda s, e: each(F.from_json(e["value"], flat), lambda x: row(s["key"], e["key"], x["key"], x["value"]))
    of = lambda s: all_of(s["value"], lambda e: F.when(e["key"] == "_count", F.array(row(s["key"], none, e["key"], e["value"]))).otherwise(fields(s, e)))
    told = bound(F.from_json("review", f"fields {flat}, sections {deep}"), lambda r: F.concat(each(r["fields"], lambda x: row(none, none, x["key"], x["value"])), all_of(r["sections"], of)))
    return reviews.select("file", F.explode_outer(told).alias("x")).where("x is not null").select("file", "x.*")


def accuracy_report(rows: DataFrame) -> DataFrame:
    """SNK5, AGG9 to AGG11, SRT6: part (top_level, section_count, section_field, overall), section, field, the counts and accuracy, sorted by name.

    rows: verdict_rows. The overall line sums all but the entry counts; skipped fields count nowhere. A section without any
    field verdict has no count line, as sections are listed by their fields.
    """
    c, none = F.col, F.lit(None).cast("string")
    part = F.when(c("section").isNull(), "top_level").when(c("field") == "_count", "section_count").otherwise("section_field")
    # one pass over the verdicts; all else is sums of these few lines
    lines = verdicts(rows.withColumn("part", part), ["part", "section", "field"]).drop("accuracy")
    has_fields = F.max(c("part") == "section_field").over(Window.partitionBy("section"))
    shown = lines.withColumn("has_fields", has_fields).where("part != 'section_count' or has_fields")
    own = F.struct("part", "section", "field")
    overall = F.when(c("part") != "section_count", F.struct(F.lit("overall").alias("part"), none.alias("section"), none.alias("field")))
    counts = [*MARKS[:3], "total"]
    both = shown.select(F.explode(F.array_compact(F.array(own, overall))).alias("of"), *counts).select("of.*", *counts)
    return with_accuracy(both.groupBy("part", "section", "field").agg(*(F.sum(k).alias(k) for k in counts))).orderBy("part", "section", "field")


def to_review(files: DataFrame, outputs: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """JOIN12, REV2: files (name, stem, ...) that have an output (stem, ...) and, when work is resumed, no review yet (stem)."""
    paired = files.join(outputs, "stem")
    return paired if reviewed is None else paired.join(reviewed.select("stem"), "stem", "left_anti")


def stored_names(uploads: DataFrame) -> DataFrame:
    """SRC13: adds stored, the name under which an upload (job_id, seq, name) is kept: a name that the job has already gets six hex digits in front.

    The digits come from job, place and name, so a repeated run stores the same names.
    """
    nth = F.row_number().over(Window.partitionBy("job_id", "name").orderBy("seq"))
    digits = F.left(F.md5(F.concat_ws("/", "job_id", F.col("seq").cast("string"), "name")), F.lit(6))
    return uploads.withColumn("stored", F.when(nth == 1, F.col("name")).otherwise(F.concat_ws("_", digits, "name")))


def job_states(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """ORC4, D16: job_id, status (running, done), total, done, success, errors, avg_fields of jobs (job_id, total) by their results so far (job_id, status, fields)."""
    c = F.col
    so_far = results.groupBy("job_id").agg(F.count("*").alias("done"), F.count_if(c("status") == "success").alias("success"), F.sum("fields").alias("fields"))
    rows = jobs.select("job_id", c("total").cast("long").alias("total")).join(so_far, "job_id", "left").na.fill(0, ["done", "success"])
    mean = F.when(c("done") > 0, F.bround(F.coalesce("fields", F.lit(0)) / F.greatest("done", F.lit(1)), 1)).otherwise(0.0)
    return rows.select("job_id", F.when(c("done") >= c("total"), "done").otherwise("running").alias("status"), "total", "done", "success", (c("done") - c("success")).alias("errors"), mean.alias("avg_fields"))


def console(results: DataFrame, width: int = 40) -> DataFrame:
    """SNK7: cv_id, verdict, bar and percent of scored records, as they are shown."""
    full = F.floor(F.col("score") * width).cast("int")
    bar = F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))
    return results.select("cv_id", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("verdict"), bar.alias("bar"), F.format_string("%.1f%%", F.col("score") * 100).alias("percent"))
