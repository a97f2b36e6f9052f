"""Records: assembly in schema order, defaults, required and unknown keys, reports.

Null values are missing ones. A document's repeated key is written as often as it occurs, in schema order; keys outside the schema are
left out. Reports of no rows are one row of zeros (means: null), groups of no rows none. Further columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivel.functions import rules as R
from scrivel.functions.dates import date_string
from scrivel.functions.text import strip

MARKS = ["correct", "wrong", "partial", "missing"]


def split_schema(field_defs: DataFrame) -> DataFrame:
    """SRC7: adds section and nested_key from ids with three dotted parts or more."""
    p = F.split("field_id", r"\.")
    return field_defs.withColumn("section", F.when(F.size(p) >= 3, F.get(p, F.lit(0)))).withColumn("nested_key", F.when(F.size(p) >= 3, F.get(p, F.lit(2))))


def typed(value: Column, option_id: Column, field_type: Column, nested: Column) -> Column:
    """JSN3: the output text of a value by field type; words for still-going dates mean the far future in sections only."""
    picked = F.coalesce(F.nullif(option_id, F.lit("")), value)
    still = ~nested & F.lower(strip(value)).isin(R.ONGOING)
    # bound once: every date pattern would repeat the whole expression otherwise, beyond what a generated method holds
    day = F.get(F.transform(F.array(F.when((field_type == "DateTime") & ~still, value)), lambda x: date_string(x, True)), F.lit(0))
    return F.when(field_type == "Picklist", picked).when(field_type == "DateTime", F.coalesce(day, value)).when((field_type == "Boolean") & ~nested, F.lower(value)).otherwise(value)


def with_defaults(fields: DataFrame, field_defs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """JOIN9: documents' (doc_id, field_id, value) with the three defaults put in where the schema has the field and the value is missing.

    docs: doc_id of all documents, if some may have no field. Three rows a document, in the task that has it.
    """
    standard = F.array(*(F.struct(F.lit(k).alias("field_id"), F.lit(v).alias("standard")) for k, v in R.DEFAULTS.items()))
    known = field_defs.select("field_id").distinct()
    want = (docs or fields).select("doc_id").distinct().select("doc_id", F.inline(standard)).join(known, "field_id", "left_semi")
    return want.join(fields, ["doc_id", "field_id"], "full").select("doc_id", "field_id", F.coalesce("value", "standard").alias("value"))


def required_ids(field_defs: DataFrame) -> Column:
    """The required field ids as one array: a scalar subquery over the dictionary, no join."""
    return field_defs.where("required").agg(F.array_sort(F.collect_set("field_id"))).scalar()


def documents(fields: DataFrame, field_defs: DataFrame) -> DataFrame:
    """doc_id, record, paths (distinct keys and section.keys of the record) and present (top-level ids) from typed fields, by one exchange.

    fields: doc_id, field_id, entry_no (null at the top level), value (typed), resolved (a picklist id was found). Rows are
    folded by entry, then by section, then by document; all three are dealt by doc_id.
    """
    c, none = F.col, F.lit(None)
    place = F.min("ordinal").over(Window.partitionBy("section"))
    d = split_schema(field_defs).select("field_id", "field_type", "ordinal", "section", "nested_key", place.alias("place"))
    f = fields.join(d, "field_id").where("value is not null").repartition("doc_id")
    text = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    item = lambda key, body: F.concat(F.lit('"'), key, F.lit('":'), body)
    top, filled = c("section").isNull(), c("section").isNull() | (c("value") != "")
    coded = F.when(top & (c("field_type") == "Picklist") & c("resolved"), F.concat(F.lit('{"id":'), text(c("value")), F.lit("}"))).otherwise(text(c("value")))
    part = F.struct(c("ordinal").cast("long").alias("ordinal"), item(F.when(top, c("field_id")).otherwise(c("nested_key")), coded).alias("part"))
    paths = F.array_compact(F.array(F.coalesce("section", "field_id"), F.when(~top, F.concat_ws(".", "section", "nested_key"))))
    by_entry = f.where(filled).groupBy("doc_id", "section", "entry_no").agg(F.min("place").alias("place"), F.array_sort(F.collect_list(part)).alias("parts"), F.array_distinct(F.flatten(F.collect_set(paths))).alias("paths"), F.collect_set(F.when(top, c("field_id"))).alias("present"))
    body = F.struct("entry_no", F.concat(F.lit("{"), F.array_join(c("parts")["part"], ","), F.lit("}")).alias("t"))
    by_section = by_entry.groupBy("doc_id", "section").agg(F.min("place").alias("place"), F.flatten(F.collect_list("parts")).alias("parts"), F.array_sort(F.collect_list(body))["t"].alias("entries"), F.flatten(F.collect_list("paths")).alias("paths"), F.flatten(F.collect_list("present")).alias("present"))
    whole = F.struct((c("place") + 1_000_000).cast("long").alias("ordinal"), item(c("section"), F.concat(F.lit('{"results":['), F.array_join("entries", ","), F.lit("]}"))).alias("part"))
    parts = F.when(top, c("parts")).otherwise(F.array(whole))
    out = by_section.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list(parts)))["part"].alias("ps"), F.array_distinct(F.flatten(F.collect_list("paths"))).alias("paths"), F.flatten(F.collect_list("present")).alias("present"))
    return out.select("doc_id", F.concat(F.lit('[{"__metadata":{"uri":"Candidate"},'), F.array_join("ps", ","), F.lit("}]")).alias("record"), "paths", "present")


def assemble(fields: DataFrame, field_defs: DataFrame) -> DataFrame:
    """JSN2, FLT13, SNK1: doc_id, record: an array of one object with keys in schema order, nested entries under section.results."""
    return documents(fields, field_defs).select("doc_id", "record")


def missing_required(fields: DataFrame, field_defs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """JOIN10: doc_id, field_id of required fields a document lacks. docs: doc_id of all documents, if some may have no field."""
    rows = fields.select("doc_id", "field_id")
    if docs is not None:
        rows = rows.unionByName(docs.select("doc_id", F.lit(None).cast("string").alias("field_id")))
    has = rows.groupBy("doc_id").agg(F.collect_set("field_id").alias("has"))
    return has.select("doc_id", F.explode(F.array_except(required_ids(field_defs), "has")).alias("field_id"))


def unknown_keys(keys: DataFrame, field_defs: DataFrame) -> DataFrame:
    """JOIN11: (doc_id, field_id) outside the schema."""
    return keys.join(field_defs.select("field_id"), "field_id", "left_anti")


def json_paths(rows: DataFrame, column: str) -> DataFrame:
    """JSN4, AGG3: doc_id, path for each distinct key of JSON objects and section.key for those of the entries in its results; other objects are not entered."""
    top = rows.select("doc_id", F.explode(F.from_json(column, "map<string,string>")).alias("key", "value")).where("key != '__metadata'")
    entries = F.from_json(F.from_json(F.when(F.col("value").startswith("{"), F.col("value")), "map<string,string>")["results"], "array<map<string,string>>")
    below = top.select("doc_id", "key", F.explode(F.array_distinct(F.flatten(F.transform(entries, F.map_keys)))).alias("inner"))
    return top.select("doc_id", F.col("key").alias("path")).union(below.select("doc_id", F.concat_ws(".", "key", "inner"))).distinct()


def issue_categories(issues: DataFrame, most: int = 10) -> DataFrame:
    """AGG8, SRT3: the most frequent texts before a colon; ties to the first seen (column seen), then by name."""
    by = issues.withColumn("category", strip(F.substring_index("issue", ":", 1))).groupBy("category").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    return by.orderBy(F.col("n").desc(), "seen", "category").limit(most)


def batch_report(results: DataFrame) -> DataFrame:
    """AGG1, AGG2, SNK2: files, successes, errors, means over all files."""
    n = F.greatest(F.count("*"), F.lit(1))
    counts = results.agg(F.count("*").alias("total_files"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "error").alias("errors"), (F.sum("fields_extracted") / n).alias("avg_fields_per_file"), F.sum("elapsed_ms").alias("total_time_ms"))
    return counts.withColumn("avg_fields_per_file", rounded("avg_fields_per_file", 1))


def verdicts(rows: DataFrame, by: list[str]) -> DataFrame:
    """AGG9, AGG10: counts of verdicts (skip left out; missing counts in the total only) and accuracy in percent."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = rows.where("verdict != 'skip'").groupBy(*by).agg(*(n(v).alias(v) for v in MARKS[:3]), F.count("*").alias("total"))
    return with_accuracy(out)


def with_accuracy(counts: DataFrame) -> DataFrame:
    return counts.withColumn("accuracy", rounded((F.col("correct") + 0.5 * F.col("partial")) / F.greatest("total", F.lit(1)) * 100, 1))


def overall_accuracy(rows: DataFrame) -> DataFrame:
    """AGG11: fields and their sum, by rollup; rows of entry counts (field _count) are left out."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = rows.where("verdict != 'skip' and field != '_count'").rollup("field").agg(n("correct").alias("correct"), n("partial").alias("partial"), F.count("*").alias("total"))
    return out.withColumn("accuracy", (F.col("correct") + 0.5 * F.col("partial")) / F.greatest("total", F.lit(1)) * 100)


def weighted_score(scores: DataFrame) -> DataFrame:
    """AGG12: (cv_id, path, score) to cv_id, score by the weight table."""
    w = F.create_map(*(F.lit(x) for pair in R.WEIGHTS.items() for x in pair))
    joined = scores.withColumn("weight", F.coalesce(F.try_element_at(w, F.col("path")), F.lit(1.0)))
    return joined.groupBy("cv_id").agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("score"))


def suite(results: DataFrame, floor: float = 0.8, least: int = 8, mean: float = 0.75) -> DataFrame:
    """AGG13, SCO5: passed, total, mean, suite_passed."""
    return results.agg(F.count_if(F.round("score", 4) >= floor).alias("passed"), F.count("*").alias("total"), F.avg("score").alias("mean")).withColumn("suite_passed", (F.col("passed") >= least) & (F.col("mean") >= mean))


def rounded(x: Column | str, places: int) -> Column:
    """MTH7: to the nearest, halves to the even digit, by the exact binary value; for the few rows of a report."""

    @F.pandas_udf("double")
    def near(v: pd.Series) -> pd.Series:
        return v.map(lambda y: None if y is None or y != y else round(y, places)).astype("float64")

    return near(x)


def job_status(results: DataFrame) -> DataFrame:
    """AGG15, D16: progress of jobs (job_id, status, fields)."""
    return results.groupBy("job_id").agg(F.count("*").alias("done"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "error").alias("errors"), F.avg("fields").alias("avg_fields"))


def low_confidence(c: Column, floor: float = 0.7) -> Column:
    """FLT14"""
    return F.map_filter(c, lambda _, v: v < floor)

