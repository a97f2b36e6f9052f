"""The whole batch as one plan: documents to typed records, a result row for each, and the batch report."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.functions import rules as R
from scrivel.operators import layout, lines, matching, personal, records
from scrivel.plans import extract
from scrivel.sources import files, sinks
from scrivel.streaming.shared import written

EMPTY_RECORD = '[{"__metadata":{"uri":"Candidate"}}]'


def typed_fields(docs: DataFrame, found: DataFrame, entries: DataFrame, field_defs: DataFrame, picklists: DataFrame) -> DataFrame:
    """doc_id, field_id, entry_no, value, resolved: extracted values under their schema ids, defaults put in, codes and dates in output form.

    docs: doc_id; found: doc_id and a column for each personal field; entries: doc_id, section, entry_no, keys. Keys
    outside the schema are dropped.
    """
    d = records.split_schema(field_defs)
    named = [c for c in found.columns if c != "doc_id"]
    long = found.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("field_id"), F.col(n).cast("string").alias("value")) for n in named))).alias("x")).select("doc_id", "x.*").where("value is not null")
    top = records.with_defaults(long, d.where("section is null"), docs).withColumn("entry_no", F.lit(None).cast("long"))
    kind_of = F.create_map(*(F.lit(x) for pair in R.SECTION_OF.items() for x in pair))
    nested = d.where("section is not null").select(F.try_element_at(kind_of, F.col("section")).alias("kind"), "nested_key", "field_id")
    inner = entries.select("doc_id", F.col("section").alias("kind"), "entry_no", F.explode("keys").alias("nested_key", "value")).where("value is not null and value != ''")
    inner = inner.join(nested, ["kind", "nested_key"]).select("doc_id", "field_id", "value", F.col("entry_no").cast("long").alias("entry_no"))
    kinds = d.select("field_id", "field_type", "picklist_id", F.col("section").isNotNull().alias("nested"))
    rows = written(top.unionByName(inner), "values").join(kinds, "field_id").withColumn("picklist_id", F.when(F.col("field_type") == "Picklist", F.col("picklist_id")))
    coded = matching.match_picklist(rows.where("picklist_id is not null").withColumn("text", F.col("value")), picklists).drop("text", "how")
    rows = rows.where("picklist_id is null").withColumn("option_id", F.lit(None).cast("string")).unionByName(coded)
    value = records.typed(F.col("value"), F.col("option_id"), F.col("field_type"), F.col("nested"))
    return rows.select("doc_id", "field_id", "entry_no", value.alias("value"), F.coalesce(F.col("option_id") != "", F.lit(False)).alias("resolved"))


def results(docs: DataFrame, fields: DataFrame, field_defs: DataFrame) -> DataFrame:
    """D12, ORC3, AGG3, JOIN10: doc_id, status, record, fields_extracted, missing_required, warnings for each of docs (doc_id, error).

    A document that could not be read has no record and its error as the warning; one without any field has an empty record.
    Dates that name the year 0000 stay as they are and give a warning (DT5). The fields are written to the shared folder and read from there.
    """
    c, none = F.col, F.expr("cast(array() as array<string>)")
    fields = written(fields, "fields")
    top = records.split_schema(field_defs).where("section is null")
    zero = fields.join(field_defs.where("field_type = 'DateTime'").select("field_id"), "field_id", "left_semi").where(c("value").rlike(r"(?:^|\D)0000(?:\D|$)"))
    dated = zero.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("Year 0000 in "), "field_id"))).alias("odd_dates"))
    rows = docs.join(records.documents(fields, field_defs), "doc_id", "left").join(dated, "doc_id", "left")
    ok = c("error").isNull()
    rows = rows.withColumn("missing", F.when(ok, F.array_except(records.required_ids(top), F.coalesce("present", none))).otherwise(none))
    short = F.concat(F.lit("Missing "), F.size("missing"), F.lit(" required fields: "), F.array_join("missing", ", "))
    warnings = F.when(~ok, F.array("error")).otherwise(F.concat(F.when(F.size("missing") > 0, F.array(short)).otherwise(none), F.coalesce("odd_dates", none)))
    made = F.when(ok, F.coalesce("record", F.lit(EMPTY_RECORD)))
    return rows.select("doc_id", F.when(ok, "success").otherwise("error").alias("status"), made.alias("record"), F.when(ok, F.coalesce(F.size("paths"), F.lit(0))).otherwise(0).cast("long").alias("fields_extracted"), c("missing").alias("missing_required"), warnings.alias("warnings"))


def run(blocks: DataFrame, tables: DataFrame | None, docs: DataFrame, field_defs: DataFrame, picklists: DataFrame) -> DataFrame:
    """results of documents docs (doc_id, error, marked: whether section marks of the layout count) from their blocks and table rows.

    Personal fields, entries and typed fields are written to the shared folder, which keeps the plans of the steps apart.
    """
    order = layout.reading_order(blocks).join(docs.select("doc_id", "marked"), "doc_id")
    text = order.select("doc_id", F.when(F.col("marked"), F.col("layout_text")).otherwise(F.col("raw_text")).alias("text"))
    pairs = written(extract.label_pairs(blocks, tables), "pairs")
    found = written(extract.personal_fields(blocks, tables, pairs).select("doc_id", *personal.FIELDS), "personal")
    entries = written(extract.section_entries(lines.explode_lines(text), tables, pairs), "entries")
    good = docs.where("error is null").select("doc_id")
    return results(docs.select("doc_id", "error"), typed_fields(good, found, entries, field_defs, picklists), field_defs)


def of_files(listed: DataFrame, field_defs: DataFrame, picklists: DataFrame) -> DataFrame:
    """Results of files (path, name, stem, extension, content). A file's doc_id is its path; files that can't be read give error rows."""
    blocks, tables = files.scan(listed)
    errors = blocks.where("error is not null").groupBy("doc_id").agg(F.first("error").alias("error"))
    docs = written(listed.select(F.col("path").alias("doc_id"), (~F.col("extension").isin("docx", "doc")).alias("marked")).join(errors, "doc_id", "left"), "documents")
    return run(blocks.where("error is null").drop("error"), tables, docs, field_defs, picklists)


def run_folder(spark: SparkSession, folder: str, field_defs: DataFrame, picklists: DataFrame, out: str | None = None) -> DataFrame:
    """ORC1, ORC2, SRC1 to SNK2: results of the documents in a folder; with out, records and the report are written below it.

    A file's doc_id is its path. Files that can't be read give error rows and stop nothing.
    """
    began = time.time()
    got = of_files(files.list_files(spark, folder), field_defs, picklists)
    if out:
        got.write.mode("overwrite").parquet(f"{out}/results")
        got = spark.read.schema(got.schema).parquet(f"{out}/results")
        # DT6: files run together, so each has its share of the wall clock
        took, n = int((time.time() - began) * 1000), got.count()
        share = F.lit(took // max(n, 1)).cast("long")
        files.write_records(got.where("record is not null"), f"{out}/records")
        sinks.write_each(got.select("doc_id", "record"), f"{out}/files")
        files.write_report(records.batch_report(got.withColumn("elapsed_ms", share)).withColumn("total_time_ms", F.lit(took).cast("long")), f"{out}/report")
    return got
