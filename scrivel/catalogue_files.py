"""Queries over files that are written from the tables: readers, folders, intake by new files, jobs as a stream, sinks, recorded replies."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.plans import batch
from scrivel.plans.inputs import made, pick, q
from scrivel.plans.registry import query
from scrivel.sources import files, sinks
from scrivel.streaming import intake, job_stream
from scrivel.streaming.shared import prepare, shared_dir, written

c = F.col


# -- Word files -------------------------------------------------------------------------------------------------------
def _as_docx(rows: DataFrame) -> DataFrame:
    """name, content (a Word file) of rows (name, lines, cells: one table row)."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, lines, cells in zip(*(b.column(k).to_pylist() for k in ("name", "lines", "cells")), strict=True):
                paragraphs = "".join(f'<w:p><w:r><w:rPr>{"<w:b/>" if k == 0 else ""}<w:sz w:val="{32 if k == 0 else 20}"/></w:rPr><w:t>{x}</w:t></w:r></w:p>' for k, x in enumerate(lines))
                grid = "<w:tbl><w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>" for x in cells) + "</w:tr></w:tbl>" if cells else ""
                file = io.BytesIO()
                with zipfile.ZipFile(file, "w") as z:
                    z.writestr(zipfile.ZipInfo("word/document.xml"), f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}{grid}</w:body></w:document>')
                out.append((name, file.getvalue()))
            yield pa.RecordBatch.from_pylist([dict(zip(("name", "content"), r, strict=True)) for r in out], schema=pa.schema([("name", pa.string()), ("content", pa.binary())]))

    return rows.select("name", "lines", "cells").mapInArrow(run, "name string, content binary")


_DOCS = made("supplier", key="cast(s_suppkey as bigint)", name="concat('cv', cast(s_suppkey as string), CASE WHEN s_suppkey % 9 = 4 THEN '.pdf' WHEN s_suppkey % 9 = 5 THEN '.DOCX' WHEN s_suppkey % 9 = 6 THEN '.txt' ELSE '.docx' END)", first=pick("s_suppkey", q("Tran Thi Mai"), q("Nguyen Van An"), q("Page 1 of 2")), mail="concat('u', cast(s_suppkey as string), '@x.org')", pair=pick("s_suppkey", "s_name", q("TRUE"), q("____")))


def _folder(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """A file for each of rows (name, lines, cells); those without a Word name hold a few bytes."""
    word = F.lower("name").endswith(".docx")
    sinks.write_files(_as_docx(rows.where(word)).unionByName(rows.where(~word).select("name", F.lit("%PDF-").cast("binary").alias("content"))), path)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    d = _DOCS[0](spark, sf)
    cells = F.when(c("key") % 2 == 0, F.array("pair", F.lit("B2"))).otherwise(F.array().cast("array<string>"))
    return d.withColumns({"lines": F.array("first", F.concat(F.lit("Email: "), "mail"), F.lit("Phone: +84 90 123 4567")), "cells": cells})


_READABLE = "name NOT LIKE '%.txt' AND name NOT LIKE '%.pdf'"


@query(f"""WITH d AS (SELECT * FROM {_DOCS[1]}), b AS (SELECT name, 0 AS block_no, first AS text, true AS is_bold, 16.0::double AS font_size, 0.0::double AS y0 FROM d WHERE {_READABLE} AND first <> 'Page 1 of 2'
 UNION ALL SELECT name, 1, concat('Email: ', mail), false, 10, CASE WHEN first = 'Page 1 of 2' THEN 15 ELSE 24 END FROM d WHERE {_READABLE} UNION ALL SELECT name, 2, 'Phone: +84 90 123 4567', false, 10, CASE WHEN first = 'Page 1 of 2' THEN 33 ELSE 42 END FROM d WHERE {_READABLE})
SELECT *, CAST(NULL AS VARCHAR) AS error FROM b UNION ALL SELECT name, 0, NULL, false, 0, 0, 'Unsupported file format: .pdf' FROM d WHERE name LIKE '%.pdf'""")
def src2_src4_word_blocks(spark, sf):
    """Blocks of a folder of Word files and others, written from the suppliers."""
    path = shared_dir(spark, "word")
    _folder(spark, _documents(spark, sf), path)
    blocks, _ = files.scan(files.list_files(spark, path))
    return blocks.select(files.name_of(c("doc_id")).alias("name"), c("block_no").cast("int").alias("block_no"), "text", "is_bold", "font_size", "y0", "error")


@query(f"SELECT name, 0 AS table_no, 0 AS row_no, [pair, 'B2'] AS cells FROM {_DOCS[1]} WHERE key % 2 = 0 AND {_READABLE}")
def src4_word_tables(spark, sf):
    path = shared_dir(spark, "word")
    _folder(spark, _documents(spark, sf), path)
    _, tables = files.scan(files.list_files(spark, path))
    return tables.select(files.name_of(c("doc_id")).alias("name"), c("table_no").cast("int").alias("table_no"), c("row_no").cast("int").alias("row_no"), "cells")


_DEFS = [("fullName", "String", None, True), ("primaryEmail", "String", None, True), ("cellPhone", "String", None, False)]


def _dictionaries(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    defs = spark.createDataFrame([(*d, k) for k, d in enumerate(_DEFS)], "field_id string, field_type string, picklist_id string, required boolean, ordinal int")
    return defs, spark.createDataFrame([], "picklist_id string, ordinal int, external_code string, label_vi string, label_en string, option_id string, status string")


@query(f"""SELECT name, CASE WHEN name LIKE '%.pdf' THEN 'error' ELSE 'success' END AS status, CASE WHEN {_READABLE} AND first <> 'Page 1 of 2' THEN first END AS "fullName", CASE WHEN {_READABLE} THEN mail END AS "primaryEmail",
 CASE WHEN {_READABLE} AND first = 'Page 1 of 2' THEN ['fullName'] ELSE CAST([] AS VARCHAR[]) END AS missing_required FROM {_DOCS[1]} WHERE name NOT LIKE '%.txt'""")
def orc1_dt6_folder(spark, sf):
    """A folder of files to results: records, the report with each file's share of the time, and one JSON file a record, read back."""
    path, out = shared_dir(spark, "word"), shared_dir(spark, "parsed")
    _folder(spark, _documents(spark, sf), path)
    got = batch.run_folder(spark, path, *_dictionaries(spark), out)
    report = spark.read.json(f"{out}/report").first()
    if report.total_files != got.count() or sinks.read_files(spark, f"{out}/files").count() != got.where("record is not null").count():
        raise ValueError("the report or the files don't agree with the results")
    field = lambda k: F.get_json_object("record", f"$[0].{k}").alias(k)
    return got.select(files.name_of(c("doc_id")).alias("name"), "status", field("fullName"), field("primaryEmail"), "missing_required")


# -- dictionaries -----------------------------------------------------------------------------------------------------
_FIELDS = made("part", ordinal="cast(p_partkey as int)", field_id=pick("p_partkey", "concat('f', cast(p_partkey as string))", "concat('s.x.', cast(p_partkey as string))", q("  ")), field_type=pick("p_partkey", q("String"), q("Picklist"), q("DateTime")), label="p_name", picklist_id=pick("p_partkey", "cast(null as string)", q("p")), required=pick("p_partkey", q("Y"), q("n"), q(" y "), "cast(null as string)"), remarks="p_brand", sample_value=pick("p_partkey", q("a, b"), q('say "x"'), q("é")))


@query(f"SELECT ordinal, field_id, field_type, label, picklist_id, upper(trim(coalesce(required, ''))) = 'Y' AS required, remarks, sample_value FROM {_FIELDS[1]} WHERE trim(field_id) <> ''")
def src5_field_dictionary(spark, sf):
    path = shared_dir(spark, "fields")
    _FIELDS[0](spark, sf).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.field_definitions(spark, path)


_LISTS = made("part", picklist_id="p_type", ordinal="cast(p_partkey as int)", external_code="concat('C', cast(p_partkey as string))", label_vi=q("Nữ"), label_en="p_name", option_id=pick("p_partkey", "concat(cast(p_partkey as string), '.0')", "cast(p_partkey as string)", "cast(null as string)"), status=pick("p_partkey", q("A"), q("I"), "cast(null as string)", q(" ")))


@query(f"SELECT picklist_id, ordinal, external_code, label_vi, label_en, regexp_replace(coalesce(option_id, ''), '\\.0+$', '') AS option_id, CASE WHEN trim(coalesce(status, '')) = '' THEN 'A' ELSE status END AS status FROM {_LISTS[1]}")
def src6_picklist_dictionary(spark, sf):
    path = shared_dir(spark, "lists")
    _LISTS[0](spark, sf).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.picklists(spark, path)


# -- replies ----------------------------------------------------------------------------------------------------------
_CALLS = made("events", doc_id="cast(event_id as string)", raw=pick("event_id", "concat('Here: ```json', chr(10), props, chr(10), '```')", "cast(null as string)", q("no braces"), q("{broken"), q("  "), "concat('{\"v\": ', cast(event_id as string), ',}')", "cast(null as string)", "cast(null as string)"), failure=pick("event_id", "cast(null as string)", q("refused"), "cast(null as string)", "cast(null as string)", "cast(null as string)", "cast(null as string)", q("timeout"), q("500 Server Error")))


@query(f"""SELECT doc_id, CASE cast(doc_id as bigint) % 9 WHEN 8 THEN 'missing' ELSE ['ok', 'refused', 'broken', 'broken', 'empty', 'ok', 'timeout', 'failed'][cast(doc_id as bigint) % 8 + 1] END AS status,
 CASE WHEN cast(doc_id as bigint) % 9 = 8 THEN NULL WHEN failure = 'refused' THEN 'Cannot connect to LLM server at http://localhost:8080/v1. Start it with: llama-server -m <model.gguf> --port 8080  OR: ollama serve' WHEN failure = 'timeout' THEN 'LLM request timed out after 120s. Try increasing LLM_TIMEOUT or using a smaller model.' WHEN failure IS NOT NULL THEN 'LLM API error: ' || failure END AS error FROM {_CALLS[1]}""")
def src12_replies(spark, sf):
    calls = _CALLS[0](spark, sf)
    recorded = calls.where("cast(doc_id as bigint) % 9 <> 8")
    return files.Replay(recorded)(calls.select("doc_id")).select("doc_id", "status", "error")


# -- sinks ------------------------------------------------------------------------------------------------------------
_SAVED = made("customer", doc_id="concat('/in/', cast(c_custkey % 7 as string), '/cv', cast(floor(c_custkey / 2) as bigint), '.pdf')", record="CASE WHEN c_custkey % 11 <> 3 THEN concat('{\"n\":\"', c_name, 'é\"}') END")
_STEMS = f"s AS (SELECT *, regexp_replace(regexp_extract(doc_id, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem FROM {_SAVED[1]} WHERE record IS NOT NULL), n AS (SELECT *, stem || CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN '-' || left(md5(doc_id), 12) ELSE '' END || '.json' AS name FROM s)"


@query(f"WITH {_STEMS} SELECT name, record AS content FROM n")
def snk1_file_each(spark, sf):
    """A JSON file for each record, read back."""
    path = shared_dir(spark, "records")
    sinks.write_each(_SAVED[0](spark, sf), path)
    return sinks.read_files(spark, path).select("name", c("content").cast("string").alias("content"))


@query(f"WITH {_STEMS} SELECT name, md5(record) AS content_md5 FROM n")
def snk6_bundle(spark, sf):
    """All records in one zip, whose members are compressed by tasks, read back."""
    path = f"{shared_dir(spark, 'zip')}.zip"
    rows = sinks.file_names(_SAVED[0](spark, sf).where("record is not null"), "doc_id").select("name", c("record").alias("content"))
    told = sinks.write_bundle(rows, path).first()
    return sinks.read_bundle(spark, told.path).select("name", F.md5("content").alias("content_md5"))


# -- intake and jobs --------------------------------------------------------------------------------------------------
_WAVES = made("supplier", key="cast(s_suppkey as bigint)", same="cast(floor(s_suppkey / 3) as bigint)", wave="cast(CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END as int)", name="concat('cv', cast(s_suppkey as string), '.docx')")


@query(f"""WITH d AS (SELECT *, row_number() OVER w AS r, first_value(name) OVER w AS same_as FROM {_WAVES[1]} WINDOW w AS (PARTITION BY same ORDER BY wave, name))
SELECT name, wave AS batch, CASE WHEN r = 1 THEN 'taken' ELSE 'repeat' END AS status, same_as, CASE WHEN r = 1 THEN concat('g', same, '@x.org') END AS mail FROM d""")
def orc2_intake(spark, sf):
    """A folder that grows: two runs, each over what is new; files of equal content are taken once."""
    path, state = shared_dir(spark, "inbox"), shared_dir(spark, "intake")
    rows = written(_WAVES[0](spark, sf).withColumns({"lines": F.array(F.lit("Tran Thi Mai"), F.concat(F.lit("Email: g"), c("same").cast("string"), F.lit("@x.org"))), "cells": F.array().cast("array<string>")}), "inbox-rows")
    for wave in (0, 1):
        _folder(spark, rows.where(c("wave") == wave), f"{path}/{wave}")
        found = intake.take(spark, f"{path}/*", state, lambda listed: batch.of_files(listed, *_dictionaries(listed.sparkSession)), 100_000)
    made_ = spark.read.option("basePath", f"{state}/results").parquet(f"{state}/results").select(c("doc_id").alias("path"), F.get_json_object("record", "$[0].primaryEmail").alias("mail"))
    return found.join(made_, "path", "left").select(files.name_of(c("path")).alias("name"), c("batch").cast("int").alias("batch"), "status", files.name_of(c("same_as")).alias("same_as"), "mail")


_STARTS = made("customer", job_id="cast(c_custkey as string)", wave="cast(c_custkey % 2 as int)", total="cast(c_custkey % 23 as bigint)", late="c_custkey % 7 = 0")
_RESULTS = made("orders", job_id="cast(o_custkey as string)", wave="cast(o_orderkey % 3 as int)", name="concat('cv', cast(o_orderkey as string), '.pdf')", status="CASE WHEN o_orderkey % 5 = 0 THEN 'error' ELSE 'success' END", fields="cast(o_orderkey % 40 as bigint)", again="o_orderkey % 4 = 0")


@query(f"""WITH r AS (SELECT job_id, count(*) AS done, count(*) FILTER (status = 'success') AS success, sum(fields) AS f, count(*) FILTER (again) AS repeats FROM {_RESULTS[1]} GROUP BY 1)
SELECT s.job_id, CASE WHEN coalesce(done, 0) >= total THEN 'done' WHEN late THEN 'running' ELSE 'stale' END AS status, total, coalesce(done, 0) AS done, coalesce(success, 0) AS success, coalesce(done - success, 0) AS errors,
 coalesce(round_even(f / done, 1), 0)::double AS avg_fields, coalesce(repeats, 0) AS repeats FROM {_STARTS[1]} s LEFT JOIN r ON r.job_id = s.job_id""")
def orc4_job_stream(spark, sf):
    """Jobs as events come in three waves, the stream restarted for each; results that come twice, starts after results, jobs that fall silent."""
    folder, state = shared_dir(spark, "events"), shared_dir(spark, "jobs")
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), k).cast("timestamp").alias("at")
    none = lambda kind, k: F.lit(None).cast(kind).alias(k)
    starts, results = _STARTS[0](spark, sf), _RESULTS[0](spark, sf)
    begin = lambda rows, at: rows.select("job_id", F.lit("start").alias("kind"), none("string", "name"), none("string", "status"), none("long", "fields"), "total", at)
    ended = lambda rows, at: rows.select("job_id", F.lit("result").alias("kind"), "name", "status", "fields", none("long", "total"), at)
    clock = spark.range(1).select(F.lit("").alias("job_id"), F.lit("clock").alias("kind"), none("string", "name"), none("string", "status"), none("long", "fields"), none("long", "total"), day(40))
    waves = [[begin(starts.where("wave = 0"), day(0)), ended(results.where("wave = 0"), day(1))], [begin(starts.where("wave = 1"), day(1)), ended(results.where("wave = 1"), day(1)), ended(results.where("wave = 0 and again"), day(2))], [ended(results.where("wave = 2"), day(2)), ended(results.where("wave > 0 and again"), day(2)), begin(starts.where("late"), day(40)), clock]]
    for rows in waves:
        reduce(DataFrame.unionByName, rows).write.mode("append").parquet(folder)
        found = job_stream.follow(spark, folder, state, patience_ms=20 * 86_400_000)
    return found.where("job_id != ''")


