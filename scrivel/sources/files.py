"""Files in and out: document adapters, dictionaries, JSON folders, recorded replies."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.functions import rules as R
from scrivel.functions.text import json_object, strip
from scrivel.sources import sheets
from scrivel.streaming.shared import prepare, written

PATTERN = lambda p: re.compile(p.removeprefix("(?iu)"), re.I if p.startswith("(?iu)") else 0)
NOISE, FORM_LABELS = [PATTERN(p) for p in R.NOISE], [PATTERN(p) for p in R.FORM_LABELS]
BLOCKS = "doc_id string, block_no int, page int, x0 double, y0 double, x1 double, y1 double, text string, is_bold boolean, font_size double, error string"
TABLES = "doc_id string, table_no int, row_no int, cells array<string>"
EXTENSIONS = ["pdf", "docx", "doc"]
#: Bytes that opening a file counts as, when files are dealt over tasks.
OPEN_COST = 262_144
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: SRC2: readers by extension; a reader gives blocks (text, is_bold, font_size) and tables of one file. PDF readers can be put in.
ADAPTERS: dict[str, Callable[[bytes], tuple[list[tuple], list[list[list[str]]]]]] = {}


def adapter(*extensions: str):
    def put(f):
        ADAPTERS.update(dict.fromkeys(extensions, f))
        return f

    return put


#: Names of the documents in a folder.
PATTERN = "*.{pdf,PDF,docx,DOCX,doc}"


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem(path: Column) -> Column:
    """STR12: the file's name without its last extension."""
    return F.regexp_replace(name_of(path), r"\.[^.]*$", "")


def allowed(path: Column) -> Column:
    """FLT5: whether a file is a document by its extension."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(EXTENSIONS)


def many_files(spark: SparkSession) -> SparkSession:
    """Small files by the hundreds a task: Spark reckons 4 MB for opening one, so a task would get 32 of them. A lower setting of the session stays."""
    key = "spark.sql.files.openCostInBytes"
    spark.conf.set(key, str(min(OPEN_COST, int(spark.conf.get(key).rstrip("b")))))
    return spark


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC1, FLT5, SRC13: path, name, stem, extension, content of documents directly in a folder."""
    return described(many_files(spark).read.format("binaryFile").option("pathGlobFilter", PATTERN).load(folder))


def described(files: DataFrame) -> DataFrame:
    """path, name, stem, extension, content of files (path, content)."""
    path = F.col("path")
    return files.select("path", name_of(path).alias("name"), stem(path).alias("stem"), F.lower(F.regexp_extract(name_of(path), r"\.([^.]*)$", 1)).alias("extension"), "content")


@adapter("docx", "doc")
def read_docx(content: bytes) -> tuple[list[tuple], list[list[list[str]]]]:
    """SRC4: paragraphs and tables of a Word file, by its zipped XML."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    blocks, tables = [], []
    for p in body.findall(f"{_W}p"):
        runs = [r.find(f"{_W}rPr") for r in p.findall(f"{_W}r")]
        sizes = [int(s.get(f"{_W}val")) / 2 for r in runs if r is not None and (s := r.find(f"{_W}sz")) is not None]
        bold = any(r is not None and (b := r.find(f"{_W}b")) is not None and b.get(f"{_W}val") not in ("0", "false") for r in runs)
        blocks.append((text(p).strip(), bold, sizes[0] if sizes else 11.0))
    for t in body.findall(f"{_W}tbl"):
        tables.append([["\n".join(text(p) for p in c.findall(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")])
    return blocks, tables


def _noise(text: str) -> bool:
    return not text.strip() or any(p.search(text.strip()) for p in NOISE)


def _parsed(path: str, extension: str, content: bytes) -> Iterator[dict]:
    """One dict for each block and each table row of a file, or one with its error."""
    try:
        if extension not in ADAPTERS:
            raise ValueError(f"Unsupported file format: .{extension}")
        blocks, tables = ADAPTERS[extension](content)
    except Exception as e:  # noqa: BLE001 - any reader may fail on any file
        yield {"block_no": 0, "page": 0, "x0": 0.0, "y0": 0.0, "x1": 0.0, "y1": 0.0, "is_bold": False, "font_size": 0.0, "error": str(e)[:500]}
        return
    y = 0.0
    for k, (text, bold, size) in enumerate(blocks):
        if _noise(text):
            y += 15
            continue
        yield {"block_no": k, "page": 0, "x0": 0.0, "y0": y, "x1": 500.0, "y1": y + size, "text": text, "is_bold": bold, "font_size": size}
        y += size + 8
    for k, table in enumerate(tables):
        yield from ({"table_no": k, "row_no": i, "cells": row} for i, row in enumerate(table) if any(not _noise(c) for c in row))


def scan(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC2 to SRC4, ORC3: blocks and tables of files. A file that can't be read gives one block row with its error; the job goes on.

    Each file is read and parsed once, into one table in the shared folder; a worker holds the files of one batch of bounded bytes.
    """
    prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, extension, content in zip(*(batch.column(c).to_pylist() for c in ("path", "extension", "content")), strict=True):
                rows = [{"doc_id": path} | row for row in _parsed(path, extension, content)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    ddl = f"{BLOCKS}, {TABLES.partition(', ')[2]}"
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])
    found = written(files.select("path", "extension", "content").mapInArrow(run, ddl), "scanned")
    of = lambda spec: [c.split()[0] for c in spec.split(", ")]
    return found.where("block_no is not null").select(*of(BLOCKS)), found.where("table_no is not null").select(*of(TABLES))


def field_definitions(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: the field dictionary from a spreadsheet or from CSV: field_id, field_type, label, picklist_id, required (Y), remarks, sample_value."""
    if path.lower().endswith(".xlsx"):
        return sheets.field_definitions(spark, path)
    raw = spark.read.option("header", True).option("escape", '"').schema("ordinal int, field_id string, field_type string, label string, picklist_id string, required string, remarks string, sample_value string").csv(path)
    return raw.where(strip("field_id") != "").withColumn("required", F.upper(strip(F.coalesce("required", F.lit("")))) == "Y")


def picklists(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: the picklist dictionary from a spreadsheet or from CSV; status A if blank, option ids without decimals."""
    if path.lower().endswith(".xlsx"):
        return sheets.picklists(spark, path)
    raw = spark.read.option("header", True).option("escape", '"').schema("picklist_id string, ordinal int, external_code string, label_vi string, label_en string, option_id string, status string").csv(path)
    return raw.withColumn("status", F.coalesce(F.nullif(strip("status"), F.lit("")), F.lit("A"))).withColumn("option_id", F.regexp_replace(F.coalesce("option_id", F.lit("")), r"\.0+$", ""))


def json_records(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """SRC8 to SRC11: file, record (variant): the first element of an array, else the whole. Names that begin with _ are skipped by Spark."""
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(folder)
    v = F.try_parse_json(F.col("value"))
    return texts.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("file"), F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v).alias("record"))


def write_records(records: DataFrame, path: str) -> None:
    """SNK1: one JSON text a line, with the document it belongs to; keyed by full path, so equal stems don't overwrite each other."""
    records.select("doc_id", "record").write.json(path)


def write_report(report: DataFrame, path: str) -> None:
    """SNK2 to SNK5"""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_validation(reports: DataFrame, totals: DataFrame, path: str) -> None:
    """SNK3: the totals and, beside them, a line for each file, by name."""
    write_report(totals, f"{path}/totals")
    reports.orderBy("file").write.mode("overwrite").json(f"{path}/files")


def write_scores(results: DataFrame, report: DataFrame, path: str) -> None:
    """SNK4: the suite's line and, beside it, a line for each record, by name."""
    write_report(report, f"{path}/suite")
    results.orderBy("cv_id").write.mode("overwrite").json(f"{path}/records")


def write_accuracy(report: DataFrame, path: str) -> None:
    """SNK5: the lines of the accuracy report, in order, under the name that readers of reviews skip."""
    write_report(report, f"{path}/_accuracy_report")


# How failures of a call are told.
FAILURES = {
    "refused": "Cannot connect to LLM server at {place}. Start it with: llama-server -m <model.gguf> --port 8080  OR: ollama serve",
    "timeout": "LLM request timed out after {limit}s. Try increasing LLM_TIMEOUT or using a smaller model.",
    "other": "LLM API error: {detail}",
}


class Replay:
    """SRC12: extraction replies recorded in a table in place of a live service; a strategy like any other.

    replies: doc_id, raw and, if calls may have failed, failure (refused, timeout, or the text of another error; null: none).
    Adds reply (variant), status and error: ok, refused, timeout, failed (the call), missing (no call was recorded), empty, broken (no
    JSON in it) and other (JSON, but no object). A document with several recorded calls comes as often; null ids have none.
    """

    def __init__(self, replies: DataFrame, place: str = "http://localhost:8080/v1", limit: int = 120):
        self.replies, self.place, self.limit = replies, place, limit

    def __call__(self, docs: DataFrame) -> DataFrame:
        c = F.col
        recorded = self.replies if "failure" in self.replies.columns else self.replies.withColumn("failure", F.lit(None).cast("string"))
        rows = docs.select("doc_id").join(recorded.withColumn("called", F.lit(True)), "doc_id", "left").withColumn("body", json_object(c("raw")))
        rows = rows.withColumn("reply", F.when(c("failure").isNull(), F.try_parse_json("body")))
        status = F.when(c("called").isNull(), "missing").when(c("failure").isin("refused", "timeout"), c("failure")).when(c("failure").isNotNull(), "failed").when(strip(F.coalesce("raw", F.lit(""))) == "", "empty")
        status = status.when(c("reply").isNull(), "broken").when(~F.schema_of_variant("reply").startswith("OBJECT"), "other").otherwise("ok")
        told = F.when(c("failure") == "refused", FAILURES["refused"].format(place=self.place)).when(c("failure") == "timeout", FAILURES["timeout"].format(limit=self.limit)).when(c("failure").isNotNull(), F.concat(F.lit(FAILURES["other"].format(detail="")), "failure"))
        return rows.withColumns({"status": status, "error": told}).drop("called", "body")
