"""Nulls, empty texts, repeated rows, empty tables and columns with the names of helper columns."""

from pyspark.sql import functions as F

from scrivel.operators import layout, lines, matching, parsers, records, reports, scoring
from scrivel.sources import spans


def docs(spark):
    rows = [("a", None), ("b", ""), (None, "Key: v"), ("c", "Key: v"), ("c", "Key: v"), ("d", "Education\n- x y (2001)\n- z w")]
    return spark.createDataFrame([(*r, 1, "x", "x", "x") for r in rows], "doc_id string, text string, run int, clean string, label string, ls string")


def test_lines_and_sections(spark):
    ls = lines.explode_lines(docs(spark))
    assert sorted((r.doc_id or "", r.pos, r.label, r.value) for r in lines.colon_pairs(ls).collect()) == [("", 0, "Key", "v"), ("c", 0, "Key", "v"), ("c", 0, "Key", "v")]
    assert lines.section_of(ls).where("header is not null").count() == 1 and lines.section_of(ls).count() == 7
    assert lines.colon_pairs(ls.limit(0)).count() == 0 and lines.section_of(ls.limit(0)).count() == 0
    e = lines.entries(docs(spark))
    assert e.count() == 6 and e.columns == [*docs(spark).columns, "entries"]
    got = e.select("doc_id", parsers.jobs(F.col("entries")).alias("j"), parsers.schools(F.col("text")).alias("s")).collect()
    assert all(r.j in (None, []) or r.doc_id in (None, "c", "d") for r in got) and all(not r.s for r in got if r.doc_id in ("a", "b"))
    listed = parsers.listed(docs(spark), 0.5, True, "startDate").collect()
    assert [(r.doc_id, r.name, r.startDate) for r in sorted(listed, key=lambda r: r.line_no)] == [("d", "x y (2001)", "2001"), ("d", "z w", None)]
    assert parsers.language_lines(docs(spark).limit(0)).count() == 0


def test_layout_and_spans(spark):
    schema = "doc_id string, block_no long, page int, x0 double, y0 double, x1 double, y1 double, text string, is_bold boolean, font_size double, two int, col int"
    one = ("a", 0, 0, 1.0, 1.0, 9.0, 2.0, "t", False, 9.0, 7, 7)
    blocks = spark.createDataFrame([one, one, ("a", 1, 0, None, None, None, None, None, None, None, 7, 7), (None, 0, 0, 1.0, 1.0, 2.0, 2.0, "u", True, 20.0, 7, 7)], schema)
    assert {r.doc_id: r.raw_text for r in layout.reading_order(blocks).collect()} == {"a": "t\nt", None: "u"}
    assert layout.columns(blocks).count() == 4 and layout.adjacent(blocks).count() == 0 and layout.reading_order(blocks.limit(0)).count() == 0
    s = spark.createDataFrame([("a", 0, 0, 0, 0, 0, 1.0, 1.0, 2.0, 2.0, None, None, None, None), ("a", 0, 1, 0, 0, 0, 1.0, 1.0, 2.0, 2.0, "w", None, None, None)], "doc_id string, page int, block int, line int, span int, kind int, x0 double, y0 double, x1 double, y1 double, text string, font string, flags int, size double")
    assert [(r.block_no, r.text, r.is_bold) for r in spans.blocks(s).collect()] == [(0, "w", False)]


def test_matching_and_records(spark):
    labels = spark.createDataFrame([("a", 0, None, "v", 1), ("a", 1, "", "v", 1), ("a", 2, "Email", None, 1), ("a", 2, "Email", "w", 1), ("b", 0, "Email", "x", 1)], "doc_id string, pos int, label string, value string, norm int")
    got = sorted((r.doc_id, r.field, r.value or "") for r in matching.assign_fields(labels).collect())
    assert ("b", "primaryEmail", "x") in got and len([g for g in got if g[0] == "a" and g[1] == "primaryEmail"]) == 1
    assert matching.assign_fields(labels.limit(0)).count() == 0 and matching.fuzzy_candidates(labels).columns == [*labels.columns, "field", "confidence"]
    values = spark.createDataFrame([("p", 0, "c", None, "One", "7", "A"), ("p", 1, None, None, None, "8", "A")], "picklist_id string, ordinal int, external_code string, label_vi string, label_en string, option_id string, status string")
    asked = spark.createDataFrame([("p", "one", 1), ("p", "one", 1), ("p", None, 1), (None, "one", 1), ("p", "Onne", 1)], "picklist_id string, text string, form int")
    assert sorted((r.option_id or "", r.how or "") for r in matching.match_picklist(asked, values).collect()) == [("", ""), ("", ""), ("7", "exact"), ("7", "exact"), ("7", "fuzzy")]
    defs = spark.createDataFrame([("fullName", "String", True, 0), ("anonymized", "String", False, 1)], "field_id string, field_type string, required boolean, ordinal int")
    fields = spark.createDataFrame([("a", "fullName", None, None, False), ("a", "other", None, "x", False), ("b", "fullName", None, "N", False)], "doc_id string, field_id string, entry_no long, value string, resolved boolean")
    assert {r.doc_id: r.record for r in records.assemble(fields, defs).collect()} == {"b": '[{"__metadata":{"uri":"Candidate"},"fullName":"N"}]'}
    assert records.assemble(fields.limit(0), defs).count() == 0 and records.missing_required(fields.limit(0), defs).count() == 0
    report = records.batch_report(spark.createDataFrame([], "status string, fields_extracted long, elapsed_ms long")).first()
    assert (report.total_files, report.success, report.errors) == (0, 0, 0)


def test_reports(spark):
    reviews = spark.createDataFrame([("a", None), ("b", "no"), ("c", '{"fields":{"x":"correct"}}'), ("c", '{"fields":{"x":"correct"}}')], "file string, review string")
    rows = reports.verdict_rows(reviews)
    assert [(r.field, r.verdict) for r in rows.collect()] == [("x", "correct")] * 2 and reports.accuracy_report(rows.limit(0)).count() == 0
    truth = spark.createDataFrame([("a", "{"), ("b", None), (None, "{}"), ("c", "{}"), ("c", "{}")], "cv_id string, record string")
    got = scoring.score_records(truth, truth.where("cv_id = 'c'").limit(1))
    assert sorted((r.cv_id or "", r.score) for r in got.collect()) == [("", 0.0), ("a", 0.0), ("b", 0.0), ("c", 1.0), ("c", 1.0)]
    assert scoring.suite_report(got.limit(0)).first().suite_passed is False
