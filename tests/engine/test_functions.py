import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scrivel.functions import dates, fuzzy, text
from scrivel.operators import parsers, scoring
from scrivel.sources import files


def column(spark, values, f):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in frame.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize(
    "given,want",
    [
        ("2020", (2020, 1, 1)), ("06/2021", (2021, 6, 1)), ("15/03/1990", (1990, 3, 15)), ("15-03-1990", (1990, 3, 15)), ("15.03.1990", (1990, 3, 15)), ("12/25/2020", (2020, 12, 25)), ("2020-01-31", (2020, 1, 31)),
        ("01/02/49", (2049, 2, 1)), ("01/02/50", (1950, 2, 1)), ("January 5, 2020", (2020, 1, 5)), ("5 jan 2020", (2020, 1, 5)), ("March 2019", (2019, 3, 1)), ("tháng 7 năm 2018", (2018, 7, 1)), ("31/02/2020", None), ("0000", None), ("T7/2022", None), ("soon", None),
    ],
)
def test_dates(spark, given, want):
    (got,) = column(spark, [given], dates.parse)
    assert got == (datetime(*want) if want else None)


def test_still_going(spark):
    assert column(spark, ["Present", "hiện tại", "", "/Date(7)/"], lambda c: dates.date_string(c, True)) == ["/Date(253402214400000)/"] * 2 + [None, "/Date(7)/"]
    assert column(spark, ["Present", "1970"], dates.date_string) == [None, "/Date(0)/"]


def test_folding_keeps_the_barred_d(spark):
    assert column(spark, ["Đào tạo", "ÉCOLE", "Đến"], text.label) == ["ao tao", "ecole", "en"]


def test_names(spark):
    assert column(spark, ["Nguyễn Văn An", "Work Experience", "Lê", "A B", "a@b c"], text.is_name) == [True, False, False, False, False]
    assert column(spark, ["O'BRIEN MARY", "Mary"], text.name_case) == ["O'Brien Mary", "Mary"]


def test_similarity():
    assert fuzzy.ratio("Abc  d", "abc d") == 1 and fuzzy.ratio("abcd", "") == 0
    assert fuzzy.ratio("ab" * 150 + "c", "c" + "ab" * 150) < 0.1  # popular letters of long texts are left out
    assert fuzzy.wratio("new york mets", "new york mets") == 100 and fuzzy.wratio("mets york new", "new york mets") == 95
    assert fuzzy.wratio("ha noi", "thu do ha noi viet nam") == 90 and fuzzy.wratio("a", "") == 0
    assert abs(fuzzy.indel("lewenstein", "levenshtein") - 2 * 9 / 21 * 100) < 1e-9


def test_scores():
    gold = {"personal_info": {"full_name": "A", "email": "a@b.org"}, "education": [{"degree": "BSc"}], "languages": ["x", "y"], "is": True, "empty": []}
    assert scoring.keys(gold, gold) == (1.0, [])
    mark = lambda *a: round(scoring.value(*a)[0], 4)
    assert mark(["English", "French"], ["English", "Frenc"]) == 1 and mark(["1", "2"], ["1", 2]) == 1 and mark(["a"], [{"a": 1}]) == 0
    assert mark([], ["x"]) == 1 and mark(["x"], []) == 0 and mark([1, "a"], [1, "b"]) == 0.5 and mark([1, "a"], [1, "a"]) == 1
    assert mark(None, None) == 0 and mark(None, 1) == 0 and mark(True, 1) == 1 and mark("5", 5) == 1 and mark({"a": 1}, [1]) == 0
    # an entry's summary weighs 1, not 2 as at the top
    assert mark([{"title": "x", "summary": "abc"}], [{"title": "x"}], "work_experience") == 0.65
    # values that are no entries count for the number only, and a pair that scores 0 uses up its entry
    assert mark([{"a": "x"}], ["?", {"a": "x"}]) == 1 and mark([{"a": "x"}, {"a": "y"}], [{"a": "y"}, 3]) == 0.3
    assert scoring.value([{"a": "x"}, {"a": "y"}], [{"a": "y"}], "l")[1] == ["SHORT    l: expected 2 entries, got 1", "MISMATCH l[0].a: expected='x', got='y' (sim=0.00)", "MISSING  l[1]: no matching entry found"]
    assert [k for _, k in scoring.taken(["ab", "ab"], ["ab"], lambda *_: 1.0, 0.0)] == [0, None]
    assert scoring.evaluated("{", "{}")[0] == "truth is no JSON" and scoring.evaluated("{}", "[]")[0] == "parsed is no object" and scoring.evaluated("{}", None)[0] == "no parsed"
    assert scoring.evaluated('{"a": "x", "metadata": 1}', '{"a": "x"}') == ("scored", 0.5, ["MISSING  metadata"], {"a": 1.0})


def test_jobs_and_schools(spark):
    one = lambda f, t: column(spark, [t], f)[0]
    job = lambda t: one(lambda c: parsers.jobs(F.array(c)), t)
    assert job("Senior Engineer\nAcme Corp 2015 - 2018\n- one\n- two\nmore") == [{"startTitle": "Senior Engineer", "employer": "Acme Corp", "startDate": "2015", "endDate": "2018", "description": "one; two; more"}]
    assert job("Gamma\nTháng 6/2021 — Hiện tại") == [{"startDate": "2021", "employer": "Gamma"}]
    assert job("Beta\n3/2019 — 5/2021") == [{"startDate": "3/2019", "employer": "Beta"}]
    assert job("Page 1 of 2\n") == []
    schools = one(parsers.schools, "Bachelor\nHanoi University | 2010 - 2014\nvery good\n\nstill the first\nMaster\nin 5/2016")
    assert schools == [{"degree": "Bachelor", "otherSchool": "Hanoi University", "grade": "Very Good", "startDate": "2010", "endDate": "2014"}, {"degree": "Master", "startDate": "5/2016"}]


def test_a_value_goes_on_for_fifty_lines(spark):
    from scrivel.operators import lines

    text = "\n".join(["Skills: a,", *(f"b{k}," for k in range(50)), "c", "d"])
    docs = spark.createDataFrame([("x", text), ("y", None), ("z", ""), ("w", "only:")], "doc_id string, text string")
    (got,) = lines.colon_pairs(lines.explode_lines(docs)).collect()
    assert got.value == " ".join(["a,", *(f"b{k}," for k in range(50)), "c"]) and (got.pos, got.label) == (0, "Skills")


def test_a_year_0000_is_a_warning_and_second_dates_are_kept(spark):
    e = spark.createDataFrame([("x", 0, "Course\n1/2018 to 2/2019\nSchool")], "doc_id string, entry_no int, entry string")
    (got,) = parsers.simple_entries(e, "course", "endDate").collect()
    assert (got.endDate, got.startDate, got.institution) == ("1/2018", "2/2019", "School")


def test_bundles_and_jobs(spark):
    from scrivel.operators import reports

    jobs = spark.createDataFrame([("j", 0), ("k", 2)], "job_id string, total int")
    none = spark.createDataFrame([], "job_id string, status string, fields long")
    assert {r.job_id: (r.status, r.done, r.avg_fields) for r in reports.job_states(jobs, none).collect()} == {"j": ("done", 0, 0.0), "k": ("running", 0, 0.0)}


def docx(paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f'<w:p><w:r><w:rPr>{"<w:b/>" if b else ""}<w:sz w:val="{2 * s}"/></w:rPr><w:t>{t}</w:t></w:r></w:p>' for t, b, s in paragraphs)
    t = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}<w:tbl>{t}</w:tbl></w:body></w:document>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("Tran Thi Mai", True, 16), ("Page 1 of 2", False, 10), ("Email: a@b.org", False, 10)], [["Language", "Level"], ["____", ""]]))
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.txt").write_bytes(b"no")
    blocks, tables = files.scan(files.list_files(spark, str(tmp_path)))
    rows = {(r.doc_id.rsplit("/", 1)[1], r.text, r.is_bold, r.y0, r.error is None) for r in blocks.collect()}
    assert ("a.docx", "Tran Thi Mai", True, 0.0, True) in rows and ("a.docx", "Email: a@b.org", False, 39.0, True) in rows and len(rows) == 4
    assert sum(not ok for *_, ok in rows) == 2
    assert [r.cells for r in tables.collect()] == [["Language", "Level"]]


def test_records_and_dictionaries(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1}]')
    (tmp_path / "_y.json").write_text("{}")
    (tmp_path / "z.json").write_text('{"b": 2}')
    got = {r.file: r.j for r in files.json_records(spark, str(tmp_path)).select("file", F.to_json("record").alias("j")).collect()}
    assert got == {"x": '{"a":1}', "z": '{"b":2}'}
    (tmp_path / "f.csv").write_text("ordinal,field_id,field_type,label,picklist_id,required,remarks,sample_value\n1,fullName,String,Name,,y,,\n2,,String,,,,,\n")
    assert [(r.field_id, r.required) for r in files.field_definitions(spark, str(tmp_path / "f.csv")).collect()] == [("fullName", True)]
    replay = files.Replay(spark.createDataFrame([("1", 'x ```json {"a": [1,],} ``` y'), ("2", "none")], "doc_id string, raw string"))
    out = replay(spark.createDataFrame([("1",), ("2",), ("3",)], "doc_id string")).select("doc_id", F.to_json("reply").alias("r"))
    assert {r.doc_id: r.r for r in out.collect()} == {"1": '{"a":[1]}', "2": None, "3": None}


def test_lines_of_odd_number_and_empty_inputs_of_the_extraction(spark):
    from scrivel.operators import lines
    from scrivel.plans import extract

    blocks = "doc_id string, block_no long, page int, x0 double, y0 double, x1 double, y1 double, text string, is_bold boolean, font_size double"
    odd = spark.createDataFrame([("a", 0, 0, 1.0, 1.0, 9.0, 2.0, "Phone\n12345678\nlast", False, 9.0), ("b", 0, 0, 1.0, 1.0, 9.0, 2.0, None, False, 9.0)], blocks)
    assert [(r.label, r.value) for r in lines.line_pairs(odd).collect()] == [("Phone", "12345678")]
    got = {r.doc_id: r.cellPhone for r in extract.personal_fields(odd).collect()}
    assert got == {"a": "12345678", "b": None}
    assert extract.personal_fields(odd.limit(0)).count() == 0
    none = spark.createDataFrame([("a", 0, "no section"), ("b", 0, None)], "doc_id string, line_no int, line string")
    assert extract.section_entries(none).count() == 0


def test_validation_of_odd_records(spark):
    from scrivel.operators import validation

    defs = spark.createDataFrame([("firstName", "String", None, True), ("languages.x.language", "String", None, False)], "field_id string, field_type string, picklist_id string, required boolean")
    given = [None, "", "{}", "[]", "[null]", '[{"firstName":null,"languages":{"results":null}}]', '[{"firstName":"An","languages":{"results":[{"language":"vi"},3]}}]']
    rows = spark.createDataFrame(list(enumerate(given)), "file int, record string")
    got = {r.file: r.issues for r in validation.validate(rows, defs).collect()}
    assert [got[k][0] for k in range(5)] == ["Cannot read file"] * 2 + ["Expected non-empty JSON array"] * 2 + ["First element is not a JSON object"]
    assert got[5] == ["Section 'languages' has empty results"] and got[6] == ["languages[1]: not a dict"]
    assert validation.totals(validation.validate(rows.limit(0), defs)).first().total_files == 0


def test_a_folder_from_files_to_records(spark, tmp_path):
    import json

    from scrivel.plans import batch

    (tmp_path / "in").mkdir()
    lines = [("Tran Thi Mai", True, 16), ("Email: a@b.org", False, 10), ("Gender: Female", False, 10), ("Languages", True, 14), ("English: fluent", False, 10)]
    (tmp_path / "in" / "a.docx").write_bytes(docx(lines, []))
    (tmp_path / "in" / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "in" / "c.docx").write_bytes(docx([("Page 1 of 2", False, 10)], []))
    defs = [("fullName", "String", None, True), ("primaryEmail", "String", None, True), ("gender", "Picklist", "g", False), ("anonymized", "String", None, False), ("languages.x.proficiency", "String", None, False), ("languages.x.language", "Picklist", "l", False)]
    defs = spark.createDataFrame([(*d, k) for k, d in enumerate(defs)], "field_id string, field_type string, picklist_id string, required boolean, ordinal int")
    lists = spark.createDataFrame([("g", 0, "F", "Nữ", "Female", "7", "A"), ("l", 0, "en", "Tiếng Anh", "English", "9", "A")], "picklist_id string, ordinal int, external_code string, label_vi string, label_en string, option_id string, status string")
    got = {r.doc_id.rsplit("/", 1)[1]: r for r in batch.run_folder(spark, str(tmp_path / "in"), defs, lists, str(tmp_path / "out")).collect()}
    assert got["b.docx"].status == "error" and got["b.docx"].record is None and got["b.docx"].warnings
    assert json.loads(got["c.docx"].record) == [{"__metadata": {"uri": "Candidate"}, "anonymized": "0"}] and got["c.docx"].missing_required == ["fullName", "primaryEmail"]
    record = json.loads(got["a.docx"].record)[0]
    assert record["fullName"] == "Tran Thi Mai" and record["primaryEmail"] == "a@b.org" and record["anonymized"] == "0"
    assert record["languages"] == {"results": [{"proficiency": "Fluent", "language": "9"}]}
    assert got["a.docx"].fields_extracted == len(record) - 1 + 2
    report = json.loads(next((tmp_path / "out" / "report").glob("*.json")).read_text())
    assert (report["total_files"], report["success"], report["errors"]) == (3, 2, 1)


def test_tables_come_before_sections(spark):
    from scrivel.plans import extract

    text = ["Languages", "English: fluent", "Awards", "- First prize (2011)", "- Second prize"]
    ls = spark.createDataFrame([("a", k, x) for k, x in enumerate(text)] + [("b", k, x) for k, x in enumerate(text)], "doc_id string, line_no int, line string")
    tables = [[["Language", "Certificate"], ["French", "DELF"], ["German", ""]], [["Korean", "TOPIK"]], [["Company", "Position", "From", "To"], ["Acme", "Dev", "2010", "2012"]], [["Employer", "Title"], ["Late", "Dev"]], [["School", "Degree", "Year"], ["Hanoi University", "MSc", "2001 - 2005"]]]
    cells = spark.createDataFrame([("a", t, r, row) for t, rows in enumerate(tables) for r, row in enumerate(rows)], "doc_id string, table_no int, row_no int, cells array<string>")
    got = {}
    for r in extract.section_entries(ls, cells).orderBy("doc_id", "section", "entry_no").collect():
        got.setdefault((r.doc_id, r.section), []).append(r["keys"])
    assert got["a", "languages"] == [{"language": "French", "remark": "DELF"}, {"language": "German"}, {"language": "Korean", "remark": "TOPIK"}]
    assert got["a", "experience"] == [{"startTitle": "Dev", "employer": "Acme", "startDate": "2010", "endDate": "2012"}]
    assert got["a", "education"] == [{"otherSchool": "Hanoi University", "degree": "MSc", "startDate": "2001", "endDate": "2005"}]
    assert [x["name"] for x in got["a", "awards"]] == ["First prize (2011)", "Second prize"] and got["a", "awards"] == got["b", "awards"]
    assert got["b", "languages"] == [{"language": "English", "proficiency": "Fluent"}]
