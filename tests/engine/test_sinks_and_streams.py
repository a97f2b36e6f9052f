"""Files for each row, bundles, tables from drawn pages, intake and jobs: odd inputs, repeated runs, other orders."""

import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from scrivel.functions.text import SPACES, contains_any, is_form_label, is_noise, strip, words_pattern
from scrivel.operators import personal
from scrivel.sources import files, grid, sinks
from scrivel.streaming import intake, job_stream


def test_a_file_for_each_row(spark, tmp_path):
    rows = spark.createDataFrame([("/a/cv.pdf", "{}"), ("/b/cv.docx", '{"x":"é"}'), ("/b/d.e.pdf", "1"), ("/c/none.pdf", None), (None, "2")], "doc_id string, record string")
    sinks.write_each(rows.where("doc_id is not null"), str(tmp_path / "out"))
    found = {p.name: p.read_text() for p in (tmp_path / "out").iterdir() if p.suffix == ".json"}
    assert len(found) == 3 and found["d.e.json"] == "1" and sorted(x for x in found if x.startswith("cv-"))[0] != "cv.json"
    assert (tmp_path / "out" / "_SUCCESS").exists()
    with pytest.raises(Exception, match="exists"):
        sinks.write_each(rows, str(tmp_path / "out"))
    broken = rows.where("doc_id is not null").select(F.lit("x").alias("name"), F.when(F.col("doc_id") == "/c/none.pdf", F.raise_error(F.lit("stop"))).otherwise(F.col("record")).alias("content"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_files(broken, str(tmp_path / "half"))
    assert not (tmp_path / "half").exists()


def test_bundles(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"d/{k}é.json", "".join(rng.choice("ab\n") for _ in range(rng.randrange(2000)))) for k in range(500)] + [("empty", ""), ("gone", None), (None, "x")]
    told = sinks.write_bundle(spark.createDataFrame(rows, "name string, content string").repartition(7), str(tmp_path / "x.zip")).first()
    with zipfile.ZipFile(tmp_path / "x.zip") as file:
        assert file.testzip() is None and {n: file.read(n).decode() for n in file.namelist()} == {n.replace("/", "_"): c for n, c in rows if n and c is not None}
    assert told.members == 501 and told.bytes == (tmp_path / "x.zip").stat().st_size
    assert sinks.read_bundle(spark, str(tmp_path / "x.zip")).count() == 501
    none = sinks.write_bundle(spark.createDataFrame([], "name string, content string"), str(tmp_path / "none.zip")).first()
    assert none.members == 0 and zipfile.ZipFile(tmp_path / "none.zip").namelist() == []


def test_files_are_read_by_the_lists_of_their_names(spark, tmp_path):
    rows = [(f"d/{k}é\n.json", "ab\u2028" * k) for k in range(300)] + [("gone", None), (None, "x")]
    path = str(tmp_path / "out")
    sinks.write_files(spark.createDataFrame(rows, "name string, content string").repartition(3), path)
    (tmp_path / "out" / "stray.json").write_text("{}")
    got = sinks.read_files(spark, path)
    assert sorted((r.name, r.content.decode()) for r in got.collect()) == sorted((n.replace("/", "_"), c) for n, c in rows if n and c is not None)
    assert "FileScan text" not in got._jdf.queryExecution().toString() and got.rdd.getNumPartitions() == 4
    sinks.write_files(spark.createDataFrame([], "name string, content string"), str(tmp_path / "none"))
    assert sinks.read_files(spark, str(tmp_path / "none")).count() == 0


def test_members_of_a_bundle_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(4500).select(F.concat(F.lit("é"), F.col("id").cast("string")).alias("name"), F.repeat(F.lit("x"), F.col("id").cast("int") % 50).alias("content"))
    sinks.write_bundle(rows, str(tmp_path / "x.zip")).collect()
    got = sinks.read_bundle(spark, str(tmp_path / "x.zip"))
    assert {(r.name, r.content.decode()) for r in got.collect()} == {(f"é{k}", "x" * (k % 50)) for k in range(4500)}
    sizes = [n for n in got.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect() if n]
    assert len(sizes) > 1 and max(sizes) <= 2000, sizes
    with open(tmp_path / "y.zip", "wb") as file:
        file.write(b"before")
        with zipfile.ZipFile(file, "a") as z:
            for k in range(70):
                z.writestr(f"y{k}", "y" * k, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
            z.comment = b"PK"
    assert sorted((r.name, len(r.content)) for r in sinks.read_bundle(spark, str(tmp_path / "y.zip")).collect()) == sorted((f"y{k}", k) for k in range(70))
    monkeypatch.setattr(sinks, "PIECE", 16)
    monkeypatch.setattr(sinks, "COPY_BYTES", 100)
    with open(tmp_path / "y.zip", "rb") as file:
        pieces = list(sinks._pieces(file, (tmp_path / "y.zip").stat().st_size))
    assert [n for *_, n in pieces] == [16, 16, 16, 16, 6] and all(a + size == b for (a, size, _), (b, *_) in zip(pieces, pieces[1:], strict=False))


def test_many_members_need_the_wide_ending(tmp_path):
    with open(tmp_path / "w.zip", "wb") as out:
        index = io.BytesIO()
        for k in range(70_000):
            at = out.tell()
            out.write(struct.pack(sinks._LOCAL, 0x04034B50, 20, sinks._FLAGS, 0, 0, sinks._DAY, 0, 0, 0, 6, 0) + b"%06d" % k)
            index.write(struct.pack(sinks._CENTRAL, 0x02014B50, 45, 20, sinks._FLAGS, 0, 0, sinks._DAY, 0, 0, 0, 6, 0, 0, 0, 0, 0, at) + b"%06d" % k)
        start = out.tell()
        out.write(index.getvalue() + sinks._ending(70_000, len(index.getvalue()), start))
    assert len(zipfile.ZipFile(tmp_path / "w.zip").namelist()) == 70_000


def test_white_space_of_all_kinds(spark):
    texts = ["".join(SPACES), "\t", " x ", "TRUE\r", "\x1cFrom *\x1f", "a * b", "x *", "Page 1 of 2　", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select(strip("t"), is_noise(F.col("t")), is_form_label(F.col("t"))).collect()
    assert [r[0] for r in got] == [t.strip() if t is not None else None for t in texts]
    assert [r[1] for r in got] == [True, True, False, True, False, False, False, True, None]
    assert [r[2] for r in got] == [False, False, False, False, True, False, True, False, None]


def test_one_pattern_for_words(spark):
    rng = random.Random(2)
    words = ["ab", "abc", "b.c", "công ty", "*", "aa"]
    texts = ["".join(rng.choice("abc.* côngty") for _ in range(rng.randrange(12))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", contains_any(F.col("t"), words).alias("has")).collect()
    assert all(r.has == any(w in r.t for w in words) for r in got)
    assert "abc" not in words_pattern(["ab", "abc"])


def test_helper_columns_of_other_names(spark):
    rows = spark.createDataFrame([("Mr An Le", None, None, None, None, "p@x.org", "kept", "too", "q")], "fullName string, firstName string, middleName string, lastName string, contactEmail string, primaryEmail string, n string, _named string, prominent string")
    got = personal.with_names(rows).first()
    assert got.n == "kept" and got["_named"] == "too" and got.lastName == "Le"
    more = rows.selectExpr("*", "'' AS address", "'' AS cellPhone", "'' AS idCard")
    assert personal.clean(more).first()["_named"] == "too"


RULES, SPANS = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double", "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string"


def test_odd_drawings(spark):
    box = lambda *at: ("a", 0, *map(float, at))
    rules = [box(0, 0, 50, 20), box(50, 0, 100, 20), box(0, 20, 100, 40), box(0, 0, 50, 20), box(1, 1, 2, 2), ("a", 0, None, 0.0, 1.0, 1.0), ("b", 0, 0.0, 0.0, 9.0, 9.0), box(70.0, 20.0, 70.0, 30.0)]
    spans = [("a", 0, 5.0, 5.0, 20.0, 10.0, "left"), ("a", 0, 60.0, 5.0, 80.0, 10.0, "right"), ("a", 0, 60.0, 25.0, 90.0, 30.0, "wide"), ("a", 0, 5.0, 25.0, 9.0, 30.0, "is"), ("a", 0, 5.0, 32.0, 9.0, 36.0, "two"), ("a", 1, 5.0, 5.0, 9.0, 9.0, "elsewhere"), ("a", 0, 5.0, 5.0, 6.0, 6.0, None)]
    got = grid.tables(spark.createDataFrame(rules, RULES), spark.createDataFrame(spans, SPANS)).orderBy("row_no").collect()
    assert [(r.doc_id, r.table_no, r.row_no, r.cells) for r in got] == [("a", 0, 0, ["left", "right"]), ("a", 0, 1, ["is wide\ntwo", ""])]
    assert grid.tables(spark.createDataFrame([], RULES), spark.createDataFrame(spans, SPANS)).count() == 0


def test_a_failed_batch_of_the_intake_runs_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.docx", b"1"), ("b.docx", b"2"), ("c.docx", b"1"), ("d.txt", b"3")):
        (tmp_path / "in" / name).write_bytes(body)
    state, calls = str(tmp_path / "state"), []

    def process(listed):
        calls.append(sorted(r.name for r in listed.select("name").collect()))
        if len(calls) == 1:
            raise RuntimeError("stopped")
        return listed.select("path", "name")

    with pytest.raises(Exception, match="stopped"):
        intake.take(spark, str(tmp_path / "in"), state, process)
    first = sorted((files_name(r.path), r.status, files_name(r.same_as), r.batch) for r in intake.take(spark, str(tmp_path / "in"), state, process).collect())
    assert first == [("a.docx", "taken", "a.docx", 0), ("b.docx", "taken", "b.docx", 0), ("c.docx", "repeat", "a.docx", 0)] and calls == [["a.docx", "b.docx"]] * 2
    (tmp_path / "in" / "e.docx").write_bytes(b"2")
    (tmp_path / "in" / "f.docx").write_bytes(b"5")
    second = sorted((files_name(r.path), r.status, files_name(r.same_as), r.batch) for r in intake.take(spark, str(tmp_path / "in"), state, process).collect())
    assert second == sorted([*first, ("e.docx", "repeat", "b.docx", 1), ("f.docx", "taken", "f.docx", 1)]) and calls[-1] == ["f.docx"]
    assert intake.take(spark, str(tmp_path / "in"), state, process).count() == 5 and len(calls) == 3
    assert spark.read.parquet(f"{state}/results").count() == 3


def files_name(path):
    return path.rsplit("/", 1)[1]


@pytest.mark.parametrize("order", [0, 1])
def test_jobs_in_any_order_and_after_a_restart(spark, tmp_path, order):
    at = lambda day: f"2024-01-{day:02d} 00:00:00"
    events = [("j", "start", None, None, None, 2, at(1)), ("j", "result", "x", "success", 4, None, at(2)), ("j", "result", "x", "success", 4, None, at(3)), ("j", "result", "y", "error", 0, None, at(3)), ("k", "start", None, None, None, 1, at(2)), ("l", "result", "x", "success", 3, None, at(2))]
    events = events if order == 0 else events[::-1]
    schema = job_stream.EVENTS.replace("at timestamp", "at string")
    folder, state = str(tmp_path / "events"), str(tmp_path / "state")
    for part in (events[:3], events[3:], [("", "clock", None, None, None, None, at(28))]):
        spark.createDataFrame(part, schema).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(folder)
        got = {r.job_id: r for r in job_stream.follow(spark, folder, state, patience_ms=10 * 86_400_000).collect()}
    assert (got["j"].status, got["j"].done, got["j"].success, got["j"].errors, got["j"].avg_fields, got["j"].repeats) == ("done", 2, 1, 1, 2.0, 1)
    assert got["k"].status == "stale" and got["k"].total == 1 and got["l"].status == "stale" and got["l"].total is None


def test_replies(spark):
    calls = spark.createDataFrame([("a", '{"x": 1}', None), ("b", "[1]", None), ("c", None, "refused"), ("d", "", None), ("e", "{", None), ("a", None, "timeout")], "doc_id string, raw string, failure string")
    got = sorted((r.doc_id, r.status, r.error is not None) for r in files.Replay(calls)(spark.createDataFrame([(x,) for x in "abcdef"] + [(None,)], "doc_id string")).select("doc_id", "status", "error").collect() if r.doc_id)
    assert got == [("a", "ok", False), ("a", "timeout", True), ("b", "broken", False), ("c", "refused", True), ("d", "empty", False), ("e", "broken", False), ("f", "missing", False)]
