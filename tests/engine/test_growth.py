"""What keeps the work of a query in proportion to its input: rows dealt over tasks, nothing worked out twice or before that."""

import random

import duckdb
from pyspark.sql import functions as F

from scrivel import catalogue, catalogue_pages
from scrivel.functions import fuzzy, text
from scrivel.operators import matching, parsers, scoring
from scrivel.plans import extract, inputs
from scrivel.sources import files, grid
from scrivel.streaming import job_stream

SF = "/root/testdata/sf0.01"


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_short_tables_are_dealt_over_tasks(spark):
    for name in inputs.SHORT:
        rows = inputs.table(spark, SF, name)
        sizes = [len(x) for x in rows.rdd.glom().collect()]
        assert len(sizes) == 4 and min(sizes) > 0.8 * max(sizes), sizes


def test_nothing_but_columns_goes_before_the_dealing(spark):
    for name in ("val8_to_val12_entries", "agg8_srt3_categories", "tvf11_win2_jobs", "tvf9_rx10_schools", "tvf12_rx11_language_lines", "agg14_heatmap"):
        for below in plan_of(catalogue.QUERIES[name](spark, SF)).split("Repartition")[1:]:
            assert "Relation" in "".join(below.split("\n")[1:3]) and "Filter" not in "".join(below.split("\n")[1:3]), (name, below[:500])


def test_a_list_is_worked_out_once(spark):
    for name in ("val8_to_val12_entries", "agg8_srt3_categories", "tvf11_win2_jobs", "tvf9_rx10_schools", "agg14_heatmap", "src11_verdict_rows"):
        assert not [x for x in plan_of(catalogue.QUERIES[name](spark, SF)).split("\n") if "Filter" in x and "size(" in x and "field_id" not in x], name


def test_records_are_joined_without_the_driver(spark):
    for name in ("snk7_console", "agg14_heatmap", "snk4_sco5_suite_report"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and "ENSURE_REQUIREMENTS" not in plan.split("SortMergeJoin")[1] and plan.count("REPARTITION_BY_NUM") == 2, plan


def test_a_key_of_a_record_is_compared_once(monkeypatch):
    asked, built = [], []
    whole, ratio, entries = fuzzy._Automaton, fuzzy.ratio, '[{"a": "Dev", "b": "Wrote"}, {"a": "Lead", "b": "Led"}]'
    monkeypatch.setattr(scoring, "ratio", lambda a, b: asked.append((a, b)) or ratio(a, b))
    monkeypatch.setattr(fuzzy, "_Automaton", lambda *a: built.append(a) or whole(*a))
    told = scoring.evaluated(f'{{"name": "An Mai", "mail": "x", "jobs": {entries}}}', '{"name": "AN  MAI ltd", "mail": "X", "jobs": [{"a": "Lead", "b": "Led"}, "text", {"a": "Dev"}]}')
    assert told == ("scored", 0.8583, ["MISMATCH name: expected='An Mai', got='AN  MAI ltd' (sim=0.75)", "MISSING  jobs[0].b"], {"name": 0.75, "mail": 1.0, "jobs": 0.825})
    # one for each text, and for the entries: both of the parsed ones for the first, the one left for the second
    assert len(asked) == 2 + 3 + 2 and len(built) <= 2 * 3
    for a, b in (("abc", "abc"), ("abc", "xabcx"), ("xabcx", "abc"), ("", "a"), ("ab" * 200, "ab" * 200)):
        n = len(built)
        assert fuzzy.in_common(a, b) == min(len(a), len(b)) and len(built) == n


def test_headings_of_a_table_are_read_once(spark):
    for name in ("tvf3_rx13_jobs", "tvf4_schools", "tvf5_certificates", "tvf6_languages"):
        assert plan_of(catalogue.QUERIES[name](spark, SF)).count(r"[^a-z0-9\s]") == 1, name
    cells = [(["Tu", "Company", "Position", "Company name"], ["2010", "x", "Dev", "Acme"]), (["Position", "To"], ["Dev"]), (["Position", "Company"], ["From *", " "]), (["Thời gian", "Chức vụ"], ["2010 - nay", "Dev"]), (None, ["Dev"]), (["x"], ["Dev"]), (["Position"], None)]
    rows = spark.createDataFrame([("a", k, h, c) for k, (h, c) in enumerate(cells)], "doc_id string, row_no int, header array<string>, cells array<string>")
    assert sorted(tuple(r)[1:] for r in parsers.experience_table(rows).collect()) == [(0, "Dev", "Acme", "2010", None), (3, "Dev", None, "2010", None)]
    assert sorted(tuple(r)[1:] for r in parsers.certificate_table(rows).collect() if r.row_no > 4) == [(5, "Dev", None, None)]


def test_a_line_is_searched_only_for_what_its_letters_allow(spark):
    plan = plan_of(catalogue.QUERIES["win2_entries"](spark, SF))
    assert plan.count("RLIKE(") > 10 and ", RLIKE(" not in plan and plan.count("array(RLIKE(") == 1, plan


def test_a_line_of_a_school_is_folded_once(spark):
    plan = plan_of(catalogue.QUERIES["tvf9_rx10_schools"](spark, SF))
    assert plan.count("translate(") == 1, plan.count("translate(")
    rows = spark.createDataFrame([("Dai hoc X 2001-2005\nCertificate\nKHÁ",), ("Học viện Y\nT3/2015\nT4/2016",), ("no date\nCollege",), (None,)], "t string")
    assert [r[0] for r in rows.select(parsers.schools(F.col("t"))).collect()] == [[{"startDate": "2001", "endDate": "2005", "degree": "Certificate", "otherSchool": "Dai hoc X", "grade": "Merit"}], [{"startDate": "T3/2015", "endDate": "T4/2016", "otherSchool": "Học viện Y"}], [{"degree": "College", "otherSchool": "College"}], None]


def test_sections_are_parsed_once_and_where_they_are(spark):
    texts = spark.createDataFrame([("a", 0, "awards", "- one (2011)\n- two")], "doc_id string, sec_no long, section string, text string")
    plan = extract._parsed(texts)._jdf.queryExecution().executedPlan().toString()
    # dealt only for languages, one of each, and for the lines of families
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2 and sum("Filter" in x and "= education)" in x for x in plan.split("\n")) == 1, plan


def test_lines_are_stripped_and_judged_once(spark):
    for name in ("tvf12_rx11_language_lines", "tvf13_tvf16_courses", "tvf13_certificates", "tvf9_rx10_schools"):
        assert plan_of(catalogue.QUERIES[name](spark, SF)).count("I accept the") == 1, name
    lines = ["", " ", "Page 1 of 2", "From *", "a *", "TRUE", "TRUE b", "____", "____ x", "Trang 1 / 2", "x\nFrom *", "Signature", "no Signature", "Approved ____", "data", None]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").withColumn("x", text.strip("x"))
    assert rows.where(~text.is_data(F.col("x")).eqNullSafe(~text.is_noise(F.col("x")) & ~text.is_form_label(F.col("x")))).count() == 0


def test_items_of_one_text_are_those_of_lists(spark):
    texts = ["- a (2011)\n- bcd (2012)", "1. one\n2. two\n- three", "- ab\n- abc\nx\ny", "- ab\n- cd", "one", "", None, "* k (19)\n\nPage 1 of 2\n> long (1999) (2001)", "-\u00a0wide\n- \u2003item\r\n12) twelve", "1. a b\n2. c d\n- e f\n- g h"]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, text string")
    for share, numbered in ((0.5, True), (0.6, False)):
        want = sorted(map(repr, parsers.listed(docs, share, numbered, "day").collect()))
        got = docs.select("doc_id", F.explode(parsers.listed_items(F.col("text"), share, numbered, "day")).alias("x")).select("doc_id", "x.*")
        assert want and sorted(map(repr, got.collect())) == want


def test_jobs_go_through_no_python_and_a_late_event_wakes_a_job(spark, tmp_path):
    folder, state, day = str(tmp_path / "events"), str(tmp_path / "state"), 86_400_000
    event = lambda job, kind, name, total, at: (job, kind, name, "success" if name else None, 2 if name else None, total, f"2024-01-{at:02d}")
    waves = [[event("j", "start", None, 3, 1)], [event("", "clock", None, None, 28)], [event("j", "result", "x", None, 2)], [event("", "clock", None, None, 29)], [event("j", "result", k, None, 2) for k in "xyz"]]
    seen = []
    for rows in waves:
        spark.createDataFrame(rows, job_stream.EVENTS.replace("at timestamp", "at string")).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(folder)
        found = job_stream.follow(spark, folder, state, patience_ms=10 * day)
        seen += [(r.status, r.done, r.repeats) for r in found.where("job_id = 'j'").collect()]
    assert seen == [("running", 0, 0), ("stale", 0, 0), ("running", 1, 0), ("stale", 1, 0), ("done", 3, 1)]
    assert found.columns == ["job_id", "status", "total", "done", "success", "errors", "avg_fields", "repeats"] and not hasattr(job_stream, "_life")


def test_drawn_pages_are_dealt_once(spark):
    rules = spark.createDataFrame([("a", 0, 0.0, 0.0, 50.0, 20.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    plan = grid.crossings(grid.edges(grid.by_document(rules)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(doc_id#") == plan.count("REPARTITION_BY_COL") == 2, plan


def test_line_items_of_drawn_pages_are_dealt_and_nothing_else(spark):
    before = {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    got = catalogue.QUERIES["src3_page_tables"](spark, "/root/testdata/sf0.001")
    got.count()
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and {r.tableName for r in spark.sql("SHOW TABLES").collect()} == before


def _odd_page(rand):
    """Lines and boxes of a crooked grid with gaps, repeats and nulls, and words over it."""
    xs, ys = [sorted(rand.sample(range(0, 300, 20), rand.randint(2, 5))) for _ in "xy"]
    shake = lambda v: v + rand.choice((0.0, 0.0, 0.5, -1.0, 2.5))
    rules = [(shake(a), shake(y), shake(b), shake(y)) for y in ys for a, b in zip(xs, xs[1:]) if rand.random() < 0.8]
    rules += [(shake(x), shake(b), shake(x), shake(a)) for x in xs for a, b in zip(ys, ys[1:]) if rand.random() < 0.8]
    rules += [(400.0, shake(y), 480.0, y + 20.0) for y in ys] + [(5.0, 5.0, 6.0, 6.0), (None, 0.0, 300.0, 0.0), (0.0, shake(ys[0]), 300.0, shake(ys[0]))] + rules[:2]
    word = lambda: (rand.choice(xs) + rand.randint(-5, 25) / 2, shake(rand.choice(ys) + rand.randint(0, 20)))
    spans = [(x, y, x + 10.0, y + 4.0, rand.choice(("a", "b ", "\u00a0", "", None, "Page 1 of 2"))) for x, y in (word() for _ in range(25))]
    return rules, spans + spans[:2] + [(None, 10.0, 20.0, 12.0, "nowhere"), (410.0, ys[0] + 8.0, 420.0, ys[0] + 12.0, "boxed")]


def test_held_pages_have_the_tables_of_rows(spark):
    rand, places = random.Random(4), "x0 double, y0 double, x1 double, y1 double"
    pages = [(f"d{k // 3}" if k != 7 else None, k % 3 if k != 8 else None, *_odd_page(rand)) for k in range(60)]
    pages += [("empty", 0, [], []), ("one line", 0, [(0.0, 0.0, 300.0, 0.0)], []), ("one cell", 0, [(0.0, 0.0, 30.0, 30.0)], [])]
    rules = spark.createDataFrame([(d, p, *r) for d, p, rs, _ in pages for r in rs], f"doc_id string, page int, {places}")
    spans = spark.createDataFrame([(d, p, *w) for d, p, _, ws in pages for w in ws], f"doc_id string, page int, {places}, text string")
    want = sorted(map(tuple, grid.tables(rules, spans).collect()))
    held = spark.createDataFrame(pages, f"doc_id string, page int, rules array<struct<{places.replace(' ', ':').replace(',:', ',')}>>, spans array<struct<{places.replace(' ', ':').replace(',:', ',')},text:string>>")
    got = grid.held_tables(held)
    assert len(want) > 100 and max(w[1] for w in want) > 2 and sorted(map(tuple, got.collect())) == want
    assert [f.dataType for f in got.schema] == [f.dataType for f in grid.tables(rules, spans).schema]


def test_short_documents_are_held_and_long_ones_drawn_as_rows(spark, monkeypatch):
    held = catalogue.QUERIES["src3_cell_grid"](spark, "/root/testdata/sf0.001")
    plan = held._jdf.queryExecution().executedPlan().toString()
    # the window that numbers tables is the only one, and nothing is joined
    assert "Join" not in plan and "Exchange" not in plan and plan.count("Window ") == 1 and plan.count("arrays_overlap") == 2, plan
    want = sorted(map(tuple, held.collect()))
    monkeypatch.setattr(catalogue_pages, "HELD", 4)
    both = catalogue.QUERIES["src3_cell_grid"](spark, "/root/testdata/sf0.001")
    assert "Union" in both._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, both.collect())) == want


def test_rows_of_held_pages_are_filtered_after_their_tables(spark):
    got = catalogue.QUERIES["src3_page_tables"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window ") == 1 and plan.count("arrays_overlap") == 2 and plan.count("BatchScan") + plan.count("FileScan") == 1, plan


def test_a_label_is_matched_once(spark):
    asked = spark.createDataFrame([("p", k, "Full name", k) for k in range(50)], "doc_id string, pos int, label string, more int")
    plan = matching.fuzzy_candidates(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [label" in plan and matching.fuzzy_candidates(asked).where("more = pos").count() == 50


def test_small_files_are_read_by_the_hundreds_a_task(spark, tmp_path):
    for k in range(200):
        (tmp_path / f"{k}.docx").write_bytes(b"x")
    listed = files.list_files(spark, str(tmp_path))
    assert listed.count() == 200 and listed.select("path").rdd.getNumPartitions() == 4


def test_phones_are_counted_as_in_sql(spark, tmp_path):
    texts = ["+84 90 1234567 +84 91 7654321", "call +84901234567,+84917654321", "+84\x0b901234567", "+84 901234567", "a@b.co", "", None]
    spark.createDataFrame([(str(k), t, "en") for k, t in enumerate(texts)], "doc_id string, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalogue.QUERIES["rx1_rx3_documents"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT * FROM ({catalogue.ORACLES['rx1_rx3_documents']}) ORDER BY doc_id").fetchall()
    assert [(a, n) for a, _, n in got[:6]] == [(a, n) for a, _, n in want[:6]] and [n for *_, n in want[:4]] == [1, 1, 0, 1]
