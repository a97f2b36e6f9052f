"""Queries of matching by folds and scores, of the scorer, of reports, jobs and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.functions import rules as R
from scrivel.operators import matching, records, reports, scoring
from scrivel.plans.inputs import KEY, keyed, made, pick, q, table
from scrivel.plans.registry import CLEAN_SQL, NOISE_SQL, NORM_SQL, query
from scrivel.sources import files, spans
from scrivel.streaming.shared import shared_dir

c = F.col


# -- labels to fields, in order ---------------------------------------------------------------------------------------
_ALIAS: dict[str, list] = {}
for _f, _names in [*R.LABEL_ALIASES.items(), *(("_section_" + k, v) for k, v in R.SECTION_ALIASES.items())]:
    for _a in _names:
        _ALIAS.setdefault(matching.normal(_a), [_f, len(_ALIAS)])[0] = _f
_ALIAS_SQL = f"(SELECT * FROM (VALUES {', '.join(f'({q(a)}, {q(f)}, {k})' for a, (f, k) in _ALIAS.items())}) v(alias, field, ordinal) WHERE field NOT LIKE '\\_section%' ESCAPE '\\')"
_LABELS = made("part", doc_id="cast(p_partkey % 60 as string)", pos="cast(p_partkey as int)", label=pick("cast(floor(p_partkey / 60) as bigint) + 3 * p_partkey", q("Họ và tên"), q("EMAIL"), q("Your phone number"), q("Home Address:"), "p_name", q("Date of birth (dd/mm)"), q("Số CMND"), q("na"), q("Education"), q("mobile phone"), q("Full name"), q("Email liên hệ")), value="concat('v', cast(p_partkey as string))")


@query(f"""WITH RECURSIVE l AS (SELECT *, {NORM_SQL('label')} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM {_LABELS[1]}), d AS (SELECT DISTINCT n FROM l), a AS {_ALIAS_SQL},
s AS (SELECT n, field, ordinal, greatest(CASE WHEN contains(n, alias) OR contains(alias, n) THEN length(alias) / length(n) ELSE 0 END, CASE WHEN list_has_all(string_split(n, ' '), string_split(alias, ' ')) THEN len(list_distinct(string_split(alias, ' '))) / len(list_distinct(string_split(n, ' '))) ELSE 0 END) AS s FROM d, a WHERE n <> ''),
z AS (SELECT n, field AS fuzzy FROM s WHERE s > 0.5 QUALIFY row_number() OVER (PARTITION BY n ORDER BY s DESC, ordinal) = 1),
p AS (SELECT l.doc_id, l.i, l.value, a.field AS exact, z.fuzzy FROM l LEFT JOIN a ON alias = l.n LEFT JOIN z ON z.n = l.n),
w AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS f, CAST([] AS VARCHAR[]) AS v FROM p
 UNION ALL SELECT doc_id, i, CASE WHEN g IS NULL THEN f ELSE list_append(f, g) END, CASE WHEN g IS NULL THEN v ELSE list_append(v, value) END
 FROM (SELECT w.doc_id, p.i, w.f, w.v, p.value, CASE WHEN exact IS NOT NULL AND NOT list_contains(f, exact) THEN exact WHEN fuzzy IS NOT NULL AND NOT list_contains(f, fuzzy) THEN fuzzy END AS g FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)),
o AS (SELECT doc_id, arg_max(f, i) AS f, arg_max(v, i) AS v FROM w GROUP BY 1)
SELECT doc_id, {', '.join(f'v[list_position(f, {q(k)})] AS "{k}"' for k in R.LABEL_ALIASES if k != 'contactEmail')}, coalesce(v[list_position(f, 'contactEmail')], v[list_position(f, 'primaryEmail')]) AS "contactEmail" FROM o WHERE len(f) > 0""")
def join3_join8_assign(spark, sf):
    got = matching.assign_fields(_LABELS[0](spark, sf)).groupBy("doc_id").pivot("field", list(R.LABEL_ALIASES)).agg(F.first("value"))
    return got.withColumn("contactEmail", F.coalesce("contactEmail", "primaryEmail"))


# -- fuzzy picklists: labels and texts of one length class, so that whole and sorted tokens decide --------------------------
_NATIONS = made("nation", picklist_id="'country'", ordinal="cast(n_nationkey as int)", external_code="cast(null as string)", label_vi="lower(n_name)", label_en="n_name", option_id="CASE WHEN n_nationkey = 6 THEN '' ELSE cast(100 + n_nationkey as string) END", status="CASE WHEN n_nationkey = 7 THEN 'I' ELSE 'A' END")
_N = "cast(c_custkey % 23 as string)"
_ASKED = made("customer", id="c_custkey", picklist_id="'country'", text=pick("c_custkey", "concat('Nation_', " + _N + ")", "concat(' NATION_', " + _N + ", ' ')", "concat('NATON ', " + _N + ")", "concat('ntion_', " + _N + ")", "concat(" + _N + ", ' NATON')", "concat('XATIO_', " + _N + ")", q("zzzzzzzz"), "concat('nAtIoN_', " + _N + ")", "cast(null as string)", "concat('NATI0N-', " + _N + ")"))


def _lcs(a: str, b: str) -> str:
    """The longest common subsequence of two short texts: one bit a letter of a, one step a letter of b."""
    full = f"((CAST(1 AS BIGINT) << CAST(length({a}) AS INTEGER)) - 1)"
    mask = f"list_sum(list_transform(range(CAST(length({a}) AS BIGINT)), lambda i: CASE WHEN substr({a}, i + 1, 1) = substr({b}, j + 1, 1) THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END))"
    steps = f"list_transform(range(CAST(length({b}) AS BIGINT)), lambda j: CAST({mask} AS BIGINT))"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {steps}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})))"


_INDEL = lambda a, b: f"(200.0::double * {_lcs(a, b)} / (length({a}) + length({b})))"


@query(f"""WITH i AS (SELECT key, arg_max(option_id, ordinal) AS opt FROM (SELECT ordinal, option_id, trim(unnest([lower(label_en), lower(label_vi), lower(external_code)])) AS key FROM {_NATIONS[1]} WHERE status = 'A') GROUP BY key),
t AS (SELECT DISTINCT text, nullif(opt, '') AS exact FROM {_ASKED[1]} LEFT JOIN i ON key = trim(lower(text))),
n AS (SELECT ordinal, unnest([label_en, label_vi]) AS name FROM {_NATIONS[1]} WHERE status = 'A'),
p AS (SELECT text, name, ordinal, array_to_string(list_sort(list_filter(string_split(text, ' '), lambda x: x <> '')), ' ') AS sorted FROM t, n WHERE exact IS NULL AND text IS NOT NULL),
s AS (SELECT text, name, ordinal, greatest({_INDEL('text', 'name')}, 0.95::double * {_INDEL('sorted', 'name')}) AS score FROM p),
b AS (SELECT text, name FROM s WHERE score >= 70 QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, ordinal) = 1),
r AS (SELECT t.text, exact, nullif(i.opt, '') AS near FROM t LEFT JOIN b ON b.text = t.text LEFT JOIN i ON key = trim(lower(name)))
SELECT id, picklist_id, a.text, coalesce(exact, near) AS option_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'fuzzy' END AS how FROM {_ASKED[1]} a LEFT JOIN r ON r.text = a.text""")
def join6_mth5_fuzzy_picklist(spark, sf):
    return matching.match_picklist(_ASKED[0](spark, sf), _NATIONS[0](spark, sf))


@query(f"""WITH n AS (SELECT n_nationkey AS ordinal, n_name AS name FROM nation), t AS (SELECT DISTINCT text FROM {_ASKED[1]} WHERE text IS NOT NULL),
s AS (SELECT text, name, ordinal, round(greatest({_INDEL('text', 'name')}, 0.95::double * {_INDEL('sorted', 'name')}), 9) AS score FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(text, ' '), lambda x: x <> '')), ' ') AS sorted FROM t, n))
SELECT 'x' AS picklist_id, text, CAST(row_number() OVER (PARTITION BY text ORDER BY score DESC, ordinal) AS INTEGER) AS rank, name, score FROM s QUALIFY rank <= 3""")
def join6_srt4_top_three(spark, sf):
    names = table(spark, sf, "nation").select(F.lit("x").alias("picklist_id"), c("n_nationkey").alias("ordinal"), c("n_name").alias("name"))
    texts = _ASKED[0](spark, sf).select(F.lit("x").alias("picklist_id"), "text").where("text is not null").distinct()
    return matching.fuzzy_top(texts, names, 3).withColumn("score", F.round("score", 9))


# -- similarity and scores --------------------------------------------------------------------------------------------
#: Texts that hold each other, share no letter, or have their blocks in other places and order.
_NEAR = made("customer", id="c_custkey", a="c_name", b=pick("c_custkey", "c_name", "upper(c_name)", "concat(c_name, '@@', c_mktsegment)", "concat('??', c_name)", "concat('  ', replace(c_name, '#', '#'), '   ')", q("!!!"), "''", "cast(null as string)", "concat(substr(c_name, 10), left(c_name, 9))", "concat(left(c_name, 8), '-', c_mktsegment, right(c_name, 4))", "replace(c_name, '0', '1')", "c_mktsegment", "concat(right(c_name, 6), ' ', c_mktsegment, ' ', left(c_name, 5))"))


@query(f"""WITH RECURSIVE t AS (SELECT id, lower(trim(a)) AS x, coalesce(lower(trim(b)), '') AS y FROM {_NEAR[1]}),
todo AS (SELECT id, x, y, CAST(1 AS BIGINT) AS a, length(x) + 1 AS b, CAST(1 AS BIGINT) AS c, length(y) + 1 AS d, CAST(0 AS BIGINT) AS n FROM t
 UNION ALL SELECT id, x, y, unnest([a, i + k]), unnest([i, b]), unnest([c, j + k]), unnest([j, d]), unnest([k, 0]) FROM
  (SELECT *, coalesce(list_max(list_filter(range(1, least(b - i, d - j) + 1), lambda m: substr(x, i, m) = substr(y, j, m))), 0) AS k FROM (SELECT *, unnest(range(c, d)) AS j FROM (SELECT *, unnest(range(a, b)) AS i FROM todo))
   WHERE substr(x, i, 1) = substr(y, j, 1) QUALIFY row_number() OVER (PARTITION BY id, a, b, c, d ORDER BY k DESC, i, j) = 1)),
s AS (SELECT id, sum(n) AS n FROM todo GROUP BY 1)
SELECT id, CASE WHEN length(x) + length(y) = 0 THEN 1 ELSE 2.0::double * n / (length(x) + length(y)) END AS ratio FROM t JOIN s USING (id)""")
def mth3_similarity(spark, sf):
    return scoring.with_ratio(_NEAR[0](spark, sf), "a", "b").select("id", "ratio")


_TRUTH = "to_json(named_struct('personal_info', named_struct('full_name', c_name, 'email', 'a@b.org'), 'summary', c_mktsegment, 'languages', array('English', 'French'), 'is_current', true, 'work_experience', array(named_struct('title', 'Dev', 'summary', 'Wrote'), named_struct('title', 'Lead', 'summary', 'Led')), 'metadata', named_struct('id', c_custkey)))"
#: What each record gets wrong, by independent choices; the last one decides what kind of row it is.
_CHOICES = {"n": "c_custkey % 3", "e": "cast(floor(c_custkey / 3) as bigint) % 2", "g": "cast(floor(c_custkey / 6) as bigint) % 4", "w": "cast(floor(c_custkey / 24) as bigint) % 4", "b": "cast(floor(c_custkey / 96) as bigint) % 2", "kind": "cast(floor(c_custkey / 5) as bigint) % 7"}


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = keyed(spark, sf_dir, "customer", "cv_id", KEY).selectExpr("*", f"{_TRUTH} AS truth", *(f"{v} AS {k}" for k, v in _CHOICES.items()))
    name = "CASE n WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) ELSE concat(c_name, '@@@@@@@@@@@@') END"
    speaks = "CASE g WHEN 0 THEN array('English', 'French') WHEN 1 THEN array('French', 'Englis', 'x') WHEN 2 THEN array('English', 'zzz') ELSE cast(array() as array<string>) END"
    works = "CASE w WHEN 0 THEN array(named_struct('title', 'Dev', 'summary', 'Wrote'), named_struct('title', 'Lead', 'summary', 'Led')) WHEN 1 THEN array(named_struct('title', 'Lead', 'summary', 'Led')) WHEN 2 THEN array(named_struct('title', 'Lead', 'summary', 'Led'), named_struct('title', 'Dev', 'summary', cast(null as string))) ELSE cast(array() as array<struct<title:string,summary:string>>) END"
    parsed = f"to_json(named_struct('personal_info', named_struct('full_name', {name}, 'email', CASE WHEN e = 0 THEN 'a@b.org' END), 'summary', c_mktsegment, 'languages', {speaks}, 'is_current', b = 0, 'work_experience', {works}, 'metadata', named_struct('id', c_custkey)))"
    got = t.where("kind != 6").selectExpr("cv_id", f"CASE kind WHEN 4 THEN '[1]' WHEN 5 THEN concat('{{', c_name) ELSE {parsed} END AS record")
    return t.select("cv_id", c("truth").alias("record")), got


def _results(spark, sf) -> DataFrame:
    return scoring.score_records(*_scored(spark, sf))


_LEN = "length(c_name)"
_MARKS = f"""m AS (SELECT {KEY} AS cv_id, *, CASE n WHEN 2 THEN 2.0::double * {_LEN} / (2 * {_LEN} + 12) ELSE 1 END AS name, CASE WHEN e = 0 THEN 1.0::double ELSE 0 END AS mail, CASE g WHEN 0 THEN 1.0::double WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0 END AS lang, CASE WHEN b = 0 THEN 1.0::double ELSE 0 END AS cur,
 -- entries: each takes the best one left; a title of another entry shares letters, so its mark is that of the first left
 CASE w WHEN 0 THEN 1.0::double WHEN 1 THEN 0.7::double * {{dev_by_lead}} / 2 + 0.15::double WHEN 2 THEN 0.7::double * {{swapped}} / 2 + 0.3::double ELSE 0 END AS work
 FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _CHOICES.items())} FROM customer)),
p AS (SELECT *, (3 * name + 3 * mail) / 6 AS info FROM m), o AS (SELECT *, (info + 2 * 1 + 2 * lang + cur + 3 * work + 1) / 10 AS score FROM p)"""
# The marks of entries by hand: 'dev' and 'lead' share 'e' (2 * 1 / 7), 'wrote' and 'led' share 'e' (2 * 1 / 8). With one entry left, the first truth entry takes it
# and the second finds none; with both, the first takes the one with its title (1 and a missing summary) and the second its own.
_DEV_BY_LEAD, _SWAPPED = "((2.0::double / 7 + 0.25) / 2)", "(0.5::double + 1)"
_MARKS = _MARKS.replace("{dev_by_lead}", _DEV_BY_LEAD).replace("{swapped}", _SWAPPED).replace(" -- entries: each takes the best one left; a title of another entry shares letters, so its mark is that of the first left\n", "")
_OK = "kind NOT IN (4, 5, 6)"
_PLACES = lambda x, n: f"round({x}, {n})"


@query(f"""WITH {_MARKS}, i AS (SELECT *, list_filter([
 CASE WHEN name < 0.8 THEN concat('MISMATCH personal_info.full_name: expected=''', c_name, ''', got=''', c_name, '@@@@@@@@@@@@'' (sim=', printf('%.2f', name), ')') END, CASE WHEN e = 1 THEN 'MISSING  personal_info.email' END,
 CASE g WHEN 2 THEN 'PARTIAL  languages: matched 50% of 2 items' WHEN 3 THEN 'EMPTY    languages: expected 2 items, got 0' END, CASE WHEN b = 1 THEN 'WRONG    is_current: expected=True, got=False' END,
 CASE w WHEN 1 THEN 'SHORT    work_experience: expected 2 entries, got 1' WHEN 3 THEN 'EMPTY    work_experience: expected 2 items, got 0' END,
 CASE w WHEN 1 THEN 'MISMATCH work_experience[0].title: expected=''Dev'', got=''Lead'' (sim=0.29)' WHEN 2 THEN 'MISSING  work_experience[0].summary' END,
 CASE w WHEN 1 THEN 'MISMATCH work_experience[0].summary: expected=''Wrote'', got=''Led'' (sim=0.25)' END, CASE w WHEN 1 THEN 'MISSING  work_experience[1]: no matching entry found' END], lambda x: x IS NOT NULL) AS found FROM o)
SELECT cv_id, CASE kind WHEN 4 THEN 'parsed is no object' WHEN 5 THEN 'parsed is no JSON' WHEN 6 THEN 'no parsed' ELSE 'scored' END AS status, CASE WHEN {_OK} THEN round(score, 4) ELSE 0 END AS score, CASE WHEN {_OK} THEN round(score, 4) >= 0.8 ELSE false END AS passed,
 CASE WHEN kind = 6 THEN ['FILE NOT FOUND: ' || cv_id || '.json'] WHEN {_OK} THEN found ELSE CAST([] AS VARCHAR[]) END AS issues, {', '.join(f'CASE WHEN {_OK} THEN round({v}, 3) END AS {k}' for k, v in (('personal_info', 'info'), ('languages', 'lang'), ('is_current', 'cur'), ('work_experience', 'work')))} FROM i""")
def sco1_to_sco4_join13_join14_mth4_score(spark, sf):
    r = _results(spark, sf)
    return r.select("cv_id", "status", "score", "passed", "issues", *(F.try_element_at("field_scores", F.lit(k)).alias(k) for k in ("personal_info", "languages", "is_current", "work_experience")))


_SCORE = f"CASE WHEN {_OK} THEN round(score, 4) ELSE 0 END"


@query(f"WITH {_MARKS} SELECT count(*) FILTER ({_SCORE} >= 0.8) >= 8 AND avg({_SCORE}) >= 0.75 AS suite_passed, round(avg({_SCORE}), 4) AS mean_score, count(*) FILTER ({_SCORE} >= 0.8) AS cvs_passed, count(*) AS cvs_total FROM o")
def snk4_sco5_suite_report(spark, sf):
    return scoring.suite_report(_results(spark, sf))


@query(f"""WITH {_MARKS}, h AS (SELECT unnest(['personal_info', 'summary', 'languages', 'is_current', 'work_experience']) AS section, unnest([round(info, 3), 1.0, round(lang, 3), round(cur, 3), round(work, 3)]) AS s FROM o WHERE {_OK}) SELECT section, round(avg(s), 9) AS mean, count(*) AS n FROM h GROUP BY 1""")
def agg14_heatmap(spark, sf):
    return scoring.heatmap(_results(spark, sf)).withColumn("mean", F.round("mean", 9))


@query(f"""WITH {_MARKS} SELECT cv_id, CASE WHEN {_SCORE} >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS verdict, concat(repeat('#', CAST(floor({_SCORE} * 40) AS INTEGER)), repeat('.', 40 - CAST(floor({_SCORE} * 40) AS INTEGER))) AS bar, printf('%.1f%%', {_SCORE} * 100) AS percent FROM o""")
def snk7_console(spark, sf):
    return reports.console(_results(spark, sf))


_ISSUES = made("lineitem", cv_id="cast(l_orderkey as string)", issue="concat('issue ', cast(l_linenumber as string), '-', cast(l_partkey as string))")


@query(f"SELECT cv_id, list_sort(list(issue))[1:5] AS issues, CAST(greatest(count(*) - 5, 0) AS INTEGER) AS more FROM {_ISSUES[1]} GROUP BY cv_id")
def srt5_top_issues(spark, sf):
    return scoring.top_issues(_ISSUES[0](spark, sf).groupBy("cv_id").agg(F.array_sort(F.collect_list("issue")).alias("issues")))


@query("""SELECT count(*) AS total_files, count(*) FILTER (value > 0) AS success, count(*) FILTER (NOT coalesce(value > 0, false)) AS errors, round_even(sum(user_id) / count(*), 1) AS avg_fields_per_file, CAST(sum(event_id) AS BIGINT) AS total_time_ms FROM events""")
def agg1_agg2_mth6_mth7_snk2_batch(spark, sf):
    return records.batch_report(table(spark, sf, "events").select(F.when(c("value") > 0, "success").otherwise("error").alias("status"), c("user_id").alias("fields_extracted"), c("event_id").alias("elapsed_ms")))


# -- reviews ----------------------------------------------------------------------------------------------------------
_V = lambda k: pick(f"(l_suppkey + {k} * l_linenumber)", q("correct"), q("wrong"), q("partial"), q("skip"), q("missing"))
_REVIEWS = made("lineitem", file=f"concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string))", a=_V(1), b=_V(2), d=_V(3), e=_V(4), kind="l_partkey % 5")


def _reviews(spark, sf) -> DataFrame:
    text = F.concat(F.lit('{"file":"x","reviewed_at":"2024","fields":{"fullName":"'), "a", F.lit('","email":"'), "b", F.lit('"},"sections":{"education":{"_count":"'), "d", F.lit('","entry_0":{"degree":"'), "e", F.lit('"},"entry_1":{"degree":"'), "a", F.lit('","school":"'), "b", F.lit('"}},"awards":{"_count":"'), "e", F.lit('"}}}'))
    return _REVIEWS[0](spark, sf).select("file", F.when(c("kind") == 0, F.lit('{"fields":{}}')).when(c("kind") == 1, F.lit("no json")).otherwise(text).alias("review"))


_VERDICTS = f"""v AS (SELECT file, unnest([NULL, NULL, 'education', 'education', 'education', 'education', 'awards']) AS section, unnest([NULL, NULL, NULL, 'entry_0', 'entry_1', 'entry_1', NULL]) AS entry, unnest(['fullName', 'email', '_count', 'degree', 'degree', 'school', '_count']) AS field, unnest([a, b, d, e, a, b, e]) AS verdict FROM {_REVIEWS[1]} WHERE kind > 1)"""


@query(f"WITH {_VERDICTS} SELECT * FROM v")
def src11_verdict_rows(spark, sf):
    return reports.verdict_rows(_reviews(spark, sf))


_COUNTS = "count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'partial') AS \"partial\", count(*) AS total, round_even((count(*) FILTER (verdict = 'correct') + 0.5::double * count(*) FILTER (verdict = 'partial')) / count(*) * 100, 1) AS accuracy"


@query(f"""WITH {_VERDICTS}, u AS (SELECT *, CASE WHEN section IS NULL THEN 'top_level' WHEN field = '_count' THEN 'section_count' ELSE 'section_field' END AS part FROM v WHERE verdict <> 'skip' AND NOT (section = 'awards' AND field = '_count'))
SELECT part, section, field, {_COUNTS} FROM u GROUP BY 1, 2, 3 UNION ALL SELECT 'overall', NULL, NULL, {_COUNTS} FROM u WHERE part <> 'section_count'""")
def snk5_srt6_accuracy_report(spark, sf):
    """Awards have a count verdict and no field verdict, so they have no line."""
    return reports.accuracy_report(reports.verdict_rows(_reviews(spark, sf)))


@query("SELECT concat('cv', p_partkey, '.pdf') AS name, concat('cv', p_partkey) AS stem, p_partkey AS size FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 1")
def join12_rev2_to_review(spark, sf):
    t = table(spark, sf, "part").select(F.concat(F.lit("cv"), c("p_partkey").cast("string"), F.lit(".pdf")).alias("name"), F.concat(F.lit("cv"), c("p_partkey").cast("string")).alias("stem"), c("p_partkey").alias("size"))
    return reports.to_review(t, t.where("size % 3 != 0").select("stem"), t.where("size % 4 = 1").select("stem")).select("name", "stem", "size")


# -- jobs -------------------------------------------------------------------------------------------------------------
@query("""WITH j AS (SELECT o_orderkey AS job_id, o_orderkey % 8 AS total FROM orders), r AS (SELECT l_orderkey AS job_id, count(*) AS done, count(*) FILTER (l_returnflag <> 'R') AS success, sum(l_quantity) AS f FROM lineitem WHERE l_linenumber < 5 GROUP BY 1)
SELECT j.job_id, CASE WHEN coalesce(done, 0) >= total THEN 'done' ELSE 'running' END AS status, CAST(total AS BIGINT) AS total, coalesce(done, 0) AS done, coalesce(success, 0) AS success, coalesce(done, 0) - coalesce(success, 0) AS errors, coalesce(round_even(f / done, 1), 0)::double AS avg_fields FROM j LEFT JOIN r USING (job_id)""")
def orc4_job_states(spark, sf):
    jobs = table(spark, sf, "orders").select(c("o_orderkey").alias("job_id"), (c("o_orderkey") % 8).alias("total"))
    done = table(spark, sf, "lineitem").where("l_linenumber < 5").select(c("l_orderkey").alias("job_id"), F.when(c("l_returnflag") == "R", "error").otherwise("success").alias("status"), c("l_quantity").alias("fields"))
    return reports.job_states(jobs, done)


_UPLOADS = made("lineitem", job_id="cast(l_orderkey as string)", seq="cast(l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey as bigint)", name=pick("l_partkey", q("cv.pdf"), q("cv.docx"), "concat('cv', cast(l_partkey as string), '.pdf')"))


@query(f"""SELECT job_id, seq, name, CASE WHEN row_number() OVER (PARTITION BY job_id, name ORDER BY seq) = 1 THEN name ELSE concat(left(md5(concat(job_id, '/', seq, '/', name)), 6), '_', name) END AS stored FROM {_UPLOADS[1]}""")
def src13_stored_names(spark, sf):
    return reports.stored_names(_UPLOADS[0](spark, sf))


_SURE = made("part", id="p_partkey", a="cast((p_partkey % 11) / 10 as double)", b="cast((p_partkey % 7) / 7 as double)")


@query(f"SELECT id, CASE WHEN a < 0.7 THEN a END AS a, CASE WHEN b < 0.7 THEN b END AS b FROM {_SURE[1]}")
def flt14_low_confidence(spark, sf):
    m = records.low_confidence(F.create_map(F.lit("a"), c("a"), F.lit("b"), c("b")))
    return _SURE[0](spark, sf).select("id", m.alias("m")).select("id", F.try_element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("b")).alias("b"))


# -- sources ----------------------------------------------------------------------------------------------------------
_SPANS = made("lineitem", doc_id="cast(l_orderkey as string)", page="cast(l_partkey % 2 as int)", block="cast(l_suppkey % 3 as int)", line="cast(l_linenumber as int)", span="cast(l_partkey * 10000 + l_suppkey as bigint)", kind="CASE WHEN l_suppkey % 3 = 2 AND l_orderkey % 4 = 0 THEN 1 ELSE 0 END",
              text=pick("l_partkey", q("Trang 1 / 2"), q("  a "), q("TRUE"), "cast(null as string)", q(" word"), q("From *"), q("")), font=pick("l_suppkey", q("Times-Bold"), q("Times"), q("Arial"), "cast(null as string)", q("Times")), flags="CASE WHEN l_partkey % 9 = 0 THEN 20 ELSE 4 END", size="cast(l_quantity as double)")


@query(f"""WITH s AS (SELECT * FROM {_SPANS[1]} WHERE kind = 0), l AS (SELECT doc_id, page, block, line, string_agg(coalesce(text, ''), '' ORDER BY span) AS t, bool_or(contains(lower(coalesce(font, '')), 'bold') OR flags & 16 <> 0) AS b, max(size) AS z FROM s GROUP BY 1, 2, 3, 4),
k AS (SELECT doc_id, page, block, regexp_replace(string_agg(t, chr(10) ORDER BY line), '^\\s+|\\s+$', '', 'g') AS text, bool_or(b) AS is_bold, max(z) AS font_size FROM l GROUP BY 1, 2, 3)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, block) - 1 AS INTEGER) AS block_no, page, CAST(block * 50 AS DOUBLE) AS y0, text, is_bold, font_size FROM k WHERE NOT {NOISE_SQL('text')}""")
def src3_span_blocks(spark, sf):
    s = _SPANS[0](spark, sf).withColumns({"x0": F.lit(0.0), "x1": F.lit(500.0), "y0": c("block") * 50.0, "y1": c("block") * 50.0 + 40})
    return spans.blocks(s).select("doc_id", "block_no", "page", "y0", "text", "is_bold", "font_size")


_CELLS = made("part", doc_id="cast(p_partkey as string)", table_no="cast(0 as int)", row_no="cast(0 as int)", a=pick("p_partkey", q(" x "), q("TRUE"), "cast(null as string)", q("From *")), b=pick("cast(floor(p_partkey / 4) as bigint)", q(""), q("Page 1 of 2"), "p_name", q("Chức vụ *")))


@query(f"SELECT doc_id, table_no, row_no, [trim(coalesce(a, '')), trim(coalesce(b, ''))] AS cells FROM {_CELLS[1]} WHERE coalesce({CLEAN_SQL('a')}, false) OR coalesce({CLEAN_SQL('b')}, false)")
def src3_table_rows(spark, sf):
    return spans.table_rows(_CELLS[0](spark, sf).select("doc_id", "table_no", "row_no", F.array("a", "b").alias("cells")))


@query("SELECT s_suppkey AS id, s_name AS name, s_nationkey % 2 = 0 AS listed FROM supplier")
def src8_src9_json_folder(spark, sf):
    """One JSON file a supplier, half of them an array of one object, read back as records."""
    path = shared_dir(spark, "json")
    t = table(spark, sf, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"), (c("s_nationkey") % 2 == 0).alias("listed"))
    for listed in (True, False):
        part = t.where(c("listed") == listed).select(F.struct("id", "name", "listed").alias("r"))
        body = F.to_json(F.array("r")) if listed else F.to_json("r")
        part.select(body.alias("value")).repartition(8).write.option("maxRecordsPerFile", 1).mode("append").text(path)
    got = files.json_records(spark, path, "*.txt")
    at = lambda p, kind: F.try_variant_get("record", f"$.{p}", kind).alias(p)
    return got.select(at("id", "bigint"), at("name", "string"), at("listed", "boolean"))


_FILES = made("part", path=pick("p_partkey", "concat('/in/cv', cast(p_partkey as string), '.pdf')", "concat('/in/cv', cast(p_partkey as string), '.DOCX')", "concat('/in/a.b.', cast(p_partkey as string), '.doc')", "concat('/in/cv', cast(p_partkey as string), '.txt')", "concat('/in/cv', cast(p_partkey as string))", q("/in/.pdf")))


@query(f"SELECT path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('pdf', 'docx', 'doc') AS allowed, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem FROM {_FILES[1]}")
def src1_flt5_str12_names(spark, sf):
    return _FILES[0](spark, sf).select("path", files.allowed(c("path")).alias("allowed"), files.stem(c("path")).alias("stem"))
