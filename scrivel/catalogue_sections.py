"""Queries over lines, sections and grids. Their texts are mixed by row, and their SQL works the answers out from the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.functions import rules as R
from scrivel.operators import grids, layout, lines, parsers, personal
from scrivel.plans import extract
from scrivel.plans.inputs import CR, KEY, NBSP, TAB, WIDE, made, pick, q
from scrivel.plans.registry import CLEAN_SQL, DATA_SQL, FOLD_SQL, LABEL_SQL, NAME_SQL, NOISE_SQL, STRIP_SQL, mixed_lines, query, re2, sql_first, sql_holds, sql_list

c = F.col
K = "c_custkey"
NL = "chr(10)"
#: The n-th thing of a list that is there.
FIRST = lambda x: f"list_filter({x}, lambda v: v IS NOT NULL)[1]"
IS = lambda x, p: f"regexp_matches({x}, {q(re2(p))})"


def customers(**columns: str):
    return made("customer", doc_id=KEY, **columns)


# -- lines ------------------------------------------------------------------------------------------------------------
FORM = customers(line_no="cast(0 as int)", text=mixed_lines(K, 12, "concat('Full name: ', c_name)", q("Phone:"), q("+84 90 1234567"), "concat('Skills: ', c_mktsegment, ',')", q("second line,"), q("third"), q("From *"), q(""), q("Page 1 of 2"), q("no pair here"), q("  with: colons: twice, "), q(": no label"), q(f"City:{CR}"), q(f"Town:{TAB}Hue{NBSP}"), q(f"{NBSP}Lines:{WIDE}one,{CR}"), q(f"{TAB}two{CR}"), q(TAB), q("A label that is a good deal longer than the sixty letters that a label may have: x")))


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS n, {STRIP_SQL('unnest(l)')} AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {FORM[1]})),
r AS (SELECT doc_id, n, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rn, {CLEAN_SQL('line')} AS ok FROM l WHERE line <> ''),
h AS (SELECT *, {STRIP_SQL("split_part(line, ':', 1)")} AS label, {STRIP_SQL("substr(line, strpos(line, ':') + 1)")} AS v FROM r WHERE ok AND contains(line, ':')),
g AS (SELECT doc_id, rn, n, label, rn AS j, v FROM h WHERE v <> '' AND length(label) < 60
 UNION ALL SELECT g.doc_id, g.rn, g.n, g.label, r.rn, rtrim(g.v) || ' ' || r.line FROM g JOIN r ON r.doc_id = g.doc_id AND r.rn = g.j + 1 WHERE regexp_matches(g.v, ',\\s*$') AND r.ok AND NOT contains(r.line, ':')),
e AS (SELECT doc_id, n, label, arg_max(v, j) AS value FROM g GROUP BY 1, 2, 3 UNION ALL SELECT h.doc_id, h.n, h.label, r.line FROM h JOIN r ON r.doc_id = h.doc_id AND r.rn = h.rn + 1 WHERE h.v = '' AND r.ok)
SELECT doc_id, CAST(n AS INTEGER) AS pos, label, value FROM e WHERE label <> '' AND {CLEAN_SQL('label')}""")
def tvf1_win4_win5_pairs(spark, sf):
    return lines.colon_pairs(lines.explode_lines(FORM[0](spark, sf)))


_PAIRED = customers(block_no="cast(0 as int)", text=mixed_lines(K, 5, q("Position"), q("Hanoi"), "c_name", q("From *"), q(""), q("a label of more than five words here"), q("TRUE"), q("City"), "c_mktsegment", q("a label that is longer than forty letters"), q("with: colon")))


@query(f"""WITH a AS (SELECT doc_id, block_no, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM {_PAIRED[1]}),
b AS (SELECT doc_id, block_no, ls, unnest(range(0, len(ls) - 1, 2)) AS k FROM a WHERE len(ls) >= 2 AND len(list_filter(ls, lambda x: contains(x, ':'))) = 0),
p AS (SELECT doc_id, block_no, CAST(k AS INTEGER) AS line_no, ls[k + 1] AS label, ls[k + 2] AS value FROM b)
SELECT * FROM p WHERE length(label) < 40 AND len(regexp_split_to_array(label, '\\s+')) <= 5 AND {CLEAN_SQL('label')} AND {CLEAN_SQL('value')}""")
def win8_pairs(spark, sf):
    return lines.line_pairs(_PAIRED[0](spark, sf))


_SECTION = customers(text=mixed_lines(K, 11, q("Senior Engineer | Acme Corp"), q("2015 - 2018"), q("- did one"), q("- did two"), q("Manager at Beta Bank"), q("T7/2019 - T5/2021"), q(""), "c_name", q("2010 - present"), q("---"), q("a tail in small letters"), q("Một dòng dài bắt đầu bằng chữ hoa và không có ngày tháng nào cả hết"), q("3/2014 at Gamma JSC"), q("Page 1 of 2")))


def _entries_sql(frame: str) -> str:
    """CTEs b and split (doc_id, entries): a walk line by line."""
    header = f"(upper(x[1]) = x[1] AND lower(x[1]) <> x[1] AND ({IS('x', R.YEAR_RANGE)} OR contains(x, '|') OR {IS('x', R.DATE)} OR length(x) < 60))"
    none = "CAST([] AS VARCHAR[])"
    return f"""b AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS ls FROM {frame}),
s AS (SELECT doc_id, 1 AS i, {none} AS done, {none} AS now, false AS had FROM b
 UNION ALL SELECT doc_id, i + 1, CASE WHEN (stop OR fresh) AND len(now) > 0 THEN list_append(done, array_to_string(now, chr(10))) ELSE done END, CASE WHEN stop THEN {none} WHEN fresh THEN [x] ELSE list_append(now, x) END,
  CASE WHEN stop THEN had AND len(now) = 0 WHEN fresh THEN false ELSE had OR bullet END
 FROM (SELECT *, len(now) > 0 AND NOT bullet AND CASE WHEN had THEN {header} ELSE {IS('x', R.YEAR_RANGE)} AND {IS("array_to_string(now, ' ')", R.YEAR_RANGE)} END AS fresh
  FROM (SELECT s.*, ls[i] AS x, ls[i] = '' OR starts_with(ls[i], '---') OR starts_with(ls[i], '===') OR starts_with(ls[i], '***') AS stop, {IS('ls[i]', R.BULLET)} AS bullet FROM s JOIN b USING (doc_id) WHERE i <= len(ls)))),
split AS (SELECT s.doc_id, CASE WHEN len(done) + len(now) = 0 THEN [text] WHEN len(now) > 0 THEN list_append(done, array_to_string(now, chr(10))) ELSE done END AS entries FROM s JOIN b USING (doc_id) WHERE i = len(ls) + 1)"""


@query(f"WITH RECURSIVE {_entries_sql(_SECTION[1])} SELECT doc_id, entries FROM split")
def win2_entries(spark, sf):
    return lines.entries(_SECTION[0](spark, sf)).select("doc_id", "entries")


def _named_sql(x: str, dates: str, more: str = "") -> str:
    bare = f"trim(regexp_replace(trim(regexp_replace({x}, {q(dates)}, '', 'g')), '[|•·]', '', 'g'))"
    bare = f"trim(regexp_replace({bare}, {q(more)}, '', 'g'))" if more else bare
    return f"CASE WHEN {bare} <> '' AND NOT {LABEL_SQL(bare)} THEN {bare} END"


def _marks_sql(months: bool) -> str:
    """For each line of ls a struct (r, a, b): whether it is a range, its first and its second date."""
    end = f"regexp_extract(x, {q(re2(R.YEAR_RANGE))}, 2)"
    m = lambda k: f"regexp_extract(x, {q(re2(R.MONTH_RANGE))}, {k})"
    by_month = f"WHEN {IS('x', R.MONTH_RANGE)} THEN {{'r': true, 'a': {m(1)} || '/' || {m(2)}, 'b': {m(3)} || '/' || {m(4)}}}" if months else ""
    return f"""list_transform(ls, lambda x: CASE {by_month} WHEN {IS('x', R.YEAR_RANGE)} THEN {{'r': true, 'a': regexp_extract(x, {q(re2(R.YEAR_RANGE))}, 1), 'b': CASE WHEN lower({end}) NOT IN ({sql_list(R.OPEN_ENDS)}) THEN {end} END}}
 ELSE {{'r': false, 'a': nullif(regexp_extract(x, {q(re2(R.DATE))}), ''), 'b': CAST(NULL AS VARCHAR)}} END)"""


START_SQL = FIRST("list_transform(marks, lambda m: m.a)")
END_SQL = FIRST("list_transform(range(1, len(marks) + 1), lambda i: CASE WHEN marks[i].r THEN marks[i].b WHEN len(list_filter(marks[1:i - 1], lambda m: m.a IS NOT NULL)) > 0 THEN marks[i].a END)")
_YEARS = r"(?i)\d{4}\s*[-–]\s*(\d{4}|present|nay)"
_SHORT = lambda words, named: f"list_transform(ls, lambda x: CASE WHEN NOT {IS('x', R.BULLET)} AND length(x) < 80 AND {sql_holds('lower(x)', words)} THEN {named} END)"
_AT = lambda xs: f"list_filter(range(1, len(ls) + 1), lambda i: {xs}[i] IS NOT NULL)[1]"


@query(f"""WITH RECURSIVE {_entries_sql(_SECTION[1])},
e AS (SELECT doc_id, unnest(entries) AS entry, generate_subscripts(entries, 1) AS k FROM split), d AS (SELECT doc_id, k, {DATA_SQL('entry')} AS ls FROM e),
f AS (SELECT *, {_SHORT(R.COMPANY_WORDS, _named_sql('x', _YEARS, 'T[0-9]{1,2}/[0-9]{4}\\s*[-–]\\s*T[0-9]{1,2}/[0-9]{4}'))} AS firms, {_SHORT(R.TITLE_WORDS, _named_sql('x', _YEARS))} AS titles, {_marks_sql(True)} AS marks FROM d),
g AS (SELECT *, {_AT('firms')} AS at_firm, {_AT('titles')} AS at_title, {FIRST('firms')} AS firm, {FIRST('titles')} AS title, {_named_sql('ls[1]', _YEARS)} AS top FROM f),
h AS (SELECT doc_id, k, title AS "startTitle", coalesce(firm, CASE WHEN length(top) > 2 THEN top END) AS employer, {START_SQL} AS "startDate", {END_SQL} AS "endDate",
 nullif(array_to_string(list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN {IS('ls[i]', R.BULLET)} THEN trim(regexp_replace(ls[i], '^[-•●○*+> ]+', '')) WHEN i > 2 AND i >= at_firm AND i >= at_title THEN ls[i] END), lambda v: v IS NOT NULL)[1:10], '; '), '') AS description FROM g)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS entry_no, "startTitle", employer, "startDate", "endDate", description FROM h WHERE employer IS NOT NULL OR "startTitle" IS NOT NULL""")
def tvf11_win2_jobs(spark, sf):
    e = lines.entries(_SECTION[0](spark, sf)).select("doc_id", F.posexplode_outer(parsers.jobs(c("entries"))).alias("entry_no", "m")).where("entry_no is not null")
    return e.select("doc_id", "entry_no", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("startTitle", "employer", "startDate", "endDate", "description")))


_STUDIES = customers(text=mixed_lines(K, 9, q("Bachelor of Science"), q("Hanoi University | 2010 - 2014"), q("Grade: Very good"), q(""), "concat('Thạc sĩ ', c_name)", q("3/2015"), q("- Master of bullets"), q("one two Master comes third"), q("one two three MBA comes fourth"), q("cu nhan truong Dai hoc 2001-2005"), q("T9/2016, excellent"), q("From *"), q("Degrees-PhD at the Institute 2018 - nay")))
_KEYWORD = rf"(?i)^(.*?)\b(?:{R.DEGREE_STARTS})\b"


@query(f"""WITH a AS (SELECT doc_id, {DATA_SQL('text')} AS all_ FROM {_STUDIES[1]}),
b AS (SELECT *, list_filter(range(1, len(all_) + 1), lambda i: i = 1 OR ({IS('all_[i]', _KEYWORD)} AND len(list_filter(regexp_split_to_array(trim(regexp_extract(all_[i], {q(_KEYWORD)}, 1)), '\\s+'), lambda w: w <> '')) <= 2 AND NOT {IS('all_[i]', R.BULLET)} AND length(all_[i]) < 100)) AS cuts FROM a),
d AS (SELECT doc_id, k, list_slice(all_, cuts[k], coalesce(cuts[k + 1], len(all_) + 1) - 1) AS ls FROM (SELECT *, unnest(range(1, len(cuts) + 1)) AS k FROM b)),
f AS (SELECT *, {_marks_sql(False)} AS marks FROM d),
g AS (SELECT doc_id, k, {FIRST(f"list_transform(ls, lambda x: {sql_first(FOLD_SQL('x'), R.DEGREES)})")} AS degree, {FIRST(f"list_transform(ls, lambda x: CASE WHEN {sql_holds(FOLD_SQL('x'), R.SCHOOL_WORDS)} THEN {_named_sql('x', '[0-9]{4}\\s*[-–]\\s*[0-9]{4}')} END)")} AS "otherSchool",
 {FIRST(f"list_transform(ls, lambda x: {sql_first(FOLD_SQL('x'), R.GRADES)})")} AS grade, {START_SQL} AS "startDate", {END_SQL} AS "endDate" FROM f)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS entry_no, degree, "otherSchool", grade, "startDate", "endDate" FROM g WHERE coalesce(degree, "otherSchool", grade, "startDate", "endDate") IS NOT NULL""")
def tvf9_rx10_schools(spark, sf):
    e = _STUDIES[0](spark, sf).select("doc_id", F.posexplode_outer(parsers.schools(c("text"))).alias("entry_no", "m")).where("entry_no is not null")
    return e.select("doc_id", "entry_no", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("degree", "otherSchool", "grade", "startDate", "endDate")))


# -- list sections ----------------------------------------------------------------------------------------------------
_PART = [q("English (Native)"), q("Spanish - B2"), q("Python"), q("english"), q("Tiếng Anh"), q(""), q("French: C1"), q("Reading"), q("123"), "c_mktsegment", q("Old Norse"), q("ENGLISH – C2")]
_INLINE = customers(value=mixed_lines(K, 6, *_PART).replace("chr(10)", pick(K, q(", "), q("; "), q(" | "), q(","))))


@query(f"""WITH p AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, trim(unnest(ps)) AS part FROM (SELECT doc_id, regexp_split_to_array(value, '[,;|]') AS ps FROM {_INLINE[1]})),
n AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, trim(regexp_extract(part, {q(R.INLINE_LANGUAGE)}, 1)) AS language, nullif(trim(concat(regexp_extract(part, {q(R.INLINE_LANGUAGE)}, 2), regexp_extract(part, {q(R.INLINE_LANGUAGE)}, 3))), '') AS remark FROM p)
SELECT * FROM n WHERE language <> '' AND lower(language) NOT IN ({sql_list([*R.NON_LANGUAGES, *R.PROGRAMMING])}) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(language) ORDER BY pos) = 1""")
def tvf7_rx9_inline(spark, sf):
    return parsers.inline_languages(_INLINE[0](spark, sf))


_LANGS = customers(text=mixed_lines(K, 6, q("English - Fluent"), q("French: thông thạo"), q("German | C1"), q("IELTS: 7.5"), q("4.5"), q("Mail a@b.org"), q("Russian"), q("Call +84 90"), q("Thai (good), Lao (basic)"), "concat('Khmer – ', c_mktsegment)", q("a name of a language that is too long to be one: native"), q("From *"), q("toeic 800 - advanced"), q(": good")))
_HEAD, _TAIL = "trim(regexp_extract(line, '^([^-:–|]*)[-:–|]', 1))", "trim(regexp_extract(line, '^[^-:–|]*[-:–|](.*)$', 1))"


@query(f"""WITH l AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, trim(unnest(ls)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {_LANGS[1]})),
u AS (SELECT *, regexp_matches(line, '[-:–|]') AS cut, {_HEAD} AS head, {_TAIL} AS tail, regexp_extract({FOLD_SQL('line')}, {q(R.TEST_SCORE)}, 1) AS test, regexp_extract({FOLD_SQL('line')}, {q(R.TEST_SCORE)}, 2) AS points FROM l
 WHERE {CLEAN_SQL('line')} AND NOT regexp_matches(replace(line, '.', ''), '^[0-9]+$') AND NOT contains(line, '@') AND NOT regexp_matches(line, '\\+[0-9]{{1,3}}\\s*\\(?[0-9]') AND NOT (regexp_matches(line, '[,|]') AND regexp_matches(line, '\\([^)]+\\)')) AND length(line) <= 80),
v AS (SELECT *, cut AND head <> '' AND length(head) < 30 AS named FROM u), w AS (SELECT *, CASE WHEN named THEN {sql_first(FOLD_SQL('tail'), R.PROFICIENCY)} END AS level FROM v)
SELECT doc_id, line_no, language, proficiency, remark FROM (SELECT doc_id, line_no, CASE WHEN test <> '' THEN upper(test) WHEN named THEN head WHEN NOT cut AND length(line) < 30 THEN line END AS language, level AS proficiency,
 CASE WHEN test <> '' THEN 'Score: ' || points WHEN named AND level IS NULL AND tail <> '' THEN tail END AS remark FROM w) WHERE language IS NOT NULL AND NOT {LABEL_SQL('language')}""")
def tvf12_rx11_language_lines(spark, sf):
    return parsers.language_lines(_LANGS[0](spark, sf))


_LIST = customers(text=mixed_lines(K, 6, q("Intro"), q("- AWS (2019)"), "concat('- ', c_name)", q("1. One thing"), q("2) Two (2020)"), q("- x"), q(""), q("• Point (1999) (2001)"), q("TRUE"), q("12. Twelve")))


def _listed_sql(share: float, numbered: bool, key: str) -> str:
    mark = r"^(\d{1,2}[.)]\s*|[-•●○*+>]\s*)" if numbered else "^[-•●○*+> ]+"
    m = IS("line", R.NUMBERED) if numbered else "false"
    return f"""WITH l AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, trim(unnest(ls)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {_LIST[1]})),
d AS (SELECT *, {IS('line', R.BULLET)} AS b, {m} AS m, count(*) OVER w AS n, count(*) FILTER ({IS('line', R.BULLET)}) OVER w AS bs, count(*) FILTER ({m}) OVER w AS ms FROM l WHERE {CLEAN_SQL('line')} WINDOW w AS (PARTITION BY doc_id)),
i AS (SELECT doc_id, line_no, trim(regexp_replace(line, {q(mark)}, '')) AS name FROM d WHERE CASE WHEN bs >= ms THEN b ELSE m END AND greatest(bs, ms) >= 2 AND greatest(bs, ms) >= n * {share}::double)
SELECT doc_id, line_no, name, nullif(regexp_extract(name, {q(R.PAREN_YEAR)}, 1), '') AS "{key}" FROM i WHERE length(name) > 2"""


@query(_listed_sql(0.5, True, "startDate"))
def tvf14_arr5_rx4_certificates(spark, sf):
    return parsers.listed(_LIST[0](spark, sf), 0.5, True, "startDate")


@query(_listed_sql(0.6, False, "issueDate"))
def tvf15_awards(spark, sf):
    return parsers.listed(_LIST[0](spark, sf), 0.6, False, "issueDate")


_SIMPLE = customers(entry_no="cast(0 as int)", entry=mixed_lines(K, 6, "c_name", q("The Institute"), q("T3/2019"), q("1/2/2018 and T4/2020"), q("a description that is over twenty"), q("Tuyển dụng 2020"), q("ab"), q(""), q("another long description of the course"), q("in 5/2011 to 6/2012")))


def _simple_sql(name: str, first: str, second: str) -> str:
    return f"""WITH a AS (SELECT doc_id, entry_no, {DATA_SQL('entry')} AS ls FROM {_SIMPLE[1]}), b AS (SELECT *, list_filter(list_transform(ls[2:], lambda x: regexp_extract_all(x, {q(re2(R.DATE))})), lambda d: len(d) > 0) AS ds, list_filter(ls[2:], lambda x: NOT {IS('x', R.DATE)}) AS o FROM a)
SELECT doc_id, entry_no, ls[1] AS {name}, ds[1][1] AS "{first}", list_filter(ds, lambda d: len(d) > 1)[1][2] AS "{second}", o[1] AS institution, list_filter(o[2:], lambda x: length(x) > 20)[1] AS description FROM b WHERE length(ls[1]) > 2 AND NOT contains(upper(ls[1]), 'TUYỂN DỤNG')"""


@query(_simple_sql("course", "endDate", "startDate"))
def tvf13_tvf16_courses(spark, sf):
    return parsers.simple_entries(_SIMPLE[0](spark, sf), "course", "endDate")


@query(_simple_sql("name", "startDate", "endDate"))
def tvf13_certificates(spark, sf):
    return parsers.simple_entries(_SIMPLE[0](spark, sf), "name", "startDate")


_FAMILY = customers(entry_no="cast(0 as int)", entry=mixed_lines(K, 6, "concat('Họ tên: ', c_name)", q("Quan hệ: Father"), q("Phone: 123"), q("Tel: 9:30"), q("Vị trí: Clerk"), q("none"), q("Name: Other"), q("Relationship: Mother"), q("From *"), q("Chức vụ:"), q("City: Hue")))
_KIND = "CASE " + " ".join(f"WHEN {sql_holds('low', words)} THEN '{k}'" for k, words in (("name", ["ten", "name", "ho ten"]), ("relationship", ["quan he", "relationship"]), ("contact", ["dien thoai", "phone", "tel", "contact"]), ("position", ["chuc vu", "position", "vi tri"]))) + " END"


@query(f"""WITH l AS (SELECT doc_id, entry_no, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM (SELECT doc_id, entry_no, {DATA_SQL('entry')} AS ls FROM {_FAMILY[1]})),
m AS (SELECT doc_id, entry_no, k, {_KIND} AS kind, trim(substr(line, strpos(line, ':') + 1)) AS v FROM (SELECT *, {FOLD_SQL("trim(split_part(line, ':', 1))")} AS low FROM l WHERE contains(line, ':')))
SELECT doc_id, entry_no, {', '.join(f"arg_max(v, k) FILTER (kind = '{k}') AS {k}" for k in ('name', 'relationship', 'contact', 'position'))} FROM m WHERE kind IS NOT NULL GROUP BY 1, 2""")
def tvf17_family(spark, sf):
    return parsers.family(_FAMILY[0](spark, sf))


# -- grids ------------------------------------------------------------------------------------------------------------
def _grid(frame: DataFrame, parse, keys: tuple[str, ...]) -> DataFrame:
    e = frame.select("doc_id", F.posexplode_outer(parse(c("text"))).alias("entry_no", "m")).where("entry_no is not null")
    return e.select("doc_id", "entry_no", *(F.try_element_at("m", F.lit(k)).alias(k) for k in keys))


def _grid_text(heads: list[str], n: int, *cells: str) -> str:
    body = [f"concat({pick(K, *map(q, heads))}, chr(10), {mixed_lines(K, k, *cells)})" for k in range(2, n + 1, 2)]
    return pick(f"cast(floor({K} / {len(heads)}) as int)", *body)


def _grid_sql(frame: str, heads: list[tuple[int, list[str]]], least: int, more: str = "true") -> str:
    """CTE r (doc_id, k, cell): for each row of a grid its cells by kind. heads: for each form of the headings their lines, and the kinds of the columns."""
    kinds = " ".join(f"WHEN {i} THEN [{sql_list(ks)}]" for i, (_, ks) in enumerate(heads))
    skip = " ".join(f"WHEN {i} THEN {n}" for i, (n, _) in enumerate(heads))
    keep = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: NOT {NOISE_SQL('x')})"
    return f"""WITH a AS (SELECT doc_id, {keep} AS ls, CASE id % {len(heads)} {kinds} END AS ks, CASE id % {len(heads)} {skip} END AS skip FROM {frame}),
d AS (SELECT doc_id, ks, ls[skip + 1:] AS ls FROM a WHERE len(ls) >= {least} AND len(ks) >= 3),
r AS (SELECT doc_id, k, map(ks, row_) AS cell FROM (SELECT doc_id, ks, k, ls[k * len(ks) + 1:(k + 1) * len(ks)] AS row_, ls FROM (SELECT *, unnest(range(CAST(len(ls) // len(ks) AS BIGINT))) AS k FROM d)) WHERE {more})"""


_SCHOOL_HEADS = [("Degree\nSchool:\nYear", 3, ["degree", "school", "year"]), ("University\nXếp loại", 2, ["degree", "school", "grade"]), ("a line\nDegree\nMajor\nSchool\nYear", 5, ["degree", "field", "school", "year"]), ("Year\nGPA", 2, ["year"])]
_SCHOOLS = customers(id=K, text=_grid_text([h for h, _, _ in _SCHOOL_HEADS], 10, q("BSc"), "c_name", q("2010 - 2014"), q("2016"), q(""), q("Good"), q("Page 1 of 2"), q("Uni of X")))


@query(f"""{_grid_sql(_SCHOOLS[1], [(n, ks) for _, n, ks in _SCHOOL_HEADS], 5)}
SELECT doc_id, CAST(k AS INTEGER) AS entry_no, cell['degree'] AS degree, cell['school'] AS "otherSchool", cell['field'] AS "otherMajor", CASE WHEN regexp_matches(cell['year'], '[0-9]{{4}}\\s*[-–—]\\s*[0-9]{{4}}') THEN regexp_extract(cell['year'], '([0-9]{{4}})\\s*[-–—]\\s*[0-9]{{4}}', 1) ELSE cell['year'] END AS "startDate",
 nullif(regexp_extract(cell['year'], '[0-9]{{4}}\\s*[-–—]\\s*([0-9]{{4}})', 1), '') AS "endDate", cell['grade'] AS grade FROM r""")
def tvf8_education_grid(spark, sf):
    return _grid(_SCHOOLS[0](spark, sf), grids.education_grid, ("degree", "otherSchool", "otherMajor", "startDate", "endDate", "grade"))


_JOB_HEADS = [("Position\nCompany\nFrom\nTo", 4, ["title", "company", "from", "to"]), ("Company\nPeriod", 2, ["title", "company", "period"]), ("Chức vụ\nCompany\nThời gian", 3, ["title", "company", "period"]), ("Position\nStart", 2, ["company", "title", "from"]), ("From\nTo", 2, ["from"])]
_POSTS = customers(id=K, text=_grid_text([h for h, _, _ in _JOB_HEADS], 10, q("Dev"), "c_name", q("2010"), q("Present"), q("3/2010 – 5/2012"), q("2010 - nay"), q(""), q("Beta"), q("2014"), q("Lead"), q("- did a thing")))


@query(f"""{_grid_sql(_POSTS[1], [(n, ks) for _, n, ks in _JOB_HEADS], 4, f"len(list_filter(ls[1:(k + 1) * len(ks)], lambda x: {IS('x', R.BULLET)})) = 0")},
p AS (SELECT *, regexp_extract(cell['period'], {q(R.PERIOD)}, ['a', 'b']) AS m FROM r)
SELECT doc_id, CAST(k AS INTEGER) AS entry_no, cell['title'] AS "startTitle", cell['company'] AS employer, coalesce(nullif(trim(m.a), ''), cell['from']) AS "startDate",
 CASE WHEN coalesce(nullif(trim(m.b), ''), cell['to']) IS NOT NULL AND lower(coalesce(nullif(trim(m.b), ''), cell['to'])) NOT IN ('present', 'nay', 'current') THEN coalesce(nullif(trim(m.b), ''), cell['to']) END AS "endDate" FROM p""")
def tvf10_experience_grid(spark, sf):
    return _grid(_POSTS[0](spark, sf), grids.experience_grid, ("startTitle", "employer", "startDate", "endDate"))


# -- names in large type, degrees among certificates ------------------------------------------------------------------
_NAMED = made("lineitem", doc_id="cast(l_orderkey as string)", block_no="cast(l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey as bigint)", page="cast(l_partkey % 2 as int)", y0="cast(l_partkey % 5 * 40 as double)", is_bold="l_returnflag = 'R'", font_size="cast(9 + l_suppkey % 8 as double)",
              text=pick("l_partkey", q("Tran Thi Mai"), q("Le Van A B"), q("Work Experience"), q("O"), f"concat('Nguyễn Văn An', {NL}, 'more')", q("a1 b2 c3"), q("Công ty X Y"), q(" John  Smith "), "concat('Le Van ', cast(l_partkey as string))", q("mail a@b.org now"), q("Anna Maria del Carmen y Ruiz Blanco")))


@query(f"""WITH b AS (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS line, font_size, is_bold, row_number() OVER (PARTITION BY doc_id ORDER BY font_size DESC, y0, block_no) AS r FROM {_NAMED[1]} WHERE page = 0)
SELECT doc_id, arg_min(line, r) AS name FROM b WHERE r <= 15 AND (font_size >= 13 OR is_bold AND font_size >= 11) AND {NAME_SQL('line')} GROUP BY doc_id""")
def lay5_srt2_prominent(spark, sf):
    return layout.prominent_name(_NAMED[0](spark, sf))


_RECOGNISED = customers(text=pick(K, "concat('I am ', c_name, '. Tran Thi Mai writes')", q("John Smith and Le Van An met Nguyen Binh"), q("Nobody is here"), f"concat(repeat('x', 790), ' Le Van An')", q("Pham Company Limited, Vo Thi Sau")))
_PERSON = r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"


@query(f"""WITH n AS (SELECT doc_id, list_filter(regexp_extract_all(left(text, 800), {q(_PERSON)}), lambda x: {NAME_SQL('x')} AND {FOLD_SQL("split_part(x, ' ', 1)")} IN ({sql_list(R.FAMILY_NAMES)}))[1] AS name FROM {_RECOGNISED[1]}) SELECT doc_id, name FROM n""")
def tvf19_recognised_name(spark, sf):
    """A recogniser by a pattern stands for a model."""
    return _RECOGNISED[0](spark, sf).select("doc_id", personal.recognised(c("text"), lambda t: F.regexp_extract_all(t, F.lit(_PERSON), F.lit(0))).alias("name"))


_DEGREE_NAMES = [q("B.A. Banking — Hanoi Academy (2009-2013)"), q("First aid"), q("Master of Law - RMIT University - Vietnam"), q("Engineer"), "concat('MBA - ', c_name)", q("Phd at work"), q("College of arts")]
_DEGREES = customers(k=K, a=pick(K, *_DEGREE_NAMES), b=pick(f"cast(floor({K} / 3) as int) + {K}", *_DEGREE_NAMES), d=pick(K, "cast(null as string)", q("a Bachelor course")), has=f"{K} % 5 = 0")
_LIKE = IS("concat_ws(' ', name, more)", R.DEGREE_WORDS)
_ACADEMY = f"trim(regexp_replace(list_filter(regexp_split_to_array(name, '\\s*[—–-]\\s*'), lambda x: {sql_holds('lower(x)', R.ACADEMIES)})[-1], '\\([0-9\\-–—]+\\)', '', 'g'))"


@query(f"""WITH e AS (SELECT doc_id, 'certificates' AS section, 0 AS entry_no, a AS name, d AS more, has FROM {_DEGREES[1]} UNION ALL SELECT doc_id, 'certificates', 1, b, NULL, has FROM {_DEGREES[1]} UNION ALL SELECT doc_id, 'education', 0, 'kept', NULL, has FROM {_DEGREES[1]} WHERE has),
l AS (SELECT *, NOT has AND section = 'certificates' AND {_LIKE} AS degree_like, nullif(regexp_extract(name, {q(R.DEGREE_WORDS)}, 1), '') AS g, {_ACADEMY} AS s FROM e),
m AS (SELECT *, degree_like AND (g IS NOT NULL OR s IS NOT NULL) AS moves FROM l), n AS (SELECT *, bool_or(moves) OVER (PARTITION BY doc_id) AS "any" FROM m)
SELECT doc_id, CASE WHEN moves THEN 'education' ELSE section END AS section, entry_no, CASE WHEN moves THEN g END AS degree, CASE WHEN moves THEN nullif(s, '') END AS "otherSchool", CASE WHEN NOT moves THEN name END AS name FROM n WHERE NOT "any" OR NOT degree_like OR moves""")
def set2_degrees(spark, sf):
    """A year range in brackets is cut at its dash with the rest of the name."""
    t = _DEGREES[0](spark, sf)
    keys = lambda name, more=None: F.map_filter(F.create_map(F.lit("name"), name, F.lit("description"), F.lit(None).cast("string") if more is None else more), lambda _, v: v.isNotNull())
    one = lambda s, n, k: F.struct(F.lit(s).alias("section"), F.lit(n).alias("entry_no"), k.alias("keys"))
    rows = F.array_compact(F.array(one("certificates", 0, keys(c("a"), c("d"))), one("certificates", 1, keys(c("b"))), F.when(c("has"), one("education", 0, keys(F.lit("kept"))))))
    return extract.move_degrees(t.select("doc_id", F.inline(rows))).select("doc_id", "section", "entry_no", *(F.try_element_at("keys", F.lit(k)).alias(k) for k in ("degree", "otherSchool", "name")))


# -- the whole extraction ---------------------------------------------------------------------------------------------
_CV = customers(k=K, name="c_name", phone=f"concat('+84 90', lpad({KEY}, 7, '0'))", title=pick(K, q("TRAN THI MAI"), q("Le Van An"), q("Work Experience"), q("Ms. Pham Hoa")), labelled=pick(f"cast(floor({K} / 4) as int)", "concat('Full name: Vo ', c_mktsegment)", q("no label"), q("Họ và tên: Nguyễn Văn An")),
                told=f"cast(floor({K} / 12) as int) % 2 = 0")


def _cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four blocks a customer: a large title, a name with or without a label, labelled lines, and running text with mail and number."""
    part = lambda k, text, size: F.struct(F.lit(k).cast("long").alias("block_no"), text.alias("text"), F.lit(size).alias("font_size"))
    lines_ = F.when(c("told"), F.concat(F.lit("Phone: "), "phone", F.lit("\nAddress: "), "name", F.lit(" | more"))).otherwise(F.concat(F.lit("Address:\n"), "name"))
    running = F.concat(F.lit("write to user"), "doc_id", F.lit("@mail.org or other@mail.org, id 1"), F.lpad("doc_id", 8, "7"))
    rows = F.array(part(0, c("title"), 16.0), part(1, c("labelled"), 10.0), part(2, lines_, 10.0), part(3, running, 10.0))
    y = c("block_no") * 30.0
    b = _CV[0](spark, sf_dir).select("doc_id", F.inline(rows))
    return b.withColumns({"page": F.lit(0), "x0": F.lit(20.0), "y0": y, "x1": F.lit(180.0), "y1": y + 12, "is_bold": c("font_size") > 12})


_CASED = "CASE WHEN f = upper(f) THEN array_to_string(list_transform(string_split(f, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') ELSE f END"
_BARE = "regexp_replace(trim(f), '(?i)^(Dr|Mr|Ms|Mrs|Prof|TS|ThS|PGS|GS)\\.?\\s+', '')"


@query(f"""WITH a AS (SELECT *, CASE WHEN labelled LIKE '%: %' THEN split_part(labelled, ': ', 2) WHEN {NAME_SQL('title')} THEN title END AS f FROM {_CV[1]}),
b AS (SELECT *, {_BARE.replace('f)', f'{_CASED})', 1)} AS n FROM a), w AS (SELECT *, string_split(n, ' ') AS ws, n IS NULL OR {NAME_SQL('n')} AS ok FROM b),
i AS (SELECT *, regexp_extract(concat('1', lpad(doc_id, 8, '7')), '^[1-9][0-9]{{8}}$') AS id_no FROM w)
SELECT doc_id, CASE WHEN ok THEN n END AS "fullName", CAST(NULL AS VARCHAR) AS "dateOfBirth", CASE WHEN told THEN phone END AS "cellPhone", concat('user', doc_id, '@mail.org') AS "primaryEmail", concat('user', doc_id, '@mail.org') AS "contactEmail", name AS address,
 CASE WHEN told THEN concat('90', lpad(doc_id, 7, '0')) ELSE id_no END AS "idCard", CAST(NULL AS VARCHAR) AS "idIssuePlace", CAST(NULL AS VARCHAR) AS "idIssueDt", CAST(NULL AS VARCHAR) AS zip, CASE WHEN ok AND n IS NOT NULL AND len(ws) > 2 THEN array_to_string(ws[2:len(ws) - 1], ' ') END AS "middleName",
 CASE WHEN ok AND n IS NOT NULL THEN ws[1] END AS "firstName", CASE WHEN ok AND n IS NOT NULL THEN ws[len(ws)] END AS "lastName" FROM i""")
def tvf21_personal_fields(spark, sf):
    return extract.personal_fields(_cv(spark, sf))


#: Sections in another order and choice for each row; the first of a kind that holds anything counts.
_EDU = [f"concat('Education', {NL}, 'Degree', {NL}, 'School', {NL}, 'Year', {NL}, 'BSc', {NL}, c_name, {NL}, '2010 - 2014', {NL}, 'AWS Certified', {NL}, 'Amazon', {NL}, '2020')", f"concat('Đào tạo', {NL}, 'Master of Arts', {NL}, c_name, ' University 2001-2003')", q("Skills")]
_LNG = [f"concat('Languages', {NL}, 'English: fluent', {NL}, 'Python', {NL}, 'english - B2')", f"concat('Languages', {NL}, 'Python')", q("Skills")]
_AWD = [f"concat('Awards', {NL}, '- First prize (2011)', {NL}, '- ', c_name)", f"concat('Awards', {NL}, c_name, {NL}, 'T3/2012')"]
_CRT = [f"concat('Certificates', {NL}, '- PMP (2019)', {NL}, '- CFA')", q("Skills"), f"concat('Certificates', {NL}, 'First aid', {NL}, '5/2011 - 6/2012')"]
_CV_LINES = customers(k=K, name="c_name", edu=f"cast({K} % 3 as int)", lng=f"cast(floor({K} / 3) as bigint) % 3", awd=f"cast(floor({K} / 9) as bigint) % 2", crt=f"cast(floor({K} / 18) as bigint) % 3", last=f"cast(floor({K} / 54) as bigint) % 2",
                      e=pick(K, *_EDU), l=pick(f"cast(floor({K} / 3) as bigint)", *_LNG), a=pick(f"cast(floor({K} / 9) as bigint)", *_AWD), r=pick(f"cast(floor({K} / 18) as bigint)", *_CRT))
_E = lambda section, n, where, **keys: f"SELECT doc_id, '{section}' AS section, {n} AS entry_no, " + ", ".join(f'CAST({keys.get(k, "NULL")} AS VARCHAR) AS "{k}"' for k in ("degree", "otherSchool", "language", "proficiency", "name", "institution", "startDate", "issueDate")) + f" FROM {_CV_LINES[1]} WHERE {where}"


@query(" UNION ALL ".join([
    _E("education", 0, "edu = 0", degree="'BSc'", otherSchool="name", startDate="'2010'"), _E("education", 0, "edu = 1", degree="'Master'", otherSchool="concat(name, ' University')", startDate="'2001'"),
    _E("languages", 0, "lng = 0", language="'English'", proficiency="'Fluent'"),
    _E("awards", 0, "awd = 0", name="'First prize (2011)'", issueDate="'2011'"), _E("awards", 1, "awd = 0", name="name"), _E("awards", 0, "awd = 1", name="name", issueDate="'T3/2012'"),
    # a certificate among the degrees comes first, unless a certificate section stands before the education
    _E("certificates", 0, "edu = 0 AND (crt = 1 OR last = 0)", name="'AWS Certified'", institution="'Amazon'", startDate="'2020'"),
    _E("certificates", 0, "crt = 0 AND NOT (edu = 0 AND last = 0)", name="'PMP (2019)'", startDate="'2019'"), _E("certificates", 1, "crt = 0 AND edu <> 0", name="'CFA'"),
    _E("certificates", 1, "crt = 0 AND edu = 0 AND last = 1", name="'CFA'"),
    _E("certificates", 0, "crt = 2 AND NOT (edu = 0 AND last = 0)", name="'First aid'", startDate="'5/2011'"),
    _E("certificates", 2, "crt = 0 AND edu = 0 AND last = 1", name="'AWS Certified'", institution="'Amazon'", startDate="'2020'"), _E("certificates", 1, "crt = 2 AND edu = 0 AND last = 1", name="'AWS Certified'", institution="'Amazon'", startDate="'2020'"),
]))
def tvf21_set3_win7_sections(spark, sf):
    t = _CV_LINES[0](spark, sf)
    text = F.when(c("last") == 0, F.concat_ws("\n", "e", "l", "a", "r")).otherwise(F.concat_ws("\n", "r", "a", "l", "e"))
    e = extract.section_entries(lines.explode_lines(t.select("doc_id", F.concat(F.lit("intro\n"), text).alias("text"))))
    return e.select("doc_id", "section", "entry_no", *(F.try_element_at("keys", F.lit(k)).alias(k) for k in ("degree", "otherSchool", "language", "proficiency", "name", "institution", "startDate", "issueDate")))


_SPOKEN = customers(pos="cast(0 as int)", k=K, label=pick(K, q("Languages"), q("Ngoại ngữ"), q("Skills"), q(" LANGUAGE ")), value=pick(f"cast(floor({K} / 4) as bigint)", q("English (Native), Spanish - B2"), q("Python"), "c_mktsegment"), later=pick(f"cast(floor({K} / 12) as bigint)", q("Lao"), q("")), sectioned=f"cast(floor({K} / 24) as bigint) % 2 = 1")


@query(f"""WITH a AS (SELECT *, {FOLD_SQL('trim(label)')} IN ({sql_list(R.LANGUAGE_KEYS)}) AS said FROM {_SPOKEN[1]}),
p AS (SELECT doc_id, sectioned, CASE WHEN said AND value <> 'Python' THEN value ELSE later END AS v FROM a),
w AS (SELECT doc_id, CASE WHEN sectioned THEN [{{'l': 'Thai', 'r': CAST(NULL AS VARCHAR)}}] WHEN v LIKE 'English%' THEN [{{'l': 'English', 'r': 'Native'}}, {{'l': 'Spanish', 'r': 'B2'}}] WHEN v <> '' THEN [{{'l': regexp_extract(v, '^[A-Za-z]+'), 'r': NULL}}] END AS ls FROM p WHERE sectioned OR v <> ''),
u AS (SELECT doc_id, unnest(range(len(ls))) AS n, ls FROM w)
SELECT doc_id, CAST(n AS INTEGER) AS entry_no, ls[n + 1].l AS language, ls[n + 1].r AS remark FROM u""")
def tvf7_languages_of_pairs(spark, sf):
    """Languages behind labels count where no section has any; the first label that yields some counts."""
    t = _SPOKEN[0](spark, sf)
    pair = lambda pos, label, value: F.struct(F.lit(pos).alias("pos"), label.alias("label"), value.alias("value"))
    pairs = t.select("doc_id", F.inline(F.array(pair(0, c("label"), c("value")), pair(1, F.lit("Foreign languages"), c("later")))))
    text = F.when(c("sectioned"), "Languages\nThai").otherwise("nothing")
    e = extract.section_entries(lines.explode_lines(t.select("doc_id", text.alias("text"))), pairs=pairs).where("section = 'languages'")
    return e.select("doc_id", "entry_no", *(F.try_element_at("keys", F.lit(k)).alias(k) for k in ("language", "remark")))
