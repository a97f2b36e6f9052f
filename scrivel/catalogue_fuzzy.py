"""Queries of the fuzzy join over labels and texts of unlike lengths, with the weighted ratio written out in SQL; of the name tagger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.operators import fuzzy_join, matching, personal, tagger
from scrivel.plans.inputs import made, pick, q
from scrivel.plans.registry import query

_WORDS = ["Hanoi", "Bach Khoa", "Technology", "of", "Economics", "Ngoại thương", "Sư phạm", "Law", "Y", "Science and", "Đà Nẵng"]
_word = lambda key: pick(key, *map(q, _WORDS))
#: 25 labels of one to four words from the nations.
_NAMES = made("nation", picklist_id="'school'", ordinal="cast(n_nationkey as int)", external_code="concat('S-', cast(n_nationkey as string))", label_vi=f"concat({_word('n_nationkey * 3')}, ' ', {_word('n_nationkey + 4')})",
              label_en=pick("n_nationkey", f"concat({_word('n_nationkey')}, ' University')", f"concat('University of ', {_word('n_nationkey + 1')}, ' ', {_word('n_nationkey + 5')}, ' ', {_word('n_nationkey + 2')})", _word("n_nationkey + 7"), f"concat({_word('n_nationkey')}, ' ', {_word('n_nationkey + 3')})"),
              option_id="cast(100 + n_nationkey as string)", status="CASE WHEN n_nationkey = 7 THEN 'I' ELSE 'A' END")
#: Texts from the customers: pieces of labels, words in another order, misspelt ones, far longer ones.
_ASKED = made("customer", id="c_custkey", picklist_id="'school'", text=pick("c_custkey", f"concat({_word('c_custkey')}, ' Univ')", f"concat({_word('c_custkey + 2')}, ' University of ', {_word('c_custkey + 1')})", f"replace({_word('c_custkey')}, 'o', '0')", f"concat('The school of ', {_word('c_custkey')}, ', ', {_word('c_custkey + 3')}, ', Vietnam, 2012 to 2016, with honours')", f"left({_word('c_custkey')}, 4)",
                                                                          f"concat('  ', {_word('c_custkey + 3')}, ' ', {_word('c_custkey')}, ' ', {_word('c_custkey + 3')})", "concat('zz ', cast(c_custkey % 40 as string))", f"upper({_word('c_custkey')})", "cast(null as string)", f"concat('S-', cast(c_custkey % 30 as string), 'x')"))


def _lcs(a: str, b: str) -> str:
    """The longest common subsequence of a (up to 62 letters) and b: one bit a letter of a, one step a letter of b."""
    full = f"((CAST(1 AS BIGINT) << CAST(length({a}) AS INTEGER)) - 1)"
    mask = f"list_sum(list_transform(range(CAST(length({a}) AS BIGINT)), lambda i: CASE WHEN substr({a}, i + 1, 1) = substr({b}, j + 1, 1) THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END))"
    steps = f"list_transform(range(CAST(length({b}) AS BIGINT)), lambda j: CAST({mask} AS BIGINT))"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {steps}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})))"


def _sorted(x: str, distinct: bool = False) -> str:
    words = f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    return f"array_to_string(list_sort({f'list_distinct({words})' if distinct else words}), ' ')"


_INDEL = lambda a, b: f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN CASE WHEN {a} = {b} THEN 100.0::double ELSE 0.0::double END ELSE 200.0::double * CASE WHEN length({a}) <= length({b}) THEN {_lcs(a, b)} ELSE {_lcs(b, a)} END / (length({a}) + length({b})) END)"
#: parts has (id, kind, s, l): the shorter and the longer text of a comparison by pieces.
_SCORES = f"""t AS (SELECT DISTINCT text FROM {_ASKED[1]} WHERE text IS NOT NULL),
n AS (SELECT name, min(ordinal) AS ordinal FROM (SELECT ordinal, unnest([label_en, label_vi, external_code]) AS name FROM {_NAMES[1]} WHERE status = 'A') GROUP BY 1),
p AS (SELECT row_number() OVER () AS id, text, name, ordinal, {_sorted('text')} AS ta, {_sorted('name')} AS na, list_distinct(list_filter(string_split(text, ' '), lambda w: w <> '')) AS tw, list_distinct(list_filter(string_split(name, ' '), lambda w: w <> '')) AS nw,
 greatest(length(text), length(name)) / least(length(text), length(name)) AS r FROM t, n),
w AS (SELECT *, list_filter(tw, lambda w: list_contains(nw, w)) AS both_, array_to_string(list_sort(list_filter(tw, lambda w: NOT list_contains(nw, w))), ' ') AS x, array_to_string(list_sort(list_filter(nw, lambda w: NOT list_contains(tw, w))), ' ') AS y FROM p),
v AS (SELECT *, array_to_string(list_sort(both_), ' ') AS b FROM w),
u AS (SELECT *, trim(b || ' ' || x) AS lx, trim(b || ' ' || y) AS ly FROM v),
parts AS (SELECT id, kind, CASE WHEN length(a) <= length(c) THEN a ELSE c END AS short, CASE WHEN length(a) <= length(c) THEN c ELSE a END AS l FROM
 (SELECT id, 0 AS kind, text AS a, name AS c FROM u WHERE r >= 1.5 UNION ALL SELECT id, 1, ta, na FROM u WHERE r >= 1.5 UNION ALL SELECT id, 2, x, y FROM u WHERE r >= 1.5 AND len(both_) = 0)),
cut AS (SELECT DISTINCT id, kind, short, substr(l, greatest(k, 0) + 1, length(short) + least(k, 0)) AS piece FROM parts, LATERAL (SELECT unnest(range(1 - length(short), length(l))) AS k)),
best AS (SELECT id, kind, max(200.0::double * {_lcs('short', 'piece')} / (length(short) + length(piece))) AS of FROM cut WHERE length(piece) > 0 GROUP BY 1, 2),
b3 AS (SELECT id, max(of) FILTER (kind = 0) AS whole, max(of) FILTER (kind = 1) AS ordered, max(of) FILTER (kind = 2) AS rest FROM best GROUP BY 1),
scored AS (SELECT text, name, ordinal, CASE WHEN r < 1.5 THEN greatest({_INDEL('text', 'name')}, 0.95::double * {_INDEL('ta', 'na')}, 0.95::double * CASE WHEN len(both_) > 0 AND (x = '' OR y = '') THEN 100 ELSE greatest({_INDEL('lx', 'ly')}, CASE WHEN len(both_) > 0 THEN greatest({_INDEL('b', 'lx')}, {_INDEL('b', 'ly')}) ELSE 0 END) END)
 ELSE greatest({_INDEL('text', 'name')}, CASE WHEN r <= 8 THEN 0.9::double ELSE 0.6::double END * greatest(coalesce(whole, 0), 0.95::double * coalesce(ordered, 0), 0.95::double * CASE WHEN len(both_) > 0 THEN 100 ELSE coalesce(rest, 0) END)) END AS score FROM u LEFT JOIN b3 USING (id))"""


@query(f"WITH {_SCORES} SELECT 'school' AS picklist_id, text, name, round(score, 6) AS score FROM scored WHERE score >= 70 - 1e-9")
def join6_mth5_similar(spark, sf):
    """All pairs of a text and a label that reach the floor, labels shorter and longer than the texts."""
    names = _NAMES[0](spark, sf).where("status = 'A'").select("picklist_id", F.explode(F.array("label_en", "label_vi", "external_code")).alias("name"))
    return fuzzy_join.similar(_ASKED[0](spark, sf), names).withColumn("score", F.round("score", 6))


@query(f"""WITH {_SCORES}, i AS (SELECT key, arg_max(option_id, ordinal) AS opt FROM (SELECT ordinal, option_id, unnest([lower(label_en), lower(label_vi), lower(external_code), lower(strip_accents(label_en)), lower(strip_accents(label_vi))]) AS key FROM {_NAMES[1]} WHERE status = 'A') GROUP BY 1),
e AS (SELECT text, coalesce(a.opt, b.opt) AS opt FROM t LEFT JOIN i a ON a.key = trim(lower(text)) LEFT JOIN i b ON b.key = trim(lower(strip_accents(text)))),
top AS (SELECT text, name FROM scored WHERE score >= 70 - 1e-9 QUALIFY row_number() OVER (PARTITION BY text ORDER BY round(score, 9) DESC, ordinal, name DESC) = 1)
SELECT id, picklist_id, a.text, coalesce(e.opt, i.opt) AS option_id, CASE WHEN e.opt IS NOT NULL THEN 'exact' WHEN i.opt IS NOT NULL THEN 'fuzzy' END AS how FROM {_ASKED[1]} a LEFT JOIN e ON e.text = a.text LEFT JOIN top ON top.text = a.text LEFT JOIN i ON i.key = lower(name)""")
def join6_join7_unlike_lengths(spark, sf):
    """Picklist values for texts of all lengths: exact, then the best label that reaches the floor."""
    return matching.match_picklist(_ASKED[0](spark, sf), _NAMES[0](spark, sf))


# -- names by a trained tagger ----------------------------------------------------------------------------------------
_PEOPLE = made("customer", id="c_custkey", family=pick("c_custkey", *map(q, ["Nguyễn", "Trần", "Lê", "Phạm", "Hoàng", "Vũ", "Đặng", "Bùi", "Do", "Ngo"])), middle=pick("cast(floor(c_custkey / 10) as bigint)", *map(q, ["Văn", "Thị", "Minh", "", "Quốc", "Hữu"])), given=pick("cast(floor(c_custkey / 3) as bigint) + c_custkey", *map(q, ["An", "Bình", "Hoa", "Dũng", "Lan", "Khánh", "Sơn", "Thảo", "Việt", "Yến", "Long", "Mai", "Hà"])),
               before=pick("cast(floor(c_custkey / 7) as bigint)", *map(q, ["", "My name is", "Curriculum vitae of", "Reference : Mr", "At Hoang Long Bank , Ha Noi ,", "Since 2012 Ms", "Work experience at Le Loi Street , Da Nang"])), after=pick("cast(floor(c_custkey / 11) as bigint)", *map(q, ["has worked at Vietnam Airlines since 2012 .", "and I live in Ha Noi .", ", Director of Sales", "Born in 1990 in Hue", "Phone : 0901 234 567"])))


def name_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, words, tags, name: sentences with one name or none, and which words it is."""
    c, split = F.col, lambda k: F.filter(F.split(k, " "), lambda x: x != "")
    name = F.when(~c("before").startswith("Work"), F.concat_ws(" ", "family", F.nullif("middle", F.lit("")), "given"))
    rows = _PEOPLE[0](spark, sf_dir).withColumn("name", name)
    own = F.coalesce(split("name"), F.array().cast("array<string>"))
    out = lambda k: F.transform(split(k), lambda _: F.lit("O"))
    words, marks = F.concat(split("before"), own, split("after")), F.concat(out("before"), F.transform(own, lambda _, i: F.when(i == 0, "B").otherwise("I")), out("after"))
    return rows.select("id", F.array_join(words, " ").alias("text"), words.alias("words"), marks.alias("tags"), "name")


@query()
def tvf19_trained_names(spark, sf):
    """Names found in the sentences that the tagger was not trained on, beside the names that are in them."""
    made_ = name_sentences(spark, sf)
    model = tagger.train(made_.where("id % 3 <> 0"))
    found = personal.recognised(F.col("text"), tagger.recognise)
    return tagger.with_model(made_.where("id % 3 = 0"), model).select("id", "text", "name", found.alias("found"))
