"""Validation of record files against the field dictionary: one pass over each record, without a shuffle.

The dictionary is folded into a single row of arrays and maps, which is what every record is joined with; its size is that
of the dictionary, whatever the number of records. Records stay variants, so texts, numbers and objects are told apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivel.functions import rules as R
from scrivel.operators.records import split_schema

STATS = ["top_level_fields", "sections_present", "total_section_entries", "required_present", "required_total", "dates_valid", "dates_total", "picklists_resolved", "picklists_total", "unknown_fields", "unknown_section_keys"]
_NONE = "cast(array() as array<string>)"


def _object(v: Column) -> Column:
    """The members of a JSON object, null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _is_date(v: Column) -> Column:
    return F.coalesce(_is_text(v) & _text(v).rlike(R.VALID_DATE), F.lit(False))


def _is_picked(v: Column) -> Column:
    digits = _is_text(v) & _text(v).rlike(r"^\p{Nd}+$")
    return F.coalesce(digits, F.lit(False)) | F.coalesce(F.map_contains_key(_object(v), "id"), F.lit(False))


def _is_filled(v: Column) -> Column:
    """Neither absent, null, false, zero nor empty."""
    return F.coalesce(~_text(v).isin("", "false", "0", "[]", "{}"), F.lit(False))


def _dictionary(field_defs: DataFrame) -> DataFrame:
    """One row: ids at the top level by kind, and for each section its keys by kind."""
    d = split_schema(field_defs)
    coded = (F.col("field_type") == "Picklist") & F.col("picklist_id").isNotNull()
    of = lambda when, name: F.array_sort(F.collect_set(F.when(when, F.col(name))))
    top = F.col("section").isNull()
    row = d.agg(of(top, "field_id").alias("ids"), of(top & F.col("required"), "field_id").alias("needed"), of(top & (F.col("field_type") == "DateTime"), "field_id").alias("dates"), of(top & coded, "field_id").alias("coded"))
    by = d.where("section is not null").groupBy("section").agg(of(F.lit(True), "nested_key").alias("keys"), of(F.col("field_type") == "DateTime", "nested_key").alias("dates"), of(coded, "nested_key").alias("coded"))
    need = F.create_map(*(x for s, ks in R.REQUIRED_KEYS.items() for x in (F.lit(s), F.array(*map(F.lit, ks)))))
    sections = by.select(F.struct("section", "keys", "dates", "coded", F.coalesce(need[F.col("section")], F.expr(_NONE)).alias("needed")).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("sections"))
    return row.withColumn("sections", F.coalesce(sections.scalar(), F.expr("cast(array() as array<struct<section:string,keys:array<string>,dates:array<string>,coded:array<string>,needed:array<string>>>)")))


def validate(records: DataFrame, field_defs: DataFrame) -> DataFrame:
    """VAL1 to VAL15, JOIN10, JOIN11, SET6: records (file, record: JSON text) to file, valid, issues (sorted) and stats.

    field_defs: field_id, field_type, picklist_id, required. A null record counts as one that can't be read. Values other
    than texts are shown as JSON in issues. A repeated file gives a row each; no records give no rows.
    """
    c = F.col
    v = F.try_parse_json("record")
    first = F.try_variant_get(v, "$[0]", "variant")
    read = records.select("file", v.alias("v"), F.coalesce(_object(first), F.expr("cast(map() as map<string,variant>)")).alias("m"), first.isNotNull().alias("any"), _object(first).isNotNull().alias("ok"), F.schema_of_variant(v).startswith("ARRAY").alias("is_array"))
    # the dictionary is one value: a scalar subquery, no join
    rows = read.withColumn("d", _dictionary(field_defs).select(F.struct("*").alias("d")).scalar()).select("*", "d.*").drop("d")
    has_results = lambda x: F.coalesce(F.map_contains_key(_object(x), "results"), F.lit(False))
    members = lambda m: F.filter(F.map_entries(m), lambda e: e["key"] != "__metadata")
    of = lambda name: F.filter(c("top"), lambda e: F.array_contains(c(name), e["key"]))

    # entries of the sections that are there: (section, place, members, by kind)
    found = F.filter("sections", lambda s: F.map_contains_key(c("m"), s["section"]))
    inner = lambda s: F.try_variant_get(F.try_element_at("m", s["section"]), "$.results", "array<variant>")
    rows = rows.withColumns({"top": members(c("m")), "found": F.transform(found, lambda s: F.struct(s.alias("s"), has_results(F.try_element_at("m", s["section"])).alias("shaped"), F.coalesce(inner(s), F.expr("cast(array() as array<variant>)")).alias("entries")))})
    numbered = lambda f: F.transform(f["entries"], lambda e, i: F.struct(f["s"].alias("s"), F.concat(f["s"]["section"], F.lit("["), i.cast("string"), F.lit("]")).alias("at"), _object(e).alias("m")))
    rows = rows.withColumn("entries", F.flatten(F.transform("found", numbered)))
    cells = lambda e: F.transform(F.map_entries(e["m"]), lambda kv: F.struct(e["s"].alias("s"), e["at"].alias("at"), kv["key"].alias("key"), kv["value"].alias("value")))
    rows = rows.withColumn("cells", F.flatten(F.transform(F.filter("entries", lambda e: e["m"].isNotNull()), cells)))
    day, code = F.filter("cells", lambda x: F.array_contains(x["s"]["dates"], x["key"])), F.filter("cells", lambda x: F.array_contains(x["s"]["coded"], x["key"]))
    odd = F.array_sort(F.filter("top", lambda e: ~has_results(e["value"]) & ~F.array_contains(c("ids"), e["key"]))["key"])
    strange = F.array_sort(F.transform(F.filter("cells", lambda x: ~F.array_contains(x["s"]["keys"], x["key"])), lambda x: F.concat_ws(".", x["s"]["section"], x["key"])))
    rows = rows.withColumns({"day": day, "code": code, "top_days": of("dates"), "top_codes": of("coded"), "unknown_fields": odd, "unknown_section_keys": strange})

    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    wrong = lambda items, good, text: F.transform(F.filter(items, lambda e: ~good(e["value"])), text)
    value = lambda e: F.coalesce(_text(e["value"]), F.lit("null"))
    field = lambda name: F.coalesce(_text(F.try_element_at("m", F.lit(name))), F.lit(""))
    if_ = lambda when, text: F.when(F.coalesce(when, F.lit(False)), F.array(text)).otherwise(F.expr(_NONE))
    shaped = lambda names, pattern, text: F.transform(F.filter("top", lambda e: e["key"].isin(*names) & ~value(e).rlike(pattern)), lambda e: say(text, " for '", e["key"], "': ", value(e)))
    lacking = lambda e: F.transform(F.filter(e["s"]["needed"], lambda k: ~_is_filled(F.try_element_at(e["m"], k))), lambda k: say(e["at"], ": missing key '", k, "'"))
    names = F.filter("top", lambda e: e["key"].isin("firstName", "lastName") & value(e).rlike(r"[@\p{Nd}]"))
    inside = F.concat(
        if_(F.size("unknown_fields") > 0, say("Unknown top-level fields: ", F.array_join("unknown_fields", ", "))),
        F.transform(F.array_except("needed", F.map_keys("m")), lambda k: say("Missing required field: ", k)),
        wrong("top_days", _is_date, lambda e: say("Invalid date format for '", e["key"], "': ", value(e))),
        wrong("top_codes", _is_picked, lambda e: say("Picklist not resolved for '", e["key"], "': ", value(e))),
        shaped(("primaryEmail", "contactEmail"), R.VALID_EMAIL, "Invalid email format"),
        shaped(("cellPhone", "homePhone"), R.VALID_PHONE, "Suspicious phone format"),
        F.transform(F.filter("found", lambda f: ~f["shaped"]), lambda f: say("Section '", f["s"]["section"], "' has wrong structure")),
        F.transform(F.filter("found", lambda f: f["shaped"] & (F.size(f["entries"]) == 0)), lambda f: say("Section '", f["s"]["section"], "' has empty results")),
        F.transform(F.filter("entries", lambda e: e["m"].isNull()), lambda e: say(e["at"], ": not a dict")),
        F.flatten(F.transform(F.filter("entries", lambda e: e["m"].isNotNull()), lacking)),
        wrong("day", _is_date, lambda e: say(e["at"], ".", e["key"], ": invalid date '", value(e), "'")),
        wrong("code", _is_picked, lambda e: say(e["at"], ".", e["key"], ": picklist not resolved '", value(e), "'")),
        if_(F.size("unknown_section_keys") > 0, say("Unknown section keys: ", F.array_join("unknown_section_keys", ", "))),
        if_((field("firstName") != "") & (field("firstName") == field("lastName")), say("firstName == lastName ('", field("firstName"), "'), likely extraction error")),
        F.transform(names, lambda e: say("'", e["key"], "' contains suspicious chars: ", value(e))),
    )
    issues = F.when(c("v").isNull(), F.array(F.lit("Cannot read file"))).when(~c("is_array") | ~c("any"), F.array(F.lit("Expected non-empty JSON array"))).when(~c("ok"), F.array(F.lit("First element is not a JSON object"))).otherwise(F.array_sort(inside))
    good = lambda *lists: reduce(lambda a, b: a + b, (F.size(F.filter(x, lambda e: f(e["value"]))) for x, f in lists))
    full = F.filter("found", lambda f: F.size(f["entries"]) > 0)
    numbers = {
        "top_level_fields": F.size(F.filter("top", lambda e: ~has_results(e["value"]) & F.array_contains(c("ids"), e["key"]))),
        "sections_present": F.transform(full, lambda f: f["s"]["section"]),
        "total_section_entries": F.size("entries"),
        "required_present": F.size(F.array_intersect("needed", F.map_keys("m"))),
        "required_total": F.size("needed"),
        "dates_valid": good(("top_days", _is_date), ("day", _is_date)),
        "dates_total": F.size("top_days") + F.size("day"),
        "picklists_resolved": good(("top_codes", _is_picked), ("code", _is_picked)),
        "picklists_total": F.size("top_codes") + F.size("code"),
        "unknown_fields": c("unknown_fields"),
        "unknown_section_keys": c("unknown_section_keys"),
    }
    out = rows.select("file", issues.alias("issues"), F.struct(*(numbers[n].alias(n) for n in STATS)).alias("stats"))
    return out.select("file", (F.size("issues") == 0).alias("valid"), "issues", "stats")


def totals(reports: DataFrame) -> DataFrame:
    """AGG7, SNK3: files, passed, failed, means and rates in percent over validation reports; without required fields the fill rate is null."""
    n, s = F.greatest(F.count("*"), F.lit(1)), lambda name: F.coalesce(F.sum(f"stats.{name}"), F.lit(0))
    rate = lambda a, b: F.round(s(a) / F.greatest(s(b), F.lit(1)) * 100, 1)
    return reports.agg(
        F.count("*").alias("total_files"), F.count_if("valid").alias("passed"), F.count_if(~F.col("valid")).alias("failed"),
        F.round(s("top_level_fields") / n, 1).alias("avg_top_level_fields"), F.round(s("total_section_entries") / n, 1).alias("avg_section_entries"),
        s("dates_total").alias("total_dates"), s("dates_valid").alias("valid_dates"), rate("dates_valid", "dates_total").alias("date_rate"),
        s("picklists_total").alias("total_picklists"), s("picklists_resolved").alias("resolved_picklists"), rate("picklists_resolved", "picklists_total").alias("picklist_rate"),
        F.round(s("required_present") / F.nullif(s("required_total"), F.lit(0)) * 100, 1).alias("required_fill_rate"),
    )
