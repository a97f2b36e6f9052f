"""Labels to fields and free text to coded values: exact, abbreviation, then fuzzy on what is left.

Null and blank labels match nothing. Ties go to the earlier alias or value, places to the smaller pos; pairs of one place to the smaller
value. Repeated rows match alike, empty tables give no rows, further columns stay.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivel.functions import rules as R
from scrivel.functions.text import bound, fold, label, strip
from scrivel.operators import fuzzy_join
from scrivel.streaming.shared import prepare, spread, written

FUZZY_FLOOR = 70.0


def normal(text: str) -> str:
    """What functions.text.label does, for dictionary entries."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isascii() and (c.isalnum() or c.isspace()) else " " for c in bare).split())


def _aliases() -> list[tuple[str, str, int]]:
    seen: dict[str, list] = {}
    for field, names in [*R.LABEL_ALIASES.items(), *(("_section_" + k, v) for k, v in R.SECTION_ALIASES.items())]:
        for name in names:
            seen.setdefault(normal(name), [field, len(seen)])[0] = field
    return [(a, f, k) for a, (f, k) in seen.items()]


def aliases(spark: SparkSession) -> DataFrame:
    """MAP2: alias, field, ordinal; of an alias that occurs twice the last field and the first place count. A few hundred rows."""
    return spark.createDataFrame(_aliases(), "alias string, field string, ordinal int")


def _alias_list(spark: SparkSession) -> list[tuple[str, str]]:
    """(alias, field) of the personal fields, in the order that breaks ties."""
    return [(a, f) for a, f, _ in sorted(_aliases(), key=lambda x: x[2]) if not f.startswith("_section")]


def _exact(spark: SparkSession, norm: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in _alias_list(spark) for x in pair)), norm)


def _fuzzy(spark: SparkSession, norm: Column) -> Column:
    """struct<score, field> of the best alias over 0.5, else null. The dictionary is fixed and small, so it is an array literal: no join."""
    names = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(f).alias("f"), F.array(*map(F.lit, dict.fromkeys(a.split()))).alias("w")) for a, f in _alias_list(spark)))

    def of(norm: Column, words: Column) -> Column:
        def score(x: Column) -> Column:
            inside = F.when(norm.contains(x["a"]) | x["a"].contains(norm), F.length(x["a"]) / F.greatest(F.length(norm), F.lit(1)))
            subset = F.when(F.size(F.array_except(x["w"], words)) == 0, F.size(x["w"]) / F.greatest(F.size(words), F.lit(1)))
            return F.struct(F.greatest(F.coalesce(inside, F.lit(0.0)), F.coalesce(subset, F.lit(0.0))).cast("double").alias("score"), x["f"].alias("field"))

        none = F.struct(F.lit(0.5).cast("double").alias("score"), F.lit(None).cast("string").alias("field"))
        return F.aggregate(F.transform(names, score), none, lambda best, x: F.when(x["score"] > best["score"], x).otherwise(best))

    best = bound(norm, lambda n: bound(F.array_distinct(F.split(n, " ")), lambda words: of(n, words)))
    return F.when(norm != "", best)


def exact_fields(labels: DataFrame) -> DataFrame:
    """JOIN1: rows with a column label get field where the label is an alias (sections aside), confidence 1."""
    return labels.withColumn("field", _exact(labels.sparkSession, label(F.col("label")))).where("field is not null").withColumn("confidence", F.lit(1.0))


def fuzzy_candidates(labels: DataFrame) -> DataFrame:
    """JOIN2: each label with its best alias by containment or by word subset; score over 0.5, ties to the earlier alias. Each distinct label is matched once."""
    asked = spread(labels.select("label").where("label is not null").distinct())
    found = asked.select("label", _fuzzy(labels.sparkSession, label(F.col("label"))).alias("_best")).where("_best.field is not null")
    found = found.select("label", F.col("_best.field").alias("field"), F.col("_best.score").alias("confidence"))
    return labels.join(found, "label").select(*labels.columns, "field", "confidence")


def assign_fields(pairs: DataFrame) -> DataFrame:
    """JOIN3: doc_id, field, value, confidence from (doc_id, pos, label, value): pairs in order, a field goes to the first; an exact label whose
    field is taken falls through to its fuzzy field. A fold over the pairs of one document. Each distinct label is matched once."""
    spark = pairs.sparkSession
    labels = pairs.select("label").distinct().withColumn("norm", label(F.col("label")))
    labels = labels.select("label", _exact(spark, F.col("norm")).alias("exact"), _fuzzy(spark, F.col("norm")).alias("best"))
    labels = labels.select("label", "exact", F.col("best.field").alias("fuzzy"), F.col("best.score").alias("score")).where("exact is not null or fuzzy is not null")
    listed = pairs.join(labels, "label").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value", "exact", "fuzzy", "score"))).alias("p"))
    empty = F.array().cast("array<struct<field:string,value:string,confidence:double>>")

    def step(out: Column, x: Column) -> Column:
        free = lambda f: f.isNotNull() & ~F.exists(out, lambda y: y["field"] == f)
        put = lambda f, c: F.concat(out, F.array(F.struct(f.alias("field"), x["value"].alias("value"), c.cast("double").alias("confidence"))))
        return F.when(free(x["exact"]), put(x["exact"], F.lit(1.0))).when(free(x["fuzzy"]), put(x["fuzzy"], x["score"])).otherwise(out)

    return listed.select("doc_id", F.explode(F.aggregate("p", empty, step)).alias("f")).select("doc_id", "f.*")


def picklist_index(values: DataFrame) -> DataFrame:
    """JOIN4: picklist_id, key, option_id, label: active values by lower and folded English, local and external names; later rows overwrite."""
    low = lambda c: strip(F.lower(c))
    active = values.where("status = 'A'")  # FLT6
    names = F.array(*(f(F.col(c)) for c in ("label_en", "label_vi", "external_code") for f in (low, lambda c: strip(fold(c)))))
    keyed = active.select("picklist_id", "ordinal", "option_id", F.explode(names).alias("key")).where("key is not null and key not in ('', 'nodata')")
    return keyed.groupBy("picklist_id", "key").agg(F.max_by("option_id", "ordinal").alias("option_id"))


def match_picklist(rows: DataFrame, values: DataFrame, fuzzy: bool = True) -> DataFrame:
    """JOIN4 to JOIN7: rows (picklist_id, text, ...) get option_id and how ('exact', 'abbreviation', 'fuzzy', null).

    Each distinct text is looked up once, under all its forms in one join: as it is and folded, then the expansions of both as
    abbreviations. Of a form the first expansion that the picklist has counts, of the forms the first that gives an option.
    Fuzzy scores are worked out for what nothing cheaper matched, against those labels of the text's own picklist that can reach the floor
    (`fuzzy_join`); ties of a score go to the earlier value, then to the greater label. Null texts
    match nothing; repeated rows match alike; the size of the dictionary is checked by Spark before it broadcasts it.
    """
    spark, c = prepare(rows.sparkSession), F.col
    index = picklist_index(values).select("picklist_id", "key", F.nullif("option_id", F.lit("")).alias("opt"))
    longer = F.create_map(*(x for a, xs in R.ABBREVIATIONS.items() for x in (F.lit(a), F.array(*map(F.lit, xs)))))
    forms = F.array(strip(F.lower("text")), strip(fold(c("text"))))
    plain = F.transform("forms", lambda x, k: F.struct(k.alias("form"), F.lit(0).alias("place"), x.alias("key")))
    expanded = F.flatten(F.transform("forms", lambda x, k: F.transform(F.coalesce(F.try_element_at(longer, x), F.expr("cast(array() as array<string>)")), lambda y, n: F.struct((k + 2).alias("form"), n.alias("place"), y.alias("key")))))
    texts = rows.select("picklist_id", "text").where("text is not null").distinct()
    asked = texts.withColumn("forms", forms).select("picklist_id", "text", F.inline(F.concat(plain, expanded)))
    hits = asked.join(index, ["picklist_id", "key"]).groupBy("picklist_id", "text", "form").agg(F.min_by("opt", "place").alias("opt"))
    best = hits.where("opt is not null").groupBy("picklist_id", "text").agg(F.min(F.struct("form", "opt")).alias("b"))
    found = best.select("picklist_id", "text", c("b.opt").alias("option_id"), F.when(c("b.form") < 2, "exact").otherwise("abbreviation").alias("how"))
    if fuzzy:
        found = written(found, "matched")
        labels = values.where("status = 'A'").select("picklist_id", "ordinal", F.explode(F.array("label_en", "label_vi", "external_code")).alias("name"))
        labels = labels.where("name != '' and lower(name) != 'nodata'").groupBy("picklist_id", "name").agg(F.min("ordinal").alias("ordinal"))
        rest = texts.join(found, ["picklist_id", "text"], "left_anti")
        scored = fuzzy_join.similar(rest, labels, FUZZY_FLOOR).join(labels, ["picklist_id", "name"])
        near = scored.groupBy("picklist_id", "text").agg(F.max_by("name", F.struct("score", -c("ordinal"), "name")).alias("name"))
        near = near.withColumn("key", strip(F.lower("name"))).join(index, ["picklist_id", "key"]).where("opt is not null")
        found = found.unionByName(near.select("picklist_id", "text", c("opt").alias("option_id"), F.lit("fuzzy").alias("how")))
    return rows.join(found, ["picklist_id", "text"], "left")


def fuzzy_top(texts: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """JOIN6, SRT4: picklist_id, text, rank, name, score: the best names (picklist_id, ordinal, name) of each distinct text, ties to the earlier name."""
    prepare(texts.sparkSession)
    scored = texts.select("picklist_id", "text").distinct().join(names, "picklist_id").withColumn("score", fuzzy_join.score("text", "name"))
    w = Window.partitionBy("picklist_id", "text").orderBy(F.col("score").desc(), "ordinal")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("picklist_id", "text", "rank", "name", "score")


def levenshtein_best(texts: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """JOIN6, with Spark's own distance: the nearest name within `most` edits, for each (picklist_id, text); the length is checked before."""
    pairs = texts.join(names, "picklist_id").where(F.abs(F.length("text") - F.length("name")) <= most)
    near = pairs.withColumn("edits", F.levenshtein(F.lower("text"), F.lower("name"), most)).where("edits >= 0")
    w = Window.partitionBy("picklist_id", "text").orderBy("edits", "ordinal")
    return near.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("picklist_id", "text", "name", "edits")
