"""TVF21: the whole extraction as one plan, from text blocks and table rows to personal fields and section entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivel.functions import rules as R
from scrivel.functions.text import contains_any, fold, is_data, strip
from scrivel.operators import grids, layout, lines, parsers, personal
from scrivel.streaming.shared import shared_dir, written

INNER_BOLD = ["experience", "education"]


def label_pairs(blocks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """TVF1, SET1: doc_id, pos, label, value of blocks, table rows and neighbours on one line, in this order; of a label the last value counts."""
    place = lambda rank, *keys: F.struct(F.lit(rank).alias("rank"), *(F.col(k).cast("long").alias(f"k{n}") for n, k in enumerate(keys)))
    zero = lambda d, *names: d.withColumns({n: F.lit(0) for n in names})
    inside = lines.line_pairs(blocks).select("doc_id", place(0, "block_no", "line_no", "line_no").alias("pos"), "label", "value")
    keyed = blocks.select(F.struct("doc_id", "block_no").alias("doc_id"), "text")
    colons = lines.colon_pairs(lines.explode_lines(keyed)).select("doc_id.*", "pos", "label", "value")
    colons = colons.select("doc_id", place(0, "block_no", "pos", "pos").alias("pos"), "label", "value")
    near = layout.adjacent(blocks).select("doc_id", F.col("pos").alias("at"), "label", "value")
    near = zero(near, "z").select("doc_id", place(2, "at", "z", "z").alias("pos"), "label", "value")
    out = inside.unionByName(colons).unionByName(near)
    if tables is not None:
        out = out.unionByName(lines.table_pairs(tables).select("doc_id", place(1, "table_no", "row_no", "k").alias("pos"), "label", "value"))
    return lines.last_wins(out)


def personal_fields(blocks: DataFrame, tables: DataFrame | None = None, pairs: DataFrame | None = None, recognise: personal.Recogniser = personal.nobody) -> DataFrame:
    """doc_id and a column for each personal field. A document without any field is a row of nulls. pairs: label_pairs, if they are there already.

    recognise (TVF19): names in the first characters of a text, for documents that no label and no large type names.
    """
    texts = layout.reading_order(blocks).select("doc_id", "raw_text")
    found = texts.join(personal.by_label(written(label_pairs(blocks, tables), "pairs") if pairs is None else pairs), "doc_id", "left")
    named = personal.by_pattern(found).join(layout.prominent_name(blocks).withColumnRenamed("name", "prominent"), "doc_id", "left")
    named = named.withColumn("prominent", F.coalesce("prominent", personal.recognised(F.col("raw_text"), recognise)))
    return personal.clean(personal.with_names(named)).select("doc_id", *personal.FIELDS)


def section_texts(ls: DataFrame) -> DataFrame:
    """WIN1, TVF20: doc_id, sec_no, section, text from lines (doc_id, line_no, line): marked lines inside stay in experience and education only."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    s = lines.section_of(ls).withColumn("sec_no", F.count("header").over(w)).where("section is not null")
    line = strip("line")
    marked = line.startswith("[SECTION]")
    bare = strip(F.replace(line, F.lit("[SECTION]"), F.lit("")))
    keep = F.when(marked, F.col("section").isin(INNER_BOLD) & (bare != "")).otherwise(is_data(line))
    rows = s.where(keep).withColumn("kept", F.struct("line_no", F.when(marked, bare).otherwise(line).alias("t")))
    return rows.groupBy("doc_id", "sec_no", "section").agg(F.array_join(F.array_sort(F.collect_list("kept"))["t"], "\n").alias("text"))


def _filled(*keys: str) -> Column:
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys)), lambda x: x["value"].isNotNull() & (x["value"] != ""))
    return F.map_from_entries(pairs).alias("keys")


def _parsed(texts: DataFrame) -> DataFrame:
    """(doc_id, sec_no, section, entry_no, keys, moved): what each section holds. The parsers work on (doc_id, sec_no) as their document."""
    of = lambda kind: texts.where(F.col("section") == kind).select(F.struct("doc_id", "sec_no").alias("doc_id"), "text")

    def rows(frame: DataFrame, kind: str, order: str, keys: Column, moved: bool = False) -> DataFrame:
        return frame.select("doc_id.*", F.lit(kind).alias("section"), F.col(order).cast("long").alias("entry_no"), keys, F.lit(moved).alias("moved"))

    def folded(frame: DataFrame, grid, parsed: Column) -> DataFrame:
        return frame.withColumn("grid", grid(F.col("text"))).select("doc_id", F.posexplode_outer(F.coalesce("grid", parsed)).alias("entry_no", "keys")).where("entry_no is not null")

    split = lambda kind: lines.entries(of(kind)).select("doc_id", F.posexplode_outer("entries").alias("entry_no", "entry")).where("entry_no is not null")
    schools = folded(of("education"), grids.education_grid, parsers.schools(F.col("text"))).where(F.size("keys") > 0)
    is_cert = contains_any(F.lower(F.coalesce(F.col("keys")["degree"], F.lit(""))), R.CERTIFICATE_WORDS)  # SET3
    # schools and certificates among them in one pass, so that the section is parsed once
    as_cert = schools.withColumns({"moved": is_cert, "name": F.col("keys")["degree"], "institution": F.col("keys")["otherSchool"], "startDate": F.col("keys")["startDate"]})
    languages = parsers.language_lines(of("languages"))
    inline = parsers.section_lines(of("languages")).where(F.col("line").rlike(r"[,|]") & F.col("line").rlike(r"\([^)]+\)"))
    out = [
        as_cert.select("doc_id.*", F.when(F.col("moved"), "certificates").otherwise("education").alias("section"), F.col("entry_no").cast("long").alias("entry_no"), F.when(F.col("moved"), _filled("name", "institution", "startDate")).otherwise(F.col("keys")).alias("keys"), "moved"),
        rows(folded(lines.entries(of("experience")), grids.experience_grid, parsers.jobs(F.col("entries"))), "experience", "entry_no", F.col("keys")),
        rows(languages, "languages", "line_no", _filled("language", "proficiency", "remark")),
        rows(parsers.inline_languages(inline.select("doc_id", F.col("line").alias("value"))), "languages", "pos", _filled("language", "remark")),
        rows(parsers.simple_entries(split("courses"), "course", "endDate"), "courses", "entry_no", _filled("course", "startDate", "endDate", "institution", "description")),
        rows(parsers.family(split("family")), "family", "entry_no", _filled("name", "relationship", "contact", "position")),
    ]
    for kind, share, numbered, date in (("certificates", 0.5, True, "startDate"), ("awards", 0.6, False, "issueDate")):
        # a list or plain entries, told by the text alone: only those that are no list are split
        seen = of(kind).withColumn("items", parsers.listed_items(F.col("text"), share, numbered, date))
        items = seen.select("doc_id", F.posexplode_outer("items").alias("nth", "x")).where("x is not null").select("doc_id", "x.*")
        plain = lines.entries(seen.where(F.coalesce(F.size("items"), F.lit(0)) <= 0).select("doc_id", "text"))
        plain = plain.select("doc_id", F.posexplode_outer("entries").alias("entry_no", "entry")).where("entry_no is not null")
        second = "endDate" if date == "startDate" else "startDate"
        out += [rows(items, kind, "line_no", _filled("name", date)), rows(parsers.simple_entries(plain, "name", date), kind, "entry_no", _filled("name", date, second, "institution", "description"))]
    first, *more = out
    for o in more:
        first = first.unionByName(o)
    return first


def table_entries(tables: DataFrame) -> DataFrame:
    """TVF2 to TVF6: doc_id, section, entry_no, keys from tables (doc_id, table_no, row_no, cells) with headings; of experience tables the first that holds anything."""
    c, doc = F.col, Window.partitionBy("doc_id")
    routed = parsers.route_tables(tables).where("kind is not null").select("doc_id", "table_no", "kind", "header")
    rows = tables.join(routed, ["doc_id", "table_no"]).withColumn("top", F.min("row_no").over(Window.partitionBy("doc_id", "table_no")))
    rows = rows.where("row_no > top or kind = 'language_more'").withColumn("row_no", c("table_no") * F.lit(1_000_000).cast("long") + c("row_no"))
    of = lambda kind: rows.where(c("kind") == kind).select("doc_id", "row_no", "header", "cells")
    entry = lambda frame, section, *keys: frame.select("doc_id", F.lit(section).alias("section"), c("row_no").alias("entry_no"), _filled(*keys))
    jobs = parsers.experience_table(of("experience")).withColumn("nth", F.expr("row_no div 1000000"))
    jobs = jobs.withColumn("least", F.min("nth").over(doc)).where("nth = least")
    first, last = strip(F.get("cells", F.lit(0))), strip(F.element_at("cells", -1))
    is_word = lambda x: (x != "") & ~F.lower(x).isin(R.NON_LANGUAGES)
    more = of("language_more").select("doc_id", "row_no", first.alias("language"), F.when(is_word(last) & (last != first), last).alias("remark")).where(is_word(c("language")))
    out = entry(jobs, "experience", "startTitle", "employer", "startDate", "endDate")
    out = out.unionByName(entry(parsers.education_table(of("education")), "education", "otherSchool", "degree", "otherMajor", "startDate", "endDate"))
    out = out.unionByName(entry(parsers.certificate_table(of("certificate")), "certificates", "name", "institution", "startDate"))
    return out.unionByName(entry(parsers.language_table(of("language")).unionByName(more), "languages", "language", "remark"))


def move_degrees(entries: DataFrame) -> DataFrame:
    """SET2: where a document has no education, certificates that name a degree become education."""
    c, doc = F.col, Window.partitionBy("doc_id")
    name, more = F.coalesce(c("keys")["name"], F.lit("")), F.coalesce(c("keys")["description"], F.lit(""))
    part = F.try_element_at(F.filter(F.split(name, r"\s*[—–-]\s*"), lambda x: contains_any(F.lower(x), R.ACADEMIES)), F.lit(-1))
    e = entries.withColumn("has", F.max((c("section") == "education").cast("int")).over(doc) == 1)
    e = e.withColumn("degree_like", ~c("has") & (c("section") == "certificates") & F.concat_ws(" ", name, more).rlike(R.DEGREE_WORDS))
    e = e.withColumns({"degree": F.when(c("degree_like"), F.nullif(F.regexp_extract(name, R.DEGREE_WORDS, 1), F.lit(""))), "otherSchool": F.when(c("degree_like"), strip(F.regexp_replace(part, r"\([\d\-–—]+\)", "")))})
    moves = F.coalesce("degree", "otherSchool").isNotNull()
    e = e.withColumn("any", F.max(moves.cast("int")).over(doc) == 1).where(~c("any") | ~c("degree_like") | moves)
    return e.select("doc_id", F.when(moves, "education").otherwise(c("section")).alias("section"), "entry_no", F.when(moves, _filled("degree", "otherSchool")).otherwise(c("keys")).alias("keys"))


def pair_languages(pairs: DataFrame) -> DataFrame:
    """TVF7: doc_id, sec_no, section, entry_no, keys, moved: languages listed behind labels for them. They come after all sections, in the order of the pairs."""
    said = pairs.where(strip(fold(F.col("label"))).isin(R.LANGUAGE_KEYS))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long") + F.lit(1 << 40)
    got = parsers.inline_languages(said.select(F.struct("doc_id", nth.alias("sec_no")).alias("doc_id"), "value"))
    return got.select("doc_id.*", F.lit("languages").alias("section"), F.col("pos").cast("long").alias("entry_no"), _filled("language", "remark"), F.lit(False).alias("moved"))


def section_entries(ls: DataFrame, tables: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """doc_id, section, entry_no, keys: of sections of one kind the first that holds anything counts, tables before them all (SET5), languages from
    label pairs after them; FLT7 to FLT11, WIN7 and SET2 after that.

    The section texts are written once, by kind, to the shared folder: each parser then reads its own kind only.
    """
    c, spark = F.col, ls.sparkSession
    kind = Window.partitionBy("doc_id", "section")
    path, texts = shared_dir(spark, "sections"), section_texts(ls)
    texts.write.partitionBy("section").parquet(path)
    e = _parsed(spark.read.schema(texts.schema).parquet(path))
    if tables is not None:
        e = e.unionByName(written(table_entries(tables), "table-entries").withColumns({"sec_no": F.lit(-1).cast("long"), "moved": F.lit(False)}))
    if pairs is not None:
        e = e.unionByName(pair_languages(pairs))
    e = written(e, "parsed").withColumn("first", F.min("sec_no").over(kind))
    school = F.min(F.when(c("section") == "education", c("sec_no"))).over(Window.partitionBy("doc_id"))
    e = e.withColumn("school", school).where(F.when(c("moved"), c("school").isNull() | (c("sec_no") <= c("school"))).otherwise(c("sec_no") == c("first")))
    names = ("language", "remark", "name", "employer", "startTitle", "otherSchool", "degree", "startDate")
    e = e.withColumns({n: c("keys")[n] for n in names})
    ok = F.lit(True)
    for k in ("languages", "awards", "certificates", "experience", "education"):
        ok = ok & ((c("section") != k) | F.coalesce(parsers.clean_entries(k), F.lit(False)))
    e = e.where(ok).withColumn("key", F.when(c("section") == "languages", strip(fold(c("language")))))
    again = F.row_number().over(Window.partitionBy("doc_id", "section", "key").orderBy("sec_no", "entry_no"))
    e = e.withColumn("nth", again).where((c("section") != "languages") | (c("nth") == 1))
    order = Window.partitionBy("doc_id", "section").orderBy("sec_no", "entry_no")
    return move_degrees(e.withColumn("entry_no", F.row_number().over(order) - 1).select("doc_id", "section", "entry_no", "keys"))
