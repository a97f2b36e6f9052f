"""Lines of documents: pairs of label and value, sections, entries, grids.

Null texts have no lines, null lines open no section. Rows of a document are ordered by line_no (block_no, table_no and row_no); rows
with equal places come in any order. A null doc_id is a document of its own. Empty tables give no rows. Columns that are not named are
dropped, but for section_of, entries and first_by, which keep them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivel.functions import rules as R
from scrivel.functions.text import bound, contains_any, is_form_label, is_noise, label, strip, unused
from scrivel.operators import matching


def explode_lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return docs.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _clean(c: Column) -> Column:
    return ~is_form_label(c) & ~is_noise(c)


def colon_pairs(lines: DataFrame) -> DataFrame:
    """TVF1, WIN4, WIN5: doc_id, pos, label, value of `label: value` lines; an empty value is the next line, a value that ends in a comma goes on.

    Lines are the non-blank lines of a document in order. A line goes on with the one before if that ends in a comma and
    the line itself is clean and has no colon, so the lines fall into runs of any length; one sort by document, no look-ahead.
    """
    c, order = F.col, Window.partitionBy("doc_id").orderBy("line_no")
    b = lines.withColumn("line", strip("line")).where("line != ''").select("doc_id", "line_no", "line").withColumn("clean", _clean(c("line")))
    b = b.withColumns({"more": F.coalesce(F.lag("line").over(order).rlike(r",\s*$") & c("clean") & ~c("line").contains(":"), F.lit(False)), "next": F.when(F.lead("clean").over(order), F.lead("line").over(order))})
    b = b.withColumn("run", F.count_if(~c("more")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    tail = F.array_sort(F.collect_list(F.when(c("more"), F.struct("line_no", "line"))))
    head = lambda k: F.max(F.when(~c("more"), c(k))).alias(k)
    runs = b.groupBy("doc_id", "run").agg(F.min("line_no").alias("pos"), head("line"), head("next"), F.bool_or(~c("more") & c("clean")).alias("clean"), tail.alias("tail"))
    runs = runs.where(c("clean") & c("line").contains(":")).withColumns({"label": strip(F.substring_index("line", ":", 1)), "first": strip(F.regexp_replace("line", "^[^:]*:", ""))})
    going = F.array_join(F.concat(F.array("first"), c("tail")["line"]), " ")
    value = F.when(c("first") != "", F.when(F.length("label") < 60, going)).otherwise(c("next"))
    return runs.where((c("label") != "") & _clean(c("label"))).select("doc_id", "pos", "label", value.alias("value")).where("value is not null")


def line_pairs(blocks: DataFrame) -> DataFrame:
    """WIN8: blocks of two lines or more without a colon are label and value in turn."""
    ls = F.filter(F.transform(F.split("text", "\n"), lambda x: strip(x)), lambda x: x != "")
    b = blocks.withColumn("ls", ls).where((F.size("ls") >= 2) & ~F.exists("ls", lambda x: x.contains(":")))
    b = b.select("doc_id", "block_no", "ls", F.posexplode("ls").alias("line_no", "label")).where((F.col("line_no") % 2 == 0) & (F.col("line_no") + 1 < F.size("ls")))
    b = b.withColumn("value", F.get("ls", F.col("line_no") + 1))
    ok = (F.length("label") < 40) & (F.size(F.split("label", r"\s+")) <= 5) & _clean(F.col("label")) & _clean(F.col("value"))
    return b.where(ok).select("doc_id", "block_no", "line_no", "label", "value")


def table_pairs(tables: DataFrame) -> DataFrame:
    """TVF1: rows with two or four clean cells are one or two pairs."""
    c = tables.withColumn("c", F.filter("cells", lambda x: x.isNotNull() & (x != "") & _clean(x)))
    pair = lambda k: F.struct(F.lit(k).alias("k"), F.get("c", F.lit(k - 1)).alias("label"), F.get("c", F.lit(k)).alias("value"))
    two = c.where(F.size("c") == 2).select("doc_id", "table_no", "row_no", pair(1).alias("p"))
    four = c.where(F.size("c") == 4).select("doc_id", "table_no", "row_no", F.explode(F.array(pair(1), pair(3))).alias("p"))
    return two.union(four).select("doc_id", "table_no", "row_no", "p.*").where(F.length("label") < 60)


def last_wins(pairs: DataFrame) -> DataFrame:
    """WIN6, SET1: one row for each label: the first place, the last value. pos orders."""
    return pairs.groupBy("doc_id", "label").agg(F.min("pos").alias("pos"), F.max_by("value", "pos").alias("value"))


def first_by(rows: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """WIN7: the first row of each key."""
    place = unused(rows.columns, "_r")
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) == 1).drop(place)


def section_of(lines: DataFrame) -> DataFrame:
    """WIN1, TVF20: adds header (the section that a header line opens) and section (of the lines below it)."""
    text = strip(F.replace("line", F.lit("[SECTION]"), F.lit("")))
    marked = strip("line").startswith("[SECTION]")

    def named(norm: Column) -> Column:
        words = F.size(F.split(norm, " "))
        names = {name: sorted({matching.normal(a) for a in aliases}) for name, aliases in R.SECTION_ALIASES.items()}
        return F.when(norm != "", F.coalesce(*(F.when(norm.isin(of) | (marked & (words <= 6) & contains_any(norm, of)), F.lit(name)) for name, of in names.items())))

    headed = lines.withColumn("header", F.when(F.size(F.split(text, r"\s+")) <= 8, bound(label(text), named)))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return headed.withColumn("section", F.when(F.col("header").isNull(), F.last("header", ignorenulls=True).over(w)))


def grid_rows(cells: DataFrame, width: int) -> DataFrame:
    """WIN3: cells (doc_id, line_no, line) cut into rows of `width`; an incomplete last row is dropped."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    rows = cells.withColumn("n", n).groupBy("doc_id", F.floor(F.col("n") / width).alias("row_no")).agg(F.array_sort(F.collect_list(F.struct("n", "line")))["line"].alias("cells"))
    return rows.where(F.size("cells") == width)


#: Lines that one inner fold takes. Its marks are put behind those before once a chunk, so a text of n lines costs about n steps.
CHUNK = 512
_DASH, _NOW = "[-–—]", r"(?:\d{4}|nay|present|current|hien tai|hiện tại)"
#: A year range may go over lines, as they are joined by spaces: what may stand at the end of one line (1 to 4), and how the next goes on.
_TAILS = {1: r"\d{4}$", 2: rf"\d{{4}}\s*{_DASH}$", 3: rf"(?iu)\d{{4}}\s*{_DASH}\s*hien$", 4: rf"(?iu)\d{{4}}\s*{_DASH}\s*hiện$"}
_GO_ON = {(1, 2): rf"^{_DASH}$", (1, 3): rf"(?iu)^{_DASH}\s*hien$", (1, 4): rf"(?iu)^{_DASH}\s*hiện$", (2, 3): "(?iu)^hien$", (2, 4): "(?iu)^hiện$"}
_ENDS = {1: rf"(?iu)^{_DASH}\s*{_NOW}", 2: rf"(?iu)^{_NOW}", 3: "(?iu)^tai", 4: "(?iu)^tại"}


def _line_marks(s: Column) -> Column:
    """What a line means to the machine: stop, bullet, header, year (it holds a range), and how it takes part in a range over lines.

    The line is stripped: by its first letter, its last one and whether it has a digit most patterns are ruled out unasked.
    """

    def of(k: Column) -> Column:
        first, small, last = k["first"], F.lower(k["first"]), F.lower(F.right(s, F.lit(1)))
        dash, word = first.isin(*"-–—"), small.isin(*"npch") | first.between("0", "9")
        header = (F.upper(first) == first) & (small != first) & ((F.length(s) < 60) | k["year"] | s.contains("|") | (k["digit"] & s.rlike(R.DATE)))
        asked = lambda when, ways: F.when(when, F.coalesce(*(F.when(s.rlike(p), n) for n, p in ways.items()), F.lit(0))).otherwise(0)
        go_on = lambda n: {to: p for (at, to), p in _GO_ON.items() if at == n}
        begin = {1: dash, 2: word, 3: small == "t", 4: small == "t"}
        return F.struct(
            ((s == "") | s.startswith("---") | s.startswith("===") | s.startswith("***")).alias("stop"), (first.isin(*"-•●○*+>") & s.rlike(R.BULLET)).alias("bullet"), header.alias("header"), k["year"].alias("year"),
            asked(k["digit"] & (last.isin(*"-–—n") | last.between("0", "9")), dict(reversed(_TAILS.items()))).alias("tail"), asked(dash, go_on(1)).alias("from1"), asked(small == "h", go_on(2)).alias("from2"), F.array(*(begin[n] & s.rlike(p) for n, p in _ENDS.items())).alias("ends"),
        )

    digit = lambda d: F.struct(F.left(s, F.lit(1)).alias("first"), d.alias("digit"), (d & s.rlike(R.YEAR_RANGE)).alias("year"))
    return bound(bound(s.rlike("[0-9]"), digit), of)


def _step(a: Column, m: Column) -> Column:
    """The machine: whether an entry is open, has had a bullet, has a year range, or half of one; `out` gets 0 (no entry), 1 (goes on) or 2 (begins)."""
    fresh = a["open"] & ~m["bullet"] & F.when(a["had"], m["header"]).otherwise(m["year"] & a["year"])
    begins = ~a["open"] | fresh
    half = F.when(begins, 0).otherwise(a["half"])
    year = (~begins & a["year"]) | m["year"] | F.coalesce(F.get(m["ends"], half - 1), F.lit(False))
    then = F.when(m["tail"] > 0, m["tail"]).when(half == 1, m["from1"]).when(half == 2, m["from2"]).otherwise(0)
    no = F.lit(False)
    return F.struct(
        (~m["stop"]).alias("open"), F.when(m["stop"] | fresh, no).otherwise(a["had"] | m["bullet"]).alias("had"), F.when(m["stop"], no).otherwise(year).alias("year"), F.when(m["stop"], 0).otherwise(then).alias("half"),
        F.concat(a["out"], F.array(F.when(m["stop"], 0).when(begins, 2).otherwise(1))).alias("out"),
    )


def entry_marks(ls: Column) -> Column:
    """For each line of an array: 0 if it is in no entry, 2 if it begins one, 1 if it goes on with one."""
    none = F.array().cast("array<int>")
    chunks = lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CHUNK).cast("int")), lambda k: F.slice(m, k * CHUNK + 1, F.lit(CHUNK)))
    start = F.struct(F.lit(False).alias("open"), F.lit(False).alias("had"), F.lit(False).alias("year"), F.lit(0).alias("half"), none.alias("out"))

    def chunk(a: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(a["open"].alias("open"), a["had"].alias("had"), a["year"].alias("year"), a["half"].alias("half"), none.alias("out")), _step)
        return bound(inner, lambda b: F.struct(b["open"].alias("open"), b["had"].alias("had"), b["year"].alias("year"), b["half"].alias("half"), F.concat(a["out"], b["out"]).alias("out")))

    return bound(F.transform(ls, _line_marks), lambda m: F.aggregate(chunks(m), start, chunk, lambda a: a["out"]))


def entries(sections: DataFrame, text: str = "text") -> DataFrame:
    """WIN2: adds entries, the section's text split at blank lines, rulers, the end of bullets and second year ranges.

    A machine of a few states goes over what the lines mean, chunk by chunk; entries are the runs of lines that it marks. A null text has one null entry.
    """

    def cut(ls: Column, marks: Column) -> Column:
        edges = F.concat(F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.get(marks, i) != 1), F.array(F.size(ls)))
        runs = lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: F.struct(F.get(e, k).alias("i"), F.get(e, k + 1).alias("j")))
        begun = lambda e: F.filter(runs(e), lambda r: F.get(marks, r["i"]) == 2)
        return bound(edges, lambda e: F.when(F.size(e) > 1, F.transform(begun(e), lambda r: F.array_join(F.slice(ls, r["i"] + 1, r["j"] - r["i"]), "\n"))))

    got = bound(F.transform(F.split(text, "\n"), strip), lambda ls: bound(entry_marks(ls), lambda marks: cut(ls, marks)))
    return sections.withColumn("entries", bound(got, lambda e: F.when(F.size(e) > 0, e).otherwise(F.array(F.col(text)))))
