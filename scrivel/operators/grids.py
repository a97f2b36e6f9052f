"""Tables that were written as lines: headings first, then the cells of each row, one to a line. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivel.functions import rules as R
from scrivel.functions.text import fold, is_noise, strip

ENTRIES = "array<map<string,string>>"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: ~is_noise(x))


def _headings(ls: Column, table: dict[str, str], within: int) -> Column:
    """struct<kinds, stop>: the kinds of the first run of headings among the first lines, and the place behind it."""
    kinds = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    keyed = F.transform(F.slice(ls, 1, within), lambda x, i: F.struct(F.try_element_at(kinds, fold(F.regexp_replace(x, ":+$", ""))).alias("kind"), (i + 1).alias("place")))
    start = F.struct(F.array().cast("array<string>").alias("kinds"), F.lit(0).alias("stop"), F.lit(True).alias("on"))

    def step(a: Column, x: Column) -> Column:
        hit = a["on"] & x["kind"].isNotNull()
        return F.struct(F.when(hit, F.concat(a["kinds"], F.array(x["kind"]))).otherwise(a["kinds"]).alias("kinds"), F.when(hit, x["place"]).otherwise(a["stop"]).alias("stop"), (a["on"] & (hit | (F.size(a["kinds"]) == 0))).alias("on"))

    return F.aggregate(keyed, start, step)


def _with_first(kinds: Column, *either: tuple[str, str]) -> Column:
    """A heading that the section header swallowed goes back to the front: (absent, present)."""
    out = kinds
    for absent, there in reversed(either):
        out = F.when((F.size(kinds) >= 2) & ~F.array_contains(kinds, absent) & F.array_contains(kinds, there), F.concat(F.array(F.lit(absent)), kinds)).otherwise(out)
    return out


def _rows(ls: Column, kinds: Column, stop: Column) -> Column:
    """Chunks of as many lines as there are kinds; an incomplete last one is dropped."""
    n = F.greatest(F.size(kinds), F.lit(1))
    count = F.floor((F.size(ls) - stop) / n).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.slice(ls, stop + k * n + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def _of(kinds: Column, row: Column, kind: str) -> Column:
    """The cell of the last column of a kind; null if there is none."""
    hits = F.filter(F.zip_with(kinds, row, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), lambda x: x["k"] == kind)
    return F.try_element_at(hits, F.lit(-1))["v"]


def entry_map(**values: Column) -> Column:
    """A map of the values that are there and not empty."""
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items())), lambda x: x["value"].isNotNull() & (x["value"] != ""))
    return F.map_from_entries(pairs)


def _parse(text: Column, table: dict[str, str], within: int, least: int, either: tuple[tuple[str, str], ...], entry, cut) -> Column:
    """Each stage is bound once in an array of one, so that the folds are not repeated wherever their result is used."""
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def of_headings(ls: Column, h: Column) -> Column:
        return bind(F.struct(_with_first(h["kinds"], *either).alias("kinds"), h["stop"].alias("stop")), lambda g: F.when((F.size(ls) >= least) & (F.size(g["kinds"]) >= 3), F.filter(F.transform(cut(_rows(ls, g["kinds"], g["stop"])), lambda row: entry(g["kinds"], row)), lambda m: m.isNotNull())))

    found = bind(_lines(text), lambda ls: bind(_headings(ls, table, within), lambda h: of_headings(ls, h)))
    return F.when(F.size(found) > 0, found)


def education_grid(text: Column) -> Column:
    """TVF8: entries of a section's text, or null where it is no grid (under 5 lines, under 3 columns, no row with a degree or school)."""

    def entry(kinds: Column, row: Column) -> Column:
        degree, school, year = (_of(kinds, row, k) for k in ("degree", "school", "year"))
        ranged = r"(\d{4})\s*[-–—]\s*(\d{4})"
        start = F.when(year.rlike(ranged), F.regexp_extract(year, ranged, 1)).otherwise(year)
        end = F.when(year.rlike(ranged), F.regexp_extract(year, ranged, 2))
        return F.when(F.coalesce(degree, school).isNotNull(), entry_map(degree=degree, otherSchool=school, otherMajor=_of(kinds, row, "field"), startDate=start, endDate=end, grade=_of(kinds, row, "grade")))

    return _parse(text, R.EDUCATION_GRID, 8, 5, (("degree", "school"),), entry, lambda rows: rows)


def experience_grid(text: Column) -> Column:
    """TVF10: entries of a section's text, or null where it is no grid (under 4 lines, under 3 columns); it ends at the first row with a bullet.

    A period counts before single dates; an end that is still going is left out.
    """

    def entry(kinds: Column, row: Column) -> Column:
        title, firm, period, end = (_of(kinds, row, k) for k in ("title", "company", "period", "to"))
        ranged = period.rlike(R.PERIOD)
        closed = lambda x: F.when(~F.lower(x).isin(R.OPEN_ENDS[:3]), x)
        start = F.when(ranged, strip(F.regexp_extract(period, R.PERIOD, 1)))
        until = F.when(ranged, closed(strip(F.regexp_extract(period, R.PERIOD, 2))))
        return F.when(F.coalesce(title, firm).isNotNull(), entry_map(startTitle=title, employer=firm, startDate=F.coalesce(start, _of(kinds, row, "from")), endDate=F.coalesce(until, closed(end))))

    def cut(rows: Column) -> Column:
        marks = F.transform(rows, lambda row: F.exists(row, lambda x: x.rlike(R.BULLET)))
        first = F.array_position(marks, F.lit(True)).cast("int")
        return F.when(first > 0, F.slice(rows, 1, F.greatest(first - 1, F.lit(0)))).otherwise(rows)

    return _parse(text, R.EXPERIENCE_GRID, 6, 4, (("title", "company"), ("company", "title")), entry, cut)
