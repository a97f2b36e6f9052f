"""Dates in free text to timestamps and to /Date(ms)/ strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivel.functions import rules as R
from scrivel.functions.text import strip


def parse(text: Column) -> Column:
    """DT2, DT3: year; month and year; day first, then month first, then year first; two-digit years (below 50: 20yy); English and Vietnamese months.

    Each form is rewritten to year-month-day by one pattern. A year 0000 gives null, as does a day that doesn't exist.
    """
    c = strip(text)
    year, word = r"((?!0000)\d{4})", "[A-Za-z]{3,9}"

    def day(pattern: str, to: str) -> Column:
        return F.when(c.rlike(pattern), F.try_to_timestamp(F.regexp_replace(c, pattern, to), F.lit("yyyy-M-d")))

    def named(pattern: str, *formats: str) -> list[Column]:
        clean = F.initcap(F.regexp_replace(c, r"[,\s]+", " "))
        return [F.when(c.rlike(pattern), F.try_to_timestamp(clean, F.lit(f))) for f in formats]

    return F.coalesce(
        day(f"^{year}$", "$1-1-1"),
        day(rf"^(\d{{1,2}})[/\-.]{year}$", "$2-$1-1"),
        day(rf"^(\d{{1,2}})([/\-.])(\d{{1,2}})\2{year}$", "$4-$3-$1"),
        day(rf"^(\d{{1,2}})([/\-])(\d{{1,2}})\2{year}$", "$4-$1-$3"),
        day(rf"^{year}([/\-])(\d{{1,2}})\2(\d{{1,2}})$", "$1-$3-$4"),
        day(r"^(\d{1,2})[/\-.](\d{1,2})[/\-.]([0-4]\d)$", "20$3-$2-$1"),
        day(r"^(\d{1,2})[/\-.](\d{1,2})[/\-.]([5-9]\d)$", "19$3-$2-$1"),
        *named(rf"^{word} \d{{1,2}},? \d{{4}}$", "MMMM d yyyy", "MMM d yyyy"),
        *named(rf"^\d{{1,2}} {word} \d{{4}}$", "d MMMM yyyy", "d MMM yyyy"),
        *named(rf"^{word},? \d{{4}}$", "MMMM yyyy", "MMM yyyy"),
        day(rf"(?ius)^.*?(?:thang|tháng)\s+(\d{{1,2}})\s*[/,\s]*\s*(?:nam|năm)\s+{year}.*$", "$2-$1-1"),
    )


def date_string(text: Column, ongoing: bool = False) -> Column:
    """DT1: /Date(ms)/ in UTC; kept if it is one already; words for "still" give the far future if ongoing, else null."""
    c = strip(text)
    still = F.lower(c).isin(R.ONGOING)
    far = F.lit(f"/Date({R.FAR_FUTURE_MS})/") if ongoing else F.lit(None).cast("string")
    return F.when(c == "", None).when(c.startswith("/Date("), c).when(still, far).otherwise(F.concat(F.lit("/Date("), F.unix_millis(parse(c)).cast("string"), F.lit(")/")))
