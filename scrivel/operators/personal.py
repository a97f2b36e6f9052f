"""Personal fields of a document: labels first, then patterns, name parts, and the final clean-up. One row for each document.

Null and empty values are missing ones. Rows are worked on each by itself, so repeated rows stay and further columns, whatever their
names, are kept; by_label has one row for each doc_id, ties of a field go to the earlier place. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivel.functions import rules as R
from scrivel.functions import text as T
from scrivel.operators import matching

FIELDS = list(R.LABEL_ALIASES)
NAMES = ["fullName", "firstName", "middleName", "lastName"]
#: TVF19: from a text to an array of the persons' names in it, in order. None ships with the engine; a model can be put in as a pandas UDF.
Recogniser = Callable[[Column], Column]
HEAD = 800


def nobody(text: Column) -> Column:
    return F.lit(None).cast("array<string>")


def recognised(text: Column, recognise: Recogniser = nobody) -> Column:
    """TVF19, FLT3, FLT4: the first recognised name in the head of a text that reads like one and begins with a family name."""
    names = F.transform(recognise(F.left(text, F.lit(HEAD))), lambda x: T.strip(x))
    return F.get(F.filter(names, lambda x: T.is_name(x) & T.is_family_name_first(x)), F.lit(0))


def by_label(pairs: DataFrame) -> DataFrame:
    """JOIN3 spread out: doc_id and a column for each field, from (doc_id, pos, label, value)."""
    got = matching.assign_fields(pairs)
    return got.groupBy("doc_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS))


def by_pattern(rows: DataFrame, text: str = "raw_text") -> DataFrame:
    """TVF18, SET5: email, phone and id number from the whole text where no label gave them; an id that is the phone number doesn't count."""
    c, none = F.col, F.lit("")
    rows = rows.withColumns({"primaryEmail": F.coalesce("primaryEmail", F.regexp_substr(text, F.lit(R.EMAIL))), "cellPhone": F.coalesce("cellPhone", T.phone(c(text)))})
    phone = F.replace(F.coalesce("cellPhone", none), F.lit(" "), none)
    return rows.withColumn("idCard", F.coalesce("idCard", F.get(F.filter(T.found(c(text), R.ID_NUMBER, 1), lambda x: x != phone), F.lit(0))))


def with_names(rows: DataFrame, prominent: str = "prominent") -> DataFrame:
    """STR4, STR5, LAY5: name parts from the full name, or from the prominent text where there is no label; JOIN8: the contact email from the first."""
    full = F.coalesce(F.nullif("fullName", F.lit("")), prominent)
    n = T.unused(rows.columns, "n")
    rows = rows.withColumn(n, T.name_parts(T.name_case(full))).withColumn("contactEmail", F.coalesce("contactEmail", "primaryEmail"))
    part = lambda f, p: F.coalesce(F.nullif(F.col(n)[p], F.lit("")), F.col(f))
    return rows.withColumns({"fullName": F.col(n)["full"], "firstName": part("firstName", "first"), "middleName": part("middleName", "middle"), "lastName": part("lastName", "last")}).drop(n)


def clean(rows: DataFrame) -> DataFrame:
    """TVF22: values that don't hold what their field says become null; the email is cut out of what surrounds it, the address ends at a pipe.

    A full name that is none takes its parts with it. Null and empty values stay as they are.
    """
    digits = lambda f: F.length(F.regexp_replace(f, r"\D", ""))
    empty = lambda f: F.col(f) == ""
    email = lambda f: F.when(empty(f), F.col(f)).otherwise(F.regexp_substr(f, F.lit(R.EMAIL)))
    named = T.unused(rows.columns, "_named")
    rows = rows.withColumn(named, F.col("fullName").isNull() | empty("fullName") | T.is_name(F.col("fullName")))
    out: dict[str, Column] = {f: F.when(F.col(named), F.col(f)) for f in NAMES}
    out |= {"primaryEmail": email("primaryEmail"), "contactEmail": email("contactEmail"), "address": T.before_pipe(F.col("address"))}
    out |= {"cellPhone": F.when(empty("cellPhone") | digits("cellPhone").between(7, 15), F.col("cellPhone")), "idCard": F.when(empty("idCard") | digits("idCard").isin(9, 12), F.col("idCard"))}
    return rows.withColumns(out).drop(named)
