"""Scores of parsed records against golden ones (JSON texts), as Arrow batches; what follows is native aggregation.

A comparison gives a mark from 0 to 1 and its issues, in the order of the truth. The kind of the truth decides how it is
compared; a null or missing parsed value marks 0 whatever the truth is. Malformed texts are a status of their row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivel.functions import rules as R
from scrivel.functions.fuzzy import ratio
from scrivel.functions.text import SPACES
from scrivel.streaming.shared import prepare

FLOOR = 0.8
#: The share of the entries' marks in the mark of a list of entries; the rest is for their number.
CONTENT = 0.7
Mark = tuple[float, list[str]]


def taken(truth: list, parsed: list, score: Callable[[int, object, object], float], least: float) -> Iterator[tuple[int, int | None]]:
    """JOIN14: for each truth item in order the parsed item left that scores best, the earlier on ties, if it reaches `least`."""
    left = dict(enumerate(parsed))
    for n, item in enumerate(truth):
        scores = {k: score(n, item, other) for k, other in left.items()}
        best = max(scores, key=scores.__getitem__, default=None)
        found = best is not None and scores[best] >= least
        if found:
            del left[best]
        yield n, best if found else None


def texts(truth: list[str], parsed: list, path: str) -> Mark:
    """SCO3, MTH4: the share of truth texts that some parsed one, as text, is close to."""
    hits = sum(k is not None for _, k in taken(truth, [str(p) for p in parsed], lambda _, a, b: ratio(a, b), FLOOR))
    share = hits / len(truth)
    return share, [] if hits == len(truth) else [f"PARTIAL  {path}: matched {share * 100:.0f}% of {len(truth)} items"]


def records(truth: list[dict], parsed: list, path: str) -> Mark:
    """SCO3: entries by their best partners, and how many there are. Parsed values that are no entries count for the number only."""
    issues = [f"SHORT    {path}: expected {len(truth)} entries, got {len(parsed)}"] if len(parsed) < len(truth) else []
    whole = [p for p in parsed if isinstance(p, dict)]
    total, marks = 0.0, {}

    def score(n: int, a: dict, b: dict) -> float:
        marks[id(b)] = keys(a, b, f"{path}[{n}]")
        return marks[id(b)][0]

    for n, k in taken(truth, whole, score, 0.0):
        mark, more = (0.0, [f"MISSING  {path}[{n}]: no matching entry found"]) if k is None else marks[id(whole[k])]
        total += mark
        issues += more
    return CONTENT * total / len(truth) + (1 - CONTENT) * min(len(parsed), len(truth)) / len(truth), issues


def items(truth: list, parsed: list, path: str) -> Mark:
    """SCO3: lists by the kind of the truth's items; mixed ones are alike or half right."""
    if truth and not parsed:
        return 0.0, [f"EMPTY    {path}: expected {len(truth)} items, got 0"]
    for kind, compare in ((str, texts), (dict, records)):
        if truth and all(isinstance(t, kind) for t in truth):
            return compare(truth, parsed, path)
    return (1.0 if not truth or truth == parsed else 0.5), []


def by_path(truth: dict, parsed: dict, path: str = "") -> dict[str, Mark]:
    """The mark of each of the truth's keys, by its path."""
    paths = {k: f"{path}.{k}" if path else k for k in truth}
    return {paths[k]: value(t, parsed.get(k), paths[k]) for k, t in truth.items()}


def weighed(marks: dict[str, Mark]) -> Mark:
    """SCO2, AGG12: the weighted mean, 1 of none, and all issues."""
    if not marks:
        return 1.0, []
    weights = {p: R.WEIGHTS.get(p, 1.0) for p in marks}
    return sum(weights[p] * m for p, (m, _) in marks.items()) / sum(weights.values()), [i for _, more in marks.values() for i in more]


def keys(truth: dict, parsed: dict, path: str = "") -> Mark:
    """SCO2, AGG12: the weighted mean over the truth's keys."""
    return weighed(by_path(truth, parsed, path))


def text(truth: str, parsed, path: str) -> Mark:
    near = ratio(truth, str(parsed))
    return near, [] if near >= FLOOR else [f"MISMATCH {path}: expected='{truth[:60]}', got='{str(parsed)[:60]}' (sim={near:.2f})"]


def value(truth, parsed, path: str = "") -> Mark:
    """SCO1, JSN5"""
    if parsed is None:
        return 0.0, [f"MISSING  {path}"]
    for kind, compare in ((dict, keys), (list, items)):
        if isinstance(truth, kind) and isinstance(parsed, kind):
            return compare(truth, parsed, path)
    if isinstance(truth, str):
        return text(truth, parsed, path)
    return (1.0, []) if truth == parsed else (0.0, [f"WRONG    {path}: expected={truth}, got={parsed}"])


def evaluated(truth: str | None, parsed: str | None) -> tuple:
    """SCO4: status, score (4 places), passed by it, issues, marks by top-level key (3 places; metadata counts but isn't listed)."""
    read = {}
    for name, given in (("truth", truth), ("parsed", parsed)):
        if given is None:
            return f"no {name}", 0.0, [], {}
        try:
            read[name] = json.loads(given)
        except ValueError:
            return f"{name} is no JSON", 0.0, [], {}
        if not isinstance(read[name], dict):
            return f"{name} is no object", 0.0, [], {}
    marks = by_path(read["truth"], read["parsed"])
    mark, issues = weighed(marks)
    return "scored", round(mark, 4), issues, {k: round(m, 3) for k, (m, _) in marks.items() if k != "metadata"}


RESULT = T.StructType().add("status", T.StringType()).add("score", T.DoubleType()).add("issues", T.ArrayType(T.StringType())).add("field_scores", T.MapType(T.StringType(), T.DoubleType()))


@F.pandas_udf(RESULT)
def evaluate(truth: pd.Series, parsed: pd.Series) -> pd.DataFrame:
    """What evaluated gives, over columns of JSON texts."""
    return pd.DataFrame([evaluated(t, p) for t, p in zip(truth, parsed, strict=True)], columns=RESULT.names)


def score_records(truth: DataFrame, parsed: DataFrame, passing: float = FLOOR) -> DataFrame:
    """SRC10, JOIN13, SCO4: cv_id, status, score, passed, issues, field_scores for each golden record.

    truth and parsed: (cv_id, record as JSON text). Parsed records without a golden one are left out, golden ones without a
    parsed one score 0 with an issue of their own. A repeated cv_id counts as often as it occurs; null ids match nothing.
    """
    prepare(truth.sparkSession)
    t = truth.select("cv_id", F.col("record").alias("truth"))
    # a file's size says little of the texts made from it: no side is sent whole through the driver
    p = parsed.select("cv_id", F.col("record").alias("parsed"), F.lit(True).alias("found")).hint("merge")
    rows = t.join(p, "cv_id", "left").select("cv_id", "found", evaluate("truth", "parsed").alias("s"))
    absent = F.array(F.concat(F.lit("FILE NOT FOUND: "), F.coalesce(F.col("cv_id").cast("string"), F.lit("")), F.lit(".json")))
    issues = F.when(F.col("found").isNull(), absent).otherwise(F.col("s.issues"))
    return rows.select("cv_id", F.col("s.status").alias("status"), F.col("s.score").alias("score"), (F.col("s.score") >= passing).alias("passed"), issues.alias("issues"), F.col("s.field_scores").alias("field_scores"))


def top_issues(results: DataFrame, most: int = 5) -> DataFrame:
    """SRT5: cv_id, the first issues of each record and how many more there are."""
    return results.select("cv_id", F.slice("issues", 1, most).alias("issues"), F.greatest(F.size("issues") - most, F.lit(0)).alias("more"))


def heatmap(results: DataFrame) -> DataFrame:
    """AGG14: section, mean, n: over the records that have the section."""
    return results.select(F.explode_outer("field_scores").alias("section", "score")).where("section is not null").groupBy("section").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))


def suite_report(results: DataFrame, least: int = 8, mean: float = 0.75) -> DataFrame:
    """SCO5, AGG13, SNK4: one row: suite_passed, mean_score (4 places), cvs_passed, cvs_total. The lines of the report are the results themselves."""
    total = results.agg(F.count_if("passed").alias("cvs_passed"), F.count("*").alias("cvs_total"), F.avg("score").alias("m"))
    return total.select(F.coalesce((F.col("cvs_passed") >= least) & (F.col("m") >= mean), F.lit(False)).alias("suite_passed"), F.coalesce(F.bround("m", 4), F.lit(0.0)).alias("mean_score"), "cvs_passed", "cvs_total")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """MTH3 over columns."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def with_ratio(rows: DataFrame, left: str, right: str, to: str = "ratio") -> DataFrame:
    """MTH3: rows with the similarity of two text columns, worked out once for each distinct pair of unequal texts that have a letter in common.

    Nulls are empty; two empty texts are alike. A column `to` is replaced.
    """
    prepare(rows.sparkSession)
    c = F.col
    text = lambda k: F.coalesce(c(k).cast("string"), F.lit(""))
    letters = lambda k: F.array_distinct(F.split(F.translate(F.lower(k), SPACES, " " * len(SPACES)), ""))
    held = rows.select(F.struct(*[x for x in rows.columns if x != to]).alias("row"), text(left).alias("mine"), text(right).alias("theirs"))
    pairs = held.select("mine", "theirs").distinct()
    plain = F.when(c("mine") == c("theirs"), 1.0).when(~F.arrays_overlap(letters("mine"), letters("theirs")), 0.0)
    pairs = pairs.withColumn("plain", plain)
    asked = pairs.where("plain is null").repartition("mine", "theirs").select("mine", "theirs", similarity("mine", "theirs").alias(to))
    known = pairs.where("plain is not null").select("mine", "theirs", c("plain").alias(to))
    return held.join(known.unionByName(asked), ["mine", "theirs"]).select("row.*", to)
