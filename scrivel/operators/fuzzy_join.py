"""JOIN6, MTH5: texts and labels whose weighted ratio reaches a floor, without scoring every pair.

A score of the floor needs letters in common. Of two texts, the shorter one must find at least `least_common` of its letters in the
longer one, whichever of the score's parts decides, unless both share a word. So of the shorter one's letters, numbered by occurrence and
taken from the rarest on, one of the first few must be in the longer one: an inverted index of letters finds these pairs, an index of
words the others. What is found is held against the exact number of common letters and pairs of letters, and only what could
still reach the floor is scored, once for each distinct pair.

Null and empty texts match nothing. Texts over eight times as long as a label, or the reverse, can't reach a floor over 60, which is why a floor must be over that.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivel.functions.fuzzy import wratio
from scrivel.functions.text import SPACES, bound
from scrivel.streaming.shared import prepare, written

#: Weights of the parts of the score: tokens, texts of unlike length; and the ratios of length that choose between them.
TOKENS, UNLIKE, FROM_RATIO, TO_RATIO = 0.95, 0.9, 1.5, 8.0
_GAP = "[" + "".join(f"\\x{{{ord(x):x}}}" for x in SPACES) + "]+"


def needs(floor: float) -> tuple[float, float, float]:
    """(share of both lengths that a whole comparison needs in common, share of the shorter one that a piece needs, the same for pairs of letters).

    A comparison with a piece of the longer text scores 200 * common / (n + piece), and a piece has no fewer letters than are common.
    Of the pairs of neighbours in the shorter text each letter that is lost breaks two and each that is put in breaks one.
    """
    if not 60 < floor <= 100:
        raise ValueError("the floor of a fuzzy join must be over 60")
    part = floor / (200 * UNLIKE)
    piece = part / (1 - part)
    return floor / 200, piece, (3 * part - 1) * (1 + piece)


def _numbered(grams: Column) -> Column:
    """Each gram with the number of its occurrence, so that sets of them meet as often as the grams do."""
    return bound(F.array_sort(grams), lambda g: F.transform(g, lambda x, i: F.concat(x, (i - F.array_position(g, x) + 1).cast("string"))))


def _letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_GAP.replace("[", "([^", 1).replace("]+", "])")), F.lit(1))


def _pairs(text: Column) -> Column:
    return F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def profile(rows: DataFrame, column: str, share: float) -> DataFrame:
    """Adds to distinct texts what bounds their scores: words, letters, pairs (of the text, its sorted and its sorted distinct words), sizes, and `least`."""
    c = F.col
    words = F.filter(F.split(column, _GAP), lambda x: x != "")
    p = rows.withColumn("words", words).withColumn("forms", F.array(c(column), F.array_join(F.array_sort("words"), " "), F.array_join(F.array_sort(F.array_distinct("words")), " ")))
    p = p.withColumns({"words": F.when(F.size("words") > 0, F.array_distinct("words")).otherwise(F.array(F.lit(""))), "letters": _numbered(_letters(c(column))), "pairs": F.transform("forms", lambda x: _numbered(_pairs(x))), "sizes": F.transform("forms", F.length)})
    p = p.withColumn("gaps", F.transform("forms", lambda x: F.length(x) - F.size(_letters(x))))
    own = F.transform(F.arrays_zip("sizes", "gaps"), lambda x: F.ceil(x["sizes"] * share - x["gaps"] - 1e-9))
    return p.withColumn("least", F.greatest(F.array_min(own), F.lit(1)).cast("int")).drop("forms")


def candidates(texts: DataFrame, names: DataFrame, floor: float) -> DataFrame:
    """picklist_id, text, name: distinct pairs that may reach the floor, and all that do."""
    c = F.col
    whole, piece, double = needs(floor)
    share = min(piece, 2 * whole)  # a whole comparison needs its share of two texts, neither of which is shorter
    longest = names.groupBy("picklist_id").agg((F.max(F.length("name")) * TO_RATIO).alias("most"))
    asked = texts.where("text != ''").select("picklist_id", "text").distinct().join(longest, "picklist_id").where(F.length("text") <= c("most")).drop("most")
    left = profile(asked, "text", share)
    right = profile(names.where("name != ''").select("picklist_id", "name").distinct(), "name", share)
    often = right.select("picklist_id", F.explode("letters").alias("letter")).groupBy("picklist_id", "letter").agg(F.count("*").alias("often"))

    def listed(side: DataFrame, key: str, size: str) -> DataFrame:
        """A row for each letter, with `rare` if it is among the rarest that must hold a common one."""
        one = side.select("picklist_id", key, c("sizes").alias(size), "least", F.size("letters").alias("n"), F.explode("letters").alias("letter")).join(often, ["picklist_id", "letter"], "left")
        ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "letter")))
        by = one.groupBy("picklist_id", key).agg(F.first(size).alias(size), F.first(c("n") - c("least") + 1).alias("first"), ranked.alias("letters"))
        return by.select("picklist_id", key, size, "first", F.posexplode("letters").alias("rank", "l")).select("picklist_id", key, size, (c("rank") < c("first")).alias(f"rare_{key}"), c("l.letter").alias("letter"), c("l.often").alias("often")).where("often > 0").drop("often")

    shorter = lambda a, b: F.exists(F.arrays_zip(c(a), c(b)), lambda x: x[a] <= x[b])
    mine, theirs, on = written(listed(left, "text", "ts"), "text-letters"), written(listed(right, "name", "ns"), "name-letters"), ["picklist_id", "letter"]
    # the common letters of one side meet the rare ones of the other only
    met = mine.where("rare_text").join(theirs, on).where(shorter("ts", "ns")).select("picklist_id", "text", "name")
    met = met.unionByName(mine.join(theirs.where("rare_name"), on).where(shorter("ns", "ts")).select("picklist_id", "text", "name"))
    said = left.select("picklist_id", "text", F.explode("words").alias("word")).join(right.select("picklist_id", "name", F.explode("words").alias("word")), ["picklist_id", "word"]).select("picklist_id", "text", "name")
    # texts that are mostly white space may have nothing but that in common with others
    bare, any_ = lambda side, key: side.where(F.element_at("gaps", 1) >= F.size("letters")).select("picklist_id", key), lambda side, key: side.where(F.element_at("gaps", 1) > 0).select("picklist_id", key)
    blank = bare(left, "text").join(any_(right, "name"), "picklist_id").unionByName(any_(left, "text").join(bare(right, "name"), "picklist_id").select("picklist_id", "text", "name"))
    pairs = met.unionByName(said).unionByName(blank).distinct()
    seen = lambda side, key, to: side.select("picklist_id", key, *(c(x).alias(f"{to}_{x}") for x in ("words", "letters", "pairs", "sizes", "gaps")))
    held = pairs.join(seen(left, "text", "t"), ["picklist_id", "text"]).join(seen(right, "name", "n"), ["picklist_id", "name"])
    return held.where(_may_reach(whole, piece, double)).select("picklist_id", "text", "name")


def _may_reach(whole: float, piece: float, double: float) -> Column:
    c, tiny = F.col, 1e-9
    of = lambda x, k: F.get(c(x), F.lit(k))
    low, high = F.least(of("t_sizes", 0), of("n_sizes", 0)), F.greatest(of("t_sizes", 0), of("n_sizes", 0))
    like = high < FROM_RATIO * low
    both = F.array_intersect("t_words", "n_words")

    def by_words(w: Column) -> Column:
        """Shared words decide between texts of unlike length; else all of one text's words must be shared, or enough letters beside those of either text."""
        length = F.aggregate(w, F.lit(-1), lambda n, x: n + F.length(x) + 1)
        enough = length * 2 * TOKENS >= (length + F.least(of("t_sizes", 2), of("n_sizes", 2))) * (2 * whole) - tiny
        whole_text = (F.size(w) == F.size("t_words")) | (F.size(w) == F.size("n_words"))
        return (F.size(w) > 0) & (high <= TO_RATIO * low) & (~like | whole_text | enough)

    share = bound(both, by_words)

    def form(k: int, common: Column) -> Column:
        a, b = of("t_sizes", k), of("n_sizes", k)
        letters = common + F.least(of("t_gaps", k), of("n_gaps", k))
        all_ = letters >= (a + b) * (whole if k == 0 else whole / TOKENS) - tiny
        in_part = ~like & (high <= TO_RATIO * low) & (letters >= F.least(a, b) * piece - tiny)
        in_part = in_part & (F.size(F.array_intersect(of("t_pairs", k), of("n_pairs", k))) >= F.least(a, b) * double - 1 - tiny)
        return in_part | (all_ if k == 0 else all_ & like)

    forms = bound(F.size(F.array_intersect("t_letters", "n_letters")), lambda n: form(0, n) | form(1, n) | form(2, n))
    return share | forms


@F.pandas_udf(T.DoubleType())
def score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([wratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similar(texts: DataFrame, names: DataFrame, floor: float = 70.0) -> DataFrame:
    """picklist_id, text, name, score of all distinct pairs (picklist_id, text) and (picklist_id, name) that reach the floor."""
    prepare(texts.sparkSession)
    return candidates(texts, names, floor).repartition("picklist_id", "text", "name").withColumn("score", score("text", "name")).where(F.col("score") >= floor)


def least_common(length: int, floor: float = 70.0) -> int:
    """How many letters of a text without spaces a longer one must hold."""
    whole, piece, _ = needs(floor)
    return math.ceil(length * min(piece, 2 * whole) - 1e-9)
