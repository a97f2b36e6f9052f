"""TVF19: persons' names in running text by a tagger that is trained from marked sentences.

Each word is outside a name, begins one, or goes on with one. How likely a word is under each of these is counted from its
features (its shape, its last letters, the words beside it, whether it is a known family name), and so is how they follow each other;
counting is one aggregate over the words, smoothed, and the model one row of two maps. The best sequence for a text is found by
Viterbi's programme in a fold over its words. Everything is a column expression.

Null texts have no names; sentences without words teach nothing; a feature that was never seen counts alike for all three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivel.functions import rules as R
from scrivel.functions.text import bound, fold

STATES = ("O", "B", "I")
SMOOTHING = 0.5
#: Features seen less often teach nothing; this bounds the model by the words of the language rather than by the sentences.
LEAST = 3
NEVER = -1e9


def words_of(text: Column) -> Column:
    """The words of a text with their marks of punctuation apart."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}[\p{L}\p{M}'’-]*|\d+|[^\s\p{L}\d]"), F.lit(0))


def _shape(w: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.left(w, F.lit(12)), r"\p{Lu}", "X"), r"\p{Ll}+", "x"), r"\d+", "9")


def features(words: Column) -> Column:
    """For each word an array of its features."""
    known = F.array(*map(F.lit, sorted({fold_plain(x) for x in R.FAMILY_NAMES})))

    def of(w: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(words, i - 1)).otherwise("^")
        after = F.coalesce(F.get(words, i + 1), F.lit("$"))
        low = fold(w)
        return F.array(F.concat(F.lit("s:"), _shape(w)), F.concat(F.lit("e:"), F.right(F.lower(w), F.lit(3))), F.concat(F.lit("b:"), F.lower(before)), F.concat(F.lit("a:"), F.lower(after)), F.concat(F.lit("c:"), F.lower(w), F.lit(" "), F.lower(after)), F.concat(F.lit("p:"), _shape(before), F.lit("/"), _shape(w), F.lit("/"), _shape(after)), F.concat(F.lit("f:"), F.array_contains(known, low).cast("string")))

    return F.transform(words, of)


def fold_plain(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def train(sentences: DataFrame) -> DataFrame:
    """One row: weights (feature to the log likelihoods of the three states) and follows (two states to a log likelihood), from words and tags (arrays alike long)."""
    c = F.col
    w = sentences.select(F.posexplode(F.arrays_zip(features(c("words")).alias("f"), c("tags").alias("t"))).alias("i", "x"), "tags").select("i", "tags", c("x.f").alias("f"), c("x.t").alias("t"))
    totals = {s: F.count_if(c("t") == s).alias(s) for s in STATES}
    by = w.select("t", F.explode("f").alias("feature")).groupBy("feature").agg(*totals.values())
    sums = w.agg(*totals.values())
    seen = by.where(sum(c(s) for s in STATES) >= LEAST)
    of = [F.log((c(s) + SMOOTHING) / (sums.select(s).scalar() + SMOOTHING * 100)) for s in STATES]
    weights = seen.select("feature", F.array(*of).alias("w")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "w")))).alias("weights"))
    steps = w.select(F.when(c("i") > 0, F.get("tags", c("i") - 1)).otherwise("^").alias("from"), "t")
    counts = steps.groupBy("from").agg(F.count("*").alias("n"), *totals.values())
    pairs = F.flatten(F.collect_list(F.array(*(F.struct(F.concat(c("from"), F.lit(s)).alias("step"), F.log((c(s) + SMOOTHING) / (c("n") + SMOOTHING * len(STATES))).alias("v")) for s in STATES))))
    follows = counts.agg(F.map_from_entries(F.array_sort(pairs)).alias("follows"))
    return weights.select("weights", follows.scalar().alias("follows"))


def tags(words: Column, weights: Column, follows: Column) -> Column:
    """The likeliest state of each word."""
    number = {s: k for k, s in enumerate(STATES)}
    step = lambda a, b: F.coalesce(F.try_element_at(follows, F.lit(a + b)), F.lit(NEVER))
    # a look into a map goes through its keys, so each feature is looked up once for all states
    found = lambda fs: F.array_compact(F.transform(fs, lambda f: F.try_element_at(weights, f)))
    sums = lambda ws: F.aggregate(ws, F.struct(*(F.lit(0.0).alias(s) for s in STATES)), lambda a, w: F.struct(*((a[s] + F.get(w, F.lit(number[s]))).alias(s) for s in STATES)))
    marks = F.transform(features(words), lambda fs: sums(found(fs)))

    def forward(a: Column, x: Column) -> Column:
        first = F.size(a["back"]) == 0
        into = {s: F.when(first, F.struct(step("^", s).alias("v"), F.lit(0).alias("k"))).otherwise(F.array_max(F.array(*(F.struct((a[p] + step(p, s)).alias("v"), F.lit(number[p]).alias("k")) for p in STATES)))) for s in STATES}
        return F.struct(*((into[s]["v"] + x[s]).alias(s) for s in STATES), F.concat(a["back"], F.array(F.array(*(into[s]["k"] for s in STATES)))).alias("back"))

    start = F.struct(*(F.lit(0.0).alias(s) for s in STATES), F.array().cast("array<array<int>>").alias("back"))

    def path(a: Column) -> Column:
        last = F.array_max(F.array(*(F.struct(a[s].alias("v"), F.lit(k).alias("k")) for k, s in enumerate(STATES))))["k"]
        walk = F.aggregate(F.reverse(a["back"]), F.struct(last.alias("k"), F.array().cast("array<int>").alias("out")), lambda b, x: F.struct(F.get(x, b["k"]).alias("k"), F.concat(F.array(b["k"]), b["out"]).alias("out")))
        return F.transform(walk["out"], lambda k: F.get(F.array(*map(F.lit, STATES)), k))

    return F.aggregate(marks, start, forward, path)


def names(text: Column, weights: Column, follows: Column) -> Column:
    """The names in a text, in order, their words joined by spaces."""

    def spans(w: Column, t: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(t, i) == "B")
        end = lambda i: F.coalesce(F.get(F.filter(F.sequence(i + 1, F.size(w)), lambda j: F.coalesce(F.get(t, j), F.lit("O")) != "I"), F.lit(0)), F.size(w))
        return F.transform(begins, lambda i: F.array_join(F.slice(w, i + 1, end(i) - i), " "))

    return bound(words_of(text), lambda w: F.when(F.size(w) > 0, bound(tags(w, weights, follows), lambda t: spans(w, t))).otherwise(F.array().cast("array<string>")))


def with_model(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Rows with the model's one row beside them, in columns tagger_weights and tagger_follows, for `recognise`."""
    return rows.withColumns({"tagger_weights": model.select("weights").scalar(), "tagger_follows": model.select("follows").scalar()})


def recognise(text: Column) -> Column:
    """A recogniser for `personal.recognised`, over rows that have a model."""
    return names(text, F.col("tagger_weights"), F.col("tagger_follows"))
