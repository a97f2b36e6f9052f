from itertools import product

from pyspark.sql import functions as F

from scrivel.catalogue_fuzzy import name_sentences
from scrivel.operators import personal, tagger

SF = "/root/testdata/sf0.01"


def test_names_of_unseen_sentences(spark):
    rows = name_sentences(spark, SF)
    model = tagger.train(rows.where("id % 3 <> 0"))
    held = tagger.with_model(rows.where("id % 3 = 0"), model)
    got = held.select("name", tagger.recognise(F.col("text")).alias("all"), personal.recognised(F.col("text"), tagger.recognise).alias("one")).collect()
    right = sum((r["all"] == ([r["name"]] if r["name"] else [])) for r in got)
    assert len(got) > 400 and right / len(got) > 0.95, right / len(got)
    assert sum(r.one == r.name for r in got) / len(got) > 0.9


def test_the_path_is_the_best_of_all_paths(spark):
    rows = name_sentences(spark, "/root/testdata/sf0.001")
    model = tagger.train(rows).first()
    some = [r.words for r in rows.limit(12).collect()]
    frame = spark.createDataFrame([(w[:6],) for w in some], "words array<string>")
    frame = tagger.with_model(frame, tagger.train(rows))
    weights, follows = F.col("tagger_weights"), F.col("tagger_follows")
    for r in frame.select("words", tagger.tags(F.col("words"), weights, follows).alias("t"), tagger.features(F.col("words")).alias("f")).collect():
        def value(path):
            total, before = 0.0, "^"
            for fs, s in zip(r.f, path, strict=True):
                total += model.follows.get(before + s, tagger.NEVER) + sum(model.weights[f][tagger.STATES.index(s)] for f in fs if f in model.weights)
                before = s
            return total

        best = max(value(p) for p in product(tagger.STATES, repeat=len(r.words)))
        assert abs(value(r.t) - best) < 1e-6


def test_empty(spark):
    none = spark.createDataFrame([], "words array<string>, tags array<string>")
    frame = spark.createDataFrame([("Nguyễn Văn An",), ("",), (None,)], "text string")
    got = [r[0] for r in tagger.with_model(frame, tagger.train(none)).select(tagger.recognise(F.col("text"))).collect()]
    assert got[1:] == [[], []]
