import numpy as np
from pyspark.sql import functions as F

from scrivel.llm import toxicity


def test_texts_without_a_label_take_part(spark, monkeypatch):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    seen = {}
    descend = toxicity.descend

    def noted(known, x_p, x, prior, *a):
        seen.update(known=known, x_p=x_p, x=x, prior=prior)
        return descend(known, x_p, x, prior, *a)

    monkeypatch.setattr(toxicity, "descend", noted)
    toxicity.train(docs, labels)
    usable = labels.where("toxic is not null").where(~toxicity.held_out())
    free = docs.where(~toxicity.held_out()).join(usable, "doc_id", "left_anti")
    texts = [(r.text or "").encode() for r in free.collect()]
    marked = docs.join(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    labelled, toxic = [(r.text or "").encode() for r in marked], [(r.text or "").encode() for r in marked if r.toxic == 1]
    rows = lambda x: sorted(map(bytes, np.ascontiguousarray(x, dtype=np.float32)))
    plain = lambda ts: toxicity.inputs(*toxicity.count_features(ts, seen["known"]))
    assert rows(seen["x"]) == rows(plain(texts + labelled)) and len(texts) > 100
    assert rows(seen["x_p"]) == rows(plain(toxic))
    every = texts + labelled
    assert seen["known"] == toxicity.choose_features(toxic + every, np.arange(len(toxic) + len(every)) < len(toxic), unlabelled=np.arange(len(toxic) + len(every)) >= len(toxic))
    by_id = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs, "doc_id")
    assert abs(seen["prior"] - by_id.agg(F.avg("toxic")).first()[0]) < 1e-9
    before = toxicity.train(docs, labels)
    changed = docs.join(usable.select("doc_id").distinct().withColumn("has", F.lit(1)), "doc_id", "left").withColumn("text", F.when(F.col("has").isNull(), F.lit("other words")).otherwise(F.col("text"))).drop("has")
    after = toxicity.train(changed, labels)
    assert not (before.known == after.known and np.array_equal(before.weights, after.weights))
