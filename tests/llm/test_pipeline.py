import corpus_pipeline
from test_near_copies import brute_gone

from scrivel.llm import exact_dedup, mixing


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = docs.union(docs.limit(5)).cache()
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, sf).cache()
        frames[name] = given
    for name in ("toxicity", "exact dedup", "near dedup", "mixing"):
        assert frames[name].columns == docs.columns
    groups = exact_dedup.exact_groups(frames["toxicity"]).where("kept")
    assert sorted(r.doc_id for r in frames["exact dedup"].collect()) == sorted(r.doc_id for r in groups.collect())
    kept = [(r.doc_id, r.text) for r in frames["exact dedup"].collect()]
    assert {r.doc_id for r in frames["near dedup"].collect()} == {d for d, _ in kept} - brute_gone(kept)
    plan = {r.doc_id: r.copies for r in mixing.mix(frames["near dedup"]).collect()}
    count = {r.doc_id: r["count"] for r in frames["mixing"].groupBy("doc_id").count().collect()}
    assert count == {d: n for d, n in plan.items() if n}
    packed = frames["packing"].collect()
    assert {r.doc_id for r in packed} == set(count)
    assert sum(1 for r in packed if r.piece == 0) == sum(count.values())


def test_odd_rows_pass(spark, odd, empty):
    for given in (odd.select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            given = stage(spark, given, "/root/testdata/sf0.001").cache()
            given.count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096 and len(used) <= sum(used.values()) / 4096 + 2


def test_repeated_ids_are_told_apart_by_their_texts(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "c"), (2, "c"), (2, "d"), (2, "d"), (None, "d"), (None, "e"), (None, "e"), (3, None), (4, ""), (5, "f")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "").replace("  ", " ")) for r in corpus_pipeline.without_copies(spark, docs, "").collect()))
    assert left == [(False, 1, "a b"), (False, 1, "c"), (False, 2, "d"), (False, 3, ""), (False, 5, "f"), (True, 0, "e")]
