import itertools
import random
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from scrivel.llm import near_copies, simhash


def brute_gone(rows):
    def sets(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    known = [(d, sets(t)) for d, t in rows if d is not None]
    of = {d: d for d, _ in known}
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(known, 2) if 5 * len(x & y) >= 4 * len(x | y)]
    for _ in of:
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    return {d for d in of if of[d] != d}


def near_rows():
    """Texts with a growing number of changed words, chains, many near copies of one text, and short texts."""
    rng = random.Random(11)
    out = [None, "", "  ", "one two", "One  two", "one two three"]
    for n in (12, 40, 300, 1500):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        out.append(" ".join(base))
        for changed in (1, 1, 2, 3, n // 60, n // 50, n // 45, n // 40, n // 20):
            words = list(base)
            for k in rng.sample(range(n), changed):
                words[k] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(words))
    base = [f"h{k}" for k in range(60)]
    out += [" ".join(base[:k] + ["z%d" % k] + base[k + 1 :]) for k in range(60)]
    return list(enumerate(out))


def test_bits_miss_similar_texts(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    left = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()}
    gone = brute_gone(rows)
    assert {d for d, _ in rows} - left == gone
    by_bits = {r.doc_id for r in simhash.near_groups(docs).where("doc_id != component_id").collect()}
    assert gone - by_bits  # what 4 bits don't find


def test_stage_equals_brute_force(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for given in (docs, odd.select("doc_id", "text", "lang", "source", "n_chars")):
        rows = [(r.doc_id, r.text) for r in given.select("doc_id", "text").collect()]
        left = corpus_pipeline.without_near_copies(spark, given, "")
        assert {d for d, _ in rows if d is not None} - {r.doc_id for r in left.collect()} == brute_gone(rows)
        assert left.where(F.col("doc_id").isNull()).count() == sum(d is None for d, _ in rows)


def test_bounds_keep_every_similar_pair():
    rng = np.random.default_rng(4)
    for n in (1, 4, 5, 9, 100, 999):
        for _ in range(40):
            pool = np.unique(rng.integers(0, 1 << 62, 2 * n + 2, dtype=np.uint64))
            a = np.sort(rng.permutation(pool)[:n])
            lost = int(rng.integers(0, n // 9 + 1))
            b = np.unique(np.concatenate([a[lost:], rng.permutation(np.setdiff1d(pool, a))[:lost]]))
            common = np.sort(rng.permutation(pool)[: n // 2])
            rank = rng.integers(1, 9, len(common))
            if near_copies.similar(a, b):
                assert np.intersect1d(near_copies.prefix(a, common, rank), near_copies.prefix(b, common, rank)).size
                bits = [np.frombuffer(near_copies.sketch(x), np.uint64) for x in (a, b)]
                assert 9 * int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(a) + len(b)
                assert 9 * near_copies.differing(near_copies.wide_sketch(a), near_copies.wide_sketch(b)) <= len(a) + len(b)
