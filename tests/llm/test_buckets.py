import random

import numpy as np
from test_dedup import brute_repeats

from scrivel.llm import substring_dedup


def test_earliest_place_of_rows_that_share_an_id(spark):
    rng = random.Random(11)
    words = [f"w{rng.randrange(3)}" for _ in range(400)]
    rows = [(k % 4 if k % 5 else None, " ".join(words[a : a + rng.randrange(5, 120)])) for k, a in enumerate(rng.randrange(0, 300) for _ in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, width=6, mer=2, bucket_bytes=300).collect())
    assert got == brute_repeats(rows, 6)


def test_a_bucket_many_times_its_limit_is_dealt_again(monkeypatch):
    """One minimiser holds all windows; a common passage is in each of them, so longer runs are needed too."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(14)]
    rows = []
    for k in range(120):
        own = [f"a{rng.randrange(50)}" for _ in range(30)]
        rows.append((k, " ".join(own[:15] + passage + own[15:] + (rows[k - 1][1].split()[:25] if k % 3 == 0 and k else []))))
    opened_at_once = []
    plain = substring_dedup.repeated_windows
    monkeypatch.setattr(substring_dedup, "repeated_windows", lambda blobs, width: opened_at_once.append(sum(map(substring_dedup.blob_bytes, blobs))) or plain(blobs, width))
    blobs = []
    for k in range(0, 120, 10):
        part = rows[k : k + 10]
        blobs += [x for _, x in substring_dedup.super_kmers([t.encode() for _, t in part], np.array([d for d, _ in part]), np.zeros(10, dtype=np.int64), 1, 20, 3)]
    found = list(substring_dedup.bucket_repeats(iter(blobs), 20, 3, limit=3000, parts=8))
    total = sum(map(substring_dedup.blob_bytes, blobs))
    assert len(found) > 20 and max(opened_at_once) <= 8000 < total / 5
    first, want = {}, set()
    for d, t in rows:
        w = t.split()
        for s in range(len(w) - 19):
            if first.setdefault(tuple(w[s : s + 20]), d) != d:
                want.add((d, s))
    assert {(d, s + k) for x in found for d, _, s, n in x.T.tolist() for k in range(n)} == want


def test_one_window_in_ten_thousand_slices(monkeypatch):
    """Copies of few windows can't be dealt apart: they are judged part by part, and little is open at a time."""
    opened_at_once = []
    plain = substring_dedup.judged
    monkeypatch.setattr(substring_dedup, "judged", lambda blobs, *a, **b: opened_at_once.append(sum(map(substring_dedup.blob_bytes, blobs))) or plain(blobs, *a, **b))
    window, docs = " ".join(f"w{k}" for k in range(20)), list(range(10_000))
    random.Random(2).shuffle(docs)
    text = f"{window} end".encode()

    def blobs():
        for d in docs:
            yield from (x for _, x in substring_dedup.super_kmers([text], np.array([d]), np.zeros(1, dtype=np.int64), 1, 20, 3))

    found = [x for x in substring_dedup.bucket_repeats(blobs(), 20, 3, limit=5000, parts=2)]
    got = sorted((d, s + k) for x in found for d, _, s, n in x.T.tolist() for k in range(n))
    assert got == [(d, s) for d in range(1, 10_000) for s in (0, 1)]
    assert max(opened_at_once) < 6000
