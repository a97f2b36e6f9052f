import hashlib
import itertools
import random
import re

import numpy as np
import xxhash

from scrivel.llm import exact_dedup, simhash, substring_dedup

NONE = 1 << 63


def groups(rows):
    by = {}
    for doc_id, text, *_ in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    return by


def test_exact_groups(docs, rows, odd, empty):
    got = {r.doc_id: tuple(r)[1:] for r in exact_dedup.exact_groups(docs).collect()}
    want = {d: (min(ids), len(ids), d == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups(rows).items() for d in ids}
    assert got == want
    got = exact_dedup.exact_groups(odd).collect()
    by = groups(odd.collect())
    assert len(got) == odd.count() and sum(r.kept for r in got) == len(by)
    for r in got:
        ids = next(ids for t, ids in by.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert exact_dedup.exact_groups(empty).count() == 0


def test_tries_spill_by_subtree():
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    for limit in (10**9, 30_000, 1000):
        owners = exact_dedup.Owners(limit)
        for k, key in enumerate(keys):
            owners.add(key, (k,), (k % 97, k), 1)
        got = {tag: (best, n, best[1] == tag) for tags, best, n in owners.results() for tag in tags}
        for k, key in enumerate(keys):
            same = [(j % 97, j) for j, other in enumerate(keys) if other == key]
            assert got[k] == (min(same), len(same), min(same) == (k % 97, k))


def test_copies_count_towards_the_memory_of_tries():
    owners = exact_dedup.Owners(20_000)
    for k in range(5000):
        owners.add(b"ab"[k % 2 : k % 2 + 1] * 9, (k,), (k, k), 1)
    assert owners.away and owners.bytes < 20_000
    assert sorted((best, n, len(tags)) for tags, best, n in owners.results()) == [((0, 0), 2500, 2500), ((1, 1), 2500, 2500)]


def test_patricia_splits_labels():
    trie = exact_dedup.Patricia()
    for word in (b"romane", b"romanus", b"roman", b"", b"rom", b"romane"):
        trie.add(word, (len(word),), 1)
    assert trie.add(b"romane", (0,), 0).count == 2 and trie.add(b"rom", (9,), 0).best == (3,) and trie.root.count == 1


def brute_fingerprint(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, budget=4):
    of = {i: i for i in ids}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for (i, x), (j, y) in itertools.combinations(list(zip(ids, fps, strict=True)), 2):
        if (x ^ y).bit_count() <= budget:
            a, b = sorted((root(i), root(j)))
            of[b] = a
    return {i: root(i) for i in ids}


def test_near_groups(docs, rows, odd, empty, spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()}
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components(ids, fps)
    assert got == {i: (f"{f:016x}", comp[i]) for i, f in zip(ids, fps, strict=True)}
    assert len(set(comp.values())) < len(ids) - 10
    found = simhash.near_groups(odd)
    assert found.count() == odd.count() and found.where("doc_id is null and component_id is not null").count() == 2
    assert {(r.doc_id, r.component_id) for r in found.where("doc_id is not null").collect()} == set(comp.items())
    assert simhash.near_groups(empty).count() == 0
    long_text = " ".join(f"w{k % 777}" for k in range(5000))
    assert simhash.fingerprint(long_text.encode()) == brute_fingerprint(long_text)


def test_trie_join_equals_brute_force():
    rng = np.random.default_rng(3)
    for n, flips in ((300, 3), (900, 2), (40, 6)):
        centres = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
        values = centres[rng.integers(0, 12, n)]
        for _ in range(flips):
            values = values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        values = np.unique(values)
        for chunk, leaf in ((1 << 15, 64), (16, 1)):
            root = simhash.trie_join(values, np.array([0]), 0, 4, chunk, leaf)
            assert root.tolist() == list(brute_components(list(range(len(values))), [int(v) for v in values]).values())


def test_layouts_cover_every_pair():
    rng = random.Random(5)
    for n in (10, 10**8, 10**11):
        tables = simhash.layout(n)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(all((x ^ y) >> fields[k][0] & ((1 << fields[k][1]) - 1) == 0 for k in shared) for shared, fields in tables)
    fp = np.array([x, y], dtype=np.uint64)
    out = simhash.permuted(fp, *tables[3])
    assert int(out[0] ^ out[1]).bit_count() == 4


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    of = {}
    nodes = sorted({x for e in edges for x in e})
    of = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    assert got == {x: r for x, r in of.items() if sum(1 for y in of.values() if y == r) > 1}


def brute_repeats(rows, width):
    docs = [(d if d is not None else NONE, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows]
    first = {}
    for d, w in docs:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, (NONE + 1, 0)), (d, k))
    out = []
    for d, w in docs:
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (d, k):
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d if d != NONE else -1, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substrings(docs, rows, odd, empty, monkeypatch):
    def run(frame, **options):
        return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame, **options).collect())

    want = brute_repeats(rows, 20)
    assert sum(r[2] for r in want) > 1000
    assert run(docs) == want
    assert run(docs, bucket_bytes=500) == want
    assert run(docs, width=6, mer=2, bucket_bytes=300) == brute_repeats(rows, 6)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 1)
    hot = substring_dedup.common_minimisers(substring_dedup.rows_of(docs, "doc_id", "text"), 400, 20, 3)
    assert len(hot)
    monkeypatch.setattr(substring_dedup, "common_minimisers", lambda *a: hot)
    assert run(docs, bucket_bytes=500) == want
    monkeypatch.undo()
    assert run(odd) == brute_repeats([tuple(r) for r in odd.collect()], 20)
    assert run(empty) == []


def test_hash_collisions_are_settled_by_the_words(monkeypatch):
    texts = [b" ".join(b"%d" % (k * j % 11) for k in range(60)) for j in range(1, 9)] * 2
    ids, keys = np.arange(16), np.zeros(16, dtype=np.int64)
    blobs = {}
    for b, x in substring_dedup.super_kmers(texts, ids, keys, 1, 5, 2):
        blobs.setdefault(b, []).append(x)
    right = substring_dedup.repeated_windows(blobs[0], 5)
    monkeypatch.setattr(substring_dedup, "mixed", lambda x: np.ones_like(x))  # every word hashes alike
    wrong = substring_dedup.repeated_windows(blobs[0], 5)
    spread = lambda found: {(d, s + k) for d, _, s, n in found.T.tolist() for k in range(n)}
    assert spread(right) == spread(wrong)
