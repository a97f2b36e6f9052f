import zlib

import numpy as np
import public_tokenizers
import pytest

from scrivel.llm import binary, packing
from scrivel.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(text):
    return [*Encoder.of(PATH).plain(text or "").tolist(), 1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_the_library(texts):
    given = [(t or "") for t in texts] + ["<|ENDOFTEXT|>", "K İ ﬁ 日本語, Straße.", "…, a...,,", "ǅ Ǆa"]
    ids, at = Encoder(PATH, limit=3).encode([t.encode() for t in given])
    for k, t in enumerate(given):
        assert ids[at[k] : at[k + 1]].tolist() == plain(t), t[:60]
    ids, at = Encoder.of(PATH).encode([b"", b" "], end_id=None)
    assert not len(ids) and at.tolist() == [0, 0, 0]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 65, 5000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    assert binary.from_planes(binary.to_planes(ids, kind), n, kind).tolist() == ids.tolist()


def test_ids_as_read_back(docs, rows, odd, empty, spark):
    for frame, kind in ((docs, "byte"), (docs, "bit")):
        got = sorted(tuple(r) for r in binary.round_trip(frame, PATH, kind).collect())
        start, want = 0, []
        for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
            ids = plain(text)
            want.append((doc_id, start, len(ids), crc(ids)))
            start += len(ids)
        assert got == want
    got = sorted(tuple(r)[1:3] for r in binary.round_trip(odd, PATH).collect())
    assert [s for s, _ in got] == [sum(n for _, n in got[:k]) for k in range(len(got))]
    assert binary.round_trip(odd, PATH).where("doc_id is null").count() == 3
    assert binary.round_trip(empty, PATH).count() == 0


def test_blocks_are_read_by_index(tmp_path):
    with open(tmp_path / "x", "wb") as out:
        w = binary.PlaneWriter(out, "bit", block_ids=8)
        w.add([5, None], np.arange(20, dtype="<u4"), [13, 7])
        w.close()
    with open(tmp_path / "x", "rb") as source:
        r = binary.PlaneReader(source, (tmp_path / "x").stat().st_size)
        assert r.block(1).tolist() == list(range(8, 16)) and [len(d) for d in r.documents()] == [13, 7] and r.known.tolist() == [1, 0]


def test_best_fit_takes_the_fullest_bin_and_closes_the_fullest():
    b = packing.BestFit(10, 2)
    assert [b.add(n) for n in (6, 7, 3, 4, 2, 9, 9, 8)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (4, 0), (2, 2)]
    with pytest.raises(ValueError):
        b.add(11)


def check_packing(got, rows, capacity=4096):
    want = []
    for doc_id, text, *_ in rows:
        ids = plain(text)
        want += [(doc_id, k // capacity, k, len(ids[k : k + capacity]), crc(ids[k : k + capacity])) for k in range(0, len(ids), capacity)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(w[3] for w in want)


def test_packing(docs, rows, odd, empty):
    n, total = check_packing(packing.pack_documents(docs, PATH).collect(), rows)
    assert n <= -(-total // 4096) + 1
    n, total = check_packing(packing.pack_documents(docs, PATH, capacity=100, bucket_rows=16).collect(), rows, 100)
    assert n <= 1.08 * total / 100 + 12
    check_packing(packing.pack_documents(odd, PATH).collect(), [tuple(r) for r in odd.collect()])
    assert packing.pack_documents(empty, PATH).count() == 0
