"""Removal of repeated passages by super-k-mer partitioning.

A window is `width` consecutive words. Its minimiser is the smallest hash among its runs of `mer` words, so it depends
on the window's words alone, and consecutive windows mostly share it: they form a super-k-mer, which travels once, as
one packed string, to the bucket of its minimiser. All copies of a window meet in one bucket; there the windows of all
strings are sorted, equal ones lie together with the earliest first, and the others are repeats. Sorting uses 64-bit
hashes; windows with equal hashes are then compared word by word, by their bytes, so the result is exact.

What bounds a bucket: a task sorts each slice of texts it reads in the same way and lets a window travel only from its
earliest place in the slice, as all other places are repeats already. Windows of common minimisers are dealt by the
minimiser among longer runs, and by all their words where that is common too. A bucket that is over its limit even so
is dealt again, by itself, on ever longer runs into files of its task.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import lean, partitions_for, persist, prepare, whole_text
from scrivel.llm.tokens import _SPACE, slices, text_bytes

WIDTH = 20
MER = 3
BUCKET_BYTES = 2_000_000
#: A task packs slices of about so many bytes of text; a bucket with more bytes of strings than the limit is dealt again.
SLICE_BYTES = 2_000_000
BUCKET_LIMIT = 12_000_000
PARTS = 32
#: Words of the longer runs by which the windows of a very common minimiser are dealt, and the most such minimisers that
#: are told apart beforehand. Those beyond lose nothing: their buckets are dealt again where they are over the limit.
LONG_MER = 12
MOST_HOT = 50_000
#: The share of texts (by hash) that is read to find common minimisers. It moves load only: results don't depend on it.
HOT_SHARE = 16
_LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


#: Common minimisers among short and among long runs, each sorted.
Hot = tuple[np.ndarray, np.ndarray]
NO_HOT: Hot = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64))


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words in a byte array."""
    space = _SPACE[data]
    before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    return np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word, and the distinct words."""
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~_SPACE[data]])])
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_LONG = 256


class Words:
    """The words of a byte array: where they start, their lengths, a 64-bit hash of each that depends on its bytes alone."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.starts, ends = word_places(raw)
        self.ends, self.sizes = ends, (ends - self.starts).astype(np.int64)
        padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
        #: the 8 bytes from each place on
        self.eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        self.hash = mixed(self.chunk(slice(None), 0) + self.sizes.astype(np.uint64) * np.uint64(_BASE))
        on, k = np.flatnonzero((self.sizes > 8) & (self.sizes <= _LONG)), 0
        while len(on):
            k += 1
            self.hash[on] = mixed(self.hash[on] * np.uint64(_BASE) + self.chunk(on, k))
            on = on[self.sizes[on] > 8 * k + 8]
        for w in np.flatnonzero(self.sizes > _LONG).tolist():
            self.hash[w] = xxhash.xxh64_intdigest(raw[self.starts[w] : ends[w]].tobytes())

    def chunk(self, on, k: int) -> np.ndarray:
        """The k-th 8 bytes of words, zeros behind their ends."""
        return self.eight[self.starts[on] + 8 * k] & _LOW[np.clip(self.sizes[on] - 8 * k, 0, 8)]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b have the same bytes."""
        out = (self.hash[a] == self.hash[b]) & (self.sizes[a] == self.sizes[b])
        on, k = np.flatnonzero(out), 0
        while len(on):
            equal = self.chunk(a[on], k) == self.chunk(b[on], k)
            out[on[~equal]] = False
            k += 1
            on = on[equal & (self.sizes[a[on]] > 8 * k)]
        return out


def minimisers(words: Words, width: int, mer: int) -> np.ndarray:
    """The smallest mer hash of the window that starts at each word (as if all words were one document)."""
    n = len(words.hash) - mer + 1
    x = np.zeros(n, dtype=np.uint64)
    for k in range(mer):
        x = x * np.uint64(_BASE) + words.hash[k : k + n]
    x, span, want = mixed(x), 1, width - mer + 1
    while span < want:
        step = min(span, want - span)
        x = np.minimum(x[: len(x) - step], x[step:])
        span += step
    return x


def is_in(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each x is among some (sorted)."""
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x if len(some) else np.zeros(len(x), dtype=bool)


def bucket_keys(words: Words, window: np.ndarray, width: int, mer: int, hot: Hot = NO_HOT) -> np.ndarray:
    """What decides the bucket of each window: its minimiser; where that is common the one of longer runs too; then all its words."""
    low = minimisers(words, width, mer)[window]
    if (common := is_in(low, hot[0])).any():
        longer = minimisers(words, width, min(LONG_MER, width))[window]
        low = np.where(common, mixed(low ^ longer), low)
        if (common := common & is_in(longer, hot[1])).any():
            low = np.where(common, mixed(low ^ minimisers(words, width, width)[window]), low)
    return low


def earliest(words: Words, at: np.ndarray, width: int) -> np.ndarray:
    """For each window (at: its first word) the first window in the list with the same words, as a place in the list."""
    n = len(words.hash)
    powers = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, _BASE, dtype=np.uint64))))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words.hash * powers[:-1])))
    powers = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, _BASE_INVERSE, dtype=np.uint64))))
    h = (sums[at + width] - sums[at]) * powers[at]
    del sums, powers
    sort = np.argsort(h)
    new = np.concatenate((np.ones(min(1, len(h)), dtype=bool), h[sort][1:] != h[sort][:-1]))
    out = np.arange(len(h))
    if new.all():
        return out
    out[sort] = np.minimum.reduceat(sort, np.flatnonzero(new))[np.cumsum(new) - 1]
    i = np.flatnonzero(out != np.arange(len(h)))
    equal = np.ones(len(i), dtype=bool)
    for k in range(width):
        equal &= words.same(at[i] + k, at[out[i]] + k)
    if not equal.all():  # a collision: those hashes are sorted by the words themselves
        codes, _ = numbered(words.raw, words.starts, words.ends)
        own = np.flatnonzero(np.isin(h, np.unique(h[i[~equal]])))
        _, group = np.unique(np.stack([codes[at[own] + k] for k in range(width)], axis=1), axis=0, return_inverse=True)
        least = np.full(group.max() + 1, len(h))
        np.minimum.at(least, group.reshape(-1), own)
        out[own] = least[group.reshape(-1)]
    return out


def blob(doc: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray, text: bytes, repeats: np.ndarray) -> bytes:
    """Super-k-mers of one bucket: places, byte sizes and strings; and runs of windows known to be repeats (4 rows: doc, key, start, n)."""
    head = struct.pack("<QQQ", len(doc), repeats.shape[1], len(text))
    raw = b"".join(np.ascontiguousarray(x, dtype="<i8").tobytes() for x in (doc, key, start, size, repeats)) + text
    return head + zstandard.ZstdCompressor(level=1).compress(raw)


def unblob(data: bytes) -> tuple[np.ndarray, bytes, np.ndarray]:
    n, m, _ = struct.unpack("<QQQ", data[:24])
    raw = zstandard.ZstdDecompressor().decompress(data[24:])
    places = np.frombuffer(raw, dtype="<i8", count=4 * n).reshape(4, n)
    repeats = np.frombuffer(raw, dtype="<i8", count=4 * m, offset=32 * n).reshape(4, m)
    return places, raw[32 * (n + m) :], repeats


def blob_bytes(data: bytes) -> int:
    return struct.unpack("<QQQ", data[:24])[2]


NO_RUNS = np.zeros((4, 0), dtype=np.int64)


def runs_of(chosen: np.ndarray, row: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first, lengths) of the runs of chosen words that follow each other in one row, alike in `same`."""
    if not len(chosen):
        return chosen, chosen
    cut = np.ones(len(chosen), dtype=bool)
    cut[1:] = (chosen[1:] != chosen[:-1] + 1) | (row[chosen[1:]] != row[chosen[:-1]])
    for x in same:
        cut[1:] |= x[1:] != x[:-1]
    begin = np.flatnonzero(cut)
    return begin, np.diff(np.append(begin, len(chosen)))


def pack_strings(words: Words, a: np.ndarray, b: np.ndarray, place: np.ndarray, bucket: np.ndarray, runs: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of the strings of words a to b; place: doc, key and start of each. The runs go with one of them."""
    raw, size = words.raw, words.sizes + 1
    to = np.cumsum(size)  # words with one space between them
    joined = np.full(int(to[-1]), 32, dtype=np.uint8)
    keep = np.ones(len(joined), dtype=bool)
    keep[to - 1] = False
    joined[keep] = raw[~_SPACE[raw]]
    del keep
    text = joined.tobytes()
    x, y = (to - size)[a], to[b] - 1
    order = np.argsort(bucket, kind="stable")
    names, cuts = np.unique(bucket[order], return_index=True)
    with_runs = int(a.sum()) % len(names)
    for i, (name, k) in enumerate(zip(names.tolist(), np.split(order, cuts[1:]), strict=True)):
        body = b" ".join([text[s:e] for s, e in zip(x[k].tolist(), y[k].tolist(), strict=True)])
        yield name, blob(*place[:, k], y[k] - x[k], body, runs if i == with_runs else NO_RUNS)


def super_kmers(texts: list[bytes], docs: np.ndarray, keys: np.ndarray, buckets: int, width: int = WIDTH, mer: int = MER, hot: Hot = NO_HOT) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) for the super-k-mers of these texts; docs and keys say which row each text is."""
    order = np.argsort(docs, kind="stable")  # the earliest first
    texts, docs, keys = [texts[k] for k in order], docs[order], keys[order]
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    words = Words(raw)
    first = np.searchsorted(words.starts, np.concatenate(([0], np.cumsum(sizes))))
    if not len(words.starts) or np.diff(first).max() < width:
        return
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    window = np.flatnonzero(np.arange(width, len(row) + width) <= first[1:][row])
    start = window - first[row[window]]
    head = earliest(words, window, width)
    doc = docs[row[window]]
    # rows of one doc_id can lie in any order here; the same place in two of them is no repeat
    later = (doc[head] < doc) | (start[head] < start)
    if (mixed_up := (doc[head] == doc) & (start[head] > start)).any():
        least = np.full(len(window), np.iinfo(np.int64).max)
        np.minimum.at(least, head, np.where(doc == doc[head], start, np.iinfo(np.int64).max))
        later = (doc[head] < doc) | (least[head] < start)
        del least
    del mixed_up, head, doc
    again = window[later]
    begin, n = runs_of(again, row)
    again = again[begin]
    known = np.stack([docs[row[again]], keys[row[again]], again - first[row[again]], n])
    low = bucket_keys(words, window, width, mer, hot)[~later]
    window = window[~later]
    begin, n = runs_of(window, row, low)
    a = window[begin]
    place = np.stack([docs[row[a]], keys[row[a]], a - first[row[a]]])
    yield from pack_strings(words, a, a + n + width - 2, place, (low[begin] % np.uint64(buckets)).astype(np.int64), known)


def opened(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, bytes of the strings, known repeats) of blobs, the strings in the order of doc and start."""
    got = [unblob(b) for b in blobs]
    places = np.concatenate([g[0] for g in got], axis=1)
    return places, np.frombuffer(b" ".join(g[1] for g in got if len(g[1])) + b" ", dtype=np.uint8), np.concatenate([g[2] for g in got], axis=1)


def repeated_windows(blobs: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Of one bucket: runs of windows that also start earlier, as 4 rows doc, key, start, n."""
    return judged(blobs, width)[0]


def judged(blobs: list[bytes], width: int, rest: bool = False) -> tuple[np.ndarray, bytes]:
    """(runs of windows that also start earlier, if asked for a blob of the strings of all others)."""
    places, raw, known = opened(blobs)
    words = Words(raw)
    first = np.searchsorted(words.starts, np.concatenate(([0], np.cumsum(places[3] + 1))))
    order = np.lexsort((places[2], places[0]))
    doc, key, start = places[0][order], places[1][order], places[2][order]
    counts = (np.diff(first) - width + 1)[order]
    run = np.repeat(np.arange(len(order), dtype=np.int32), counts)
    step = (np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    head = earliest(words, first[:-1][order][run] + step, width)
    later = np.flatnonzero(head != np.arange(len(head)))
    i, j = later, head[later]
    # strings are in order but their windows are not: of one document a later string may begin before an earlier one ends
    at_i, at_j = start[run[i]] + step[i], start[run[j]] + step[j]
    least = np.full(len(head), np.iinfo(np.int64).max)
    least[j] = at_j
    own = doc[run[i]] == doc[run[j]]
    np.minimum.at(least, j[own], at_i[own])
    on = i[~own | (least[j] < at_i)]
    on = np.union1d(on, j[least[j] < at_j])
    begin, n = runs_of(on, run)
    s = on[begin]
    found = np.concatenate([known, np.stack([doc[run[s]], key[run[s]], start[run[s]] + step[s], n])], axis=1)
    if not rest:
        return found, b""
    left = np.setdiff1d(np.arange(len(run)), on, assume_unique=True)
    begin, n = runs_of(left, run)
    s = left[begin]
    a = first[:-1][order][run[s]] + step[s]
    place = np.stack([doc[run[s]], key[run[s]], start[run[s]] + step[s]])
    return found, next(pack_strings(words, a, a + n + width - 2, place, np.zeros(len(s), dtype=np.int64), NO_RUNS))[1]


def redealt(data: bytes, width: int, mer: int, level: int, parts: int) -> Iterator[tuple[int, bytes]]:
    """The strings of a blob, cut and dealt by the smallest of their runs of `mer` words, otherwise at each level."""
    places, raw, known = opened([data])
    words = Words(raw)
    first = np.searchsorted(words.starts, np.concatenate(([0], np.cumsum(places[3] + 1))))
    row = np.repeat(np.arange(places.shape[1], dtype=np.int32), np.diff(first))
    window = np.flatnonzero(np.arange(width, len(row) + width) <= first[1:][row])
    low = mixed(minimisers(words, width, mer)[window] + np.uint64(level))
    begin, n = runs_of(window, row, low)
    a = window[begin]
    place = np.stack([places[0][row[a]], places[1][row[a]], places[2][row[a]] + a - first[row[a]]])
    yield from pack_strings(words, a, a + n + width - 2, place, (low[begin] % np.uint64(parts)).astype(np.int64), known)


def bucket_repeats(blobs: Iterator[bytes], width: int, mer: int = MER, limit: int = BUCKET_LIMIT, parts: int = PARTS, level: int = 0) -> Iterator[np.ndarray]:
    """What repeated_windows gives for all blobs, with no more than about `limit` bytes of strings opened at a time.

    Blobs over the limit are dealt again. What is still over it after the last deal are copies of few windows: they are judged as
    they come, and of each part only the windows that start earliest go on to meet the next.
    """
    levels = (mer, min(LONG_MER, width), width, width, width)
    held, size, bar = [], 0, limit
    for data in blobs:
        held.append(data)
        size += blob_bytes(data)
        if size <= bar:
            continue
        if level < len(levels):
            break
        runs, data = judged(held, width, rest=True)
        yield runs
        held, size = [data], blob_bytes(data)
        bar = max(limit, 2 * size)
    else:
        if held:
            yield repeated_windows(held, width)
        return
    # scratch of this task: a task that is run again begins anew
    files = [tempfile.TemporaryFile() for _ in range(parts)]
    for data in itertools.chain(held, blobs):
        for part, piece in redealt(data, width, levels[level], level, parts):
            pickle.dump(piece, files[part])
    del held

    def read(file) -> Iterator[bytes]:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return

    for file in files:
        yield from bucket_repeats(read(file), width, mer, limit, parts, level + 1)
        file.close()


def common_minimisers(rows: DataFrame, buckets: int, width: int, mer: int) -> Hot:
    """Minimisers among short and long runs that have over a quarter of a bucket's share of windows, by one text in HOT_SHARE; at most MOST_HOT of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                texts = text_bytes(batch.column("text"))
                raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
                words = Words(raw)
                if len(words.starts) < width:
                    continue
                for kind, k in enumerate((mer, min(LONG_MER, width))):
                    low, n = np.unique(minimisers(words, width, k), return_counts=True)
                    often = n >= 4
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(often.sum()), kind, dtype=np.int32)), pa.array(low[often].view(np.int64)), pa.array(n[often])], ["kind", "low", "n"])

    sample = rows.where(F.pmod("text_hash", F.lit(HOT_SHARE)) == 0).select("text")
    total = sample.agg(F.sum(F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]+")))).first()[0] or 0
    found = sample.mapInArrow(lean(count), "kind int, low long, n long").groupBy("kind", "low").agg(F.sum("n").alias("n")).where(F.col("n") > max(40, total // (4 * buckets)))
    hot = [[r.low for r in found.where(F.col("kind") == k).orderBy(F.col("n").desc(), "low").limit(MOST_HOT).collect()] for k in (0, 1)]
    return tuple(np.sort(np.array(h, dtype=np.int64).view(np.uint64)) for h in hot)


def repeats(docs: DataFrame, width: int = WIDTH, mer: int = MER, bucket_bytes: int = BUCKET_BYTES, id_column: str = "doc_id", text_column: str = "text", limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id (nulls as the largest long), text_hash, start and n: runs of windows of that row whose words also start earlier."""
    spark = docs.sparkSession
    prepare(spark)
    rows = rows_of(docs, id_column, text_column)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min(total // bucket_bytes + 1, 1 << 30))
    hot = common_minimisers(rows, buckets, width, mer)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                found = list(super_kmers(text_bytes(batch.column("text")), *(batch.column(c).to_numpy() for c in ("doc_id", "text_hash")), buckets, width, mer, hot))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["bucket", "blob"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, data.as_buffer().to_pybytes()) for batch in batches for b, data in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True))
        for _, own in itertools.groupby(rows, key=lambda r: r[0]):
            for runs in bucket_repeats((data for _, data in own), width, mer, limit):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in runs], ["doc_id", "text_hash", "start", "n"])

    dealt = rows.mapInArrow(lean(deal), "bucket long, blob binary")
    return dealt.repartition(partitions_for(spark, 3 * total), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(sort), "doc_id long, text_hash long, start long, n long")


def rows_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = whole_text(text_column)
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, mer: int = MER, bucket_bytes: int = BUCKET_BYTES, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (words joined by one space) for every row.

    A word goes if a window covers it whose words also start in a row with a smaller doc_id or earlier in the same row.
    All windows are judged on the input. Null texts have no words. Rows that share a doc_id are not earlier than each
    other at the same start. A null doc_id counts as the largest. Further columns are ignored; no rows give no rows.
    """
    found = persist(repeats(docs, width, mer, bucket_bytes, id_column, text_column), "repeats")
    of_row = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    rows = rows_of(docs, id_column, text_column).join(of_row.hint("shuffle_hash"), ["doc_id", "text_hash"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, runs in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                words = text.split()
                total = len(words)
                if runs:
                    edge = np.zeros(total + 1, dtype=np.int64)
                    for r in runs:
                        edge[r["start"]] += 1
                        edge[r["start"] + r["n"] + width - 1] -= 1
                    gone = np.cumsum(edge)[:-1] > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                out.append((None if doc_id == _LAST else doc_id, total, total - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return rows.select("doc_id", "text", "runs").mapInArrow(lean(cut), schema)


__all__ = ["minimisers", "remove_repeats", "repeated_windows", "repeats", "super_kmers"]
