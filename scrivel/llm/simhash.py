"""SimHash near-duplicates: fingerprints, a binary trie self-join for links, and their components.

A link is a pair of fingerprints that differ in at most `budget` bits. Two such fingerprints agree on some block
(or some blocks) of bits, so the fingerprints are dealt by block: in each bucket, bits are permuted so that the
block comes first, which makes the bucket a subtree of one binary trie. That trie is joined with itself: node pairs
are walked together from the top, the bits in which the two paths differ are added up, and a pair over the budget is
dropped with all below it. Equal fingerprints are one node from the start, and a pair of nodes whose fingerprints are
already known to be connected is dropped too, so a group of near copies costs no quadratic work.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import Workspace, lean, persist, prepare, whole_text
from scrivel.llm.tokens import text_bytes

BUDGET = 4
SHINGLE = 4
SEED = 42
#: (blocks, how many of them are shared): any 4 differing bits leave that many blocks untouched.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the shingles in order, repeats included: lower case in A-Z, the whole sequence if there are fewer words."""
    words = text.lower().split()
    n = len(words)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([digest(joined, seed)], dtype="<u8")
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - shingle + 1].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")


def bits_of(h: np.ndarray) -> int:
    """64 bits, as an unsigned number: bit k is set if it is in over half the hashes."""
    octets = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 2000:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The bits of the text's shingles; 0 without words."""
    return bits_of(shingle_hashes(text, shingle, seed)) if text.strip() else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row; null texts count as empty."""
    prepare(docs.sparkSession)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in text_bytes(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return rows.mapInArrow(lean(marked), "doc_id long, fp long")


def layout(n: int, budget: int = BUDGET) -> list[tuple[list[int], list[tuple[int, int]]]]:
    """Tables of blocks for n fingerprints: for each, the shared blocks, and all blocks as (shift, width).

    With b blocks and at most `budget` differing bits, b - budget blocks are equal. The more fingerprints, the more
    blocks are shared: 1 of 5 up to a few million, 2 of 6 up to hundreds of millions, 3 of 7 beyond.
    """
    for shared in range(1, 5):
        blocks = budget + shared
        if n <= 256 << (64 * shared // blocks) or shared == 4:
            break
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    fields = [(a, b - a) for a, b in itertools.pairwise(cuts)]
    return [(list(c), fields) for c in itertools.combinations(range(blocks), shared)]


def permuted(fp: np.ndarray, shared: list[int], fields: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.uint64)
    for k in [*shared, *(k for k in range(len(fields)) if k not in shared)]:
        shift, width = fields[k]
        out = (out << np.uint64(width)) | ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


class Components:
    """Connected places of an array, as the smallest place of each component."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.changes = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                break
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(self.of, up := self.of[self.of]):
                self.of = up
        self.changes = np.cumsum(np.concatenate(([0], self.of[1:] != self.of[:-1]))) if len(self.of) else self.of

    def within(self, u_lo, u_hi, v_lo, v_hi) -> np.ndarray:
        """Whether both ranges lie in one component."""
        c = self.changes
        return (c[u_hi - 1] == c[u_lo]) & (c[v_hi - 1] == c[v_lo]) & (self.of[u_lo] == self.of[v_lo])


def trie_join(values: np.ndarray, starts: np.ndarray, depth: int, budget: int = BUDGET, chunk: int = 1 << 15, leaf: int = 64, labels: np.ndarray | None = None, told=None) -> np.ndarray:
    """values: sorted within each range that begins at starts; ranges share their first `depth` bits.

    Gives for each place the smallest place it is connected with inside its range, by pairs within the budget.
    Pairs of small nodes are compared value by value. The pairs still to be walked are kept as a stack of chunks, so
    memory doesn't grow with their number. With labels, places of one label count as connected and pairs within the
    budget connect no others: told(i, j) gets all of them that have different labels, some at a time.
    """
    n = len(values)
    parts = Components(n)
    ends = np.append(starts[1:], n)
    if labels is None:
        bucket = np.repeat(np.arange(len(starts)), ends - starts)
        next_ = np.flatnonzero(bucket[1:] == bucket[:-1])
        close = next_[np.bitwise_count(values[next_] ^ values[next_ + 1]) <= budget]
        parts.link(close, close + 1)
    else:
        parts.of = labels
        parts.link(starts[:0], starts[:0])
    ones: dict[int, np.ndarray] = {}
    big = ends - starts > 1
    stack = [(depth, starts[big], ends[big], starts[big], ends[big], np.zeros(int(big.sum()), dtype=np.int8))]
    while stack:
        level, ul, uh, vl, vh, err = stack.pop()
        if len(ul) > chunk:
            stack += [(level, *(x[k : k + chunk] for x in (ul, uh, vl, vh, err))) for k in range(0, len(ul), chunk)]
            continue
        live = ~parts.within(ul, uh, vl, vh)
        ul, uh, vl, vh, err = (x[live] for x in (ul, uh, vl, vh, err))
        small = ((uh - ul) * (vh - vl) <= leaf) | (level == 64)
        if small.any():
            a, b, c, d = (x[small] for x in (ul, uh, vl, vh))
            size = (b - a) * (d - c)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat(d - c, size)
            i, j = np.repeat(a, size) + at // wide, np.repeat(c, size) + at % wide
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any() and labels is None:
                parts.link(i[near], j[near])
            elif near.any():
                near &= (labels[i] != labels[j]) & (i < j)
                told(i[near], j[near])
            ul, uh, vl, vh, err = (x[~small] for x in (ul, uh, vl, vh, err))
        if not len(ul):
            continue
        if level not in ones:
            ones[level] = np.concatenate(([0], np.cumsum((values >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int64)))
        count = ones[level]
        um, vm = uh - (count[uh] - count[ul]), vh - (count[vh] - count[vl])
        same = (ul == vl) & (uh == vh)
        more = err + np.int8(1)
        pairs = [(ul, um, vl, vm, err), (um, uh, vm, vh, err), (ul, um, vm, vh, more), (um[~same], uh[~same], vl[~same], vm[~same], more[~same])]
        columns = [np.concatenate(x) for x in zip(*pairs, strict=True)]
        ul, uh, vl, vh, err = columns
        keep = (uh > ul) & (vh > vl) & (err <= budget) & ~((ul == vl) & (uh - ul == 1))
        if keep.any():
            stack.append((level + 1, *(x[keep] for x in columns)))
    return parts.of


def links(nodes: DataFrame, n: int, budget: int = BUDGET, batch_rows: int = 200_000) -> DataFrame:
    """Links (a, b), enough of them to connect what the budget connects, between rows (node, fp) with distinct fp. n: their number.

    A task holds the buckets it reads one after the other, at most about batch_rows fingerprints besides one bucket.
    """
    tables = layout(n, budget)

    def key(shared: list[int], fields: list[tuple[int, int]]):
        return F.xxhash64(*(F.shiftrightunsigned("fp", fields[k][0]).bitwiseAND((1 << fields[k][1]) - 1) for k in shared))

    dealt = nodes.select("node", "fp", F.posexplode(F.array(*(key(*t) for t in tables))).alias("tab", "key"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def work(rows: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            for tab in np.unique(rows[0]):
                of = rows[:, rows[0] == tab]
                shared, fields = tables[int(tab)]
                values = permuted(of[2].view(np.uint64), shared, fields)
                order = np.argsort(values, kind="stable")
                values, node = values[order], of[3][order]
                depth = sum(fields[k][1] for k in shared)
                top = values >> np.uint64(64 - depth)
                starts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
                root = trie_join(values, starts, depth, budget)
                moved = np.flatnonzero(root != np.arange(len(root)))
                a.append(node[moved])
                b.append(node[root[moved]])
            x, y = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tab", "key", "fp", "node")]))
            size += batch.num_rows
            if size > batch_rows:
                rows = np.concatenate(held, axis=1)
                last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])  # that bucket may go on in the next batch
                if not last.all():
                    yield work(rows[:, ~last])
                    held = [rows[:, last]]
                    size = int(last.sum())
        if held:
            yield work(np.concatenate(held, axis=1))

    found = dealt.repartition("tab", "key").sortWithinPartitions("tab", "key").mapInArrow(lean(joined), "a long, b long")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b): alternating large and small stars.

    Each round is two aggregations and two joins on a shrinking table of links, written to the shared folder, so there
    is no long lineage and nothing comes to the driver but a checksum; the tables before the last are deleted. The
    number of rounds is logarithmic.
    """
    space = Workspace(edges.sparkSession, "components")

    def star(pairs: DataFrame) -> DataFrame:
        # every neighbour, and the node itself, is hung on the smallest of them
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return pairs.join(least, "u")

    def mark(table: DataFrame) -> tuple:
        r = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = space.persist(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = space.persist(star(both).where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "links")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        hung = star(down)
        small = hung.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(hung.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b")
        before, now = now, space.persist(small.distinct(), "links")
        space.drop(before, large)
        if (after := mark(now)) == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_groups(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    Texts are lower-cased in A-Z; shingles are of `shingle` words, repeats included, the whole sequence if there are
    fewer; a text without words (null, empty) has fingerprint 0, which links like any other. component_id is the
    smallest doc_id that links lead to. Rows of one doc_id count as one document. A null doc_id takes its
    component_id from an equal fingerprint that has an id, else null, and links nothing. Further columns are ignored.
    """
    marked = persist(fingerprints(docs, shingle, seed, id_column, text_column), "fingerprints")
    nodes = persist(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
    linked = nodes.where("node is not null")
    found = components(links(linked, linked.count(), budget).union(shared_ids(marked)))
    of_fp = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shared_ids(marked: DataFrame) -> DataFrame:
    """Links between the fingerprints' first documents where rows with one doc_id have several fingerprints."""
    several = marked.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x != y").select("doc_id")
    fps = marked.join(several, "doc_id", "left_semi").select("doc_id", "fp").distinct()
    least = marked.join(fps.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("node"))
    return fps.join(least, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a != b")


__all__ = ["bits_of", "components", "fingerprint", "fingerprints", "layout", "links", "near_groups", "permuted", "shingle_hashes", "trie_join"]
