"""Near copies: SimHash trie self-joins at a wide error budget, settled by the exact similarity of word shingles.

Texts whose shingle sets have a similarity of LEAST / OF or more differ in about 15 % of the bits of a fingerprint, up to
20 of 64 and more. At such a budget no block of bits has to stay equal, so fingerprints are dealt by shingles instead: if
two sets are similar enough, the first shingle that they share is among the first fifth of either, in an order that
all texts have in common and that puts common shingles last. Each group that shares such a shingle is joined
with itself by the binary trie of op6, which drops node pairs over the budget. Sizes, places and parity sketches, whose
differing bits never outnumber the differing shingles, rule out further pairs, and whole sets settle what is left.

First the pairs that lie next to each other in a trie, and those with the fingerprint nearest to the group's majority,
are settled, and what they link is one component. Then the tries are walked for pairs of different components, so
a large group of near copies makes few rows. Only the budget can lose a pair: at a similarity of 0.8 a bit differs with a
probability of 0.15, so more than 24 of 64 do once in 200,000 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import Workspace, lean, partitions_for, prepare, whole_text
from scrivel.llm.simhash import SEED, bits_of, components, shingle_hashes, trie_join
from scrivel.llm.tokens import slices, text_bytes

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST, OF = 4, 5
#: Bits of 64 in which the fingerprints of similar texts may differ.
BITS = 24
#: So many followers in its trie each row is compared with first.
NEXT = 3
SKETCH_BITS = 512
#: About so many texts are read for common shingles, and at most so many of these are put last. That moves load only.
SAMPLE_ROWS, MOST_COMMON = 10_000, 100_000
#: Texts of pairs are looked up by so many buckets of doc_id first.
ID_BUCKETS = 1 << 20
SLICE_BYTES = 2_000_000


def shingles(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the distinct shingles, sorted: lower case in A-Z, the whole sequence if there are fewer words."""
    return np.unique(shingle_hashes(text, shingle, seed))


def set_key(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def sketch(found: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """For each residue, whether an odd number of shingles has it. bits: a power of 2."""
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def wide_sketch(found: np.ndarray) -> bytes:
    """A sketch of twice as many bits as there are shingles, or up to four times."""
    return sketch(found, max(64, 1 << (2 * len(found) - 1).bit_length()))


def differing(a: bytes, b: bytes) -> int:
    """The bits in which two sketches differ; the wider one is folded to the other's width."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles, one more than may be missing from a similar set; common is sorted, rank its order."""
    order = np.zeros(len(found), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        order = np.where(common[at] == found, rank[at], 0)
    n = len(found)
    return found[np.lexsort((found, order))[: n + (-LEAST * n // OF) + 1]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * OF >= LEAST * (len(a) + len(b) - both)


def common_shingles(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that 3 or more of about SAMPLE_ROWS texts have, sorted, and their ranks by number (1 and up)."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [shingles(t) for t in text_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["h"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE_ROWS))) == 0)
    counts = sample.mapInArrow(lean(told), "h long").groupBy("h").count().where("count >= 3").orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()
    counts = sorted((r.h % (1 << 64), r["count"]) for r in counts)
    return np.array([h for h, _ in counts], dtype=np.uint64), np.array([k for _, k in counts], dtype=np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], least_rows: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of h without repeats of a key, and the end of each row's group. Batches are sorted by h, size, key."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        h, key = (table.column(c).to_numpy() for c in ("h", "key"))
        table = table.filter(pa.array(np.concatenate(([True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])))))
        h = table.column("h").to_numpy()
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
        return table, np.repeat(ends, np.diff(ends, prepend=0))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= least_rows:
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            last = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
            if last:
                yield cut(table.slice(0, last))
                held = table.slice(last).to_batches()
                size = table.num_rows - last
    if held:
        yield cut(pa.Table.from_batches(held))


def possible(size: np.ndarray, pos: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes, places and sketches allow rows i and j of a group to be similar: 9 x shared >= 4 x (both sizes)."""
    n, least = size[i] + size[j], np.minimum(size[i], size[j])
    fits = (OF * least >= LEAST * (n - least)) & ((LEAST + OF) * np.minimum(size[i] - pos[i], size[j] - pos[j]) >= LEAST * n)
    for k in range(0, len(i), 50_000):
        on = k + np.flatnonzero(fits[k : k + 50_000])
        apart = np.bitwise_count(bits[i[on]] ^ bits[j[on]]).sum(axis=1, dtype=np.int64)
        fits[on] = (LEAST + OF) * apart <= (OF - LEAST) * n[on]
    return fits


def nearest_to_majority(fp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each range the place of the fingerprint that is nearest to the bits that most of the range have."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sizes = np.diff(np.append(starts, len(fp)))
    most = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > sizes[:, None]
    centre = np.packbits(most, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    range_ = np.repeat(np.arange(len(starts)), sizes)
    return np.lexsort((np.bitwise_count(fp ^ centre[range_]), range_))[starts]


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(np.int64) for c in names]


def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of groups that have two keys or more."""
    for table, ends in whole_groups(batches):
        several = np.repeat(np.diff(np.unique(ends), prepend=0) > 1, np.diff(np.unique(ends), prepend=0))
        yield from table.filter(pa.array(several)).combine_chunks().to_batches()


def pairs_of(all_pairs: bool):
    """Pairs (a, b) of keys that fingerprints, sizes, places and sketches allow to be similar: of each group the likeliest ones, or all of different parts."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in whole_groups(batches):
            fp = table.column("fp").to_numpy().view(np.uint64)
            order = np.lexsort((fp, ends))
            fp, ends = fp[order], ends[order]
            size, pos, key, part = (x[order] for x in numbers(table, "size", "pos", "key", "part"))
            bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(size), -1)[order]
            starts = np.concatenate(([0], np.unique(ends)[:-1]))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

            def told(i: np.ndarray, j: np.ndarray) -> None:
                fits = possible(size, pos, bits, i, j) & (part[i] != part[j])
                a.append(key[i[fits]])
                b.append(key[j[fits]])

            if all_pairs:
                several = np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts)
                _, label = np.unique(part, return_inverse=True)
                if several.any():
                    on = np.repeat(several, np.diff(np.append(starts, len(fp))))
                    size, pos, key, part, bits, fp, label = (x[on] for x in (size, pos, key, part, bits, fp, label))
                    sizes = np.diff(np.append(starts, len(on)))[several]
                    trie_join(fp, np.cumsum(sizes) - sizes, 0, BITS, labels=label, told=told)
            else:
                centre = np.repeat(nearest_to_majority(fp, starts), np.diff(np.append(starts, len(fp))))
                row = np.arange(len(fp))
                for i, j in [(centre, row), *((row[: len(row) - k], row[k:]) for k in range(1, NEXT + 1))]:
                    near = (i != j) & (ends[i] == ends[j])
                    near &= np.bitwise_count(fp[i] ^ fp[j]) <= BITS
                    told(i[near], j[near])
            x, y = np.concatenate(a), np.concatenate(b)
            once = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(once[1])], ["a", "b"])

    return found


def similar_ids(docs: DataFrame) -> DataFrame:
    """doc_id, component_id: rows of documents with a doc_id whose texts are linked by a similarity of LEAST / OF or more,
    and the smallest doc_id that links lead to; documents without links are left out. Rows of one doc_id count as one document,
    texts without words are alike, an empty table gives no rows, further columns are ignored."""
    spark = docs.sparkSession
    prepare(spark)
    space = Workspace(spark, "near-copies")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shared = spark.sparkContext.broadcast(common_shingles(rows, n_rows))  # at most MOST_COMMON pairs of numbers

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                hashes = [shingle_hashes(t, SHINGLE) for t in text_bytes(batch.column("text"))]
                fp = np.array([bits_of(h) for h in hashes], dtype=np.uint64).view(np.int64)
                sets = [np.unique(h) for h in hashes]
                first = [prefix(s, *shared.value).view(np.int64) for s in sets]
                at = np.cumsum([0, *map(len, first)])
                arrays = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(fp), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([wide_sketch(s) for s in sets], pa.binary())]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays, lists], ["doc_id", "key", "size", "fp", "sketch", "wide", "prefix"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                sets = [shingles(t) for t in text_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "hashes"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair)) for pair in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [(LEAST + OF) * differing(x, y) <= (OF - LEAST) * n for x, y, n in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    def both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
        """Pairs with the column for a as x and for b as y, and the sum of the sizes where there are any as n."""
        size = F.col("size") if "size" in of.columns else F.lit(0)
        x, y = (of.select(F.col("key").alias(k), F.col(column).alias(v), size.alias(f"n{v}")) for k, v in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", (F.col("nx") + F.col("ny")).alias("n"))

    marks = space.persist(rows.mapInArrow(lean(marked), "doc_id long, key long, size int, fp long, sketch binary, wide binary, prefix array<long>"), "marks")
    firsts = ("size", "fp", "sketch", "wide")
    nodes = space.persist(marks.groupBy("key").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in firsts)), "sets")
    place = space.persist(nodes.select("key", "node"), "nodes")
    dealt = marks.select("key", "size", F.posexplode("prefix").alias("pos", "h"))
    group = ("h", "size", "key")
    parts_n = partitions_for(spark, n_bytes)
    kept = space.persist(dealt.repartition(parts_n, "h").sortWithinPartitions(*group).mapInArrow(lean(partnered), "key long, size int, pos int, h long"), "groups")
    equal = space.persist(marks.select("doc_id", "key").join(place, "key").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a != b"), "equal")
    space.drop(marks)

    def similar_pairs(parts: DataFrame, all_pairs: bool, name: str) -> DataFrame:
        listed = kept.join(parts.join(nodes.select("key", "fp", "sketch"), "key"), "key")
        pairs = listed.repartition(parts_n, "h").sortWithinPartitions(*group).mapInArrow(lean(pairs_of(all_pairs)), "a long, b long").distinct()
        pairs = space.persist(both(pairs, nodes, "wide").mapInArrow(lean(sifted), "a long, b long"), f"{name}-pairs")
        asked = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        ids = place.join(asked, "key", "left_semi").select(F.col("node").alias("doc_id"))
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS)).cast("int").alias("bucket")
        # at most ID_BUCKETS numbers are broadcast; they spare most texts the shuffle
        some = rows.withColumn("bucket", bucket).join(F.broadcast(ids.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
        if n_rows > ID_BUCKETS:  # else a bucket has a document or two
            some = some.join(ids, "doc_id", "left_semi")
        texts = some.mapInArrow(lean(keyed), "key long, hashes binary")
        sets = space.persist(texts.join(asked, "key", "left_semi").dropDuplicates(["key"]), f"{name}-hashes")
        links = space.persist(both(pairs, sets, "hashes").mapInArrow(lean(settled), "a long, b long"), f"{name}-links")
        space.drop(pairs, sets)
        return links

    first = similar_pairs(nodes.select("key", F.col("key").alias("part")), False, "likeliest")
    joined = components(first).withColumnRenamed("node", "key")
    parts = place.select("key").join(joined, "key", "left").select("key", F.coalesce("component", "key").alias("part"))
    rest = similar_pairs(parts, True, "other")
    linked = first.union(rest).join(place.select(F.col("key").alias("a"), F.col("node").alias("m")), "a").join(place.select(F.col("key").alias("b"), F.col("node").alias("n")), "b").select(F.col("m").alias("a"), F.col("n").alias("b"))
    out = components(linked.union(equal)).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    space.close()
    return out


__all__ = ["shingles", "similar", "similar_ids"]
