"""Exact duplicates by compressed radix tries.

Texts are dealt by length and content hash, and each partition puts the full byte strings, behind length and
hash, into a Patricia trie; a string that is already there ends at the node that holds the owner so far, the
row with the smallest identifier. Equality is decided by bytes, never by the hash alone. When a trie outgrows
its memory its largest subtree goes to disk, and later strings for that subtree follow it there.

Before the shuffle each task merges the equal texts it has read, so a text that makes up a third of the table
reaches its trie once for each few dozen MB read, with a count; the identifiers of copies never meet in one task.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import lean, one_space, partitions_for, persist, prepare, whole_text
from scrivel.llm.tokens import text_bytes

_NONE = (1 << 63) - 1


class Node:
    __slots__ = ("best", "children", "count", "label", "tags")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.count, self.best = 0, None
        self.tags: array | None = None


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Patricia:
    """add(key, best, n, tags): the node where key ends, which sums n, keeps the smallest best and all tags. bytes: about what it takes."""

    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def add(self, key: bytes, best: tuple, n: int, tags: Iterable[int] = ()) -> Node:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:])
                node.children[key[at]] = child
                self.bytes += len(child.label) + 200
                node, at = child, len(key)
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            same = common_prefix(child.label, key[at : at + len(child.label)])
            above = Node(child.label[:same])
            child.label = child.label[same:]
            above.children[child.label[0]] = child
            node.children[key[at]] = above
            self.bytes += 200
            node, at = above, at + same
        if node.tags is None:
            node.tags = array("q")
            self.bytes += 80
        before = len(node.tags)
        node.tags.extend(tags)
        self.bytes += 9 * (len(node.tags) - before)
        node.count += n
        if node.best is None or best < node.best:
            node.best = best
        return node


class Owners:
    """Finds the owner of each entry (key, tags, best, n); results() gives (tags, best, count) of each key.

    max_bytes bounds the tries in memory, tags included. Subtrees are told apart by one byte of the key, the first place
    after `depth` bytes; a subtree sent to disk is later worked through by itself, split by the next byte. One key by
    itself stays in memory: its text once, and 8 bytes for each run of texts that met it before the shuffle.
    """

    def __init__(self, max_bytes: int = 128_000_000, depth: int = 0):
        self.max_bytes, self.depth, self.bytes = max_bytes, depth, 0
        self.tries: dict[int, Patricia] = {}
        self.away: dict[int, object] = {}

    def add(self, key: bytes, tags: Iterable[int], best: tuple, n: int) -> None:
        branch = key[self.depth] if self.depth < len(key) else -1
        if branch in self.away:
            pickle.dump((key, array("q", tags), best, n), self.away[branch])
            return
        trie = self.tries.setdefault(branch, Patricia())
        self.bytes -= trie.bytes
        trie.add(key, best, n, tags)
        self.bytes += trie.bytes
        if self.bytes > self.max_bytes and len(self.tries) + len(self.away) > 1 and (others := [b for b in self.tries if b >= 0]):
            self._spill(max(others, key=lambda b: self.tries[b].bytes))

    def _spill(self, branch: int) -> None:
        # scratch of this task: a task that is run again begins anew
        out = self.away[branch] = tempfile.TemporaryFile()
        trie = self.tries.pop(branch)
        self.bytes -= trie.bytes
        stack = [(trie.root, b"")]
        while stack:
            node, head = stack.pop()
            key = head + node.label
            if node.tags is not None:
                pickle.dump((key, node.tags, node.best, node.count), out)
            stack += [(child, key) for child in node.children.values()]

    def results(self) -> Iterator[tuple]:
        for trie in self.tries.values():
            stack = [trie.root]
            while stack:
                node = stack.pop()
                if node.tags is not None:
                    yield node.tags, node.best, node.count
                stack += node.children.values()
        self.tries.clear()
        self.bytes = 0
        for file in self.away.values():
            inner = Owners(self.max_bytes, self.depth + 1)
            file.seek(0)
            while True:
                try:
                    inner.add(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            yield from inner.results()


def local_entries(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", merge_bytes: int = 32_000_000) -> DataFrame:
    """An entry for each text and run of about merge_bytes read: entry, n_bytes, hash, body, sha, best, members."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        held: dict[bytes, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal serial
            bodies = list(held)
            first = serial
            serial += len(bodies)
            members = [held[b] for b in bodies]
            columns = [
                pa.array([(part << 40) + first + k for k in range(len(bodies))], pa.int64()),
                pa.array(map(len, bodies), pa.int64()),
                pa.array([xxhash.xxh64_intdigest(b) - (1 << 63) for b in bodies], pa.int64()),
                pa.array(bodies, pa.binary()),
                pa.array([hashlib.sha256(b).hexdigest() for b in bodies]),
                pa.array([min((m for m in ms if m is not None), default=None) for ms in members], pa.int64()),
                pa.array(members, pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["entry", "n_bytes", "hash", "body", "sha", "best", "members"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                body = one_space(text)
                if body not in held:
                    held[body] = []
                    size += len(body)
                held[body].append(doc_id)
                size += 32
                if size > merge_bytes:
                    yield out()
                    held, size = {}, 0
        yield out()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return rows.mapInArrow(lean(merge), "entry long, n_bytes long, hash long, body binary, sha string, best long, members array<long>")


def owners(entries: DataFrame, max_bytes: int = 128_000_000, partitions: int | None = None) -> DataFrame:
    """entry, keep_id, group_size, first: by the tries, with `first` true for one entry of each text."""

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Owners(max_bytes)
        for batch in batches:
            bodies = batch.column("body")
            for k, (entry, n_bytes, hash_, best, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("entry", "n_bytes", "hash", "best", "n")), strict=True)):
                key = (hash_ + (1 << 63)).to_bytes(8, "big") + n_bytes.to_bytes(8, "big") + bodies[k].as_buffer()
                found.add(key, (entry,), (_NONE if best is None else best, entry), n)
        rows: list[tuple] = []
        for tags, best, count in found.results():
            for entry in tags:
                rows.append((entry, None if best[0] == _NONE else best[0], count, entry == best[1]))
                if len(rows) == 20_000:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["entry", "keep_id", "group_size", "first"])

    rows = entries.select("entry", "n_bytes", "hash", "body", "best", F.size("members").alias("n"))
    dealt = rows.repartition(partitions, "n_bytes", "hash") if partitions else rows.repartition("n_bytes", "hash")
    return dealt.mapInArrow(lean(insert), "entry long, keep_id long, group_size long, first boolean")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", entries_path: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical after each run of white space is one space; null counts as empty. The row with
    the smallest doc_id of a group stays. Of several rows with that same doc_id one stays. Null doc_ids come after
    all others: keep_id is null only in a group without any id, where one row stays. Further columns are ignored.
    An empty table gives no rows. entries_path: where the entries are written, for callers that delete them afterwards.
    """
    prepare(docs.sparkSession)
    entries = persist(local_entries(docs, id_column, text_column), "exact-entries", entries_path)
    spark = docs.sparkSession
    n_bytes = entries.agg(F.sum("n_bytes")).first()[0] or 0
    owned = owners(entries, partitions=partitions_for(spark, n_bytes))
    rows = entries.select("entry", "sha", "best", "members").join(owned, "entry").select("sha", "best", "keep_id", "group_size", "first", F.array_position("members", F.col("best")).alias("own"), F.posexplode("members").alias("place", "doc_id"))
    kept = F.col("first") & (F.col("place") + 1 == F.greatest(F.coalesce("own", F.lit(0)), F.lit(1)))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


__all__ = ["Owners", "Patricia", "exact_groups", "local_entries", "owners"]
