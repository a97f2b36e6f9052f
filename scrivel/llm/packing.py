"""Best-fit packing of documents into token sequences of fixed capacity.

Bounded-space online best-fit: a fixed number of bins is open. They hang in stacks by their free space,
and an integer used as a bitset says which stacks are not empty, so the fullest bin with room is one shift
and one lowest-bit step away. When no open bin has room and all are in use, the fullest closes.

Pieces are dealt into buckets by a hash of the whole row, and arrive in the order of another one; each bucket is packed by
itself, in one pass that holds the open bins only. So the work is spread evenly however the table is ordered, and a bucket
leaves no more part-filled bins than are open.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import lean, prepare, whole_text
from scrivel.llm.tokens import END_ID, Encoder, slices, text_bytes

CAPACITY = 4096
OPEN_BINS = 64
BUCKET_ROWS = 65_536
SLICE_BYTES = 2_000_000


class BestFit:
    """add(length) gives (bin number, place in it)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        if open_bins < 1:
            raise ValueError("at least one bin has to be open")
        self.capacity, self.open_bins = capacity, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = self.n_open = self.n_bins = self.n_closed = 0

    def _pop(self, free: int) -> int:
        stack = self.stacks[free]
        found = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        self.n_open -= 1
        return found

    def add(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece has from 1 to {self.capacity} tokens, not {length}")
        if room := self.mask >> length:
            free = length + (room & -room).bit_length() - 1
            number = self._pop(free)
        else:
            if self.n_open == self.open_bins:
                self._pop((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
                self.n_closed += 1
            number, free = self.n_bins, self.capacity
            self.n_bins += 1
        left = free - length
        if left:
            self.stacks[left].append(number)
            self.mask |= 1 << left
            self.n_open += 1
        return number, self.capacity - free


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32. A document is its ids, then the end id."""
    prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids, at = encoder.encode(text_bytes(batch.column("text")))
                n_pieces = -(-np.diff(at) // capacity)
                row = np.repeat(np.arange(batch.num_rows), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(at)[row] - start)
                begin = at[:-1][row] + start
                view = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(view[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return rows.mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, n_rows: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds sequence_id and offset to rows with a length (1 to capacity; others raise). n_rows: about how many rows there are; it sets the number of buckets only.

    Equal rows are packed each by itself. No rows give no rows. The names bucket, arrival, sequence_id and offset are taken.
    """
    if clash := {"bucket", "arrival", "sequence_id", "offset"}.intersection(pieces.columns):
        raise ValueError(f"columns that packing adds are there already: {sorted(clash)}")
    prepare(pieces.sparkSession)
    buckets = max(1, -(-n_rows // bucket_rows))
    arrival = F.xxhash64(F.lit(1), *pieces.columns)
    dealt = pieces.withColumns({"bucket": F.pmod(F.xxhash64(*pieces.columns), F.lit(buckets)), "arrival": arrival})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, None
        for batch in batches:
            sequence, offset = [], []
            for bucket, length in zip(batch.column("bucket").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if bucket != now:
                    now, bins = bucket, BestFit(capacity, open_bins)
                number, place = bins.add(length)
                sequence.append((bucket << 32) + number)
                offset.append(place)
            keep = [c for c in batch.schema.names if c not in ("bucket", "arrival")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "arrival", *pieces.columns).mapInArrow(lean(fill), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, bucket_rows: int = BUCKET_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packs whole documents; only those over the capacity are cut, into full pieces and a rest.

    Null or empty texts are the end id alone. A null doc_id stays null; repeated rows are packed as often as
    they occur. Further columns of docs are ignored, whatever their names. An empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer, capacity, id_column, text_column)
    return pack(pieces, docs.count(), capacity, open_bins, bucket_rows)


__all__ = ["BestFit", "CAPACITY", "END_ID", "pack", "pack_documents", "token_pieces"]
