"""Token ids in plane-shuffled binary files.

A file holds ids in blocks of a fixed size. A block is transposed into planes: byte planes (all lowest
bytes, then all second bytes, ...) or bit planes (all lowest bits, ...). Each plane is compressed by itself
with zstandard; planes of zeros cost a few bytes. The chunk index at the end has the place of every plane,
and the documents' ids and lengths, so one block can be read without the others.

Layout: magic, planes in order, index (zstandard over JSON head and int64 arrays), index length, magic.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import lean, partitions_for, prepare, shared_dir, whole_text
from scrivel.llm.tokens import Encoder, slices, text_bytes

MAGIC = b"SCRVPLN1"
BLOCK_IDS = 65_536
FILE_BYTES = 64_000_000
SLICE_BYTES = 2_000_000


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(bits[:, k]), bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class PlaneWriter:
    """Appends documents' ids to an open binary stream; memory holds one block and the index."""

    def __init__(self, out, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self.out, self.kind, self.block_ids = out, kind, block_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.left = np.zeros(0, dtype="<u4")
        self.at, self.n_ids = len(MAGIC), 0
        self.blocks, self.places = array("q"), array("q")
        self.doc_ids, self.known, self.lengths = array("q"), array("q"), array("q")
        out.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        for plane in to_planes(ids, self.kind):
            data = self.zip.compress(plane)
            self.out.write(data)
            self.places.extend((self.at, len(data)))
            self.at += len(data)
        self.blocks.append(len(ids))

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: list[int]) -> None:
        self.doc_ids.extend(0 if d is None else d for d in doc_ids)
        self.known.extend(int(d is not None) for d in doc_ids)
        self.lengths.extend(lengths)
        self.n_ids += len(ids)
        self.left = np.concatenate([self.left, ids]) if len(self.left) else ids
        while len(self.left) >= self.block_ids:
            self._block(self.left[: self.block_ids])
            self.left = self.left[self.block_ids :]

    def close(self) -> None:
        if len(self.left):
            self._block(self.left)
            self.left = self.left[:0]
        head = json.dumps({"planes": self.kind, "block_ids": self.block_ids, "blocks": len(self.blocks), "docs": len(self.doc_ids)}).encode()
        arrays = b"".join(np.array(x, dtype="<i8").tobytes() for x in (self.blocks, self.places, self.doc_ids, self.known, self.lengths))
        index = self.zip.compress(struct.pack("<I", len(head)) + head + arrays)
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)


class PlaneReader:
    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a plane file, or cut short")
        (n,) = struct.unpack("<Q", tail[:8])
        source.seek(size - 16 - n)
        index = zstandard.ZstdDecompressor().decompress(source.read(n))
        (m,) = struct.unpack("<I", index[:4])
        head = json.loads(index[4 : 4 + m])
        self.kind, self.n_planes = head["planes"], 4 if head["planes"] == "byte" else 32
        rest = np.frombuffer(index, dtype="<i8", offset=4 + m) if len(index) > 4 + m else np.zeros(0, dtype="<i8")
        cuts = np.cumsum([head["blocks"], 2 * head["blocks"] * self.n_planes, head["docs"], head["docs"]])
        self.blocks, places, self.doc_ids, self.known, self.lengths = np.split(rest, cuts)
        self.places = places.reshape(-1, self.n_planes, 2)

    def block(self, k: int) -> np.ndarray:
        unzip = zstandard.ZstdDecompressor()
        first, last = self.places[k, 0, 0], self.places[k, -1].sum()
        self.source.seek(int(first))
        data = self.source.read(int(last - first))
        return from_planes([unzip.decompress(data[a - first : a - first + n]) for a, n in self.places[k]], int(self.blocks[k]), self.kind)

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in order; one block and one document are in memory."""
        k, have = 0, np.zeros(0, dtype="<u4")
        for n in self.lengths.tolist():
            parts, got = [], 0
            while got < n:
                if not len(have):
                    have, k = self.block(k), k + 1
                parts.append(have[: n - got])
                have = have[len(parts[-1]) :]
                got += len(parts[-1])
            yield parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else have[:0]


def write_ids(docs: DataFrame, tokenizer: str, path: str, kind: str = "byte", block_ids: int = BLOCK_IDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes every text and writes files below path in ascending doc_id order; returns the manifest: part, file, n_docs, n_ids, base.

    Files follow each other by part; base is the number of ids in the files before. Nulls come first in doc_id
    order, null texts are empty, rows with one doc_id follow each other by text. A task writes under the name of
    its attempt, and the manifest names the files of the attempts that counted: a repeated task does no harm and no
    store has to rename. The manifest has a row for each file of about FILE_BYTES of text.
    """
    spark = docs.sparkSession
    prepare(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        own = f"part-{part:06d}-{task.taskAttemptId()}.planes"
        encoder = Encoder.of(tokenizer)
        with store.open_output_stream(f"{folder}/{own}", compression=None) as out:
            writer = PlaneWriter(out, kind, block_ids)
            for whole in batches:
                for batch in slices(whole, "text", SLICE_BYTES):
                    ids, at = encoder.encode(text_bytes(batch.column("text")))
                    writer.add(batch.column("doc_id").to_pylist(), ids, np.diff(at).tolist())
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own]), pa.array([len(writer.doc_ids)], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["part", "file", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    ordered = rows.repartitionByRange(partitions_for(spark, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, FILE_BYTES), "doc_id").sortWithinPartitions("doc_id", "text")
    files = sorted(ordered.mapInArrow(lean(write), "part int, file string, n_docs long, n_ids long").collect())
    base, manifest = 0, []
    for part, file, n_docs, n_ids in files:
        manifest.append((part, file, n_docs, n_ids, base))
        base += n_ids
    return spark.createDataFrame(manifest, "part int, file string, n_docs long, n_ids long, base long")


def read_ids(manifest: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Reads the files of a manifest: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary, little-endian uint32)."""
    spark = manifest.sparkSession
    prepare(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                name = f"{folder}/{file}"
                with store.open_input_file(name) as source:
                    reader = PlaneReader(source, store.get_file_info(name).size)
                    rows: list[tuple] = []
                    held = 0
                    for doc_id, known, ids in zip(reader.doc_ids.tolist(), reader.known.tolist(), reader.documents(), strict=True):
                        raw = ids.tobytes()
                        rows.append((doc_id if known else None, start, len(ids), zlib.crc32(raw), raw if with_ids else None))
                        start += len(ids)
                        held += len(raw) if with_ids else 64
                        if held > 16_000_000:
                            yield _rows(rows)
                            rows, held = [], 0
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)][: 4 + with_ids], names[: 4 + with_ids])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return manifest.select("file", "base").repartition(max(1, manifest.count())).mapInArrow(lean(read), schema)


def round_trip(docs: DataFrame, tokenizer: str, kind: str = "byte") -> DataFrame:
    """Writes docs' ids into a new shared folder and returns a row for each document as read back from the files."""
    path = shared_dir(docs.sparkSession, "token-ids")
    return read_ids(write_ids(docs, tokenizer, path, kind), path)


__all__ = ["BLOCK_IDS", "PlaneReader", "PlaneWriter", "from_planes", "read_ids", "round_trip", "to_planes", "write_ids"]
