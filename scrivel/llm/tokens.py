"""Exact token ids of whole texts, with the work done once per distinct word.

The vocabulary's normaliser and splitter never look across white space, so a text's ids are the ids of
its words in order. A batch of texts is cut into words with numpy, Arrow finds the distinct ones, and the
tokenizers library encodes only words that this worker has not met lately. The memory of met words is bounded: it has two
halves, and when the younger is full it takes the place of the older, so frequent words stay. Texts that hold the start of a special token are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

END_ID = 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LATIN = re.compile("[a-zß-öø-ÿ]+")
_LATIN_ANY = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet by its rule: printable bytes stand for themselves, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(rest)}


class Encoder:
    """Ids by a tokenizers file. limit bounds the words remembered between calls (a call adds its own)."""

    _open: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.table = self.tokenizer.model, byte_letters()
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str, limit: int = 400_000) -> Encoder:
        """One encoder for each worker process."""
        if (path, limit) not in cls._open:
            cls._open[path, limit] = cls(path, limit)
        return cls._open[path, limit]

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        low = text.lower() if _LATIN_ANY.fullmatch(text) else text
        if _LATIN.fullmatch(low):  # one run of letters that the normaliser leaves as it is
            letters = low.encode().decode("latin-1").translate(self.table)
            return np.array([t.id for t in self.model.tokenize(letters)], dtype="<u4").tobytes()
        if len(text) > 1 and text[-1] in ".," and _LATIN_ANY.fullmatch(text[-2]):
            return self._known(word[:-1]) + self._known(word[-1:])
        return self.plain(text).astype("<u4").tobytes()

    def _known(self, word: bytes) -> bytes:
        got = self.memo.get(word)
        if got is None:
            got = self.older.get(word)
            got = self.memo[word] = self._word(word) if got is None else got
        return got

    def encode(self, texts: list[bytes], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, places where each text's ids start, with the total at the end)."""
        odd = {k for k, t in enumerate(texts) if b"<|" in t}
        lines = [b"" if k in odd else t for k, t in enumerate(texts)]
        data = np.frombuffer((b"\n".join(lines) + b"\n").lower(), dtype=np.uint8)
        space = _SPACE[data]
        edge = np.empty(len(data), dtype=bool)
        edge[0] = True
        edge[1:] = space[:-1]
        starts = np.flatnonzero(edge & ~space)
        edge[:-1] = space[1:]
        edge[-1] = True
        ends = np.flatnonzero(edge & ~space) + 1
        sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)) + 1
        first_word = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
        if len(starts):
            offsets = np.zeros(len(starts) + 1, dtype=np.int64)
            np.cumsum(ends - starts, out=offsets[1:])
            found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])]).dictionary_encode()
            if len(self.memo) > self.limit // 2:
                self.older, self.memo = self.memo, {}
            known = [self._known(w) for w in found.dictionary.to_pylist()]
            codes = found.indices.to_numpy(zero_copy_only=False)
            lens = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
            pool = np.frombuffer(b"".join(known), dtype="<u4")
            from_ = np.cumsum(lens) - lens
            per_word = lens[codes]
            out_at = np.zeros(len(codes) + 1, dtype=np.int64)
            np.cumsum(per_word, out=out_at[1:])
            ids = pool[np.repeat(from_[codes] - out_at[:-1], per_word) + np.arange(out_at[-1])]
            doc_at = out_at[first_word]
        else:
            ids, doc_at = np.zeros(0, dtype="<u4"), np.zeros(len(lines) + 1, dtype=np.int64)
        if not odd and end_id is None:
            return ids, doc_at
        if not odd:
            at = doc_at + np.arange(len(doc_at))
            out = np.full(at[-1], end_id, dtype="<u4")
            keep = np.ones(len(out), dtype=bool)
            keep[at[1:] - 1] = False
            out[keep] = ids
            return out, at
        parts, at = [], [0]
        for k, text in enumerate(texts):
            own = self.plain(text.decode("utf-8", "replace")) if k in odd else ids[doc_at[k] : doc_at[k + 1]]
            own = own if end_id is None else np.append(own, np.uint32(end_id))
            parts.append(own.astype("<u4"))
            at.append(at[-1] + len(own))
        return np.concatenate(parts) if parts else ids, np.array(at, dtype=np.int64)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000):
    """The batch in runs of rows whose texts have about `most` bytes together."""
    sizes = np.array([len(x) for x in text_bytes(batch.column(column))], dtype=np.int64)
    at, total = 0, 0
    for k, size in enumerate(sizes):
        total += size
        if total >= most:
            yield batch.slice(at, k + 1 - at)
            at, total = k + 1, 0
    if at < len(sizes):
        yield batch.slice(at)
