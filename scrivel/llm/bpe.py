"""Byte-level BPE by prefix dynamic programming: encoding, decoding, and re-encoding after appends and edits.

Of every prefix of a piece of text, exactly one token can be the last of the prefix's encoding: the one that ends there and
goes with the last token of what stands before it. Two tokens go together if merging their bytes by rank gives these two again, which is seen
by undoing both tokens' merges from the latest. So one pass over the bytes stores a last token for each prefix, the encoding is read from the end,
and a table of last tokens stays right for everything before a change and, once it agrees with the old one over the length of a token, after it.

A text is split by a pattern first, and the pieces are encoded each by itself. A worker remembers the pieces that it has met
lately, so the pass runs once for each of them.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import lean, prepare, whole_text
from scrivel.llm.tokens import slices, text_bytes

NO_TOKEN = (1 << 31) - 1
#: Pieces of up to so many characters are remembered.
KNOWN_CHARS = 64
#: Before an edit the pattern looks at most so many characters beyond the end of a piece.
LOOK_AHEAD = 2


class Vocabulary:
    """The ranks of a file of lines `base64 rank`, with what the prefix pass needs: a trie of reversed tokens and the pairs that go together."""

    _open: dict[tuple[str, str], Vocabulary] = {}

    def __init__(self, path: str, pattern: str, limit: int = 700_000):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens: dict[int, bytes] = {rank: token for token, rank in self.ranks.items()}
        self.sizes = {rank: len(token) for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split_at, self.limit = regex.compile(pattern), limit
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.long: list[str] = []

    @classmethod
    def of(cls, path: str, pattern: str) -> Vocabulary:
        """One for each worker process."""
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(path, pattern)
        return cls._open[path, pattern]

    @cached_property
    def backwards(self) -> list:
        """The tokens from their last bytes on, as nodes [rank or -1, children by byte]."""
        root: list = [-1, {}]
        for token, rank in self.ranks.items():
            node = root
            for byte in reversed(token):
                if byte not in node[1]:
                    node[1][byte] = [-1, {}]
                node = node[1][byte]
            node[0] = rank
        return root

    def merged(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge is the last to make this one; None for a single byte, and for a token that its own bytes don't merge to."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            found = min(((self.ranks.get(a + b, NO_TOKEN), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(NO_TOKEN, 0))
            if found[0] == NO_TOKEN:
                return None
            k = found[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 and parts[0] in self.ranks and parts[1] in self.ranks else None

    def halves_of(self, rank: int) -> tuple[int, int] | None:
        if rank not in self.halves:
            self.halves[rank] = self.merged(self.tokens[rank])
        return self.halves[rank]

    def usable(self, rank: int) -> bool:
        """Whether merging ever makes this token."""
        return len(self.tokens[rank]) == 1 or self.halves_of(rank) is not None

    def fit(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens; left is -1 where right begins a piece.

        The merges that made them are undone from the latest. At each step the two tokens at the seam must not merge with
        each other earlier than the merge that was just undone; of equal ranks the place more to the left merges first.
        """
        a, b, before, good = left, right, NO_TOKEN, self.usable(right)
        while good and left >= 0:
            if self.ranks.get(self.tokens[a] + self.tokens[b], NO_TOKEN) < before:
                good = False
                break
            one, two = self.halves_of(a), self.halves_of(b)
            if one is None and two is None:
                break
            # Single bytes are there from the beginning; of two equal tokens the right one was made later.
            if two is None or one is not None and a > b:
                before, a = a, one[1]
            else:
                before, b = b + 1, two[0]
        if len(self.pairs) >= 4 * self.limit:
            self.pairs.clear()
        self.pairs[left << 32 | right] = good
        return good

    def extend(self, last: array, data: bytes, upto: int | None = None) -> array:
        """Continues the table of last tokens of prefixes of `data` from where it ends."""
        first, sizes, pairs, fit = self.backwards[1], self.sizes, self.pairs, self.fit
        for i in range(len(last), len(data) if upto is None else upto):
            children, k = first, i
            while k >= 0:
                node = children.get(data[k])
                if node is None:
                    raise ValueError(f"no token ends with byte {data[i]}")
                rank, children = node
                k -= 1
                if rank >= 0:  # one of the tokens that end here goes with what stands before it, so the first that does is the one
                    before = last[k] if k >= 0 else -1
                    good = pairs.get(before << 32 | rank)
                    if good or good is None and fit(before, rank):
                        last.append(rank)
                        break
            else:
                raise ValueError(f"no token ends with byte {data[i]}")
        return last

    def read(self, last: array, data: bytes) -> list[int]:
        """The encoding of a piece from its table. A piece that is a token by itself is that token, as the merges are not asked then."""
        if data in self.ranks:
            return [self.ranks[data]]
        out, at = [], len(data) - 1
        while at >= 0:
            out.append(last[at])
            at -= self.sizes[last[at]]
        return out[::-1]

    def learn(self, pieces: set[str]) -> None:
        """Makes the encodings of all these pieces known. In order of their bytes, each takes the table of what it shares with the one before."""
        if len(self.known) > self.limit // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = []
        for p in pieces:
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    new.append((p.encode("utf-8", "replace"), p))
                    if len(p) > KNOWN_CHARS:
                        self.long.append(p)
        last, before = array("i"), b""
        for data, p in sorted(new):
            rank = self.ranks.get(data)
            if rank is not None:
                known[p] = rank.to_bytes(4, "little")
                continue
            same, most = 0, min(len(data), len(before))
            while same < most and data[same] == before[same]:
                same += 1
            del last[same:]
            known[p] = array("i", self.read(self.extend(last, data), data)).tobytes()
            before = data

    def encode(self, *texts: str) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.split_at.findall(t) for t in texts]
        self.learn(set().union(*split))
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), dtype="<i4") for pieces in split]
        for p in self.long:
            del self.known[p]
        self.long.clear()
        return ids

    @cached_property
    def spelt(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens in a row, where each begins and how long it is, by rank."""
        most = max(self.tokens) + 1
        sizes = np.array([len(self.tokens.get(k, b"")) for k in range(most)], dtype=np.int64)
        return np.frombuffer(b"".join(self.tokens.get(k, b"") for k in range(most)), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, in runs of ids of a bounded length."""
        letters, starts, sizes = self.spelt
        out = []
        for k in range(0, len(ids), 1 << 18):
            part = ids[k : k + (1 << 18)]
            each = sizes[part]
            ends = np.cumsum(each)
            out.append(letters[np.repeat(starts[part] - ends + each, each) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


class Table:
    """A text with its pieces and, for each byte, the last token of the piece's prefix that ends there. The pattern must match at every character."""

    def __init__(self, vocabulary: Vocabulary, text: str = "", chars: array | None = None, last: array | None = None):
        self.of, self.text, self.made = vocabulary, text, 0
        self.chars = array("i") if chars is None else chars
        self.last = array("i") if last is None else last
        if text and chars is None:
            self._renew(text, 0, 0, len(text))

    def ids(self) -> list[int]:
        data, out, at, byte = self.text, [], 0, 0
        for n in self.chars:
            piece = data[at : at + n].encode("utf-8", "replace")
            out += self.of.read(self.last[byte : byte + len(piece)], piece)
            at, byte = at + n, byte + len(piece)
        return out

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Characters start to stop become `new`. Pieces before the change stay as they are, and so do those from the first old seam behind it on."""
        self._renew(self.text[:start] + new + self.text[stop:], start, stop, start + len(new))

    def _renew(self, text: str, start: int, stop: int, end: int) -> None:
        old, old_chars, old_last, self.made = self.text, self.chars, self.last, 0
        seams, at = {0: (0, 0)}, 0  # place in characters of the old text: (piece, byte)
        byte = 0
        for k, n in enumerate(old_chars):
            byte += len(old[at : at + n].encode("utf-8", "replace"))
            at += n
            seams[at] = (k + 1, byte)
        keep = max((x for x in seams if x == 0 or x + LOOK_AHEAD <= start), default=0)
        places = list(seams)
        after = dict(zip(places, places[1:], strict=False))
        first, byte = seams[keep]
        chars, last, shift, at = old_chars[:first], old_last[:byte], len(old) - len(text), keep
        while at < len(text):
            if at >= end and at + shift >= stop and at + shift in seams:
                k, byte = seams[at + shift]
                self.text, self.chars, self.last = text, chars + old_chars[k:], last + old_last[byte:]
                return
            found = self.of.split_at.match(text, at)
            piece = found[0] if found and found[0] else text[at]
            self._piece(piece, old[at : after.get(at, at)], seams.get(at, (0, 0))[1], last, old_last)
            chars.append(len(piece))
            at += len(piece)
        self.text, self.chars, self.last = text, chars, last

    def _piece(self, piece: str, was: str, byte: int, last: array, old_last: array) -> None:
        """Appends a piece's table. `was` is the old piece that began at the same place, its table at `byte`; what both have in common is taken from there.

        Behind a change within the piece the pass goes on until its tokens agree with the old ones over the length of the longest token.
        """
        data, before = piece.encode("utf-8", "replace"), was.encode("utf-8", "replace")
        same = _common(data, before)
        own = old_last[byte : byte + same]
        tail = _common(data[same:][::-1], before[same:][::-1])
        shift, agree, i = len(before) - len(data), 0, same
        while i < len(data):
            if agree >= self.of.longest:
                own += old_last[byte + i + shift : byte + len(before)]
                break
            self.of.extend(own, data, i + 1)
            self.made += 1
            agree = agree + 1 if i >= len(data) - tail and own[i] == old_last[byte + i + shift] else 0
            i += 1
        last += own


def _common(a: bytes, b: bytes) -> int:
    """How many first bytes are the same."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def encode(docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text.

    Null and empty texts have no ids; repeated rows and rows without a doc_id come as often as they are; further columns are not looked at; no
    rows give no rows. A text of any length is one row; a piece's table is in memory, four bytes for each of the piece.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.of(ranks, pattern)
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                ids = words.encode(*(t.decode("utf-8", "replace") for t in text_bytes(batch.column("text"))))
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), flat)], ["doc_id", "ids"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded, the bytes that the ids stand for; null ids are none."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.of(ranks, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                lists = part.column("ids")
                at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                bytes_ = [words.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(bytes_, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, ids array<int>, decoded binary")


def tables(docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, chars (of each piece) and last (of each byte): what `edited` starts from. Nulls as for `encode`."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.of(ranks, pattern)
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                made = [Table(words, t.decode("utf-8", "replace")) for t in text_bytes(batch.column("text"))]
                columns = [batch.column("doc_id"), pa.array([m.text for m in made], pa.string()), *(pa.array([np.array(x) for x in xs], pa.list_(pa.int32())) for xs in ([m.chars for m in made], [m.last for m in made]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "chars", "last"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")).mapInArrow(lean(run), "doc_id long, text string, chars array<int>, last array<int>")


def edited(stored: DataFrame, edits: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The tables of documents after an edit each, with their ids, and `made`, the number of bytes whose last token was looked for anew.

    edits: doc_id, start and stop (characters; cut to the text's length, null is its end: an append), replacement (null is empty). A document with several
    edits gives a row for each, none builds on another; documents without an edit are not returned, nor edits without a document.
    """
    prepare(stored.sparkSession)
    c = F.col
    one = edits.select("doc_id", c("start").cast("long").alias("start"), c("stop").cast("long").alias("stop"), whole_text("replacement").alias("replacement"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.of(ranks, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                table = Table(words, r["text"], array("i", r["chars"]), array("i", r["last"]))
                start, stop = (len(r["text"]) if x is None else min(max(x, 0), len(r["text"])) for x in (r["start"], r["stop"]))
                table.replace(start, max(start, stop), r["replacement"])
                yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "text": table.text, "chars": table.chars.tolist(), "last": table.last.tolist(), "ids": table.ids(), "made": table.made}], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), *((x, pa.list_(pa.int32())) for x in ("chars", "last", "ids")), ("made", pa.int64())]))

    joined = stored.select("doc_id", "text", "chars", "last").join(one, "doc_id")
    return joined.mapInArrow(lean(run), "doc_id long, text string, chars array<int>, last array<int>, ids array<int>, made long")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 of every document, encoded and decoded again."""
    both = decode(encode(docs, ranks, pattern), ranks, pattern)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
