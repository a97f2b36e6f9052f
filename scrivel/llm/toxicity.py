"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of the texts without a usable label, at most SAMPLE_ROWS by a hash of
doc_id, and the sampled labelled texts, whatever their label, are the unlabelled ones. The class prior p is the share of
toxic texts among the labelled ones. The risk is p * E+[loss(+)] + max(0, E_u[loss(-)] - p * E+[loss(-)]). Where the
corrected part turns negative the step goes the other way, which keeps the classifier from explaining the unlabelled
texts away. The classifier is linear, in numpy, over the words and word beginnings that are most over-represented in the
positives.

Scoring reads whole texts: each distinct word of a batch is looked up once, and only words with a feature are counted.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import discard, lean, persist, prepare, shared_dir, whole_text
from scrivel.llm.substring_dedup import numbered, word_places
from scrivel.llm.tokens import slices, text_bytes

#: At most so many labelled rows, the first by a hash of doc_id, give the positives and the prior, and as many rows without a label take part.
SAMPLE_ROWS = 8000
SAMPLE_BYTES = 200_000_000
FEATURES = 256
STEPS = 400
THRESHOLD = 0.7
LEAST_ERRORS = 5.0
DECAY = 1e-4
BEGINNINGS = (4, 5, 6, 7)
_TRIM = b".,;:!?|()\"'[]{}<>*#$%&"


def features_of(word: bytes) -> list[bytes]:
    """The word, trimmed and in lower case, and its beginnings in letters."""
    text = word.strip(_TRIM).decode("utf-8", "replace").lower()
    return [b"w" + text.encode(), *(b"p" + text[:k].encode() for k in BEGINNINGS if len(text) > k)] if text else []


def count_features(texts: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(words by text, occurrences by text and known feature)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts, ends = word_places(raw)
    out = np.zeros((len(texts), len(known)), dtype=np.float32)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    if len(starts):
        codes, words = numbered(raw, starts, ends)
        pairs = [(c, known[f]) for c, w in enumerate(words) for f in features_of(w) if f in known]
        if pairs:
            which, feature = np.array(pairs).T
            has = np.zeros(len(words), dtype=bool)
            has[which] = True
            at = np.flatnonzero(has[codes])
            row = np.searchsorted(first, at, side="right") - 1
            begin = np.searchsorted(which, np.arange(len(words) + 1))
            n = np.diff(begin)[codes[at]]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            np.add.at(out, (np.repeat(row, n), feature[np.repeat(begin[codes[at]], n) + step]), 1)
    return np.diff(first), out


def inputs(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How densely each feature occurs, and whether it does."""
    dense = np.log1p(1000 * counts / np.maximum(words, 20)[:, None].astype(np.float32)) / 3
    return np.concatenate([dense, (counts > 0).astype(np.float32)], axis=1)


class Classifier:
    def __init__(self, known: dict[bytes, int], weights: np.ndarray, bias: float):
        self.known, self.weights, self.bias = known, weights, bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = inputs(*count_features(texts, self.known)) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def features_by_text(texts: list[bytes], known: dict[bytes, int], grow: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for each feature that a text has, once; each distinct word is looked at once. grow: new features get the next numbers."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts, ends = word_places(raw)
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    codes, words = numbered(raw, starts, ends)
    pairs = np.unique(np.repeat(np.arange(len(texts)), np.diff(first)) * len(words) + codes)
    of = [[known.setdefault(f, len(known)) if grow else known[f] for f in features_of(w) if grow or f in known] for w in words]
    n = np.fromiter(map(len, of), dtype=np.int64, count=len(of))
    flat, begin = np.array([f for fs in of for f in fs], dtype=np.int64), np.cumsum(n) - n
    row, word = np.divmod(pairs, len(words))
    step = np.arange(int(n[word].sum())) - np.repeat(np.cumsum(n[word]) - n[word], n[word])
    both = np.unique(np.repeat(row, n[word]) * max(1, len(known)) + flat[np.repeat(begin[word], n[word]) + step])
    return np.divmod(both, max(1, len(known)))


def texts_with(texts: list[bytes], known: dict[bytes, int], grow: bool = False, run: int = 500) -> np.ndarray:
    """The number of texts that have each feature."""
    out = np.zeros(len(known), dtype=np.int64)
    for k in range(0, len(texts), run):
        _, feature = features_by_text(texts[k : k + run], known, grow)
        out = np.concatenate([out, np.zeros(len(known) - len(out), dtype=np.int64)])
        out += np.bincount(feature, minlength=len(known))
    return out


def choose_features(texts: list[bytes], positive: np.ndarray, most: int = FEATURES, least: float = LEAST_ERRORS, unlabelled: np.ndarray | None = None) -> dict[bytes, int]:
    """The features whose share of positive texts is furthest above that of the unlabelled, `least` standard errors or more; at least 4 positives have them."""
    unlabelled = np.ones(len(texts), dtype=bool) if unlabelled is None else unlabelled
    pick = lambda mask: [t for t, m in zip(texts, mask, strict=True) if m]
    seen: dict[bytes, int] = {}
    often = texts_with(pick(positive), seen, grow=True)
    names = [f for f, k in seen.items() if often[k] >= 4]
    in_p = np.array([often[seen[f]] for f in names], dtype=np.int64)
    in_u = texts_with(pick(unlabelled), {f: k for k, f in enumerate(names)})
    n, n_p = max(1, int(unlabelled.sum())), max(1, int(positive.sum()))
    value = (in_p / n_p - in_u / n) / np.sqrt(np.maximum(in_u / n * (1 - in_u / n), 1e-9) / n_p)
    best = sorted((-v, f) for f, v in zip(names, value.tolist(), strict=True) if v >= least)
    return {f: k for k, (_, f) in enumerate(best[:most])}


def fit(texts: list[bytes], positive: np.ndarray, features: int = FEATURES, steps: int = STEPS, rate: float = 0.05, decay: float = DECAY, prior: float | None = None, unlabelled: np.ndarray | None = None) -> Classifier:
    """A classifier by the non-negative risk; without positives (or texts) it scores every text 0. prior: the share of toxic texts, if the
    positives' share of the sample isn't it. unlabelled: which texts are the unlabelled ones, if not all."""
    unlabelled = np.ones(len(texts), dtype=bool) if unlabelled is None else unlabelled
    if not unlabelled.any() or not positive.any():
        return Classifier({}, np.zeros(0, dtype=np.float32), -50.0)
    known = choose_features(texts, positive, features, unlabelled=unlabelled)
    x = np.concatenate([inputs(*count_features(texts[k : k + 500], known)) for k in range(0, len(texts), 500)])
    return descend(known, x[positive], x[unlabelled], int(positive.sum()) / len(texts) if prior is None else prior, steps, rate, decay)


def descend(known: dict[bytes, int], x_p: np.ndarray, x: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05, decay: float = DECAY) -> Classifier:
    """Minimises the non-negative risk over the inputs of the positives and of the unlabelled texts."""
    n, n_p = len(x), len(x_p)
    w, b = np.zeros(x.shape[1]), -2.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    x_p, x = x_p.astype(np.float32), x.astype(np.float32)
    times = lambda rows, by: (rows @ by.astype(np.float32)).astype(np.float64)
    for t in range(1, steps + 1):
        z, z_p = times(x, w) + b, times(x_p, w) + b
        s, s_p = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-z_p))
        rest = np.logaddexp(0, z).mean() - prior * np.logaddexp(0, z_p).mean()
        # slopes of the risk by the texts' scores
        g, g_p = s / n, -prior * s_p / n_p
        if rest >= 0:
            g_p = g_p - prior * (1 - s_p) / n_p
        else:
            g, g_p = -g, -g_p
        slope = np.append(times(x.T, g) + times(x_p.T, g_p) + decay * w, g.sum() + g_p.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Classifier(known, w.astype(np.float32), float(b))


def held_out(column: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, steps: int = STEPS, sample_bytes: int = SAMPLE_BYTES) -> Classifier:
    """Fits on rows that aren't held out: the toxic ones of at most sample_rows labelled rows, and as unlabelled
    ones at most sample_rows without a label and the labelled rows, whatever their label; of either kind at most sample_bytes
    of text: those beyond in the order of the sample don't take part. Tasks count features and then the chosen features by
    text; to the driver come the chosen ones and their counts, about 1 KB for each text of the sample.

    Null ids and labels take no part, a doc_id with several labels is toxic if one says so, with several texts it counts once, by
    the smallest. Null and empty texts have no features. Without toxic rows, or without rows, every text scores 0.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    free = rows.select("doc_id").where("doc_id is not null").where(~held_out()).join(usable, "doc_id", "left_anti").distinct()

    def sample_of(ids: DataFrame) -> tuple[DataFrame, list]:
        chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        # sample_rows bounds what is broadcast: two numbers a row
        sizes = rows.select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("n").alias("n"), F.count("*").alias("texts"))
        held = sorted(sizes.select("doc_id", "toxic", "n", "texts", F.xxhash64("doc_id").alias("h")).collect(), key=lambda r: (r.h, r.doc_id))
        upto = list(itertools.accumulate(r.n for r in held))
        held = [r for r, total in zip(held, upto, strict=True) if total <= sample_bytes]
        near = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in held], "doc_id long, toxic int")
        found = rows.join(F.broadcast(near), "doc_id")
        if any(r.texts > 1 for r in held):
            found = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        return found.select("doc_id", "text", "toxic"), held

    known_texts, known_rows = sample_of(usable)
    n_p = sum(r.toxic == 1 for r in known_rows)
    if not n_p:
        return fit([], np.zeros(0, dtype=bool))
    rest_texts, rest_rows = sample_of(free.withColumn("toxic", F.lit(None).cast("int")))
    path = shared_dir(docs.sparkSession, "toxicity-sample")
    sample = persist(known_texts.unionByName(rest_texts), "toxicity-sample", path)
    known = chosen_features(sample, n_p, len(known_rows) + len(rest_rows), features)
    x, toxic = counted(sample, known)
    discard(docs.sparkSession, path)
    return descend(known, x[toxic], x, n_p / len(known_rows), steps)


def chosen_features(sample: DataFrame, n_p: int, n: int, most: int = FEATURES, least: float = LEAST_ERRORS) -> dict[bytes, int]:
    """What choose_features gives for the sample (text, toxic), counted in tasks: n_p texts are toxic, all n are the unlabelled ones."""
    prepare(sample.sparkSession)
    schema = pa.schema([("feature", pa.binary()), ("in_p", pa.int64()), ("in_u", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts, toxic = text_bytes(batch.column("text")), np.array([t == 1 for t in batch.column("toxic").to_pylist()], dtype=bool)
                seen: dict[bytes, int] = {}
                row, feature = features_by_text(texts, seen, grow=True)
                in_u, in_p = np.bincount(feature, minlength=len(seen)), np.bincount(feature[toxic[row]], minlength=len(seen))
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(in_p.astype(np.int64)), pa.array(in_u.astype(np.int64))], schema=schema)

    c = F.col
    by = sample.select("text", "toxic").mapInArrow(lean(count), "feature binary, in_p long, in_u long").groupBy("feature").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    share = c("in_u") / n
    value = (c("in_p") / n_p - share) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) / n_p)
    best = by.where("in_p >= 4").withColumn("value", value).where(c("value") >= least).orderBy(c("value").desc(), "feature").limit(most)
    return {bytes(r.feature): k for k, r in enumerate(best.select("feature").collect())}


def counted(sample: DataFrame, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(inputs of the classifier for each text of the sample, whether it is toxic), in the order of doc_id and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = inputs(*count_features(text_bytes(batch.column("text")), known)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("text_hash"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "toxic", "text_hash", "x"])

    rows = sample.select("doc_id", "toxic", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(lean(count), "doc_id long, toxic int, text_hash long, x binary")
    got = sorted(rows.collect(), key=lambda r: (r.doc_id, r.text_hash))
    x = np.frombuffer(b"".join(r.x for r in got), dtype=np.float32).reshape(len(got), -1)
    return x, np.array([r.toxic == 1 for r in got], dtype=bool)


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted and text_hash for every row; null and empty texts are scored as texts without words.

    Further columns are ignored; repeated rows get the same score; no rows give no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # a few hundred words and weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = shared.value.score(text_bytes(batch.column("text"))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32)), batch.column("text_hash")], ["doc_id", "held_out", "score", "predicted", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), whole_text().alias("text"), F.xxhash64(whole_text()).alias("text_hash"))
    return rows.mapInArrow(lean(scored), "doc_id long, held_out boolean, score double, predicted int, text_hash long")


def keep_clean(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_column):
                yield batch.filter(pa.array(shared.value.score(text_bytes(batch.column(text_column))) < threshold))

    return docs.mapInArrow(lean(keep), docs.schema)


__all__ = ["Classifier", "fit", "held_out", "keep_clean", "score", "train"]
