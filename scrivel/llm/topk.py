"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are cut into blocks of neighbours. A block's summary has the largest and smallest component in each dimension,
so the sum of a query's best terms bounds every score in the block. For each query the blocks are ordered by that bound
and scored through the block's own matrix until the bound falls below the k-th score found; what is left can't matter.

Groups of vectors are spread over tasks and every query visits each group; queries stream through a task in batches,
so a task holds one group and one batch whatever their numbers. Each group gives k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivel.llm.common import lean, persist, prepare

SCALE = 1024
K = 10
BLOCK = 64
LEAST_GROUP, MOST_GROUP = 1024, 65_536
_LOW = -(1 << 62)


class Index:
    """Blocks of vectors (rows of a matrix of integers) with their summaries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = BLOCK):
        # Neighbours: those whose largest component is in the same dimension, by its size.
        top = np.argmax(np.abs(vectors), axis=1) if vectors.shape[1] else np.zeros(len(ids), dtype=np.int64)
        value = vectors[np.arange(len(ids)), top] if vectors.shape[1] else ids
        order = np.lexsort((ids, value, top))
        self.ids, self.block = ids[order], block
        self.exact = bool(len(ids)) and vectors.shape[1] * float(np.abs(vectors).max(initial=0)) ** 2 < 2**53
        self.vectors = vectors[order].astype(np.float64) if self.exact else vectors[order]
        cuts = np.arange(0, len(ids), block)
        self.high, self.low = np.maximum.reduceat(self.vectors, cuts), np.minimum.reduceat(self.vectors, cuts)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) by query, the best first, ties to the smaller id; unused places have score _LOW. Also the number of blocks scored."""
        exact = self.exact and queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) < 2**53
        kind = np.float64 if exact else np.int64
        q, high, low, vectors = (x.astype(kind) for x in (queries, self.high, self.low, self.vectors))
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        best = np.full((len(q), k), _LOW, dtype=np.int64)
        who = np.full((len(q), k), (1 << 63) - 1, dtype=np.int64)
        live, scored = np.arange(len(q)), 0
        for r in range(bound.shape[1]):
            b = order[live, r]
            live = live[bound[live, b] >= best[live, -1]]  # an equal score may have a smaller id
            if not len(live):
                break
            b = order[live, r]
            for name in np.unique(b):
                rows = live[b == name]
                at = slice(name * self.block, (name + 1) * self.block)
                ids = self.ids[at]
                score = (q[rows] @ vectors[at].T).astype(np.int64)
                score[query_ids[rows][:, None] == ids] = _LOW
                all_scores = np.concatenate([best[rows], score], axis=1)
                all_ids = np.concatenate([who[rows], np.broadcast_to(ids, score.shape)], axis=1)
                first = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
                best[rows] = np.take_along_axis(all_scores, first, axis=1)
                who[rows] = np.take_along_axis(all_ids, first, axis=1)
                scored += len(rows)
        return who, best, scored


def top_k(rows: DataFrame, k: int = K, every: int = 100, scale: int = SCALE, block: int = BLOCK, group_rows: int | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k best other rows by inner product.

    Component x counts as floor(scale * x). Rows with a null id or vector, or with null or non-finite components, take no
    part. Ties go to the smaller id, fewer than k rows are all returned. Vectors of different lengths are filled up with
    zeros. Of several rows with one id the smallest vector asks, and none of them is an answer to it; as answers to others
    they all count. Further columns are ignored; no rows give no rows. Components so large that a score may not fit a long raise an error.
    """
    prepare(rows.sparkSession)
    fine = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    given = rows.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & F.coalesce(fine, F.lit(False)))
    base = persist(given.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(vector_column, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")), "vectors")
    n, width, most = base.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    if (most or 0.0) ** 2 * (width or 0) >= 2.0**62:
        raise ValueError(f"scores of components up to {most:.0f} can be beyond a long; use a smaller scale")
    size = group_rows or max(LEAST_GROUP, min(MOST_GROUP, n // 32))
    groups = max(1, -(-n // size))
    docs = base.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "vec_id", "v")
    asking = base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = asking.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "vec_id", "v")

    def matrix(column: pa.ListArray) -> np.ndarray:
        lens = np.diff(column.offsets.to_numpy())
        out = np.zeros((len(column), width or 0), dtype=np.int64)
        out[np.arange(width or 0) < lens[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            g, kind = batch.column("g").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                ids, vectors = batch.column("vec_id").to_numpy()[a:b], matrix(batch.column("v").slice(a, b - a))
                if g[a] != now:
                    now, held, index = g[a], [], None
                if kind[a] == 0:
                    held.append((ids, vectors))
                    continue
                if index is None:
                    if not held:
                        continue
                    index, held = Index(*(np.concatenate(x) for x in zip(*held, strict=True)), block), held[:1]
                for s in range(0, len(ids), 1024):
                    q = ids[s : s + 1024]
                    who, score, _ = index.search(q, vectors[s : s + 1024], k)
                    full = score > _LOW
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, k)[full.reshape(-1)]), pa.array(who[full]), pa.array(score[full])], ["query_id", "vec_id", "score"])

    found = docs.unionByName(queries).repartition("g").sortWithinPartitions("g", "kind").mapInArrow(lean(search), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""

__all__ = ["Index", "ORACLE", "top_k"]
