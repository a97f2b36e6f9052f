"""Shards of bounded size by extendible hashing.

A directory maps prefixes of a document's hash to shards. It starts with one shard; a shard over the byte limit
splits on the next bit of the hash, and only such shards do. The splits need the byte sums of prefixes alone, so
the directory is grown from sums over the first bits and only the prefixes that are still too large are summed over
further bits, a few bits a round. Documents are then given their shard by a join on those bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import persist, whole_text

HASH_BITS = 60
LIMIT_BYTES = 1 << 20
ROUND_BITS = 12


def hash60(column: str):
    """The first 60 bits of the md5 of the id as text; null ids hash as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def directory(sums: DataFrame, limit_bytes: int = LIMIT_BYTES, round_bits: int = ROUND_BITS) -> list[tuple[int, DataFrame]]:
    """Grows the directory over rows (h, n_bytes). Gives for each round its bits and a table p, depth, shard, shard_bytes:
    hashes that begin with the bits p belong to that shard.

    The first round sums over round_bits bits; each further one only hashes below prefixes that are still too large.
    """
    rounds: list[tuple[int, DataFrame]] = []
    low, open_ = 0, sums
    while True:
        high = min(HASH_BITS, low + round_bits)
        fine = open_.groupBy(F.shiftright("h", HASH_BITS - high).alias("p")).agg(F.sum("n_bytes").alias("n_bytes"))
        fine = persist(fine, "shard-sums")
        first = low if low == 0 else low + 1
        paths = fine.select("p", "n_bytes", F.explode(F.sequence(F.lit(first), F.lit(high))).alias("depth")).withColumn("shard", F.expr(f"shiftright(p, {high} - depth)"))
        nodes = paths.groupBy("depth", "shard").agg(F.sum("n_bytes").alias("shard_bytes"))
        fits = nodes.where((F.col("shard_bytes") <= limit_bytes) | (F.col("depth") == HASH_BITS))
        # A prefix belongs to the shortest of its prefixes that fits: a bucket that fits is never split again.
        own = paths.select("p", "depth", "shard").join(fits, ["depth", "shard"]).groupBy("p").agg(F.min_by(F.struct("depth", "shard", "shard_bytes"), "depth").alias("s"))
        rounds.append((high, persist(own.select("p", "s.*"), "shard-directory")))
        large = fine.join(rounds[-1][1].select("p"), "p", "left_anti").select("p")
        if high == HASH_BITS or large.isEmpty():
            return rounds
        open_ = open_.withColumn("p", F.shiftright("h", HASH_BITS - high)).join(large, "p", "left_semi").drop("p")
        low = high


def with_shards(rows: DataFrame, rounds: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows with a column h get depth, shard and shard_bytes from the round that settled their prefix."""
    out = rows
    for k, (bits, own) in enumerate(rounds):
        out = out.withColumn("p", F.shiftright("h", HASH_BITS - bits)).join(own.select("p", F.struct("depth", "shard", "shard_bytes").alias(f"s{k}")), "p", "left").drop("p")
    found = F.coalesce(*(F.col(f"s{k}") for k in range(len(rounds))))
    return out.withColumn("s", found).select(*rows.columns, "s.depth", "s.shard", "s.shard_bytes")


def assign_shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, round_bits: int = ROUND_BITS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, depth, shard (the depth first bits of the hash, as a number) and shard_bytes for every row.

    A shard is a prefix whose texts have at most limit_bytes together while those of the prefix one bit shorter
    have more. What shares all 60 bits (one document over the limit, repeated ids) can't be split: it is a shard of
    depth 60 over the limit. Null texts have 0 bytes, null ids share one hash. Further columns are ignored. An empty
    table gives no rows. There are at most 60 / round_bits rounds, whatever the size.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.octet_length(whole_text(text_column)).cast("long").alias("n_bytes"), hash60(id_column).alias("h"))
    light = persist(rows, "shard-sizes")
    return with_shards(light, directory(light, limit_bytes, round_bits)).drop("h")


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes a folder of Parquet files for each shard below path, with all columns of docs.

    The folders are named by shard_name, or by that name with underscores behind it where docs has such a column. Null and
    empty texts have 0 bytes, null ids share one hash, repeated rows are all written to one shard; no rows write no folder.
    """
    folder = "shard_name"
    while folder in docs.columns:
        folder += "_"
    light = persist(docs.select(F.octet_length(whole_text(text_column)).cast("long").alias("n_bytes"), hash60(id_column).alias("h")), "shard-sizes")
    rows = docs.select(F.struct(*docs.columns).alias("row"), hash60(id_column).alias("h"))
    found = with_shards(rows, directory(light, limit_bytes))
    name = F.concat_ws("-", F.lpad(F.col("depth").cast("string"), 2, "0"), F.col("shard").cast("string"))
    found.select("row.*", name.alias(folder)).repartition(folder).write.partitionBy(folder).parquet(path)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h
  FROM documents),
paths AS (SELECT d.*, k AS depth, h >> ({HASH_BITS} - k) AS shard FROM d, range({HASH_BITS} + 1) AS r(k)),
nodes AS (SELECT depth, shard, sum(n_bytes) AS shard_bytes FROM paths GROUP BY ALL),
fits AS (SELECT * FROM nodes WHERE shard_bytes <= {LIMIT_BYTES} OR depth = {HASH_BITS}),
found AS (SELECT p.doc_id, p.n_bytes, p.h, min(p.depth) AS depth FROM paths p JOIN fits USING (depth, shard) GROUP BY ALL)
SELECT f.doc_id, f.n_bytes, CAST(f.depth AS INTEGER) AS depth, n.shard, CAST(n.shard_bytes AS BIGINT) AS shard_bytes
FROM found f JOIN nodes n ON n.depth = f.depth AND n.shard = f.h >> ({HASH_BITS} - f.depth)
"""

__all__ = ["ORACLE", "assign_shards", "directory", "hash60", "with_shards", "write_shards"]
