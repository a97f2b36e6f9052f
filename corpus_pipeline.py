"""From raw documents to packed token sequences: toxicity, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.llm import exact_dedup, mixing, near_copies, packing, toxicity
from scrivel.llm.common import SPACE, discard, persist, shared_dir, whole_text
from scrivel.llm.queries import TOKENIZER


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Null and empty texts are scored too, and stay; repeated rows stay or go together; no rows give no rows."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of equal texts stays; of repeated rows, one. Null ids come after all others.

    Whole rows are shuffled once, against the ids that stay. Only rows whose doc_id occurs more than once, or is null, are
    told apart by their texts and grouped.
    """
    path, c = shared_dir(spark, "exact-entries"), F.col
    groups = persist(exact_dedup.exact_groups(docs, entries_path=path).select(c("doc_id").alias("kept_id"), "kept", "text_sha256"), "exact-kept")
    discard(spark, path)
    many = persist(groups.where("kept_id is not null").groupBy("kept_id").count().where("count > 1").select("kept_id"), "exact-repeated")
    kept = groups.where("kept").drop("kept")
    once = kept.where("kept_id is not null").join(many, "kept_id", "left_anti").select("kept_id")
    out = docs.join(once, c("doc_id") == c("kept_id"), "left_semi")
    told = kept.where("kept_id is null").unionByName(kept.join(many, "kept_id", "left_semi"))
    if told.isEmpty():
        return out
    some = docs.where("doc_id is null").unionByName(docs.join(many, c("doc_id") == c("kept_id"), "left_semi"))
    sha = F.sha2(F.regexp_replace(whole_text(), SPACE, " "), 256)
    rows = some.select(F.struct(*docs.columns).alias("row"), c("doc_id").alias("row_id"), sha.alias("row_sha"))
    same = c("row_id").eqNullSafe(c("kept_id")) & (c("row_sha") == c("text_sha256"))
    return out.unionByName(rows.join(told, same, "left_semi").groupBy("row_id", "row_sha").agg(F.first("row").alias("row")).select("row.*"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a 5-word Jaccard similarity of 0.8 or more the document with the smallest doc_id stays. Rows without a doc_id stay: they link nothing."""
    gone = near_copies.similar_ids(docs).where("doc_id != component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their weights: a document comes as often as the mix takes it, 0 to 2 times. Nulls are a source of their own; ties of
    the seeded order go by doc_id; rows that share doc_id and text come alike; no rows give no rows."""
    plan = persist(mixing.mix(docs).groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies")), "mix-plan")
    plan = plan.select(F.col("doc_id").alias("plan_id"), F.col("text_hash").alias("plan_hash"), "copies")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64(whole_text()).alias("row_hash"))
    taken = rows.join(plan, F.col("row_id").eqNullSafe(F.col("plan_id")) & (F.col("row_hash") == F.col("plan_hash")))
    return taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("use")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids. Null and empty texts are the end id alone; rows are packed as often as they occur; no rows give no rows."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", clean_of_toxicity), ("exact dedup", without_copies), ("near dedup", without_near_copies), ("mixing", mixed), ("packing", packed)]

#: The classifier and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = persist(out, f"pipeline-{name.replace(' ', '-')}")
    return out
