"""Intake of a folder by new files only (ORC1, ORC2, REV2), with a ledger by content.

A file stream gives each file once. A batch writes its part of the ledger and its results as tables of their own under its number,
so a batch that failed and runs again writes the same ones. A file whose content has been taken before, under whatever name, is a repeat: it
is listed, but not read again. Of equal files within a batch the one with the least path is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.sources.files import PATTERN, described, many_files
from scrivel.streaming.shared import prepare

_FILES = "path string, modificationTime timestamp, length long, content binary"
LEDGER = "path string, sha string, status string, same_as string"


def marked(batch: DataFrame, earlier: DataFrame) -> DataFrame:
    """The ledger's rows of a batch (path, sha): taken or repeat, and the path that was taken with that content."""
    c = F.col
    known = earlier.where("status = 'taken'").select("sha", c("path").alias("before")).dropDuplicates(["sha"])
    first = batch.groupBy("sha").agg(F.min("path").alias("first"))
    rows = batch.join(first, "sha").join(known, "sha", "left")
    taken = c("before").isNull() & (c("path") == c("first"))
    return rows.select("path", "sha", F.when(taken, "taken").otherwise("repeat").alias("status"), F.coalesce("before", "first").alias("same_as"))


def ledger(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """The ledger so far, or of the batches before one; with the batch of each row."""
    if before == 0:
        return spark.createDataFrame([], f"{LEDGER}, batch int")
    table = spark.read.schema(f"{LEDGER}, batch int").option("basePath", f"{state}/ledger").parquet(f"{state}/ledger")
    return table if before is None else table.where(F.col("batch") < before)


def take(spark: SparkSession, folder: str, state: str, process: Callable[[DataFrame], DataFrame], most: int = 1000) -> DataFrame:
    """Takes what is new in the folder since the last call on the same state, `most` files a batch; returns the ledger.

    process makes results of files (path, name, stem, extension, content), which are written to {state}/results by batch.
    """
    many_files(prepare(spark))
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", PATTERN).option("maxFilesPerTrigger", most).load(folder)

    def one(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        rows = marked(batch.select("path", F.sha2("content", 256).alias("sha")), ledger(own, state, number))
        rows.write.mode("overwrite").parquet(f"{state}/ledger/batch={number}")
        here = own.read.schema(LEDGER).parquet(f"{state}/ledger/batch={number}").where("status = 'taken'").select("path")
        process(described(batch.join(here, "path", "left_semi"))).write.mode("overwrite").parquet(f"{state}/results/batch={number}")

    files.writeStream.foreachBatch(one).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ledger(spark, state)
