"""Job progress over a folder of files as they come (ORC4, ORC5, AGG15), with the batch aggregate's own expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.operators.records import job_status


def progress(spark: SparkSession, folder: str, schema, to_results, state: str, checkpoint: str, max_files: int = 100) -> DataFrame:
    """Runs the stream over what is in the folder and returns the last state; new files are taken on the next call with the same checkpoint.

    Each batch writes the state as a table of its own below `state`, by batch number: a batch that is run again writes the
    same one, and nothing is held by the driver.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    query = job_status(to_results(events)).writeStream.outputMode("complete").foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{state}/batch={number}"))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    table = spark.read.option("basePath", state).parquet(state)
    last = table.agg(F.max("batch")).first()[0]
    return table.where(F.col("batch") == last).drop("batch")


def results_of_events(events: DataFrame) -> DataFrame:
    """Events read as parse results: the type is the job, a purchase or a value over zero a success."""
    return events.select(F.col("event_type").alias("job_id"), F.when(F.col("value") > 0, "success").otherwise("error").alias("status"), F.col("value").alias("fields"))
