"""The life of upload jobs as a keyed stream (SRC13, ORC4, ORC5): running, done, stale; the same result sent twice counts once.

events: job_id, kind (start, result, or another word that only tells that time goes on), name, status, fields, total, at. The stream's state
holds one row for each job, kind and name: its first result, how often it came, its last announcement and time; a job of many results
is many rows. A job is done when as many results have come as it announced; if nothing comes for `patience` by the stream's own
time, the latest event so far, a job that isn't done is stale until its next event. Events may come in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivel.streaming.shared import prepare

EVENTS = "job_id string, kind string, name string, status string, fields long, total long, at timestamp"
_TOLD = "job_id string, kind string, name string, n long, status string, fields long, total long, at timestamp"


def follow(spark: SparkSession, folder: str, state: str, patience_ms: int, most: int = 1000) -> DataFrame:
    """Reads the event files that are new in the folder and returns the last state of each job; call again on the same state for more."""
    events = prepare(spark).readStream.schema(EVENTS).option("maxFilesPerTrigger", most).parquet(folder)
    held = events.groupBy("job_id", "kind", "name").agg(F.count("*").alias("n"), F.first("status").alias("status"), F.first("fields").alias("fields"), F.last("total").alias("total"), F.max("at").alias("at"))
    query = held.writeStream.outputMode("update").foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{state}/states/batch={number}"))
    query.option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return last_states(spark, state, patience_ms)


def last_states(spark: SparkSession, state: str, patience_ms: int) -> DataFrame:
    """Of each job its state by what the batches told.

    A job's time is up `patience` after its last event, but not before the stream's time has gone on since the batch that told of it last.
    """
    c = F.col
    told = spark.read.schema(f"{_TOLD}, batch int").option("basePath", f"{state}/states").parquet(f"{state}/states")
    held = told.groupBy("job_id", "kind", "name").agg(F.max_by(F.struct("n", "status", "fields", "total", "at"), "batch").alias("s"), F.max("batch").alias("batch")).select("job_id", "kind", "name", "s.*", "batch")
    result = c("kind") == "result"
    jobs = held.groupBy("job_id").agg(
        F.max(F.when(c("kind") == "start", c("total"))).alias("total"), F.count_if(result).alias("done"), F.count_if(result & (c("status") == "success")).alias("success"),
        F.coalesce(F.sum(F.when(result, c("fields"))), F.lit(0)).alias("fields"), F.coalesce(F.sum(F.when(result, c("n") - 1)), F.lit(0)).alias("repeats"), F.max("at").alias("last"), F.max("batch").alias("batch"),
    )
    # the stream's time before each batch and now: a row a batch
    by_batch = told.groupBy("batch").agg(F.unix_millis(F.max("at")).alias("at"))
    order = Window.orderBy("batch")
    clock = by_batch.select("batch", F.max("at").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.max("at").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("now"))
    up = F.greatest(F.unix_millis("last") + patience_ms, c("before") + 1)
    status = F.when(F.coalesce(c("done") >= c("total"), F.lit(False)), "done").when(up < c("now"), "stale").otherwise("running")
    mean = F.when(c("done") > 0, F.bround(c("fields") / F.greatest("done", F.lit(1)), 1)).otherwise(0.0)
    return jobs.join(F.broadcast(clock), "batch").select("job_id", status.alias("status"), "total", "done", "success", (c("done") - c("success")).alias("errors"), mean.alias("avg_fields"), "repeats")
