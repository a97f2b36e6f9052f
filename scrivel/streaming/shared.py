"""What the engine needs of the cluster: the folder that driver and executors share, and workers that can import it."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Python workers get Arrow batches of at most about so many bytes (or one row); a lower setting of the session stays.
BATCH_BYTES = 16_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where only the driver's path has it, and bound the batches they get."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    now = int(spark.conf.get(_BATCH).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a temporary one, on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="scrivel-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its plan ends here, and what it took to make is not made again."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like `written`, in as many buckets by key as a shuffle has partitions: what follows by that key, alone or with others, needs no dealing.

    The catalogue's entry of the table is gone when this returns; the frame and the files stay.
    """
    spark, path, table = df.sparkSession, shared_dir(df.sparkSession, name), f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt evenly (or by keys) over as many tasks as a shuffle has, and what is worked out from them stays behind that shuffle.

    Filters, also those that Spark infers from an explode, would go before it with all that they need; none goes through one that isn't deterministic.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).where(F.spark_partition_id() >= 0)
