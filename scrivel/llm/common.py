"""What the corpus operators share: word and white-space rules, the shared folder, lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is the ASCII set that bytes.split() uses: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
ROOT = str(Path(__file__).resolve().parents[2])
#: Python workers get Arrow batches of at most about so many bytes (or one row); a lower setting of the session stays.
BATCH_BYTES = 4_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's path has it, and bound the batches they get.

    A batch is held by the JVM and by the worker, so its bytes count twice for each core; the default of 64 MB is too much
    where rows are whole texts.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    now = int(spark.conf.get(_BATCH).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is unset (tests on one machine) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="scrivel-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def persist(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends here, and a lost executor costs only a read."""
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables of one operator in the shared folder, deleted together or one by one when nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, shared_dir(spark, name), 0
        self.of: dict[int, tuple[str, DataFrame]] = {}

    def persist(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{name}-{self.n}"
        out = persist(df, name, path)
        self.of[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            discard(self.spark, self.of.pop(id(table))[0])

    def close(self) -> None:
        discard(self.spark, self.path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f for mapInArrow, after which the worker gives what it has freed back to the machine: workers live on between stages."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


def partitions_for(spark: SparkSession, n_bytes: int, each: int = 64_000_000) -> int:
    """How many partitions to deal n_bytes into: about `each` bytes a partition, and no fewer than the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // each))


def whole_text(column: str = "text"):
    """Null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: bytes) -> list[bytes]:
    return text.split()


def one_space(text: bytes) -> bytes:
    """Each run of white space becomes one space, at the ends too."""
    if not text:
        return text
    body = b" ".join(text.split())
    if not body:
        return b" "
    return (b" " if text[:1].isspace() else b"") + body + (b" " if text[-1:].isspace() else b"")


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: {step})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({text}) + 1), lambda i: CAST(ord(substr({text}, i, 1)) AS BIGINT))), lambda a, b: {byte}), 4294967295)"
