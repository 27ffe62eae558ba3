"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space: words are maximal runs of any other character.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: For tables that this subpackage writes: no checksum files beside them, as Parquet's pages have checksums of their own. Without its native library
#: Hadoop starts a process for each permission that it sets on a mounted folder (five for a file with checksums, two without), each of which is an
#: image of the whole executor until it has become ``chmod``.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Taken from ``spark.checkpoint.dir``; only where that is unset and Spark
    runs in one process (tests, local mode) a temporary folder is created.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="graphloom-shared-")
        sc.setCheckpointDir(path)
    return path


#: Bytes of input for each file of a result.
FILE_BYTES = 1 << 26


def gathered(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` in one file for each ``FILE_BYTES`` of the table that it was made from, but two for each core. Nothing is shuffled.

    Gather before a step in Python, not after it: what a task has exchanged with its worker for one partition is kept until the task ends.
    """
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # very large where it is not known
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, min(-(-size // FILE_BYTES), 1 << 30)))


#: Bytes that a writer of an intermediate table holds before it writes them out.
ROW_GROUP_BYTES = 1 << 24
#: Rows of one Arrow batch where a step is run at once: whole texts and sets of shingles are some kilobytes a row, and each is held by the executor and its worker.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows (fewer if the session says so) for what is run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, min(rows, before) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """As ``small_batches``, from now on: for a session that runs steps of whole texts one after another."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, min(rows, before) if before > 0 else rows)


def materialize(df: DataFrame, name: str, codec: str = "zstd", source: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts the lineage and survives the loss of any executor.  ``source``:
    the table that a large ``df`` is made from, by whose size files are few.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df = df if source is None else gathered(df, source)
    with small_batches(spark):
        df.write.options(**PLAIN_FILES).option("compression", codec).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table that ``materialize`` returned."""
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles():
        folder = jvm.org.apache.hadoop.fs.Path(f)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, False)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Spark deletes them once the driver has collected what refers to them,
    which a driver with little to do may put off for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(id_col: str, n: int):
    """crc32 of the id's decimal text modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)
