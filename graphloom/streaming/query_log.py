"""Query log: append, retention, daily summaries and alerts, batch and streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..schema import QUERY_LOG, Settings


def entry(tool: str, query_type: str, params: dict, result_count: int, duration_ms: float, error: str | None = None, now: datetime | None = None) -> dict:
    """One log row; ``entity_not_found`` is an entity query without results."""
    zero = result_count == 0
    return {"ts": now or datetime.now(timezone.utc), "tool_name": tool, "query_type": query_type, "query_params": json.dumps(params, sort_keys=True), "result_count": result_count, "zero_results": zero, "entity_not_found": zero and query_type == "entity", "duration_ms": duration_ms, "error": error}


def append(spark: SparkSession, rows: list[dict], path: str) -> None:
    """JSON lines in a folder per day, which is what retention drops."""
    spark.createDataFrame(rows, QUERY_LOG).withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").json(path)


def expired(days: list[str], today: date, retention: int = 7) -> list[str]:
    """Days before the retention; today's always stays."""
    return sorted(d for d in days if date.fromisoformat(d) < today - timedelta(days=retention))


def apply_retention(spark: SparkSession, path: str, today: date, retention: int = 7) -> list[str]:
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    days = {s.getPath().getName().removeprefix("date="): s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("date=")}
    gone = expired(list(days), today, retention)
    for d in gone:
        fs.delete(days[d], True)
    return gone


def to_folder(spark: SparkSession, path: str, retention: int = Settings.log_retention_days) -> Callable[[dict], None]:
    """A service's log: each entry is a file of its own in its day's folder, so writers never meet; days beyond the retention go with the first entry of a day."""
    swept: set[date] = set()

    def log(row: dict) -> None:
        jvm = spark.sparkContext._jvm  # noqa: SLF001
        day = row["ts"].astimezone(timezone.utc).date()
        file = jvm.org.apache.hadoop.fs.Path(f"{path}/date={day}/{uuid.uuid4().hex}.json")
        out = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(file, False)  # noqa: SLF001
        try:
            out.write(bytearray(json.dumps(row | {"ts": row["ts"].astimezone(timezone.utc).isoformat(timespec="milliseconds")}).encode() + b"\n"))
        finally:
            out.close()
        if day not in swept:
            swept.add(day)
            apply_retention(spark, path, day, retention)

    return log


def from_events(events: DataFrame) -> DataFrame:
    """The test events as log rows."""
    return events.select(F.col("ts"), F.col("event_type").alias("tool_name"), F.col("value").alias("duration_ms"), "user_id")


def daily(log: DataFrame) -> DataFrame:
    """Per day and tool: number, mean and largest duration. Works on streams with a watermark too."""
    return log.groupBy(F.window("ts", "1 day").alias("w"), "tool_name").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms")).select(F.col("w.start").alias("day"), "tool_name", "n", "mean_ms", "max_ms")


def alerts(scores: DataFrame, baseline: float, drop: float = 0.2, days: int = 3) -> DataFrame:
    """(first, last, length) of runs of at least ``days`` consecutive days whose score is more than ``drop`` below the baseline."""
    low = scores.where(F.col("score") < baseline * (1 - drop)).select(F.to_date("day").alias("day"))
    # one row a day: the order is over days, not over the log
    island = F.date_sub("day", F.row_number().over(Window.orderBy("day")))
    return low.withColumn("island", island).groupBy("island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("length")).where(F.col("length") >= days).drop("island")


def sample(log: DataFrame, percent: int = 5, key: str = "user_id") -> DataFrame:
    """A fixed part of the log by hash, the same on every run (a sampling operator)."""
    return log.where(F.pmod(F.xxhash64(key), F.lit(100)) < percent)


def stream_daily(spark: SparkSession, path: str, out: str, checkpoint: str, schema: str = QUERY_LOG, late: str = "1 day"):
    """Daily summaries of a growing log folder; days are written once the watermark has passed them."""
    rows = spark.readStream.schema(schema).json(path).withWatermark("ts", late)
    return daily(rows).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_upserts(spark: SparkSession, path: str, store, table: str, schema: str, checkpoint: str, files: int = Settings.batch_size):
    """Micro-batches of ``files`` files of rows into a versioned table; a batch that is replayed changes nothing."""

    def flush(batch: DataFrame, _: int) -> None:
        store.upsert(table, batch)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    return rows.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
