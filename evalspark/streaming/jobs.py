"""Structured Streaming over append logs: first records, hourly rollups, ready cells.

Sinks are file tables in a folder the caller names, so results never pass the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: StructType, pattern: str | None = None,
             files_per_trigger: int | None = None) -> DataFrame:
    """A growing folder of Parquet parts as a stream."""
    reader = spark.readStream.format("parquet").schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.load(path)


def first_records(log: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First record per key; duplicates within ``delay`` of event time are dropped.

    State is bounded by the watermark. Rows later than the watermark are dropped, and a
    batch merge stays authoritative for them.
    """
    return log.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def call_rollup(calls: DataFrame, ts: str, delay: str, keys: list[str], size: str = "1 hour") -> DataFrame:
    """Calls, failures, tokens and latency per tumbling window."""
    return (calls.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("failures"),
        F.sum("total_tokens").alias("total_tokens"), F.sum("latency_ms").alias("api_time_ms"))
        .select(F.col("w.start").alias("window_start"), *keys, "calls", "failures", "total_tokens", "api_time_ms"))


def to_table(stream: DataFrame, path: str) -> StreamingQuery:
    """Append a stream to Parquet, processing what is there now."""
    return (stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table")
            .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())


def coverage(records: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per cell of the table written by :func:`to_table`."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("done"))


def ready_cells(stream: DataFrame, expected: DataFrame, keys: list[str], path: str) -> StreamingQuery:
    """Emit a cell once its row count reaches ``expected_count``.

    Each micro-batch overwrites its own folder of per-cell counts and of newly ready
    cells, so a batch that is retried after a failure leaves the same tables. Counts are
    kept per batch and cell, not per row.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("done")).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
        counts = spark.read.parquet(f"{path}/counts").where(F.col("batch") <= batch_id)
        totals = counts.groupBy(*keys).agg(F.sum("done").alias("done"))
        before = counts.where(F.col("batch") < batch_id).groupBy(*keys).agg(F.sum("done").alias("before"))
        crossed = totals.join(expected, keys).join(before, keys, "left").where(
            (F.col("done") >= F.col("expected_count")) & (F.coalesce("before", F.lit(0)) < F.col("expected_count")))
        crossed.select(*keys, "expected_count").write.mode("overwrite").parquet(f"{path}/ready/batch={batch_id}")

    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/progress")
            .trigger(availableNow=True).start())
