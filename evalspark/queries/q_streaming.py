"""Streaming jobs run to the end of the given event log, then read from their tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalspark.queries import query, table
from evalspark.queries.standins import SQL_K, k_of
from evalspark.session import ensure_checkpoint_dir
from evalspark.streaming import jobs as J


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


def _log(spark, sf):
    schema = table(spark, sf, "events").schema
    return J.read_log(spark, sf, schema, "events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type AS task, count(DISTINCT user_id) AS done FROM events GROUP BY 1")
def streaming_coverage(spark, sf):
    """K1: first record per sample and task, counted per task"""
    folder = _folder(spark)
    J.to_table(J.first_records(_log(spark, sf).select(F.col("event_type").alias("task"), "user_id", "ts"), ["task", "user_id"], "ts", "60 days"), folder).awaitTermination()
    return J.coverage(spark.read.parquet(f"{folder}/table"), ["task"])


@query(f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS stage, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures,
 sum({SQL_K})::BIGINT AS total_tokens, round(sum(value), 3) AS api_time_ms FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""")
def streaming_call_rollup(spark, sf):
    """K2: windows the watermark has closed"""
    folder = _folder(spark)
    log = _log(spark, sf).select(
        "ts", F.col("event_type").alias("stage"), (F.col("event_type") != "error").alias("success"),
        k_of(F.col("props")).cast("bigint").alias("total_tokens"), F.col("value").alias("latency_ms"))
    J.to_table(J.call_rollup(log, "ts", "10 minutes", ["stage"]), folder).awaitTermination()
    rows = spark.read.parquet(f"{folder}/table")
    return rows.withColumns({"window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), "api_time_ms": F.round("api_time_ms", 3)})


@query("""WITH u AS (SELECT event_type AS task, count(DISTINCT user_id) AS done FROM events GROUP BY 1), e AS (SELECT count(DISTINCT user_id) AS n FROM events)
SELECT task, CASE WHEN task IN ('click', 'view') THEN n + 1 ELSE n END AS expected_count FROM u, e WHERE done >= CASE WHEN task IN ('click', 'view') THEN n + 1 ELSE n END""")
def streaming_ready_cells(spark, sf):
    """K3: two cells expect one sample more than there is"""
    folder = _folder(spark)
    events = table(spark, sf, "events")
    tasks = events.select(F.col("event_type").alias("task")).distinct()
    users = events.select("user_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    expected = tasks.withColumn("expected_count", users.scalar() + F.when(F.col("task").isin("click", "view"), 1).otherwise(0))
    first = J.first_records(_log(spark, sf).select(F.col("event_type").alias("task"), "user_id", "ts"), ["task", "user_id"], "ts", "60 days")
    J.ready_cells(first, expected, ["task"], folder).awaitTermination()
    return spark.read.parquet(f"{folder}/ready").select("task", "expected_count")
