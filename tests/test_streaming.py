"""Streams over several files equal the batch result."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evalspark.streaming import jobs as J

START = datetime(2024, 1, 1)
SCHEMA = "task string, sample_id int, ts timestamp, success boolean, total_tokens bigint, latency_ms double"


def write_log(spark, path):
    rows = [("t%d" % (i % 2), i % 37, START + timedelta(minutes=i), i % 5 != 0, i, float(i)) for i in range(600)]
    for n in range(4):
        spark.createDataFrame(rows[n * 150:(n + 1) * 150], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return rows


def log(spark, path):
    return J.read_log(spark, path, spark.read.parquet(path).schema, "*.parquet", files_per_trigger=1)


def test_first_records_and_ready_cells(spark, tmp_path):
    rows = write_log(spark, f"{tmp_path}/log")
    first = J.first_records(log(spark, f"{tmp_path}/log"), ["task", "sample_id"], "ts", "30 days")
    J.to_table(first, f"{tmp_path}/k1").awaitTermination()
    got = {r["task"]: r["done"] for r in J.coverage(spark.read.parquet(f"{tmp_path}/k1/table"), ["task"]).collect()}
    want = {t: len({r[1] for r in rows if r[0] == t}) for t in ("t0", "t1")}
    assert got == want
    expected = spark.createDataFrame([("t0", want["t0"]), ("t1", want["t1"] + 1)], "task string, expected_count int")
    J.ready_cells(first, expected, ["task"], f"{tmp_path}/k3").awaitTermination()
    assert [r["task"] for r in spark.read.parquet(f"{tmp_path}/k3/ready").collect()] == ["t0"]


def test_hourly_rollup_closes_windows(spark, tmp_path):
    rows = write_log(spark, f"{tmp_path}/log")
    J.to_table(J.call_rollup(log(spark, f"{tmp_path}/log"), "ts", "5 minutes", ["task"]), f"{tmp_path}/k2").awaitTermination()
    got = {(r["window_start"], r["task"]): (r["calls"], r["failures"], r["total_tokens"]) for r in spark.read.parquet(f"{tmp_path}/k2/table").collect()}
    limit = max(r[2] for r in rows) - timedelta(minutes=5)
    want = {}
    for task, _, ts, ok, tokens, _ in rows:
        hour = ts.replace(minute=0)
        if hour + timedelta(hours=1) <= limit:
            c, f, t = want.get((hour, task), (0, 0, 0))
            want[hour, task] = (c + 1, f + (not ok), t + tokens)
    assert got == want


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    path = f"{tmp_path}/log"
    early = [("t", 1, START, True, 1, 1.0), ("t", 2, START + timedelta(hours=9), True, 1, 1.0)]
    for rows in (early, [("t", 3, START + timedelta(minutes=1), True, 1, 1.0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    J.to_table(J.call_rollup(log(spark, path), "ts", "1 minute", ["task"]), f"{tmp_path}/out").awaitTermination()
    first = spark.read.parquet(f"{tmp_path}/out/table").where(F.col("window_start") == F.lit(START)).collect()
    assert [r["calls"] for r in first] in ([1], [2])
