"""Call-log accounting over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import efficiency as E
from evalspark.queries import query
from evalspark.queries.standins import CALLS_SQL, calls

_SUMS = """sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens,
 sum(cached_input_tokens)::BIGINT AS cached_input_tokens, sum(reasoning_tokens)::BIGINT AS reasoning_tokens, round(sum(latency_ms), 3) AS api_time_ms, round(sum(retry_sleep_ms), 3) AS retry_wait_ms,
 count(*) AS api_call_count, count(*) FILTER (success) AS successful_api_call_count, count(*) FILTER (NOT success) AS failed_api_call_count,
 count(*) FILTER (success AND NOT usage_available) AS usage_missing_call_count"""


def samples(spark, sf):
    """One row per user and day from the call log."""
    log = calls(spark, sf)
    wall = (F.unix_micros(F.max("response_received_at")) - F.unix_micros(F.min("request_started_at"))) / 1000.0
    return log.groupBy("run_id", "sample_id", "task", "phase").agg(
        F.min("request_started_at").alias("run_started_at"), F.min("request_started_at").alias("sample_started_at"),
        F.max("response_received_at").alias("sample_finished_at"), F.round(wall, 3).alias("sample_wall_time_ms"),
        (F.count_if("success") * 2 >= F.count(F.lit(1))).alias("success"),
        *[F.sum(t).alias(t) for t in E.TOKENS[:3]], F.count(F.lit(1)).alias("api_call_count"))


SAMPLES_SQL = """samples AS (SELECT run_id, sample_id, task, phase, min(request_started_at) AS run_started_at, max(response_received_at) AS sample_finished_at,
  round((epoch_us(max(response_received_at)) - epoch_us(min(request_started_at))) / 1000.0, 3) AS sample_wall_time_ms, count(*) FILTER (success) * 2 >= count(*) AS success,
  sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS api_call_count FROM calls GROUP BY ALL)"""


@query(f"""WITH {CALLS_SQL}, st AS (SELECT task, stage, max(attempt) - 1 AS r FROM calls GROUP BY ALL), ss AS (SELECT task, sample_id, stage, max(attempt) - 1 AS r FROM calls GROUP BY ALL),
a AS (SELECT task, {_SUMS} FROM calls GROUP BY 1)
SELECT a.*, (SELECT sum(r)::BIGINT FROM st WHERE st.task = a.task) AS retry_count, (SELECT sum(r)::BIGINT FROM ss WHERE ss.task = a.task) AS retry_total FROM a""")
def efficiency_call_totals(spark, sf):
    """F7, F10, T5"""
    out = E.aggregate_calls(calls(spark, sf), ["task"])
    return out.withColumns({"retry_count": F.col("retry_count").cast("bigint"), "retry_total": F.col("retry_total").cast("bigint")})


@query(f"""WITH {CALLS_SQL} SELECT call_id, row_number() OVER (PARTITION BY sample_id, stage ORDER BY request_started_at, call_id) AS attempt FROM calls""")
def efficiency_attempt_numbers(spark, sf):
    """G9"""
    return E.number_attempts(calls(spark, sf).drop("attempt")).select("call_id", "attempt")


@query(f"""WITH {CALLS_SQL}, g AS (SELECT *, (epoch_us(lead(request_started_at) OVER (PARTITION BY sample_id, stage ORDER BY request_started_at, call_id)) - epoch_us(response_received_at)) / 1000.0 AS gap FROM calls)
SELECT call_id, CASE WHEN NOT success AND gap > 0 THEN round(gap, 3) ELSE 0.0 END AS retry_sleep_ms FROM g""")
def efficiency_retry_gaps(spark, sf):
    """G10"""
    return E.retry_gaps(calls(spark, sf).drop("retry_sleep_ms")).select("call_id", "retry_sleep_ms")


@query(f"""WITH {CALLS_SQL}, {SAMPLES_SQL}, c AS (SELECT sample_id, phase, run_id, {_SUMS} FROM calls GROUP BY ALL)
SELECT s.sample_id, s.run_id, s.task, c.api_call_count, c.failed_api_call_count, c.api_time_ms, c.total_tokens FROM samples s LEFT JOIN c ON c.sample_id = s.sample_id AND c.phase = s.phase AND c.run_id = s.run_id""")
def efficiency_attach_calls(spark, sf):
    """E4"""
    out = E.attach_calls(samples(spark, sf).drop("api_call_count", *E.TOKENS[:3]), calls(spark, sf))
    return out.select("sample_id", "run_id", "task", "api_call_count", "failed_api_call_count", "api_time_ms", "total_tokens")


@query(f"""WITH {CALLS_SQL}, {SAMPLES_SQL}, m AS (SELECT *, CASE WHEN CAST(right(run_id, 2) AS INTEGER) % 5 = 0 THEN 0 ELSE api_call_count END AS made FROM samples)
SELECT sample_id, phase, arg_max(run_id, CASE WHEN made > 0 THEN '1' ELSE '0' END || run_id) AS run_id, arg_max(made, CASE WHEN made > 0 THEN '1' ELSE '0' END || run_id)::BIGINT AS api_call_count FROM m GROUP BY ALL""")
def efficiency_keep_recorded_runs(spark, sf):
    """Every fifth day replays without calls"""
    replay = F.right("run_id", F.lit(2)).cast("int") % 5 == 0
    rows = samples(spark, sf).withColumn("api_call_count", F.when(replay, 0).otherwise(F.col("api_call_count")).cast("bigint"))
    return E.keep_recorded_runs(rows, ["sample_id", "phase"], ["run_id", "api_call_count"])


_STATS = ", ".join(
    f"round(CAST(avg({c}) FILTER (success) AS DECIMAL(38,6)), 3)::DOUBLE AS mean_{l}, round(CAST(median({c}) FILTER (success) AS DECIMAL(38,4)), 3)::DOUBLE AS median_{l}, quantile_disc({c}, 0.95) FILTER (success)::DOUBLE AS p95_{l}"
    for c, l in E.STATISTICS.items())


@query(f"""WITH {CALLS_SQL}, {SAMPLES_SQL},
owners AS (SELECT * REPLACE (CASE WHEN sample_id % 13 = 0 THEN 'moved' ELSE task END AS task) FROM samples),
owned AS (SELECT c.* REPLACE (o.task AS task) FROM calls c JOIN owners o ON o.sample_id = c.sample_id AND o.run_id = c.run_id AND o.phase = CASE WHEN NOT c.success AND c.attempt = 4 THEN 'replay' ELSE c.phase END),
wide AS (SELECT * REPLACE (t AS task) FROM owners, LATERAL (SELECT unnest([NULL, owners.task]) AS t)), wcalls AS (SELECT * REPLACE (t AS task) FROM owned, LATERAL (SELECT unnest([NULL, owned.task]) AS t)),
s AS (SELECT phase, run_id, task, count(*) AS sample_count, count(*) FILTER (success) AS completed_sample_count, count(*) FILTER (NOT success) AS failed_sample_count, {_STATS},
  round((epoch_us(max(sample_finished_at)) - epoch_us(min(run_started_at))) / 1000.0, 3) AS batch_wall_time_ms FROM wide GROUP BY ALL),
c AS (SELECT phase, run_id, task, {_SUMS} FROM wcalls GROUP BY ALL),
st AS (SELECT phase, run_id, task, sum(r)::BIGINT AS retry_count FROM (SELECT phase, run_id, task, stage, max(attempt) - 1 AS r FROM wcalls GROUP BY ALL) GROUP BY ALL),
ss AS (SELECT phase, run_id, task, sum(r)::BIGINT AS retry_total FROM (SELECT phase, run_id, task, stage, sample_id, max(attempt) - 1 AS r FROM wcalls GROUP BY ALL) GROUP BY ALL)
SELECT s.*, c.* EXCLUDE (phase, run_id, task), st.retry_count, ss.retry_total, round(completed_sample_count / (batch_wall_time_ms / 1000), 6) AS samples_per_second,
 round(output_tokens / (batch_wall_time_ms / 1000), 6) AS output_tokens_per_second, round(total_tokens / (batch_wall_time_ms / 1000), 6) AS total_tokens_per_second
FROM s LEFT JOIN c ON s.run_id = c.run_id AND s.task IS NOT DISTINCT FROM c.task LEFT JOIN st ON s.run_id = st.run_id AND s.task IS NOT DISTINCT FROM st.task LEFT JOIN ss ON s.run_id = ss.run_id AND s.task IS NOT DISTINCT FROM ss.task""")
def efficiency_run_report(spark, sf):
    """Some samples carry another task than their calls, and some calls have no sample"""
    owners = samples(spark, sf).drop("api_call_count").withColumn("task", F.when(F.col("sample_id") % 13 == 0, "moved").otherwise(F.col("task")))
    log = calls(spark, sf).withColumn("phase", F.when(~F.col("success") & (F.col("attempt") == 4), "replay").otherwise(F.col("phase")))
    out = E.run_report(owners, log)
    return out.withColumns({"retry_count": F.col("retry_count").cast("bigint"), "retry_total": F.col("retry_total").cast("bigint")})
