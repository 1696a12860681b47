"""Token and latency accounting over a call log and per-sample rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions.stats import rounded_mean
from evalspark.operators.ordered import exact_quantiles, time_chunk, with_neighbours, with_position

TOKENS = ["input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "reasoning_tokens"]


COUNTERS = ["api_call_count", "successful_api_call_count", "failed_api_call_count", "usage_missing_call_count"]


def call_sums() -> list[Column]:
    """Null-aware call aggregates; a token sum stays NULL while no value is known."""
    return [
        *[F.sum(t).alias(t) for t in TOKENS],
        F.sum(F.coalesce("latency_ms", F.lit(0.0))).alias("api_time_ms"),
        F.sum(F.coalesce("retry_sleep_ms", F.lit(0.0))).alias("retry_wait_ms"),
        F.count(F.lit(1)).alias("api_call_count"),
        F.count_if("success").alias("successful_api_call_count"),
        F.count_if(~F.col("success")).alias("failed_api_call_count"),
        F.count_if(F.col("success") & ~F.coalesce("usage_available", F.lit(False))).alias("usage_missing_call_count"),
    ]


def _merged_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in [*TOKENS, "api_time_ms", "retry_wait_ms", *COUNTERS]]


def aggregate_calls(calls: DataFrame, keys: list[str], total_over: str | None = None) -> DataFrame:
    """Call totals per key, by three combinable steps: sample and stage, stage, key.

    ``retry_count`` is the highest attempt per stage over the whole group, minus one,
    summed over stages; ``retry_total`` sums the same per sample and stage.
    ``total_over`` names a key for which total rows (that key NULL) are added; they are
    rolled up from the per-sample step, so the call log is read and reduced once.
    """
    attempt = F.coalesce("attempt", F.lit(1))
    fine = calls.groupBy(*keys, F.coalesce("stage", F.lit("unknown")).alias("stage"), "sample_id").agg(
        F.max(attempt).alias("attempt"), *call_sums())
    if total_over:
        fine = fine.withColumn(total_over, F.explode(F.array(F.lit(None).cast("string"), F.col(total_over))))
    by_stage = fine.groupBy(*keys, "stage").agg(
        *_merged_sums(), F.greatest(F.max("attempt") - 1, F.lit(0)).alias("retry_count"),
        F.sum(F.col("attempt") - 1).alias("retry_total"))
    return by_stage.groupBy(*keys).agg(
        *_merged_sums(), F.sum("retry_count").alias("retry_count"), F.sum("retry_total").alias("retry_total")
    ).withColumns({c: F.round(c, 3) for c in ("api_time_ms", "retry_wait_ms")})


def number_attempts(calls: DataFrame) -> DataFrame:
    """Attempt number of each call within sample and stage, by start time.

    ``call_id`` breaks ties. Time chunks keep a busy sample out of a single task.
    """
    return with_position(calls, ["sample_id", "stage"], ["request_started_at", "call_id"],
                         time_chunk(F.col("request_started_at")), "attempt")


def retry_gaps(calls: DataFrame) -> DataFrame:
    """Wait between a failed call and the stage's next request, on the failed call's row."""
    linked = with_neighbours(calls, ["sample_id", "stage"], ["request_started_at", "call_id"],
                             time_chunk(F.col("request_started_at")), ["request_started_at"])
    gap = (F.unix_micros("next.request_started_at") - F.unix_micros("response_received_at")) / 1000.0
    waited = F.when(~F.col("success") & (gap > 0), F.round(gap, 3)).otherwise(0.0)
    return linked.withColumn("retry_sleep_ms", F.coalesce(waited, F.lit(0.0))).drop("prev", "next")


def keep_recorded_runs(samples: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Latest record per key, except that a run without calls never replaces one with calls."""
    order = F.struct((F.col("api_call_count") > 0).alias("has_calls"), F.col("run_started_at"))
    return samples.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(*keys, "_r.*")


def attach_calls(samples: DataFrame, calls: DataFrame) -> DataFrame:
    """Sample rows with their call totals on ``(sample_id, phase, run_id)``.

    Calls are reduced to that grain first, so the join is one row to one row however
    many calls a sample made.
    """
    keys = ["sample_id", "phase", "run_id"]
    totals = calls.groupBy(*keys).agg(*call_sums()).withColumns(
        {c: F.round(c, 3) for c in ("api_time_ms", "retry_wait_ms")})
    return samples.join(totals, keys, "left")


STATISTICS = {
    "sample_wall_time_ms": "sample_wall_time_ms", "input_tokens": "input_tokens_per_sample",
    "output_tokens": "output_tokens_per_sample", "total_tokens": "tokens_per_sample",
}


def sample_statistics(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, mean, median and nearest-rank p95 over successful samples, and the wall time."""
    done = F.col("success")
    base = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(done).alias("completed_sample_count"),
        F.count_if(~done).alias("failed_sample_count"),
        *[rounded_mean(F.when(done, F.col(c))).alias(f"mean_{label}") for c, label in STATISTICS.items()],
        F.round((F.unix_micros(F.max("sample_finished_at"))
                 - F.unix_micros(F.min(F.coalesce("run_started_at", "sample_started_at")))) / 1000.0, 3)
        .alias("batch_wall_time_ms"))
    measures = F.inline(F.array(*[
        F.struct(F.lit(label).alias("measure"), F.col(c).cast("double").alias("value")) for c, label in STATISTICS.items()]))
    spread = exact_quantiles(samples.where(done).select(*keys, measures), [*keys, "measure"], "value",
                             {"median": ("cont", 0.5), "p95": ("disc", 0.95)})
    wide = spread.groupBy(*keys).agg(*[
        column for label in STATISTICS.values() for column in (
            _half_up(F.max(F.when(F.col("measure") == label, F.col("median")))).alias(f"median_{label}"),
            F.max(F.when(F.col("measure") == label, F.col("p95"))).alias(f"p95_{label}"))])
    return join_null_safe(base, wide, keys)


def _half_up(median: Column) -> Column:
    """Three digits, halves up. A midpoint of three-digit values has four, so it is cast to those first."""
    return F.round(median.cast("decimal(38,4)"), 3).cast("double")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be NULL (the total rows of a grouping)."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    marked = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(marked, same, "left").drop(*[f"_r_{k}" for k in keys])


def throughput(run: DataFrame) -> DataFrame:
    """Three rates per second of batch wall time; NULL without a positive wall time."""
    seconds = F.when(F.col("batch_wall_time_ms") > 0, F.col("batch_wall_time_ms") / 1000)
    return run.select(
        "*", F.round(F.col("completed_sample_count") / seconds, 6).alias("samples_per_second"),
        F.round(F.col("output_tokens") / seconds, 6).alias("output_tokens_per_second"),
        F.round(F.col("total_tokens") / seconds, 6).alias("total_tokens_per_second"))


def run_report(samples: DataFrame, calls: DataFrame) -> DataFrame:
    """Run totals by ``(phase, run_id)`` and again by task inside it (task NULL = all tasks).

    A call belongs to the sample with its id, phase and run, and counts under that sample's
    task; calls without a sample count nowhere. Where a sample stands under several tasks, its calls count
    once, under the first of them. A sample without a wall time took 0 ms.
    """
    keys, place = ["phase", "run_id", "task"], ["sample_id", "phase", "run_id"]
    owners = samples.groupBy(*[F.col(c).alias(f"_o_{c}") for c in place]).agg(F.min("task").alias("task"))
    same = F.lit(True)
    for c in place:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    totals = aggregate_calls(calls.drop("task").join(owners, same).drop(*[f"_o_{c}" for c in place]), keys, total_over="task")
    samples = samples.withColumn("sample_wall_time_ms", F.coalesce("sample_wall_time_ms", F.lit(0.0)))
    with_total = samples.withColumn("task", F.explode(F.array(F.lit(None).cast("string"), F.col("task"))))
    return throughput(join_null_safe(sample_statistics(with_total, keys), totals, keys))
