"""Metrics over judge records: dimension means, failure rate at K, pass tables, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark import registry
from evalspark.functions.stats import share, wilson_interval


def latest_scores(scores: DataFrame, keys: list[str], order: Column, k_max: int) -> DataFrame:
    """Last score of every run as columns ``s0..s{k_max-1}``, one row per sample.

    ``scores`` has ``run_index`` and an integer ``score``; the last record by ``order``
    wins. Runs become filtered aggregates, so one combinable shuffle does it; a single
    numeric or timestamp ``order`` (the append position) keeps that aggregate hash-based.
    """
    return scores.groupBy(*keys, "sample_id").agg(*[
        F.max_by("score", F.when(F.col("run_index") == run, order)).alias(f"s{run}") for run in range(k_max)])


def failure_rate_at_k(expected: DataFrame, latest: DataFrame, keys: list[str], k: Column, inverted: Column,
                      k_max: int, threshold: int = registry.FAILURE_THRESHOLD) -> DataFrame:
    """FR@1..k per cell: a sample fails when its worst score of the first K runs reaches the threshold.

    Samples without a score leave the denominator but stay in the coverage. ``k`` and
    ``inverted`` are expressions over the key columns.
    """
    joined = expected.join(latest, [*keys, "sample_id"], "left")
    sums = []
    for upto in range(1, k_max + 1):
        runs = [F.col(f"s{r}") for r in range(upto)]
        worst = F.greatest(*runs) if len(runs) > 1 else runs[0]
        sums += [F.count_if(worst >= threshold).alias(f"h{upto}"), F.count(worst).alias(f"n{upto}")]
    cells = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"), *sums)
    rows = F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"h{i}").alias("hits"), F.col(f"n{i}").alias("n_scored"))
                     for i in range(1, k_max + 1)])
    long = cells.select(*keys, "expected", F.inline(rows)).where(F.col("k") <= k)
    raw = F.col("hits") / F.when(F.col("n_scored") > 0, F.col("n_scored")) * 100
    bounds = wilson_interval(F.col("hits"), F.col("n_scored"), inverted)
    return long.select(
        *keys, F.concat(F.lit("FR@"), F.col("k").cast("string")).alias("k_label"), "k",
        F.when(inverted, 100 - raw).otherwise(raw).alias("rate_percent"),
        bounds["low"].alias("ci95_low"), bounds["high"].alias("ci95_high"),
        "hits", "n_scored", share(F.col("n_scored"), F.col("expected")).alias("coverage"))


def dimension_means(judged: DataFrame, keys: list[str], low: int = 0, high: int = 5) -> DataFrame:
    """Count, mean and percent per dimension from a ``dimension_scores`` map of integers."""
    scores = judged.select(*keys, F.explode("dimension_scores").alias("dimension", "value"))
    return (scores.where(F.col("value").between(low, high)).groupBy(*keys, "dimension")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
            .withColumn("percent", F.col("mean") / high * 100))


def dimension_macro(means: DataFrame, keys: list[str], high: int = 5) -> DataFrame:
    """Unweighted mean of the dimension means."""
    return (means.groupBy(*keys).agg(F.avg("mean").alias("macro_mean"))
            .withColumn("macro_percent", F.col("macro_mean") / high * 100))


def reportability(source_n: Column, retrieved_n: Column, judged_n: Column, final_coverage: Column | None = None,
                  gate: float = registry.COVERAGE_GATE) -> Column:
    """Coverage struct of a cell; ``final_coverage`` replaces the judge coverage in the gate."""
    complete = retrieved_n == source_n
    coverage = share(judged_n, retrieved_n)
    reportable = complete & ((coverage if final_coverage is None else final_coverage) >= gate)
    return F.struct(
        complete.alias("retrieval_complete"), coverage.alias("judge_coverage"), reportable.alias("reportable"),
        F.when(reportable, "complete").otherwise("pilot_or_incomplete").alias("status"))


def flatten_metrics(dimensions: DataFrame, rates: DataFrame) -> DataFrame:
    """Dimension rows and rate rows as one table; absent columns are NULL."""
    return dimensions.unionByName(rates, allowMissingColumns=True)


def dimension_summary(scores: Column) -> Column:
    """Count and mean of one judgement's dimension scores; the mean of none is NULL."""
    values = F.map_values(scores)
    total = F.aggregate(values, F.lit(0.0).cast("double"), lambda s, v: s + v)
    return F.struct(F.size(values).alias("dimension_count"),
                    (total / F.when(F.size(values) > 0, F.size(values))).alias("dimension_mean"))


def pass_summary(tasks: DataFrame, judged: DataFrame) -> DataFrame:
    """Per task: all rows, valid rows, pass rate. ``judged`` has ``task, passed`` (NULL = invalid)."""
    counts = judged.groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.count("passed").alias("pass_valid_n"),
        F.avg(F.col("passed").cast("double")).alias("pass_value"))
    return tasks.join(counts, "task", "left").select(
        "task", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pass_valid_n", F.lit(0)).alias("pass_valid_n"),
        "pass_value")


def pass_macro(summary: DataFrame, value: str = "pass_value", complete: Column | None = None,
               keys: list[str] | None = None) -> DataFrame:
    """Mean over tasks, NULL unless every task has a value (and is complete)."""
    good = F.col(value).isNotNull() & (F.lit(True) if complete is None else complete)
    return summary.groupBy(*(keys or [])).agg(
        F.bool_and(good).alias("macro_complete"),
        F.when(F.bool_and(good), F.avg(value)).alias("macro_task_pass"))


def method_table(selected: DataFrame, judged: DataFrame, methods: list[str]) -> DataFrame:
    """Expected, valid, rate and completeness per method and task of a selection.

    ``selected(sample_id, task)``; ``judged(method, sample_id, passed)`` with one row per
    method and id. Every method is crossed with the selection through an array literal.
    """
    grid = selected.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    return grid.join(judged, ["method", "sample_id"], "left").groupBy("method", "task").agg(
        F.count(F.lit(1)).alias("expected_n"), F.count("passed").alias("valid_n"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        (F.count("passed") == F.count(F.lit(1))).alias("complete"))


def paired_outcomes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Wins, losses, ties and net wins of ``left`` over ``right`` on shared valid ids."""
    both = (left.where("passed IS NOT NULL").select("sample_id", F.col("passed").alias("l"))
            .join(right.where("passed IS NOT NULL").select("sample_id", F.col("passed").alias("r")), "sample_id"))
    wins, losses = F.count_if(F.col("l") & ~F.col("r")), F.count_if(~F.col("l") & F.col("r"))
    return both.agg(F.count(F.lit(1)).alias("paired_n"), wins.alias("wins"), losses.alias("losses"),
                    (F.count(F.lit(1)) - wins - losses).alias("ties"), (wins - losses).alias("net_wins"))


def last_record(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Last record per key by ``order`` as a combinable aggregate instead of a sort."""
    picked = F.max_by(F.struct(*columns), order)
    return rows.groupBy(*keys).agg(picked.alias("_row")).select(*keys, "_row.*")


def coverage(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and done counts per cell with the missing count. Ids are unique per side."""
    marked = expected.select(*keys, "sample_id").join(
        done.select(*keys, "sample_id", F.lit(1).alias("_done")), [*keys, "sample_id"], "left")
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("expected"), F.count("_done").alias("done"),
        F.count_if(F.col("_done").isNull()).alias("missing"))


def missing_ids(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The ids behind the missing count, one row each."""
    return expected.join(done, [*keys, "sample_id"], "left_anti")
