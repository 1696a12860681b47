"""Experiment matrix and call budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalspark import registry


def matrix(tasks: DataFrame, systems: list[str], arms: list[str]) -> DataFrame:
    """Every task row for each system and arm, by exploding two literal arrays."""
    return (tasks.withColumn("system", F.explode(F.array(*[F.lit(s) for s in systems])))
            .withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms]))))


def call_budget(cells: DataFrame) -> DataFrame:
    """Generation and judge calls per cell: one stage for the baseline arm, three for the staged one."""
    stages = F.when(F.col("arm") == "baseline", 1).otherwise(3)
    calls = F.col("sample_count") * F.col("k_generations")
    return cells.withColumns({
        "stages_per_sample": stages, "generation_calls": calls * stages, "judge_calls": calls,
        "total_calls": calls * stages + calls})


def budget_totals(budget: DataFrame) -> DataFrame:
    """Totals over all cells (arm NULL) and by arm."""
    return budget.rollup("arm").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("generation_calls").alias("generation_calls"),
        F.sum("judge_calls").alias("judge_calls"), F.sum("total_calls").alias("total_calls"))


def retrieval_budget(messages: DataFrame) -> DataFrame:
    """Messages and estimated model calls per task and system from per-sample counts.

    ``messages(task, messages_count)``; rates come from the five-row systems table.
    """
    per_task = messages.groupBy("task").agg(F.count(F.lit(1)).alias("samples"), F.sum("messages_count").alias("messages"))
    crossed = per_task.withColumn("_s", F.explode(F.array(*[
        F.struct(F.lit(name).alias("system"), F.lit(rate).alias("rate"))
        for name, _, _, rate in registry.SYSTEMS if rate is not None])))
    return crossed.select("task", F.col("_s.system").alias("system"), "samples", "messages",
                          (F.col("messages") * F.col("_s.rate")).alias("estimated_calls"))
