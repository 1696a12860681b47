"""The task registry and protocol constants as small DataFrames (a fixed number of rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Task, dataset, subset, data file, rubric, judge family, generations, metric, score key.
TASKS = [
    ("memtrap_poison", "memtrapbench", "poison", "memtrapbench/safety/poison_200.json", "judge_poison.txt", "poison", 1, "dim5", "dimensions"),
    ("memtrap_number_game", "memtrapbench", "number_game", "memtrapbench/cognitive_bias/number_game_200.json", "judge_number_game.txt", "number_game", 1, "dim5", "dimensions"),
    ("memtrap_hurt", "memtrapbench", "hurt", "memtrapbench/trauma/hurt_150.json", "judge_shared.txt", "shared", 1, "dim5", "dimensions"),
    ("memtrap_hallucination", "memtrapbench", "hallucination", "memtrapbench/task_boundary/hallucination_150.json", "judge_shared.txt", "shared", 1, "dim5", "dimensions"),
    ("memtrap_inertia", "memtrapbench", "inertia", "memtrapbench/cognitive_bias/Inertia_150.json", "judge_shared.txt", "shared", 1, "dim5", "dimensions"),
    ("memtrap_unclear", "memtrapbench", "unclear", "memtrapbench/task_boundary/unclear_200.json", "judge_shared.txt", "shared", 1, "dim5", "dimensions"),
    ("persist_cross_domain", "persistbench", "cross_domain", "baseline/cross_domain.jsonl", "judge_cross_domain.txt", "", 3, "score5", "score"),
    ("persist_sycophancy", "persistbench", "sycophancy", "baseline/sycophancy.jsonl", "judge_sycophancy.txt", "", 3, "score5", "score"),
    ("persist_beneficial_memory_usage", "persistbench", "beneficial_memory_usage", "baseline/beneficial_samples.jsonl", "judge_beneficial.txt", "", 1, "rating3", "rating"),
]
# Category of each dialogue subset.
CATEGORIES = {
    "poison": "Safety", "number_game": "Cognitive Bias", "hurt": "Trauma",
    "hallucination": "Task Boundary", "inertia": "Cognitive Bias", "unclear": "Task Boundary",
}
# Memory systems with method label, memory-id prefix, model calls per stored message.
SYSTEMS = [
    ("AMEM", "A-MEM", "amem", 2.0), ("Mem0", "MemZero", "memzero", 2.0), ("naiveRAG", "NaiveRAG", "naiverag", 0.0),
    ("MemoryBank", "MemoryBank", "memorybank", None), ("LightMem", "LightMem", "lightmem", None),
]
# Native tasks with their pass and correctness metrics.
NATIVE_TASKS = [
    ("objective_fact_judgment", "suppress_pass", "objective_correctness"),
    ("contextual_scope_control", "scope_pass", "accuracy"),
    ("memory_evidence_conflict", "evidence_pass", "accuracy"),
    ("personalized_memory_use", "memory_use_pass", "answer_accuracy"),
    ("valid_memory_selection", "valid_selection_pass", "uses_latest_preference"),
]
# Arms, gates, depths and the protocol pins.
MAIN_ARMS = ("baseline", "staged")
INTERVENTION_ARMS = ("anti_sycophancy", "self_recheck", "dynamic_partition", "memgate")
COVERAGE_GATE = 0.98
DEFAULT_TOP_K = 10
MAX_EXTERNAL_DEPTH = 16
FAILURE_THRESHOLD = 3
JUDGE_TEMPERATURE = 0.0
JUDGE_MAX_TOKENS = 2000
GENERATION_TEMPERATURE = 0.2
GENERATION_MAX_TOKENS = 4096

TASK_SCHEMA = ("task string, dataset string, subset string, data_file string, rubric_file string, "
               "judge_type string, k_generations int, metric string, score_key string")


def task_registry(spark: SparkSession) -> DataFrame:
    """One row per registered task, with derived protocol columns."""
    base = spark.createDataFrame(TASKS, TASK_SCHEMA)
    dialogue = F.col("dataset") == "memtrapbench"
    return base.select(
        "*",
        F.when(dialogue, F.lit(DEFAULT_TOP_K)).alias("top_k"),
        F.when(dialogue, "fixed").otherwise("per_sample_len_memories").alias("top_k_policy"),
        F.when(dialogue, "single_user").otherwise("system_plus_user").alias("judge_prompt_mode"),
        F.when(dialogue, "messages").otherwise("raw").alias("ingest_mode"),
        F.when(dialogue, "retrieved_top10.jsonl").otherwise("retrieved_topk.jsonl").alias("retrieval_file"),
        F.when(F.col("metric") == "rating3", F.lit(3)).otherwise(F.lit(5)).alias("score_high"),
        (F.col("metric") == "rating3").alias("inverted"),
    )


def systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYSTEMS, "system string, method string, id_prefix string, calls_per_message double")


def native_tasks(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(NATIVE_TASKS, start=1)]
    return spark.createDataFrame(rows, "task_order int, task string, pass_metric string, correctness_metric string")


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a fixed mapping, NULL for an unknown key."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


def category(subset: Column) -> Column:
    return lookup(CATEGORIES, subset)


def with_task(df: DataFrame, task_column: str = "task") -> DataFrame:
    """Join registry columns; the registry has nine rows, so it is always broadcast.

    Rows of a task that is not registered stay, without registry columns and with a
    ``task_problem``; :func:`refuse_unknown_tasks` fails on them.
    """
    registry = task_registry(df.sparkSession).withColumnRenamed("task", "_task")
    joined = df.join(F.broadcast(registry), F.col(task_column) == F.col("_task"), "left")
    return joined.withColumn("task_problem", F.when(F.col("_task").isNull(), "unknown task")).drop("_task")


def refuse_unknown_tasks(df: DataFrame, task_column: str = "task") -> DataFrame:
    """Rows from :func:`with_task`, failing the job on the first unknown task instead of losing its rows."""
    name = F.coalesce(F.col(task_column), F.lit("NULL"))
    checked = F.when(F.col("task_problem").isNull(), F.col(task_column)).otherwise(
        F.raise_error(F.concat(F.lit("unknown task: "), name)).cast("string"))
    return df.withColumn(task_column, checked).drop("task_problem")


def unknown_tasks(df: DataFrame, task_column: str = "task") -> DataFrame:
    """Task names that are not registered, once each."""
    registry = task_registry(df.sparkSession).select(F.col("task").alias("_task"))
    return (df.select(F.col(task_column).alias("task")).distinct()
            .join(F.broadcast(registry), F.col("task") == F.col("_task"), "left_anti"))
