"""Run configs, fingerprints, and field-by-field drift between configs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark import registry
from evalspark.functions.hashing import fingerprint

# Fields both arms must share, and the subset that identifies a run.
SHARED_FIELDS = [
    "dataset", "subset", "system", "run_index", "generation_model", "generation_base_url", "temperature",
    "max_tokens", "thinking_enabled", "judge_model", "judge_base_url", "judge_temperature", "judge_max_tokens",
    "judge_prompt_mode", "k_generations", "top_k", "top_k_policy", "ingest_mode", "dialogue_context_policy",
    "retrieval_file", "retrieval_sha256", "rubric_file", "rubric_sha256", "sample_count", "memory_llm_model",
    "embedding_model", "tool_env",
]
RUN_FIELDS = [
    "dataset", "subset", "system", "run_index", "temperature", "max_tokens", "thinking_enabled", "top_k",
    "top_k_policy", "ingest_mode", "dialogue_context_policy", "retrieval_sha256", "rubric_sha256",
    "generation_model", "judge_model",
]


def run_configs(cells: DataFrame, generation_model: str, base_url: str, retrieval: DataFrame | None = None) -> DataFrame:
    """Config row per ``(task, system, arm, run_index, sample_count)`` from registry defaults.

    ``retrieval(task, system, retrieval_sha256)`` adds the frozen file's digest.
    """
    joined = registry.refuse_unknown_tasks(registry.with_task(cells))
    if retrieval is not None:
        joined = joined.join(retrieval, ["task", "system"], "left")
    else:
        joined = joined.withColumn("retrieval_sha256", F.lit(""))
    configs = joined.select(
        "task", "dataset", "subset", "system", "arm", "run_index",
        F.lit(generation_model).alias("generation_model"), F.lit(base_url).alias("generation_base_url"),
        F.lit(registry.GENERATION_TEMPERATURE).alias("temperature"),
        F.lit(registry.GENERATION_MAX_TOKENS).alias("max_tokens"), F.lit(False).alias("thinking_enabled"),
        F.lit(generation_model).alias("judge_model"), F.lit(base_url).alias("judge_base_url"),
        F.lit(registry.JUDGE_TEMPERATURE).alias("judge_temperature"),
        F.lit(registry.JUDGE_MAX_TOKENS).alias("judge_max_tokens"), "judge_prompt_mode", "k_generations", "top_k",
        "top_k_policy", "ingest_mode", F.lit("none").alias("dialogue_context_policy"), "retrieval_file",
        F.coalesce("retrieval_sha256", F.lit("")).alias("retrieval_sha256"), "rubric_file",
        F.lit("").alias("rubric_sha256"), "sample_count", F.lit("").alias("memory_llm_model"),
        F.lit("").alias("embedding_model"), F.lit("").alias("tool_env"))
    return with_fingerprints(configs)


def with_fingerprints(configs: DataFrame) -> DataFrame:
    """Add the shared and the run fingerprint; neither covers the arm."""
    return configs.withColumns({"shared_fingerprint": fingerprint(SHARED_FIELDS),
                                "run_fingerprint": fingerprint(RUN_FIELDS)})


def field_drift(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key and differing field, NULL-safe, values as text.

    Keys are unique on the left; the join is one equi-join whatever the field count.
    """
    l = left.select(*keys, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_l"))
    r = right.select(*keys, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_r"))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col("_l")[f].alias("left_value"), F.col("_r")[f].alias("right_value"))
                     for f in fields])
    changed = F.filter(rows, lambda x: ~x["left_value"].eqNullSafe(x["right_value"]))
    return l.join(r, keys).select(*keys, F.inline(changed))


def continuation_allowed(drift: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: whether exactly ``retrieval_sha256`` drifted."""
    return drift.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("drifted"),
        ((F.count(F.lit(1)) == 1) & F.bool_and(F.col("field") == "retrieval_sha256")).alias("allowed"))


def stale_fingerprints(configs: DataFrame, stored: str = "stored_fingerprint") -> DataFrame:
    """Configs whose stored digest is not the digest of the fields beside it."""
    return configs.where(~F.col(stored).eqNullSafe(fingerprint(SHARED_FIELDS)))


def answer_prompts_identical(configs: DataFrame, keys: list[str]) -> DataFrame:
    """Cells where the arms share one answer prompt (the intervention is absent) or lack one."""
    return configs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("arms"), F.count_if(F.coalesce(F.col("final_answer_prompt") == "", F.lit(True))).alias("unnamed"),
        (F.min("final_answer_prompt") == F.max("final_answer_prompt")).alias("identical"))


def prompt_gate(outputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Output rows made under another prompt version or other prompt hashes.

    ``prompts(ablation, prompt_version, prompt_hash)`` holds one row per ablation.
    """
    expected = prompts.select("ablation", F.col("prompt_version").alias("_v"), F.col("prompt_hash").alias("_h"))
    joined = outputs.join(F.broadcast(expected), "ablation", "left")
    problem = (F.when(~F.col("prompt_version").eqNullSafe(F.col("_v")), "prompt_version")
               .when(~F.col("prompt_hash").eqNullSafe(F.col("_h")), "prompt_hash"))
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").drop("_v", "_h")


def stage_cache_state(rows: DataFrame, cache: DataFrame, match: list[str]) -> DataFrame:
    """Cache state per sample: ``hit``, ``miss`` or ``mismatch`` (same sample, other keys)."""
    tagged = cache.select("sample_id", F.struct(*match).alias("_c"))
    joined = rows.join(tagged, "sample_id", "left")
    return joined.withColumn("cache_state", F.when(F.col("_c").isNull(), "miss")
                             .when(F.struct(*match).eqNullSafe(F.col("_c")), "hit").otherwise("mismatch")).drop("_c")


def parity(rendered: DataFrame, expected: DataFrame) -> DataFrame:
    """Rendered texts against stored expectations by ``name``: ok flag and first difference."""
    from evalspark.functions.text import first_difference

    joined = expected.select("name", F.col("text").alias("_e")).join(
        rendered.select("name", F.col("text").alias("_t")), "name", "left")
    return joined.select("name", F.col("_t").eqNullSafe(F.col("_e")).alias("ok"),
                         first_difference(F.col("_t"), F.col("_e")).alias("first_difference"))


def primary_cell(column: Column) -> Column:
    """``dataset/subset/system`` label of a cell struct."""
    return F.concat_ws("/", column["dataset"], column["subset"], column["system"])
