"""Arms: resumable generation and judging passes built from prompts and model calls.

Every arm skips finished ids with an anti join, runs the model only for the rest, and
returns the new outputs, the call log and the failures as frames to append. Before its first call
it checks its whole input by a guard; a finding ends the arm without a call.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions import replies as R
from evalspark.functions.text import identified_memories
from evalspark.operators.selection import pending
from evalspark.plans import prompts as P
from evalspark.plans.guards import Guard, gate
from evalspark.plans.modelcalls import CALL_SCHEMA, ModelFactory, call_model, failure_ledger, last_attempt, validated_pass, validated_replies
from evalspark.session import cut_lineage


@dataclass
class ArmResult:
    outputs: DataFrame
    calls: DataFrame
    failures: DataFrame
    #: Broken guard rules, and cached replies that were refused as stale.
    findings: DataFrame | None = None
    #: Valid stage replies with their keys, to be kept for later runs.
    replies: DataFrame | None = None


def _guarded(rows: DataFrame, done: DataFrame, guard: Guard | None, run: Callable[[], ArmResult]) -> ArmResult:
    """The arm's result, or its findings without a call."""
    found = cut_lineage((guard or Guard()).findings(rows, done))

    def passed() -> ArmResult:
        result = run()
        result.findings = found if result.findings is None else found.unionByName(result.findings)
        return result

    def refused() -> ArmResult:
        session = rows.sparkSession
        failures = found.select(F.col("sample_id").alias("call_key"), F.lit("guard").alias("stage"), F.concat_ws(": ", "check", "detail").alias("error"))
        return ArmResult(rows.limit(0).withColumn("final_answer", F.lit(None).cast("string")), session.createDataFrame([], CALL_SCHEMA), failures, found)
    return gate(found, passed, refused)


def _answer(rows: DataFrame, prompt: Column, factory: ModelFactory, stage: str, **options) -> ArmResult:
    """One answer call per row; the log is materialised before it is read twice."""
    asked = P.add_prompt(rows, prompt)
    log = cut_lineage(call_model(asked, factory, stage, **options))
    good = last_attempt(log).where("success").select("call_key", F.col("text").alias("final_answer"))
    return ArmResult(asked.join(good, "call_key").drop("call_key", "system", "user"), log, failure_ledger(asked, log))


def baseline_arm(rows: DataFrame, done: DataFrame, prompt: Column, factory: ModelFactory, guard: Guard | None = None, **options) -> ArmResult:
    """The official answer prompt for every row without an output."""
    return _guarded(rows, done, guard, lambda: _answer(pending(rows, done), prompt, factory, "answer", **options))


STAGES = {"full": ("stage1", "stage2", "stage3"), "stage1-baseline": ("stage1", "baseline"),
          "stage1-stage2-baseline": ("stage1", "stage2", "baseline")}


def staged_arm(rows: DataFrame, done: DataFrame, prompts: dict[str, tuple[str, str]], factory: ModelFactory,
               variant: str = "full", cache: DataFrame | None = None, rounds: int = 3, guard: Guard | None = None, **options) -> ArmResult:
    """Boundary cards, use instructions, then the answer; ablations end in a baseline answer.

    ``rows(sample_id, current_request, memories array<struct<memory_id, memory_text>>)``;
    ``prompts`` maps a stage to its ``(system, user template)``. ``cache(sample_id, stage, cache_key,
    text)`` holds the ``replies`` of earlier runs. A reply is used only where its key, the fingerprint of
    variant, stage, prompt and everything filled into it, is the one of this run; a reply of the same sample
    and stage under another key is stale: it is a finding, and the model is asked again.
    """
    return _guarded(rows, done, guard, lambda: _staged(rows, done, prompts, factory, variant, cache, rounds, **options))


def cache_key(variant: str, stage: str) -> Column:
    """Fingerprint of a stage's prompt; the prompt holds the request, the memories and earlier replies."""
    return F.sha2(F.concat_ws("\x00", F.lit(variant), F.lit(stage), F.sha2("system", 256), F.sha2("user", 256)), 256)


def _staged(rows: DataFrame, done: DataFrame, prompts: dict[str, tuple[str, str]], factory: ModelFactory,
            variant: str, cache: DataFrame | None, rounds: int, **options) -> ArmResult:
    # written once: every pass reads these rows. A stage adds a table of keys and what it learned; checks read ids, not memories
    base = cut_lineage(pending(rows, done).withColumns(
        {"call_key": F.col("sample_id").cast("string"), "_ids": F.transform("memories", lambda m: m["memory_id"])}))
    ids, todo, learned = F.col("_ids"), base, None
    logs: list[DataFrame] = []
    ledgers: list[DataFrame] = []
    findings: list[DataFrame] = []
    replies: list[DataFrame] = []
    for stage in STAGES[variant][:-1]:
        cards = F.col("stage1_json") if stage == "stage2" else None
        system, template = prompts[stage]

        def check(replied: DataFrame, stage: str = stage) -> DataFrame:
            parsed = replied.withColumn("_v", R.recover_outermost(F.col("text")))
            if stage == "stage1":
                return parsed.withColumns({"problem": R.stage1_problem(F.col("_v"), ids),
                                           "stage1_json": F.to_json("_v")}).drop("_v")
            checked = parsed.withColumn("_r", R.stage2_instructions(F.col("_v"), ids))
            return checked.withColumns({"problem": F.col("_r.problem"),
                                        "stage2_json": P.pretty_json(F.struct(F.col("_r.instructions").alias("memory_use_instructions")))}).drop("_v", "_r")

        asked = P.add_prompt(todo, P.stage_prompt(system, template, F.col("current_request"), F.col("memories"), cards))
        keys = asked.select("call_key", "sample_id", cache_key(variant, stage).alias("cache_key"))
        stored = None
        if cache is not None:
            mine = cache.where(F.col("stage") == stage).select("sample_id", "cache_key", "text")
            keys = cut_lineage(keys)
            # one reply per sample, the smallest text where a cache holds several
            stored = cut_lineage(keys.join(mine, ["sample_id", "cache_key"]).groupBy("call_key").agg(F.min("text").alias("text")))
            stale = mine.join(keys.withColumnRenamed("cache_key", "_now"), "sample_id").where("cache_key IS DISTINCT FROM _now")
            findings.append(stale.select(F.lit("stale_cache").alias("check"), F.col("sample_id").cast("string").alias("sample_id"),
                                         F.concat(F.lit(f"{stage} "), F.coalesce("cache_key", F.lit("none"))).alias("detail")))
        fresh = asked if stored is None else asked.join(stored, "call_key", "left_anti")
        accepted, log = validated_replies(fresh, factory, stage, check, rounds, **options)
        logs.append(log)
        ledgers.append(fresh.join(accepted.select("call_key"), "call_key", "left_anti").select(
            "call_key", F.lit(stage).alias("stage"), F.lit("no valid reply").alias("error")))
        if stored is not None:
            cached = check(asked.join(stored, "call_key")).where("problem IS NULL")
            accepted = accepted.unionByName(cached.select(*accepted.columns))
        replies.append(accepted.select("call_key", "text").join(keys, "call_key").select("sample_id", F.lit(stage).alias("stage"), "cache_key", "text"))
        found = accepted.withColumnRenamed("text", f"{stage}_raw").drop("problem")
        learned = cut_lineage(found if learned is None else learned.join(found, "call_key"))
        todo = base.join(learned, "call_key")
    last = STAGES[variant][-1]
    system, template = prompts[last]
    instructions = F.col("stage2_json") if "stage2" in STAGES[variant] else None
    cards = F.col("stage1_json") if variant == "stage1-baseline" else None
    result = _answer(todo, P.stage_prompt(system, template, F.col("current_request"), F.col("memories"), cards, instructions),
                     factory, last, **options)
    failures = result.failures.select("call_key", "stage", "error")
    for ledger in ledgers:
        failures = failures.unionByName(ledger)
    calls = result.calls
    for log in logs:
        calls = calls.unionByName(log.drop("round"))
    return ArmResult(result.outputs.drop("_ids"), calls, failures, reduce(DataFrame.unionByName, findings) if findings else None,
                     reduce(DataFrame.unionByName, replies))


def intervention_arm(rows: DataFrame, done: DataFrame, method: str, prompt_of, factory: ModelFactory, guard: Guard | None = None, **options) -> ArmResult:
    """The four post-retrieval arms over ``rows(sample_id, current_request, memories)``.

    ``memories`` holds ``struct(memory_id, content)``; ``prompt_of(memories, query)``
    builds the answer prompt struct from the selected memories. The gate keeps everything.
    """
    return _guarded(rows, done, guard, lambda: _intervened(rows, done, method, prompt_of, factory, **options))


def _intervened(rows: DataFrame, done: DataFrame, method: str, prompt_of, factory: ModelFactory, **options) -> ArmResult:
    todo = pending(rows, done)
    ids = F.transform("memories", lambda m: m["memory_id"])
    logs, ledger = None, None
    if method in ("self_recheck", "dynamic_partition"):
        partition = method == "dynamic_partition"
        system = P.DYNAMIC_PARTITION if partition else P.SELF_RECHECK

        def check(replied: DataFrame) -> DataFrame:
            picked = replied.withColumn("_r", R.selected_ids(F.col("text"), ids, partition))
            return picked.withColumns({"problem": F.col("_r.problem"), "selected": F.col("_r.ids")}).drop("_r")

        asked = P.add_prompt(todo, F.struct(F.lit(system).alias("system"),
                                            P.selector_input(F.col("current_request"), F.col("memories")).alias("user")))
        accepted, logs = validated_pass(asked, factory, method, check, 6 if partition else 1, **options)
        ledger = asked.join(accepted.select("call_key"), "call_key", "left_anti").select(
            "call_key", F.lit(method).alias("stage"), F.lit("no valid reply").alias("error"))
        todo = accepted.withColumnRenamed("text", "intermediate_output").drop("problem", "call_key")
    elif method in ("anti_sycophancy", "memgate"):
        todo = todo.withColumns({"selected": ids, "intermediate_output": F.lit(None).cast("string")})
    else:
        raise ValueError(f"Unknown method: {method}")
    kept = F.filter("memories", lambda m: F.array_contains("selected", m["memory_id"]))
    prompt = prompt_of(kept, F.col("current_request"))
    if method == "anti_sycophancy":
        prompt = F.struct(F.concat(prompt["system"], F.lit("\n\n" + P.ANTI_SYCOPHANCY)).alias("system"), prompt["user"].alias("user"))
    result = _answer(todo.withColumn("final_context", identified_memories(kept)), prompt, factory, "answer", **options)
    failures = result.failures.select("call_key", "stage", "error")
    if logs is not None:
        return ArmResult(result.outputs, result.calls.unionByName(logs.drop("round")), failures.unionByName(ledger))
    return ArmResult(result.outputs, result.calls, failures)


def judge_arm(outputs: DataFrame, done: DataFrame, prompt: Column, interpret, factory: ModelFactory, guard: Guard | None = None, **options) -> ArmResult:
    """Judge every output without a record; a reply that fails validation is never stored.

    ``interpret(text)`` returns a struct with a ``problems`` array.
    """
    return _guarded(outputs, done, guard, lambda: _judged(outputs, done, prompt, interpret, factory, **options))


def _judged(outputs: DataFrame, done: DataFrame, prompt: Column, interpret, factory: ModelFactory, **options) -> ArmResult:
    asked = P.add_prompt(pending(outputs, done), prompt)
    log = cut_lineage(call_model(asked, factory, "judge", **options))
    replies = last_attempt(log).where("success").select("call_key", F.col("text").alias("judge_raw"))
    read = asked.join(replies, "call_key").withColumn("verdict", interpret(F.col("judge_raw")))
    good = F.size("verdict.problems") == 0
    refused = read.where(~good).select("call_key", F.lit("judge").alias("stage"), F.array_join("verdict.problems", "; ").alias("error"))
    failed = failure_ledger(asked, log).select("call_key", "stage", "error")
    return ArmResult(read.where(good).drop("call_key", "system", "user"), log, failed.unionByName(refused))
