"""Adapters from raw records to one sample schema. All work stays inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark import registry
from evalspark.functions.text import is_blank, non_blank, strip
from evalspark.operators.dialogue import clean_messages, speaker


def _problems(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in rules]))


def adapt_dialogue(raw: DataFrame, subset: Column) -> DataFrame:
    """Dialogue records (``row_index, id, context_history, final_trigger, ...``) to samples.

    Refusals are listed in ``problems`` instead of raised, so a job can split them off.
    """
    messages = clean_messages(F.col("context_history"))
    request = strip(F.coalesce("final_trigger", F.lit("")))
    is_poison, is_game = subset == "poison", subset == "number_game"
    missing = F.array_compact(F.array(
        F.when(is_poison & is_blank(F.col("poisoned_fact")), "poisoned_fact"),
        F.when(is_poison & is_blank(F.col("objective_truth")), "objective_truth"),
        F.when(is_game & is_blank(F.col("gold_standard")), "gold_standard")))
    default_id = F.format_string("%s_%06d", subset, F.col("row_index"))
    return raw.select(
        F.coalesce(F.when(F.col("id") != "", F.col("id")), default_id).alias("sample_id"),
        F.concat(F.lit("memtrap_"), subset).alias("task"), F.lit("memtrapbench").alias("dataset"),
        subset.alias("subset"), "row_index", request.alias("current_request"),
        F.lit("messages").alias("ingest_mode"), messages.alias("ingest_messages"),
        F.lit(None).cast("int").alias("top_k"), registry.category(subset).alias("paper_category"),
        F.size(F.filter(messages, lambda m: m["role"] == "user")).alias("user_turns"),
        F.size(F.filter(messages, lambda m: m["role"] == "assistant")).alias("assistant_turns"),
        missing.alias("missing_judge_fields"),
        _problems((F.size(messages) == 0, "no usable turns"), (request == "", "empty request")).alias("problems"))


def adapt_memories(raw: DataFrame, subset: Column) -> DataFrame:
    """Memory-set records (``row_index, memories, query, failure_type``) to samples."""
    memories = F.filter(F.transform(F.coalesce("memories", F.array().cast("array<string>")), strip),
                        lambda m: m.isNotNull() & (F.length(m) > 0))
    query = strip(F.coalesce("query", F.lit("")))
    declared = strip(F.coalesce(F.when(F.col("failure_type") != "", F.col("failure_type")), subset))
    return raw.select(
        F.format_string("persistbench_%s_%04d", declared, F.col("row_index")).alias("sample_id"),
        F.concat(F.lit("persist_"), subset).alias("task"), F.lit("persistbench").alias("dataset"),
        subset.alias("subset"), "row_index", query.alias("current_request"),
        F.lit("raw").alias("ingest_mode"),
        F.transform(memories, lambda m: F.struct(F.lit("user").alias("role"), m.alias("content"))).alias("ingest_messages"),
        F.size(memories).alias("top_k"), memories.alias("given_memories"),
        _problems((F.size(memories) == 0, "no memories"),
                  (F.size(F.array_distinct(memories)) != F.size(memories), "duplicate memories"),
                  (query == "", "empty query"),
                  (declared != subset, "failure type differs")).alias("problems"))


def dialogue_context_turns(messages: Column) -> Column:
    """Audit view of the messages, each with its speaker label."""
    return F.transform(messages, lambda m: F.struct(
        speaker(m["role"]).alias("speaker"),
        F.concat(speaker(m["role"]), F.lit(": "), m["content"]).alias("content"),
        F.lit(False).alias("is_query")))


def wrapper_row(samples: DataFrame) -> DataFrame:
    """The dataset-agnostic row: identity, request and the source record."""
    return samples.select("sample_id", "task", "source_file", "row_index", "current_request", "benchmark_row")


def canonical_memories(retrieved: Column, prefix: Column) -> Column:
    """Frozen memory structs: rank from 1, prefixed id, used and raw text with fallbacks.

    ``retrieved`` structs hold ``used_content, content`` and a map ``metadata``, empty if missing.
    """
    def one(m: Column, i: Column) -> Column:
        used = F.coalesce(F.when(m["used_content"] != "", m["used_content"]), F.when(m["content"] != "", m["content"]), F.lit(""))
        raw = F.coalesce(F.when(m["content"] != "", m["content"]), used)
        return F.struct(
            F.concat(prefix, F.lit("_"), F.format_string("%02d", i + 1)).alias("memory_id"),
            strip(used).alias("content"), strip(raw).alias("raw_content"),
            (i + 1).cast("int").alias("retrieval_rank"),
            F.coalesce(m["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"))
    return F.transform(retrieved, one)


def slim_memories(memories: Column) -> Column:
    """``{memory_id, memory_text}`` from structs that use any of the known key names."""
    return F.transform(memories, lambda m: F.struct(
        F.coalesce(m["memory_id"], m["id"]).alias("memory_id"),
        F.coalesce(m["memory_text"], m["content"], m["text"]).alias("memory_text")))


def memory_text(m: Column, names: tuple[str, ...] = ("memory_text", "content", "text", "raw_content")) -> Column:
    """First non-blank text of a memory struct, trimmed; ``''`` when all are blank."""
    return F.coalesce(*[strip(non_blank(m[name])) for name in names], F.lit(""))


def judge_memories(given: Column, retrieved: Column) -> Column:
    """Texts shown to the judge: the whole given set, else the retrieved texts."""
    shown = F.transform(retrieved, lambda m: F.coalesce(
        F.when(m["memory_text"] != "", m["memory_text"]), F.when(m["content"] != "", m["content"]), F.lit("")))
    return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(shown)


def normalize_retrieval_rows(rows: DataFrame, allowed_tasks: list[str], external: Column,
                             native_depth: int = registry.DEFAULT_TOP_K,
                             external_depth: int = registry.MAX_EXTERNAL_DEPTH) -> DataFrame:
    """Normalised retrieval rows; every broken rule is named in ``problems``.

    Expects ``sample_id, id, task, current_request, question, has_benchmark_row`` and
    ``retrieved_memories`` (structs with ``memory_id, memory_text, content, raw_content``).
    """
    def present(*columns: Column) -> Column:
        return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))

    memories = F.transform("retrieved_memories", lambda m, i: F.struct(
        present(m["memory_id"], F.concat(F.lit("memory_"), F.format_string("%02d", i + 1))).alias("memory_id"),
        present(m["memory_text"], m["content"], m["raw_content"]).alias("memory_text")))
    ids = F.transform(memories, lambda m: m["memory_id"])
    depth = F.when(external, F.lit(external_depth)).otherwise(F.lit(native_depth))
    request = strip(present(F.col("current_request"), F.col("question")))
    sample_id = present(F.col("sample_id"), F.col("id"))
    problems = F.array_compact(F.array(
        F.when(sample_id == "", "no sample_id"),
        F.when(~F.col("has_benchmark_row"), "no benchmark row"),
        F.when(~F.coalesce(F.col("task").isin(*allowed_tasks), F.lit(False)), "unknown task"),
        F.when(request == "", "empty request"),
        F.when(F.col("retrieved_memories").isNull(), "no memory list"),
        F.when(F.exists(memories, lambda m: is_blank(m["memory_text"])), "empty memory"),
        F.when(~F.size(memories).between(1, depth), "depth out of bounds"),
        F.when(F.size(F.array_distinct(ids)) != F.size(ids), "duplicate memory ids")))
    return rows.select(sample_id.alias("sample_id"), "task", request.alias("current_request"),
                       memories.alias("retrieved_memories"), problems.alias("problems"))


def cell_identity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Task and primary ingest mode of each cell; ``task_count`` other than 1 is refused.

    The mode is ``messages`` when any row has it, else the first in order.
    """
    mode = F.coalesce(F.when(F.col("ingest_mode") != "", F.col("ingest_mode")), F.lit("messages"))
    return rows.groupBy(*keys).agg(
        F.min("task").alias("task"),
        F.when(F.min("task") == F.max("task"), 1).otherwise(2).cast("bigint").alias("task_count"),
        F.when(F.bool_or(mode == "messages"), "messages").otherwise(F.min(mode)).alias("primary_ingest_mode"))


# Extra columns each native task takes from a release row, by source field.
RELEASE_FIELDS: dict[str, dict[str, str]] = {
    "personalized_memory_use": {
        "generated_question.question": "question", "generated_question.reference_answer": "reference_answer",
        "generated_question.preference_basis": "rubric.expected_behavior",
        "generated_question.why_correct": "rubric.correct_reason"},
    "valid_memory_selection": {
        "old_preference": "memory.outdated", "updated_preference": "memory.current",
        "user_question": "question", "reference_answer": "reference_answer",
        "updated_preference_basis": "rubric.expected_behavior", "old_preference_trap": "rubric.failure_behavior"},
    "memory_evidence_conflict": {
        "correct_answer": "reference_answer",
        "generated_question.question": "question", "generated_question.reference_answer": "reference_answer",
        "generated_question.preference_answer": "preference_aligned_answer",
        "generated_question.open_answer_target": "rubric.expected_behavior",
        "generated_question.memory_interference": "rubric.failure_behavior",
        "generated_question.evidence_basis": "rubric.supporting_evidence",
        "generated_question.preference_supporting_evidence": "rubric.preference_supporting_evidence",
        "generated_question.decisive_evidence": "rubric.decisive_evidence",
        "generated_question.target_tradeoff": "rubric.tradeoff",
        "generated_question.evaluation_policy": "rubric.evaluation_policy"},
    "contextual_scope_control": {
        "generated_question.question": "question", "generated_question.reference_answer": "reference_answer",
        "generated_question.expected_behavior": "rubric.expected_behavior",
        "generated_question.memory_trap": "rubric.failure_behavior",
        "generated_question.scope_conflict": "rubric.scope_conflict",
        "generated_question.scope_label": "rubric.scope_label",
        "generated_question.acceptable_memory_use": "rubric.acceptable_memory_use",
        "generated_question.required_scope_limit": "rubric.scope_limits",
        "generated_question.overgeneralization_failure": "rubric.overgeneralization_failure",
        "generated_question.underuse_failure": "rubric.underuse_failure"},
    "objective_fact_judgment": {
        "source_dataset": "source.dataset", "source_split": "source.split", "source_row_idx": "source.row_index",
        "source_question": "source.question",
        "generated_question.question": "question", "generated_question.source_question": "source.question",
        "generated_question.source_url": "source.url",
        "generated_question.preference_answer": "preference_aligned_answer",
        "generated_question.reference_answer": "reference_answer",
        "generated_question.objective_fact_basis": "rubric.supporting_evidence",
        "generated_question.preference_interference": "rubric.failure_behavior",
        "generated_question.open_answer_rubric": "open_rubric"},
}
# Applicability flag and answer behaviour by native task.
APPLICABILITY = {
    "personalized_memory_use": "applicable", "memory_evidence_conflict": "applicable",
    "contextual_scope_control": "partially_applicable", "objective_fact_judgment": "applicable",
}


def release_to_eval(rows: DataFrame) -> DataFrame:
    """Canonical release rows (a ``VARIANT`` column ``row``) to evaluator columns.

    Task-specific values land in ``fields map<string,string>`` under dotted names. Rows
    that already have the evaluator shape pass through with ``adapted`` false.
    """
    def text(path: str) -> Column:
        return F.try_variant_get("row", path, "string")

    def items(path: str) -> Column:
        return F.try_variant_get("row", path, "array<variant>")

    def by_status(status: str) -> Column:
        first = F.get(F.filter(items("$.memory.items"),
                               lambda m: F.try_variant_get(m, "$.status", "string") == status), F.lit(0))
        return F.coalesce(F.try_variant_get(first, "$.content", "string"), F.lit(""))

    # the members of the rubric that have no field of their own, as JSON
    members = F.try_variant_get("row", "$.evaluation.rubric", "map<string,variant>")
    open_rubric = F.to_json(F.map_filter(members, lambda name, _: ~name.isin("supporting_evidence", "failure_behavior")))
    sources = {
        "question": text("$.question"), "reference_answer": text("$.evaluation.reference_answer"),
        "preference_aligned_answer": text("$.evaluation.preference_aligned_answer"),
        "memory.outdated": by_status("outdated"), "memory.current": by_status("current"),
        "open_rubric": open_rubric}

    def source(name: str) -> Column:
        if name in sources:
            return sources[name]
        head, _, leaf = name.partition(".")
        return text(f"$.evaluation.rubric.{leaf}") if head == "rubric" else text(f"$.metadata.source.{leaf}")

    task = text("$.task")
    fields = F.lit(None).cast("map<string,string>")
    for name, mapping in RELEASE_FIELDS.items():
        pairs = [x for target, origin in mapping.items() for x in (F.lit(target), source(origin))]
        fields = F.when(task == name, F.create_map(*pairs)).otherwise(fields)
    adapted = F.try_variant_get("row", "$.dialogue", "variant").isNotNull() & F.try_variant_get("row", "$.evaluation", "variant").isNotNull()
    turns = F.transform(items("$.dialogue"), lambda m: F.struct(
        speaker(F.lower(strip(F.try_variant_get(m, "$.role", "string")))).alias("speaker"),
        F.concat(speaker(F.lower(strip(F.try_variant_get(m, "$.role", "string")))), F.lit(": "),
                 strip(F.try_variant_get(m, "$.content", "string"))).alias("content"),
        F.lit(False).alias("is_query")))
    memories = F.transform(items("$.memory.items"), lambda m, i: F.struct(
        (i + 1).alias("memory_id"), F.try_variant_get(m, "$.type", "string").alias("memory_type"),
        F.try_variant_get(m, "$.content", "string").alias("content"), F.lit("high").alias("confidence"),
        F.try_variant_get(m, "$.status", "string").alias("status")))
    subtype = text("$.metadata.subtype")
    return rows.select(
        text("$.id").alias("id"), adapted.alias("adapted"), task.alias("task_type"),
        F.when(adapted & ~F.coalesce(task.isin(*RELEASE_FIELDS), F.lit(False)), "unsupported task").alias("problem"),
        F.coalesce(text("$.metadata.source_id"), text("$.id")).alias("source_query_id"),
        F.coalesce(subtype, task).alias("question_type"), turns.alias("dialogue_context_turns"),
        memories.alias("extraction"), F.coalesce(F.get(memories, F.lit(0))["content"], F.lit("")).alias("original_memory"),
        F.coalesce(text("$.metadata.topic"), F.lit("")).alias("topic"),
        F.concat(F.lit("data/"), task, F.lit(".jsonl")).alias("source_file"),
        registry.lookup(APPLICABILITY, task).alias("applicability"),
        F.when(task == "valid_memory_selection", F.coalesce(subtype, F.lit("update"))).alias("update_type"),
        F.when(task == "contextual_scope_control", "subject_aware_partial_application").alias("correct_behavior"),
        fields.alias("fields"))
