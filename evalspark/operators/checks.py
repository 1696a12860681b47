"""Record-quality checks as finding rows.

Every row-level group is one projection over its table: the rules become an array of
optional structs that is inlined, so twenty checks cost one scan and no union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evalspark import registry
from evalspark.functions.hashing import fingerprint
from evalspark.functions.text import is_blank
from evalspark.operators.adapt import memory_text
from evalspark.operators.provenance import SHARED_FIELDS

OK, WARN, FAIL = "ok", "warn", "fail"
FINDING = ["group", "level", "check", "cell", "run_index", "sample_id", "detail"]
Rule = tuple[str, str, Column, Column | str]
# Keys every retrieval row must have, and expected settings by dataset.
ROW_KEYS = ["benchmark_row", "current_request", "memory_config", "memory_system", "official_context_text",
            "retrieved_count", "retrieved_memories", "task"]
EXPECTED_INGEST = {"memtrapbench": "messages", "persistbench": "raw"}
STORE_STATES = ["built", "reused", "managed_by_adapter"]


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def findings(rows: DataFrame, group: str, rules: list[Rule], cell: Column | str = "cell",
             run_index: Column | None = None, sample_id: Column | None = None) -> DataFrame:
    """Rows of ``FINDING`` columns: one per rule whose predicate holds (NULL counts as no)."""
    built = F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(False)),
               F.struct(F.lit(level).alias("level"), F.lit(check).alias("check"),
                        F.coalesce(_text(detail), F.lit("")).alias("detail")))
        for check, level, bad, detail in rules]))
    run = F.lit(None).cast("int") if run_index is None else run_index.cast("int")
    sample = F.lit(None).cast("string") if sample_id is None else sample_id.cast("string")
    cell = F.col(cell) if isinstance(cell, str) else cell
    return rows.select(F.lit(group).alias("group"), cell.alias("cell"), run.alias("run_index"),
                       sample.alias("sample_id"), F.inline(built)).select(*FINDING)


def retrieval_cell_checks(cells: DataFrame) -> DataFrame:
    """Cell facts ``cell, file_present, row_count, expected_count, unreadable, duplicates, out_of_order``."""
    n, expected = F.col("row_count"), F.col("expected_count")
    present = F.col("file_present")
    some = present & (n > 0)
    return findings(cells, "retrieval", [
        ("retrieval_file_missing", FAIL, ~present, "no retrieval rows stored"),
        ("retrieval_row_unreadable", FAIL, present & (F.col("unreadable") > 0), F.col("unreadable")),
        ("retrieval_file_empty", FAIL, present & (n == 0), "no readable rows"),
        ("retrieval_rows_exceed_dataset", FAIL, some & (n > expected), F.concat_ws("/", n, expected)),
        ("retrieval_file_partial", WARN, some & (n < expected), F.concat_ws("/", n, expected)),
        ("retrieval_coverage", OK, some & (n == expected), n),
        ("retrieval_duplicate_ids", FAIL, some & (F.col("duplicates") > 0), F.col("duplicates")),
        ("retrieval_not_in_source_order", WARN, some & F.col("out_of_order").isNotNull(), F.col("out_of_order")),
        ("retrieval_rows_checked", OK, some, n),
    ])


def retrieval_row_checks(rows: DataFrame) -> DataFrame:
    """Rows with ``cell, dataset, task, method, sample_id, keys, row_task, memory_system,
    retrieved_memories, retrieved_count, context_text, top_k, top_k_policy, given_count``."""
    memories = F.col("retrieved_memories")
    missing = F.array_except(F.array(*[F.lit(k) for k in ROW_KEYS]), F.col("keys"))
    complete = F.size(missing) == 0
    filled = complete & (F.size(memories) > 0)
    bound = F.coalesce("top_k", "given_count")
    broken = F.filter(memories, lambda m: m["memory_id"].isNull() | m["content"].isNull()
                      | m["raw_content"].isNull() | m["retrieval_rank"].isNull())
    per_sample = F.col("dataset") == "persistbench"
    policy = F.when(per_sample, "per_sample_len_memories").otherwise("fixed")
    return findings(rows, "retrieval", [
        ("retrieval_row_keys", FAIL, ~complete, F.concat_ws(",", missing)),
        ("retrieval_row_task", FAIL, complete & ~F.col("row_task").eqNullSafe(F.col("task")), F.col("row_task")),
        ("retrieval_row_system", FAIL, complete & ~F.col("memory_system").eqNullSafe(F.col("method")), F.col("memory_system")),
        ("retrieval_row_no_memories", FAIL, complete & (F.coalesce(F.size(memories), F.lit(0)) <= 0), ""),
        ("retrieval_count_mismatch", FAIL, filled & ~F.col("retrieved_count").eqNullSafe(F.size(memories)), F.col("retrieved_count")),
        ("retrieval_memory_schema", FAIL, filled & (F.size(broken) > 0), F.size(broken)),
        ("retrieval_context_text_empty", FAIL, filled & is_blank(F.col("context_text")), ""),
        ("retrieval_depth_exceeded", FAIL, filled & (F.size(memories) > bound), F.concat_ws(">", F.size(memories), bound)),
        ("retrieval_top_k_not_given_set", FAIL, filled & per_sample & ~F.col("top_k").eqNullSafe(F.col("given_count")), F.col("top_k")),
        ("retrieval_top_k_policy", FAIL, filled & ~F.col("top_k_policy").eqNullSafe(policy), F.col("top_k_policy")),
    ], sample_id=F.col("sample_id"))


def store_checks(rows: DataFrame, samples: DataFrame, markers: DataFrame) -> DataFrame:
    """Retrieval rows against re-adapted samples and index markers.

    ``rows``: cell, dataset, sample_id, row_index and the recorded ``memory_config``
    columns with the store's ``save_dir``; ``samples``: sample_id, expected_digest,
    expected_messages, expected_prior_sha256, sample_ingest_mode, sample_top_k; ``markers``:
    save_dir, digest, marker_file_count, has_documents (one row per store). With a column ``marker_state``
    ('readable', 'unreadable' or 'missing') a row stands for a store's folder: a store without a
    row has no folder, and a marker that is missing or unreadable is judged no further.
    """
    stated = "marker_state" in markers.columns
    markers = markers if stated else markers.withColumn("marker_state", F.lit("readable"))
    joined = (rows.join(samples.withColumn("_known", F.lit(True)), "sample_id", "left")
              .join(markers.select("save_dir", F.col("digest").alias("_marker_digest"), "marker_file_count", "has_documents",
                                   F.col("marker_state").alias("_marker")), "save_dir", "left"))
    known = F.coalesce("_known", F.lit(False)) & F.col("row_index").isNotNull()
    marked = known & F.col("_marker").eqNullSafe("readable")
    absent, lost = known & F.col("_marker").isNull(), known & F.col("_marker").eqNullSafe("missing")
    per_sample = F.col("sample_top_k").isNotNull()

    def differs(a: str, b: str | Column) -> Column:
        other = F.col(b) if isinstance(b, str) else b
        return ~F.col(a).eqNullSafe(other)

    return findings(joined, "store", [
        ("store_row_index_missing", FAIL, F.col("row_index").isNull(), ""),
        ("store_sample_absent", FAIL, F.col("row_index").isNotNull() & F.col("_known").isNull(), ""),
        ("store_digest_mismatch", FAIL, known & differs("marker_digest", "expected_digest"), F.col("marker_digest")),
        ("store_digest", OK, known & ~differs("marker_digest", "expected_digest"), ""),
        ("store_messages_count", FAIL, known & differs("messages_count", "expected_messages"), F.col("messages_count")),
        ("store_marker_messages_count", FAIL, known & differs("marker_messages_count", "expected_messages"), F.col("marker_messages_count")),
        ("store_prior_sha256", FAIL, known & differs("prior_sha256", "expected_prior_sha256"), ""),
        ("store_ingest_mode", FAIL, known & differs("ingest_mode", registry.lookup(EXPECTED_INGEST, F.col("dataset"))), F.col("ingest_mode")),
        ("store_ingest_mode_adapter", FAIL, known & differs("ingest_mode", "sample_ingest_mode"), F.col("ingest_mode")),
        ("store_top_k_policy", FAIL, known & (per_sample != F.col("top_k_policy").eqNullSafe(F.lit("per_sample_len_memories"))), F.col("top_k_policy")),
        ("store_top_k", FAIL, known & per_sample & differs("top_k", "sample_top_k"), F.col("top_k")),
        ("store_top_k_schema", FAIL, known & ~F.coalesce(F.col("top_k") > 0, F.lit(False)), F.col("top_k")),
        ("store_status", FAIL, known & ~F.coalesce(F.col("store_status").isin(*STORE_STATES), F.lit(False)), F.col("store_status")),
        ("store_dir_missing", FAIL, absent & F.lit(stated), F.col("save_dir")),
        ("store_marker_missing", FAIL, lost if stated else absent, ""),
        ("store_marker_unreadable", FAIL, known & F.col("_marker").eqNullSafe("unreadable"), F.col("save_dir")),
        ("store_marker_digest", FAIL, marked & differs("_marker_digest", "expected_digest"), F.col("_marker_digest")),
        ("store_marker_file_count", FAIL, marked & differs("marker_file_count", "expected_messages"), F.col("marker_file_count")),
        ("store_documents_missing", FAIL, marked & ~F.coalesce("has_documents", F.lit(False)), ""),
    ], sample_id=F.col("sample_id"))


def store_dataset_checks(cells: DataFrame) -> DataFrame:
    """Cells (``cell, dataset_error``) whose source dataset could not be read; NULL: it could."""
    return findings(cells, "store", [("store_dataset_unreadable", FAIL, F.col("dataset_error").isNotNull(), F.col("dataset_error"))])


def alignment_cell_checks(arms: DataFrame) -> DataFrame:
    """Arm facts: ``cell, run_index, has_config, config_unreadable, outputs, duplicates,
    first_divergence, config_retrieval_sha256, retrieval_sha256, config_retrieval_path,
    retrieval_path, config_sample_count, retrieval_rows, config_top_k, row_top_k,
    unreadable_outputs, unreadable_judge`` (NULL row_top_k = not uniform)."""
    started = F.col("outputs") > 0
    configured = started & F.col("has_config")
    return findings(arms, "alignment", [
        ("run_config_unreadable", FAIL, F.col("config_unreadable"), ""),
        ("run_config_missing", FAIL, ~F.col("has_config") & ~F.col("config_unreadable"), ""),
        ("outputs_unreadable", FAIL, F.col("unreadable_outputs") > 0, F.col("unreadable_outputs")),
        ("judge_unreadable", FAIL, F.col("unreadable_judge") > 0, F.col("unreadable_judge")),
        ("outputs_duplicate_ids", FAIL, started & (F.col("duplicates") > 0), F.col("duplicates")),
        ("outputs_not_retrieval_prefix", FAIL, started & F.col("first_divergence").isNotNull(), F.col("first_divergence")),
        ("outputs_are_retrieval_prefix", OK, started & F.col("first_divergence").isNull(), F.col("outputs")),
        ("config_retrieval_sha256", FAIL, configured & ~F.col("config_retrieval_sha256").eqNullSafe(F.col("retrieval_sha256")), ""),
        ("config_retrieval_path", FAIL, configured & (F.col("config_retrieval_path") != F.col("retrieval_path")), F.col("config_retrieval_path")),
        ("config_sample_count", FAIL, configured & ~F.col("config_sample_count").eqNullSafe(F.col("retrieval_rows")), F.col("config_sample_count")),
        ("config_top_k", FAIL, configured & (F.col("dataset") == "memtrapbench") & ~F.col("config_top_k").eqNullSafe(F.col("row_top_k")), F.col("row_top_k")),
    ], run_index=F.col("run_index"))


def alignment_row_checks(records: DataFrame) -> DataFrame:
    """Records with ``cell, run_index, sample_id, record_retrieval_sha256, retrieval_sha256,
    memory_count, retrieved_count, embedded_fingerprint, shared_fingerprint``."""
    empty = F.coalesce("memory_count", F.lit(0)) == 0
    return findings(records, "alignment", [
        ("record_retrieval_sha256", FAIL, F.col("record_retrieval_sha256").isNotNull()
         & (F.col("record_retrieval_sha256") != F.col("retrieval_sha256")), ""),
        ("record_no_memories", FAIL, empty, ""),
        ("record_retrieved_count", FAIL, ~empty & ~F.col("retrieved_count").eqNullSafe(F.col("memory_count")), F.col("retrieved_count")),
        ("record_config", FAIL, F.col("embedded_fingerprint").isNotNull()
         & (F.col("embedded_fingerprint") != F.col("shared_fingerprint")), ""),
    ], run_index=F.col("run_index"), sample_id=F.col("sample_id"))


def arm_config_checks(baseline: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Config pairs of a cell: shared fields, stored and recomputed fingerprints, prompts.

    Both frames hold ``SHARED_FIELDS``, ``shared_fingerprint``, ``run_fingerprint``,
    ``answer_prompt_sha256``, ``prompt_sha256`` (of the prompt in use), ``final_answer_prompt``
    and ``expected_prompt``.
    """
    extra = ["shared_fingerprint", "run_fingerprint", "answer_prompt_sha256", "prompt_sha256",
             "final_answer_prompt", "expected_prompt"]

    def pack(df: DataFrame, name: str) -> DataFrame:
        values = [F.col(f).cast("string").alias(f) for f in SHARED_FIELDS + extra]
        return df.select(*keys, F.struct(*values, fingerprint(SHARED_FIELDS).alias("recomputed")).alias(name))

    pair = pack(baseline, "b").join(pack(staged, "s"), keys, "full")
    both = F.col("b").isNotNull() & F.col("s").isNotNull()
    drift = F.array_compact(F.array(*[
        F.when(~F.col("b")[f].eqNullSafe(F.col("s")[f]), f) for f in SHARED_FIELDS]))
    rules: list[Rule] = [
        ("arm_pair_incomplete", WARN, ~both, ""),
        ("arm_shared_config", FAIL, both & (F.size(drift) > 0), F.concat_ws(",", drift)),
        ("arm_shared_config", OK, both & (F.size(drift) == 0), ""),
        ("arm_shared_fingerprint", FAIL, both & ~F.col("b.shared_fingerprint").eqNullSafe(F.col("s.shared_fingerprint")), ""),
        ("arm_run_fingerprint", FAIL, both & ~F.col("b.run_fingerprint").eqNullSafe(F.col("s.run_fingerprint")), ""),
        ("arm_intervention_absent", FAIL, both & (F.col("b.prompt_sha256") == F.col("s.prompt_sha256")), ""),
        ("arm_intervention", OK, both & (F.col("b.prompt_sha256") != F.col("s.prompt_sha256")), ""),
    ]
    for side, label in (("b", "baseline"), ("s", "staged")):
        here = F.col(side)
        rules += [
            ("arm_shared_fingerprint_stale", FAIL, both & ~here["shared_fingerprint"].eqNullSafe(here["recomputed"]), label),
            ("arm_answer_prompt_missing", FAIL, both & here["prompt_sha256"].isNull(), label),
            ("arm_answer_prompt_sha256", FAIL, both & (here["answer_prompt_sha256"] != here["prompt_sha256"]), label),
            ("arm_answer_prompt_identity", FAIL, both & (here["final_answer_prompt"] != here["expected_prompt"]), label),
        ]
    return findings(pair, "arms", rules, cell=F.concat_ws("/", *keys))


def arm_presence_checks(arms: DataFrame) -> DataFrame:
    """Started arms (``cell, run_index, arm, has_config``): pairs that are whole but lack a config."""
    pairs = arms.groupBy("cell", "run_index").agg(
        F.count_distinct("arm").alias("_arms"), F.array_join(F.array_sort(F.collect_set(
            F.when(~F.coalesce("has_config", F.lit(False)), F.col("arm")))), ",").alias("_without"))
    return findings(pairs, "arms", [("arm_config_missing", FAIL, (F.col("_arms") > 1) & (F.col("_without") != ""), F.col("_without"))],
                    run_index=F.col("run_index"))


RECORD_SETTINGS = ["generation_model", "generation_base_url", "generation_temperature", "generation_max_tokens"]
JUDGE_SETTINGS = ["judge_model", "judge_base_url", "judge_temperature", "judge_max_tokens",
                  "judge_prompt_mode", "rubric_sha256", "run_fingerprint"]


def arm_record_checks(baseline: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Output pairs joined on the id: generation settings, run fingerprint, memory texts."""
    fields = RECORD_SETTINGS + ["run_fingerprint"]

    def pack(df: DataFrame, name: str) -> DataFrame:
        texts = F.transform("retrieved_memories", lambda m: memory_text(m))
        return df.select(*keys, "sample_id", F.struct(
            *[F.col(f).cast("string").alias(f) for f in fields], texts.alias("texts")).alias(name))

    pair = pack(baseline, "b").join(pack(staged, "s"), [*keys, "sample_id"])
    rules: list[Rule] = [
        ("arm_record_settings", FAIL, ~F.col("b")[f].eqNullSafe(F.col("s")[f]), f) for f in RECORD_SETTINGS]
    rules += [
        ("arm_record_fingerprint", FAIL, ~F.col("b.run_fingerprint").eqNullSafe(F.col("s.run_fingerprint")), ""),
        ("arm_record_memories", FAIL, ~F.col("b.texts").eqNullSafe(F.col("s.texts")),
         F.concat_ws(" vs ", F.size("b.texts"), F.size("s.texts")))]
    return findings(pair, "arms", rules, cell=F.concat_ws("/", *keys), sample_id=F.col("sample_id"))


def arm_judge_checks(baseline: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Judge pairs joined on the id: the judge protocol fields and the embedded config."""
    fields = JUDGE_SETTINGS + ["config_fingerprint"]

    def pack(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, "sample_id", F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(name))

    pair = pack(baseline, "b").join(pack(staged, "s"), [*keys, "sample_id"])
    rules: list[Rule] = [("arm_judge_field", FAIL, ~F.col("b")[f].eqNullSafe(F.col("s")[f]), f) for f in JUDGE_SETTINGS]
    rules.append(("arm_judge_config", FAIL, ~F.col("b.config_fingerprint").eqNullSafe(F.col("s.config_fingerprint")), ""))
    return findings(pair, "arms", rules, cell=F.concat_ws("/", *keys), sample_id=F.col("sample_id"))


def judge_row_checks(rows: DataFrame, single_score: bool) -> DataFrame:
    """Judge records against their rubric and their own stored reply.

    Common columns: ``cell, arm, expected_arm, run_index, expected_run_index, sample_id,
    final_answer, rubric_sha256, expected_rubric_sha256, rubric_file, expected_rubric_file``.
    Single score: ``score, score_key, expected_key, scale_low, scale_high, low, high`` and
    ``rescored`` (struct of score, key, problems). Dimensions: ``dimension_scores,
    dimension_count, expected_dimensions`` and ``rescored`` (struct of scores, problems).
    """
    rules: list[Rule] = [
        ("judge_rubric_sha256", FAIL, ~F.col("rubric_sha256").eqNullSafe(F.col("expected_rubric_sha256")), ""),
        ("judge_rubric_file", FAIL, F.col("rubric_file") != F.col("expected_rubric_file"), F.col("rubric_file")),
        ("judge_arm_label", FAIL, ~F.col("arm").eqNullSafe(F.col("expected_arm")), F.col("arm")),
        ("judge_run_index", FAIL, F.coalesce("run_index", F.lit(0)) != F.col("expected_run_index"), F.col("run_index")),
        ("judge_empty_answer", FAIL, is_blank(F.col("final_answer")), ""),
    ]
    problems = F.col("rescored.problems")
    if single_score:
        known = F.col("score_key").isin("score", "rating")
        same = F.col("rescored.score").eqNullSafe(F.col("score")) & F.col("rescored.key").eqNullSafe(F.col("score_key"))
        rules += [
            ("judge_score_scale", FAIL, ~F.col("scale_low").eqNullSafe(F.col("low"))
             | ~F.col("scale_high").eqNullSafe(F.col("high")), F.concat_ws("-", "scale_low", "scale_high")),
            ("judge_score_key", FAIL, ~F.coalesce(known, F.lit(False)), F.col("score_key")),
            ("judge_score_key_deviation", WARN, known & (F.col("score_key") != F.col("expected_key")), F.col("score_key")),
            ("judge_score_range", FAIL, ~F.coalesce(F.col("score").between(F.col("low"), F.col("high")), F.lit(False)), F.col("score")),
            ("judge_rescore", FAIL, (F.size(problems) > 0) | ~same, F.get(problems, F.lit(0))),
        ]
    else:
        scores = F.col("dimension_scores")
        present = F.coalesce(F.size(scores), F.lit(0)) > 0
        outside = F.exists(F.map_values(scores), lambda v: ~v.between(0, 5))
        same = F.sort_array(F.map_entries("rescored.scores")).eqNullSafe(F.sort_array(F.map_entries(scores)))
        rules += [
            ("judge_dimensions_missing", FAIL, ~present, ""),
            ("judge_dimensions", FAIL, present & (F.sort_array(F.map_keys(scores)) != F.sort_array("expected_dimensions")), ""),
            ("judge_score_range", FAIL, present & outside, ""),
            ("judge_dimension_count", FAIL, present & ~F.col("dimension_count").eqNullSafe(F.size(scores)), F.col("dimension_count")),
            ("judge_rescore", FAIL, present & ((F.size(problems) > 0) | ~same), F.get(problems, F.lit(0))),
        ]
    return findings(rows, "judge", rules, run_index=F.col("run_index"), sample_id=F.col("sample_id"))


def rows_checked(rows: DataFrame, group: str, check: str) -> DataFrame:
    """One OK finding per cell with the number of rows a group looked at."""
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return findings(counts, group, [(check, OK, F.col("n") > 0, F.col("n"))])


def agreed_cells(pairs: DataFrame, found: DataFrame, check: str) -> DataFrame:
    """Arm cells with pairs and no failing finding (OK), or with no pair at all (warning).

    ``pairs(cell, pairs)`` counts the ids present on both sides of every cell.
    """
    failed = found.where(F.col("level") == FAIL).select("cell", F.lit(True).alias("_failed")).distinct()
    cells = pairs.join(failed, "cell", "left")
    return findings(cells, "arms", [
        ("arm_records_unpaired", WARN, F.col("pairs") == 0, ""),
        (check, OK, (F.col("pairs") > 0) & F.col("_failed").isNull(), F.col("pairs"))])


def rubric_checks(cells: DataFrame) -> DataFrame:
    """Cells (``cell, rubric_file, rubric_present``) whose rubric text is not available."""
    return findings(cells, "judge", [("rubric_file_missing", FAIL, ~F.col("rubric_present"), F.col("rubric_file"))])


def judge_coverage_checks(arms: DataFrame) -> DataFrame:
    """``cell, run_index, generated, judged``: the 0.98 publication gate."""
    started = F.col("generated") > 0
    ratio = F.col("judged") / F.when(started, F.col("generated"))
    detail = F.concat_ws("/", "judged", "generated")
    return findings(arms, "judge", [
        ("judge_coverage", FAIL, started & (ratio < registry.COVERAGE_GATE), detail),
        ("judge_coverage", OK, started & (ratio >= registry.COVERAGE_GATE), detail),
    ], run_index=F.col("run_index"))


def finding_counts(found: DataFrame) -> DataFrame:
    """ok, warn and fail counts per group and in total (group NULL)."""
    return found.rollup("group").agg(*[
        F.count_if(F.col("level") == level).alias(f"{level}_count") for level in (OK, WARN, FAIL)])


def capped_findings(found: DataFrame, limit: int = 5) -> DataFrame:
    """First ``limit`` details per group, level and check, with the full count beside them.

    The rank filter is pruned inside each map task before the shuffle; the counts are a
    combinable aggregate over all findings, so nothing is lost from the totals.
    """
    keys = ["group", "level", "check"]
    totals = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
    order = W.partitionBy(*keys).orderBy("cell", "run_index", "sample_id", "detail")
    shown = found.withColumn("shown", F.row_number().over(order)).where(F.col("shown") <= limit)
    return shown.join(F.broadcast(totals), keys)


def native_cell_checks(cells: DataFrame) -> DataFrame:
    """Order and row counts of native cells: ``cell, retrieval_rows, output_rows, judge_rows,
    output_divergence, judge_divergence`` (first differing positions)."""
    return findings(cells, "native", [
        ("outputs_not_retrieval_prefix", FAIL, F.col("output_divergence").isNotNull(), F.col("output_divergence")),
        ("judge_not_output_prefix", FAIL, F.col("judge_divergence").isNotNull(), F.col("judge_divergence")),
        ("output_count", FAIL, F.col("output_rows") != F.col("retrieval_rows"), F.concat_ws("/", "output_rows", "retrieval_rows")),
        ("judge_count", FAIL, F.col("judge_rows") != F.col("output_rows"), F.concat_ws("/", "judge_rows", "output_rows")),
    ])


def native_checks(outputs: DataFrame, judged: DataFrame, ablation: str, version: str, prompt_hash: str) -> DataFrame:
    """Native output and judge rows: prompt version and hash, required fields, binary metrics.

    ``judged(sample_id, known_task, correctness_valid, pass_valid)`` with NULL-safe flags.
    """
    rules: list[Rule] = [
        ("prompt_version", FAIL, ~F.col("prompt_version").eqNullSafe(F.lit(version)), F.col("prompt_version")),
        ("prompt_hashes", FAIL, ~F.col("prompt_hash").eqNullSafe(F.lit(prompt_hash)), ""),
        ("missing_final_answer", FAIL, F.coalesce(F.col("final_answer") == "", F.lit(True)), ""),
        ("missing_boundary_cards", FAIL, F.col("boundary_cards").isNull(), "")]
    if ablation in ("full", "stage1-stage2-baseline"):
        rules.append(("missing_role_assignments", FAIL, F.col("role_assignments").isNull(), ""))
    first = findings(outputs, "native", rules, cell=F.lit(ablation), sample_id=F.col("sample_id"))
    second = findings(judged, "native", [
        ("invalid_judge_record", FAIL, ~F.col("known_task"), ""),
        ("invalid_correctness", FAIL, F.col("known_task") & ~F.col("correctness_valid"), ""),
        ("invalid_task_pass", FAIL, F.col("known_task") & ~F.col("pass_valid"), ""),
    ], cell=F.lit(ablation), sample_id=F.col("sample_id"))
    return first.unionByName(second)


