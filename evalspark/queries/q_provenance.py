"""Run configs, fingerprints and drift; orders stand for stored configs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark import registry
from evalspark.operators import budget as B, provenance as P
from evalspark.queries import query, table
from evalspark.queries.standins import SQL_LINES, lines

_TASK_ROWS = ", ".join(f"({i}, '{t[0]}', '{t[1]}', '{t[2]}', {t[6]}, '{t[4]}')" for i, t in enumerate(registry.TASKS))
_COUNTS = f"""reg(i, task, dataset, subset, k, rubric_file) AS (VALUES {_TASK_ROWS}),
counts AS (SELECT reg.*, count(DISTINCT conv_id) AS sample_count, count(*) AS messages FROM conversations JOIN reg ON reg.i = conv_id % 9 GROUP BY ALL)"""


def task_counts(spark, sf):
    """Conversations dealt out to the registered tasks, with sample and message counts."""
    names = F.array(*[F.lit(t[0]) for t in registry.TASKS])
    chats = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages_count"))
    return chats.select(F.get(names, (F.col("conv_id") % 9).cast("int")).alias("task"), "messages_count")


def cells(spark, sf):
    counts = task_counts(spark, sf).groupBy("task").agg(F.count(F.lit(1)).alias("sample_count"))
    return B.matrix(counts, ["AMEM", "naiveRAG"], ["baseline", "staged"]).withColumn("run_index", F.lit(0))


_FIELDS = """'dataset='''||dataset||'''', 'dialogue_context_policy=''none''', 'embedding_model=''''', 'generation_base_url=''http://model''', 'generation_model=''gen-model''',
 'ingest_mode='''||CASE WHEN dataset='memtrapbench' THEN 'messages' ELSE 'raw' END||'''', 'judge_base_url=''http://model''', 'judge_max_tokens=''2000''', 'judge_model=''gen-model''',
 'judge_prompt_mode='''||CASE WHEN dataset='memtrapbench' THEN 'single_user' ELSE 'system_plus_user' END||'''', 'judge_temperature=''0.0''', 'k_generations='''||k||'''', 'max_tokens=''4096''',
 'memory_llm_model=''''', 'retrieval_file='''||CASE WHEN dataset='memtrapbench' THEN 'retrieved_top10.jsonl' ELSE 'retrieved_topk.jsonl' END||'''', 'retrieval_sha256=''''',
 'rubric_file='''||rubric_file||'''', 'rubric_sha256=''''', 'run_index=''0''', 'sample_count='''||sample_count||'''', 'subset='''||subset||'''', 'system='''||system||'''', 'temperature=''0.2''',
 'thinking_enabled=''false''', 'tool_env=''''', CASE WHEN dataset='memtrapbench' THEN 'top_k=''10''' ELSE 'top_k=null' END, 'top_k_policy='''||CASE WHEN dataset='memtrapbench' THEN 'fixed' ELSE 'per_sample_len_memories' END||''''"""


@query(f"""WITH {_COUNTS}, c AS (SELECT * FROM counts, (SELECT unnest(['AMEM','naiveRAG']) AS system), (SELECT unnest(['baseline','staged']) AS arm))
SELECT task, system, arm, sample_count, CAST(k AS INTEGER) AS k_generations, CASE WHEN dataset = 'memtrapbench' THEN CAST(10 AS INTEGER) END AS top_k, sha256(concat_ws(chr(10), {_FIELDS})) AS shared_fingerprint FROM c""")
def provenance_run_configs(spark, sf):
    """Both arms of a cell share one fingerprint"""
    configs = P.run_configs(cells(spark, sf), "gen-model", "http://model")
    return configs.select("task", "system", "arm", "sample_count", "k_generations", "top_k", "shared_fingerprint")


CONFIG_FIELDS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "retrieval_sha256"]


def config_pair(spark, sf):
    """Orders as configs; the right side differs by priority and status."""
    left = table(spark, sf, "orders").withColumn("retrieval_sha256", F.md5(F.col("o_orderkey").cast("string")))
    urgent, pending = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "P"
    right = left.withColumns({
        "o_custkey": F.when(urgent, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")),
        "retrieval_sha256": F.when(urgent | pending, F.lit("new")).otherwise(F.col("retrieval_sha256")),
        "o_orderstatus": F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_orderstatus"))})
    return left, right


_DRIFT = """drift AS (SELECT o_orderkey, 'o_custkey' AS field, CAST(o_custkey AS VARCHAR) AS left_value, CAST(o_custkey + 1 AS VARCHAR) AS right_value FROM orders WHERE o_orderpriority = '1-URGENT'
 UNION ALL SELECT o_orderkey, 'retrieval_sha256', md5(CAST(o_orderkey AS VARCHAR)), 'new' FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'
 UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus, NULL FROM orders WHERE o_orderpriority = '5-LOW')"""


@query(f"WITH {_DRIFT} SELECT * FROM drift")
def provenance_field_drift(spark, sf):
    """J22, E5, E6"""
    return P.field_drift(*config_pair(spark, sf), ["o_orderkey"], CONFIG_FIELDS)


@query(f"WITH {_DRIFT} SELECT o_orderkey, count(*) AS drifted, count(*) = 1 AND bool_and(field = 'retrieval_sha256') AS allowed FROM drift GROUP BY 1")
def provenance_continuation(spark, sf):
    """J23"""
    return P.continuation_allowed(P.field_drift(*config_pair(spark, sf), ["o_orderkey"], CONFIG_FIELDS), ["o_orderkey"])


@query(f"""WITH {_COUNTS} SELECT task, system, arm FROM counts, (SELECT unnest(['AMEM','naiveRAG']) AS system), (SELECT unnest(['baseline','staged']) AS arm) WHERE arm = 'staged' AND dataset = 'persistbench'""")
def provenance_stale_fingerprints(spark, sf):
    """2.14 arm_shared_fingerprint_stale: a field of the staged memory-set configs was edited"""
    configs = P.run_configs(cells(spark, sf), "gen-model", "http://model").withColumn("stored_fingerprint", F.col("shared_fingerprint"))
    edited = F.when((F.col("arm") == "staged") & (F.col("dataset") == "persistbench"), 999).otherwise(F.col("judge_max_tokens"))
    return P.stale_fingerprints(configs.withColumn("judge_max_tokens", edited)).select("task", "system", "arm")


@query(f"""WITH {_COUNTS} SELECT task, system, CAST(2 AS BIGINT) AS arms, CASE WHEN task = 'memtrap_hurt' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS unnamed, task = 'memtrap_poison' AS identical FROM counts, (SELECT unnest(['AMEM','naiveRAG']) AS system)""")
def provenance_answer_prompts(spark, sf):
    """2.14 arm_intervention_absent: one task uses one prompt on both sides, one leaves it empty"""
    prompt = (F.when(F.col("task") == "memtrap_poison", "same.txt").when((F.col("task") == "memtrap_hurt") & (F.col("arm") == "staged"), "")
              .otherwise(F.concat("arm", F.lit(".txt"))))
    return P.answer_prompts_identical(cells(spark, sf).withColumn("final_answer_prompt", prompt), ["task", "system"])


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN 'prompt_version' ELSE 'prompt_hash' END AS problem FROM documents WHERE lang = 'de' OR source = 'src3'""")
def provenance_prompt_gate(spark, sf):
    """M3: German rows have an old version, source 3 another hash"""
    rows = table(spark, sf, "documents").select(
        "doc_id", F.lit("full").alias("ablation"), F.when(F.col("lang") == "de", "v0").otherwise("v1").alias("prompt_version"),
        F.when(F.col("source") == "src3", "x").otherwise("h").alias("prompt_hash"))
    prompts = spark.createDataFrame([("full", "v1", "h"), ("stage1-baseline", "v1b", "h2")], "ablation string, prompt_version string, prompt_hash string")
    return P.prompt_gate(rows, prompts).select("doc_id", "problem")


@query("""SELECT d.doc_id AS sample_id, CASE WHEN l.doc_id IS NULL THEN 'miss' WHEN l.toxic = 1 THEN 'mismatch' ELSE 'hit' END AS cache_state FROM documents d LEFT JOIN labels l USING (doc_id)""")
def provenance_stage_cache(spark, sf):
    """M4: labels are cached stages, toxic ones under another fingerprint"""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.lit("v1").alias("prompt_version"), F.lit("f").alias("run_fingerprint"))
    cache = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), F.lit("v1").alias("prompt_version"),
                                              F.when(F.col("toxic") == 1, "g").otherwise("f").alias("run_fingerprint"))
    return P.stage_cache_state(rows, cache, ["prompt_version", "run_fingerprint"]).select("sample_id", "cache_state")


@query("""SELECT CAST(doc_id AS VARCHAR) AS name, source <> 'src1' AND lang <> 'es' AS ok, CASE WHEN source = 'src1' AND lang <> 'es' THEN CAST(length(text) AS BIGINT) END AS first_difference FROM documents""")
def provenance_prompt_parity(spark, sf):
    """Source 1 renders one character more, Spanish prompts are absent"""
    expected = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    rendered = table(spark, sf, "documents").where("lang <> 'es'").select(
        F.col("doc_id").cast("string").alias("name"), F.when(F.col("source") == "src1", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    out = P.parity(rendered, expected)
    return out.withColumn("first_difference", F.col("first_difference").cast("bigint"))


_BUDGET = f"""{_COUNTS}, b AS (SELECT task, system, arm, sample_count, CAST(CASE WHEN arm = 'baseline' THEN 1 ELSE 3 END AS INTEGER) AS stages_per_sample, sample_count * k * CASE WHEN arm = 'baseline' THEN 1 ELSE 3 END AS generation_calls,
 sample_count * k AS judge_calls, sample_count * k * (CASE WHEN arm = 'baseline' THEN 1 ELSE 3 END + 1) AS total_calls FROM counts, (SELECT unnest(['AMEM','naiveRAG']) AS system), (SELECT unnest(['baseline','staged']) AS arm))"""


@query(f"WITH {_BUDGET} SELECT * FROM b")
def budget_call_matrix(spark, sf):
    """E13, F11, N12"""
    budget = B.call_budget(registry.refuse_unknown_tasks(registry.with_task(cells(spark, sf))))
    return budget.select("task", "system", "arm", "sample_count", "stages_per_sample", "generation_calls", "judge_calls", "total_calls")


@query(f"WITH {_BUDGET} SELECT arm, count(*) AS cells, sum(generation_calls)::BIGINT AS generation_calls, sum(judge_calls)::BIGINT AS judge_calls, sum(total_calls)::BIGINT AS total_calls FROM b GROUP BY ROLLUP (arm)")
def budget_totals(spark, sf):
    """F11"""
    return B.budget_totals(B.call_budget(registry.refuse_unknown_tasks(registry.with_task(cells(spark, sf)))))


@query(f"""WITH {_COUNTS} SELECT task, system, sample_count AS samples, messages, messages * rate AS estimated_calls FROM counts, (VALUES ('AMEM', 2.0::DOUBLE), ('Mem0', 2.0::DOUBLE), ('naiveRAG', 0.0::DOUBLE)) r(system, rate)""")
def budget_retrieval(spark, sf):
    """F12"""
    return B.retrieval_budget(task_counts(spark, sf))


@query(f"""SELECT source, CAST(sum(len(list_filter({SQL_LINES}, lambda x: x <> ''))) AS BIGINT) AS messages, count(*) AS samples FROM documents GROUP BY 1""")
def budget_message_counts(spark, sf):
    """messages per source before any model call"""
    sizes = table(spark, sf, "documents").select("source", F.size(F.filter(lines(F.col("text")), lambda x: x != "")).alias("n"))
    return sizes.groupBy("source").agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("samples"))
