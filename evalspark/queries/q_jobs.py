"""Jobs end to end. Model passes use deterministic stand-in models, so they have oracles."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from evalspark.functions import replies
from evalspark.operators import checks as C, metrics as M, selection as S
from evalspark.plans import arms as A, jobs as J, prompts as P
from evalspark.plans.guards import Guard
from evalspark.plans.modelcalls import call_model, last_attempt
from evalspark.queries import query, table
from evalspark.queries.q_checks import _ROW_RULES, _ROWS, retrieval_rows
from evalspark.queries.q_metrics import _DIMS, _PASS, _RATES, _rates, judgements, pass_rows
from evalspark.queries.q_selection import _PARTS, parts
from evalspark.queries.standins import SQL_LINES, expected_samples, lines, scores, sql_strip
from evalspark.session import cut_lineage


def digest_model():
    """Answers with the MD5 of what it was asked."""
    return lambda system, user, stage: hashlib.md5(f"{system}\n{user}".encode()).hexdigest()


def flaky_model():
    """Fails on prompts of some lengths and is silent on others."""
    def call(system, user, stage):
        if len(user) % 5 == 0:
            raise RuntimeError("rate limit")
        return "" if len(user) % 5 == 1 else {"text": "ok", "input_tokens": len(user), "output_tokens": 1, "total_tokens": len(user) + 1}
    return call


def staged_model():
    """Valid stage replies read off the prompt, then an answer that digests the instructions."""
    def call(system, user, stage):
        asked = json.loads(user)
        if stage == "stage1":
            return json.dumps({"memory_boundary_cards": [
                {"memory_id": m["memory_id"], "key_factors": ["f"], "conditional_use_rules": ["r"], "boundary_summary": f"s{len(m['memory_text'])}"}
                for m in asked["memories"]]})
        if stage == "stage2":
            cards = asked["cards"]["memory_boundary_cards"]
            return "```json\n" + json.dumps({"memory_use_instructions": [
                {"use_instruction": "use " + c["boundary_summary"], "rationale": "why"} for c in cards]}) + "\n```"
        used = [i["use_instruction"] for i in asked["instructions"]["memory_use_instructions"]] if "instructions" in asked else \
            [c["boundary_summary"] for c in asked["cards"]["memory_boundary_cards"]]
        return f"{len(used)}:{hashlib.md5('|'.join(used).encode()).hexdigest()}"
    return call


def selector_model():
    """Keeps every second memory; groups memories by parity; otherwise answers with a digest."""
    def call(system, user, stage):
        if stage in ("self_recheck", "dynamic_partition"):
            ids = [m["memory_id"] for m in json.loads(user)["retrieved_memories"]]
            if stage == "self_recheck":
                return json.dumps({"keep_memory_ids": ids[::2]})
            return json.dumps({"groups": [{"domain": "a", "memory_ids": ids[1::2]}, {"domain": "b", "memory_ids": ids[::2]}]})
        return hashlib.md5(f"{system}\n{user}".encode()).hexdigest()
    return call


def judge_model():
    """Scores by prompt length, sometimes outside the scale."""
    return lambda system, user, stage: json.dumps({"reasoning": "because", "score": len(user) % 7})


NO_WAIT = {"attempts": 2, "wait_seconds": lambda attempt, error: 0.0}
ANSWER_TEMPLATE = "You are {model_name}. Known:\n{memories}"
DIALOGUE_TEMPLATE = "Recalled: {conversation_history}\nQuery: {user_query}\n"


def _rows(spark, sf):
    """Documents without a label, as retrieval rows; labelled ones count as done."""
    def memory(t, i, text):
        return F.struct(F.concat(F.lit("m"), (i + 1).cast("string")).alias("memory_id"), t.alias(text))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("current_request"),
        F.transform(lines(F.col("text")), lambda t, i: memory(t, i, "content")).alias("memories"))


def _done(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))


_TODO = f"todo AS (SELECT doc_id AS sample_id, source AS q, {SQL_LINES} AS mem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"
_BULLETS = "'<memories>' || chr(10) || array_to_string(list_transform({m}, lambda x: '- ' || x), chr(10)) || chr(10) || '</memories>'"


@query(f"WITH {_TODO} SELECT sample_id, md5('You are gen. Known:' || chr(10) || {_BULLETS.format(m='mem')} || chr(10) || q) AS final_answer FROM todo")
def jobs_baseline_memory_arm(spark, sf):
    """Memory-set answer prompt"""
    prompt = P.memory_answer_prompt(ANSWER_TEMPLATE, F.transform("memories", lambda m: m["content"]), F.col("current_request"), "gen")
    return A.baseline_arm(_rows(spark, sf), _done(spark, sf), prompt, digest_model, **NO_WAIT).outputs.select("sample_id", "final_answer")


@query(f"""WITH {_TODO} SELECT sample_id, md5(chr(10) || 'Recalled: ' || {sql_strip("array_to_string(list_transform(mem, lambda x, i: '### Memory ' || i || ':' || chr(10) || " + sql_strip('x') + "), chr(10) || chr(10))")} || chr(10) || 'Query: ' || q || chr(10)) AS final_answer FROM todo""")
def jobs_baseline_dialogue_arm(spark, sf):
    """Dialogue answer prompt"""
    prompt = P.dialogue_answer_prompt(DIALOGUE_TEMPLATE, F.transform("memories", lambda m: m["content"]), F.col("current_request"))
    return A.baseline_arm(_rows(spark, sf), _done(spark, sf), prompt, digest_model, **NO_WAIT).outputs.select("sample_id", "final_answer")


@query("""WITH d AS (SELECT doc_id, length(text) AS n FROM documents) SELECT CAST(doc_id AS VARCHAR) AS call_key, n % 5 NOT IN (0, 1) AS success, CAST(CASE WHEN n % 5 IN (0, 1) THEN 2 ELSE 1 END AS INTEGER) AS attempt,
 CASE n % 5 WHEN 0 THEN 'RuntimeError' WHEN 1 THEN 'ValueError' END AS error_type, CASE WHEN n % 5 NOT IN (0, 1) THEN n + 1 END AS total_tokens FROM d""")
def jobs_call_log(spark, sf):
    """Errors and empty replies are retried once and end as rows"""
    prompts = P.add_prompt(table(spark, sf, "documents"), F.struct(F.lit("s").alias("system"), F.col("text").alias("user")), "doc_id")
    return last_attempt(call_model(prompts, flaky_model, "answer", **NO_WAIT)).select("call_key", "success", "attempt", "error_type", "total_tokens")


STAGE_PROMPTS = {
    "stage1": ("s1", '{"memories": {{RETRIEVED_MEMORIES}}}'),
    "stage2": ("s2", '{"memories": {{RETRIEVED_MEMORIES}}, "cards": {{MEMORY_BOUNDARY_CARDS}}}'),
    "stage3": ("s3", '{"memories": {{RETRIEVED_MEMORIES}}, "instructions": {{MEMORY_USE_INSTRUCTIONS}}, "query": "{{CURRENT_QUERY}}"}'),
    "baseline": ("s3", '{"memories": {{RETRIEVED_MEMORIES}}, "cards": {{MEMORY_BOUNDARY_CARDS}}, "query": "{{CURRENT_QUERY}}"}'),
}


def _slim(spark, sf):
    return _rows(spark, sf).withColumn("memories", F.transform("memories", lambda m: F.struct(m["memory_id"].alias("memory_id"), m["content"].alias("memory_text"))))


@query(f"""WITH {_TODO} SELECT sample_id, len(mem) || ':' || md5(array_to_string(list_transform(mem, lambda x: 'use s' || length(x)), '|')) AS final_answer FROM todo""")
def jobs_staged_arm(spark, sf):
    """L3, L7, N5, J7, J11, J16, J17"""
    return A.staged_arm(_slim(spark, sf), _done(spark, sf), STAGE_PROMPTS, staged_model, "full", **NO_WAIT).outputs.select("sample_id", "final_answer")


@query(f"""WITH {_TODO} SELECT sample_id, len(mem) || ':' || md5(array_to_string(list_transform(mem, lambda x: 's' || length(x)), '|')) AS final_answer FROM todo""")
def jobs_staged_ablation(spark, sf):
    """L4: stage 1, then the baseline answer with the cards"""
    return A.staged_arm(_slim(spark, sf), _done(spark, sf), STAGE_PROMPTS, staged_model, "stage1-baseline", **NO_WAIT).outputs.select("sample_id", "final_answer")


@query(f"""WITH {_TODO} SELECT sample_id, len(mem) || ':' || md5(array_to_string(list_transform(mem, lambda x: 'use s' || length(x)), '|')) AS final_answer FROM todo""")
def jobs_staged_ablation_two(spark, sf):
    """L4: stages 1 and 2, then the baseline answer with the instructions"""
    prompts = {**STAGE_PROMPTS, "baseline": STAGE_PROMPTS["stage3"]}
    return A.staged_arm(_slim(spark, sf), _done(spark, sf), prompts, staged_model, "stage1-stage2-baseline", **NO_WAIT).outputs.select("sample_id", "final_answer")


@query(f"""WITH {_TODO}, n AS (SELECT count(*) AS n FROM todo)
SELECT stage, calls, stale FROM (SELECT 'stage1' AS stage, 0 AS calls, 0 AS stale UNION ALL SELECT 'stage2', n, n FROM n UNION ALL SELECT 'stage3', n, 0 FROM n)""")
def jobs_staged_cache(spark, sf):
    """Replies of a run are used again under their keys; where a stage's prompt changed they are stale"""
    first = A.staged_arm(_slim(spark, sf), _done(spark, sf), STAGE_PROMPTS, staged_model, "full", **NO_WAIT)
    changed = {**STAGE_PROMPTS, "stage2": ("another", STAGE_PROMPTS["stage2"][1])}
    second = A.staged_arm(_slim(spark, sf), _done(spark, sf), changed, staged_model, "full", cut_lineage(first.replies), **NO_WAIT)
    stages = spark.createDataFrame([("stage1",), ("stage2",), ("stage3",)], "stage string")
    made = second.calls.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"))
    stale = second.findings.where(F.col("check") == "stale_cache").groupBy(F.split("detail", " ")[0].alias("stage")).agg(F.count(F.lit(1)).alias("stale"))
    return stages.join(made, "stage", "left").join(stale, "stage", "left").select(
        "stage", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("calls", "stale")])


@query("""WITH d AS (SELECT doc_id AS sample_id, source, lang FROM documents), l0 AS (SELECT doc_id AS sample_id, quality, toxic FROM labels), l AS (SELECT * FROM l0 UNION ALL SELECT * FROM l0 WHERE toxic = 1),
f AS (SELECT 'wrong_arm' AS "check", CAST(sample_id AS VARCHAR) AS sample_id, 'arm ' || lang AS detail FROM d WHERE lang <> 'en'
 UNION ALL SELECT 'prompt_drift', CAST(sample_id AS VARCHAR), 'answer p' || quality FROM l WHERE quality <> 1
 UNION ALL SELECT 'config_drift', CAST(sample_id AS VARCHAR), 'c' || toxic FROM l WHERE toxic <> 0
 UNION ALL SELECT 'duplicate_records', CAST(sample_id AS VARCHAR), count(*) || ' rows' FROM l GROUP BY sample_id HAVING count(*) > 1)
SELECT "check", sample_id, detail, CAST(0 AS BIGINT) AS calls FROM f""")
def jobs_guarded_arm(spark, sf):
    """2.14 input guards, M3: findings over the whole input, and no call"""
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("sample_id"), F.create_map(F.lit("answer"), F.concat(F.lit("p"), F.col("quality"))).alias("prompt_hashes"),
        F.concat(F.lit("c"), F.col("toxic")).alias("run_fingerprint"), "toxic")
    rows = _rows(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("arm")), "sample_id")
    prompt = P.memory_answer_prompt(ANSWER_TEMPLATE, F.transform("memories", lambda m: m["content"]), F.col("current_request"), "gen")
    result = A.baseline_arm(rows, labels.unionByName(labels.where("toxic = 1")), prompt, digest_model, Guard("en", {"answer": "p1"}, "c0"), **NO_WAIT)
    return result.findings.select("check", "sample_id", "detail", F.lit(result.calls.count()).cast("bigint").alias("calls"))


def _intervention(spark, sf, method):
    def prompt_of(memories, q):
        return P.memory_answer_prompt(ANSWER_TEMPLATE, F.transform(memories, lambda m: m["content"]), q, "gen")
    out = A.intervention_arm(_rows(spark, sf), _done(spark, sf), method, prompt_of, selector_model, **NO_WAIT).outputs
    return out.select("sample_id", F.lit(method).alias("method"), "final_answer", F.array_join("selected", ",").alias("selected"), F.md5("final_context").alias("context_digest"))


_IDS = "list_transform(mem, lambda x, i: 'm' || i)"
_CONTEXT = "md5(array_to_string({items}, chr(10) || chr(10)))"
_ALL_CONTEXT = _CONTEXT.format(items="list_transform(mem, lambda x, i: 'Memory m' || i || ': ' || x)")


@query(f"""WITH {_TODO}, k AS (SELECT *, list_filter(list_transform(mem, lambda x, i: CASE WHEN i % 2 = 1 THEN 'Memory m' || i || ': ' || x END), lambda x: x IS NOT NULL) AS ctx,
 list_filter(list_transform(mem, lambda x, i: CASE WHEN i % 2 = 1 THEN x END), lambda x: x IS NOT NULL) AS kept, list_filter({_IDS}, lambda x: CAST(substr(x, 2) AS INTEGER) % 2 = 1) AS ids FROM todo)
SELECT sample_id, 'self_recheck' AS method, md5('You are gen. Known:' || chr(10) || {_BULLETS.format(m='kept')} || chr(10) || q) AS final_answer, array_to_string(ids, ',') AS selected, {_CONTEXT.format(items='ctx')} AS context_digest FROM k""")
def jobs_self_recheck_arm(spark, sf):
    """L5, L8, N6, J18"""
    return _intervention(spark, sf, "self_recheck")


@query(f"""WITH {_TODO} SELECT sample_id, 'dynamic_partition' AS method, md5('You are gen. Known:' || chr(10) || {_BULLETS.format(m='mem')} || chr(10) || q) AS final_answer,
 array_to_string(list_concat(list_filter({_IDS}, lambda x: CAST(substr(x, 2) AS INTEGER) % 2 = 0), list_filter({_IDS}, lambda x: CAST(substr(x, 2) AS INTEGER) % 2 = 1)), ',') AS selected, {_ALL_CONTEXT} AS context_digest FROM todo""")
def jobs_dynamic_partition_arm(spark, sf):
    """L5, L8, T15"""
    return _intervention(spark, sf, "dynamic_partition")


@query(f"""WITH {_TODO} SELECT sample_id, 'anti_sycophancy' AS method, md5('You are gen. Known:' || chr(10) || {_BULLETS.format(m='mem')} || chr(10) || chr(10) || '{P.ANTI_SYCOPHANCY.replace("'", "''")}' || chr(10) || q) AS final_answer,
 array_to_string({_IDS}, ',') AS selected, {_ALL_CONTEXT} AS context_digest FROM todo""")
def jobs_anti_sycophancy_arm(spark, sf):
    """L5, L8"""
    return _intervention(spark, sf, "anti_sycophancy")


@query(f"""WITH {_TODO} SELECT sample_id, 'memgate' AS method, md5('You are gen. Known:' || chr(10) || {_BULLETS.format(m='mem')} || chr(10) || q) AS final_answer,
 array_to_string({_IDS}, ',') AS selected, {_ALL_CONTEXT} AS context_digest FROM todo""")
def jobs_memgate_arm(spark, sf):
    """The gate keeps every memory"""
    return _intervention(spark, sf, "memgate")


_JUDGE_USER = f"{_BULLETS.format(m='mem')} || chr(10) || chr(10) || '<query>' || chr(10) || q || chr(10) || '</query>' || chr(10) || chr(10) || '<response>' || chr(10) || 'answer ' || sample_id || chr(10) || '</response>'"


@query(f"""WITH {_TODO}, n AS (SELECT sample_id, length({_JUDGE_USER}) % 7 AS s FROM todo) SELECT sample_id, s BETWEEN 1 AND 5 AS stored, CASE WHEN s BETWEEN 1 AND 5 THEN CAST(s AS INTEGER) END AS score, CASE WHEN NOT s BETWEEN 1 AND 5 THEN 'score out of range' END AS error FROM n""")
def jobs_judge_arm(spark, sf):
    """Refused replies are failures, never zero scores"""
    outputs = _rows(spark, sf).withColumn("final_answer", F.concat(F.lit("answer "), F.col("sample_id").cast("string")))
    prompt = P.memory_judge_prompt("rubric", F.transform("memories", lambda m: m["content"]), F.col("current_request"), F.col("final_answer"))

    def interpret(text):
        return replies.score_single(replies.recover_ladder(replies.split_reasoning(text)["answer"]), F.lit(1), F.lit(5))
    result = A.judge_arm(outputs, _done(spark, sf), prompt, interpret, judge_model, **NO_WAIT)
    good = result.outputs.select("sample_id", F.lit(True).alias("stored"), F.col("verdict.score").alias("score"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(result.failures.select(F.col("call_key").cast("bigint").alias("sample_id"), F.lit(False).alias("stored"), F.lit(None).cast("int").alias("score"), "error"))


POISON_RUBRIC = "Trigger {final_trigger} query {query} fact {poisoned_fact} truth {objective_truth} response {response} answer {assistant_response}"


@query("""SELECT doc_id, md5(replace(replace(replace(replace('Trigger ' || CASE WHEN lang = 'fr' THEN 'fallback' ELSE text END || ' query {query} fact {poisoned_fact} truth {objective_truth} response {response} answer {assistant_response}', '{query}', CASE WHEN lang = 'fr' THEN 'fallback' ELSE text END),
 '{poisoned_fact}', CASE WHEN lang = 'de' THEN 'N/A' ELSE '{objective_truth}' END), '{objective_truth}', source), '{response}', text).replace('{assistant_response}', text)) AS digest FROM documents""")
def jobs_dialogue_judge_prompt(spark, sf):
    """Ordered substitution, braces inside filled values included"""
    lang = F.col("lang")
    prompt = P.dialogue_judge_prompt(POISON_RUBRIC, "poison", {
        "final_trigger": F.when(lang == "fr", "").otherwise(F.col("text")), "current_request": F.lit("fallback"), "assistant_response": F.col("text"),
        "poisoned_fact": F.when(lang == "de", "").otherwise("{objective_truth}"), "objective_truth": F.col("source")})
    return table(spark, sf, "documents").select("doc_id", F.md5(prompt["user"]).alias("digest"))


@query(f"""WITH {_PARTS}, p AS (SELECT lang AS cell, * FROM parts), m AS (SELECT cell, count(DISTINCT sample_id) AS rows, count(*) AS n FROM p WHERE shard <> 3 GROUP BY 1),
e AS (SELECT cell, count(DISTINCT sample_id) AS expected FROM p GROUP BY 1)
SELECT cell, expected, coalesce(rows, 0) AS rows, coalesce(n - rows, 0) AS duplicate_records, expected - coalesce(rows, 0) AS missing, expected = coalesce(rows, 0) AS complete FROM e LEFT JOIN m USING (cell)""")
def jobs_merge_parts(spark, sf):
    """Shard 3 never arrived"""
    rows = parts(spark, sf).withColumnRenamed("lang", "cell")
    expected = rows.select("cell", "sample_id").distinct()
    return J.merge_parts(rows.where("shard <> 3"), expected, ["cell"], ["modified", "shard", "line"])[1]


@query(f"""WITH o AS (SELECT lang AS cell, source, len(list_filter({SQL_LINES}, lambda x: contains(x, 'the'))) AS m, len(list_filter({SQL_LINES}, lambda x: contains(x, 'e'))) AS n FROM documents)
SELECT cell, count(*) FILTER (m = 0) AS empty_primary, count(*) FILTER (m = 0 AND source <> 'src5') AS repaired, count(*) FILTER (m = 0 AND source <> 'src5' AND n = 0) AS still_empty,
 count(*) FILTER (m > 0) AS preserved, CAST(0 AS BIGINT) AS wrongly_changed FROM o GROUP BY ROLLUP (cell)""")
def jobs_repair_manifest(spark, sf):
    """N3, F16, E2"""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("cell"), "source", "text")

    def view(word):
        return F.filter(lines(F.col("text")), lambda x: x.contains(word))
    original = d.select("sample_id", "cell", view("the").alias("retrieved_memories"))
    fallback = d.where("source <> 'src5'").select("sample_id", "cell", view("e").alias("retrieved_memories"))
    return J.repair_manifest(S.overlay_empty(original, fallback), ["cell"])


_SUMMARY_COUNTS = """cnt AS (SELECT e.task, e.n AS source_n, r.n AS retrieved_n, r.j AS judged_n FROM (SELECT task, count(*) AS n FROM expected GROUP BY 1) e
 JOIN (SELECT task, count(DISTINCT sample_id) AS n, count(DISTINCT sample_id) FILTER (run_index = 0) AS j FROM scores GROUP BY 1) r USING (task)),
fin AS (SELECT task, arg_max(n::DOUBLE / expected, k) AS cov FROM c GROUP BY 1),
gate AS (SELECT task, source_n, retrieved_n, judged_n, retrieved_n = source_n AND coalesce(cov, judged_n::DOUBLE / retrieved_n) >= 0.98 AS ok FROM cnt LEFT JOIN fin USING (task))"""


@query(f"""WITH {_RATES}, {_DIMS}, {_SUMMARY_COUNTS}
SELECT m.task, system, dimension, CAST(NULL AS VARCHAR) AS k_label, round(mean, 6) AS value, source_n, retrieved_n, judged_n, ok AS reportable, CASE WHEN ok THEN 'complete' ELSE 'pilot_or_incomplete' END AS status FROM means m JOIN gate g ON g.task = m.task
UNION ALL SELECT c.task, NULL, NULL, 'FR@' || k, round(CASE WHEN c.task = 'signup' THEN 100 - p * 100 ELSE p * 100 END, 6), source_n, retrieved_n, judged_n, ok, CASE WHEN ok THEN 'complete' ELSE 'pilot_or_incomplete' END FROM c JOIN gate g ON g.task = c.task""")
def jobs_external_summary(spark, sf):
    """Dimension rows and rate rows with reportability"""
    dims = M.dimension_means(judgements(spark, sf), ["task", "system"]).select("task", "system", "dimension", F.round("mean", 6).alias("value"))
    rates = _rates(spark, sf).select("task", "k", "k_label", F.round("rate_percent", 6).alias("value"), "coverage")
    source = expected_samples(spark, sf).groupBy("task").agg(F.count(F.lit(1)).alias("source_n"))
    seen = scores(spark, sf).groupBy("task", "sample_id").agg(F.bool_or(F.col("run_index") == 0).alias("judged"))
    counts = source.join(seen.groupBy("task").agg(F.count(F.lit(1)).alias("retrieved_n"), F.count_if("judged").alias("judged_n")), "task")
    return J.external_summary(dims, rates, counts, ["task"]).drop("k", "coverage")


@query(f"""WITH {_PASS}, t AS (SELECT method, task, count(*) = count(passed) AS complete, avg(CASE WHEN passed THEN 1.0 WHEN NOT passed THEN 0.0 END) AS rate FROM pass_rows GROUP BY ALL),
w AS (SELECT count(*) AS n, count(*) FILTER (s AND NOT b) AS wins, count(*) FILTER (NOT s AND b) AS losses FROM rows WHERE s IS NOT NULL AND b IS NOT NULL)
SELECT method, task, 'pass_rate' AS measure, round(rate, 6) AS value FROM t UNION ALL SELECT method, NULL, 'macro_task_pass', CASE WHEN bool_and(complete AND rate IS NOT NULL) THEN round(avg(rate), 6) END FROM t GROUP BY 1
UNION ALL SELECT 'staged_vs_baseline', NULL, unnest(['paired_n','wins','losses','ties','net_wins']), unnest([n, wins, losses, n - wins - losses, wins - losses])::DOUBLE FROM w""")
def jobs_native_report(spark, sf):
    """N9, F5, F6, E7"""
    rows = pass_rows(spark, sf)
    selected = rows.where("method = 'baseline'").select("sample_id", "task")
    return J.native_report(selected, rows.select("method", "sample_id", "passed"), ["baseline", "staged"], "staged").withColumn("value", F.round("value", 6))


@query(f"""WITH {_ROWS}, f AS ({_ROW_RULES} UNION ALL SELECT 'judge', CASE WHEN j::DOUBLE / g < 0.98 THEN 'fail' ELSE 'ok' END, 'judge_coverage', cell, NULL, j || '/' || g
 FROM (SELECT d.source AS cell, count(*) AS g, count(*) FILTER (quality = 1 OR toxic = 1) AS j FROM documents d JOIN labels USING (doc_id) GROUP BY 1))
SELECT "group", count(*) FILTER (level = 'ok') AS ok_count, count(*) FILTER (level = 'warn') AS warn_count, count(*) FILTER (level = 'fail') AS fail_count FROM f GROUP BY ROLLUP ("group")""")
def jobs_validation_report(spark, sf):
    """Findings of two groups, counted"""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    arms = rows.groupBy(F.col("source").alias("cell")).agg(
        F.count(F.lit(1)).alias("generated"), F.count_if((F.col("quality") == 1) | (F.col("toxic") == 1)).alias("judged"))
    found = [C.retrieval_row_checks(retrieval_rows(spark, sf)), C.judge_coverage_checks(arms.withColumn("run_index", F.lit(0)))]
    return J.validation_report(found)[0]


@query("""WITH o AS (SELECT d.source, d.doc_id, l.doc_id IS NOT NULL AS judged FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, count(*) AS expected, count(*) FILTER (judged) AS done, count(*) FILTER (NOT judged) AS missing, round(count(*) FILTER (judged)::DOUBLE / count(*), 6) AS coverage, count(*) FILTER (judged)::DOUBLE / count(*) >= 0.98 AS reportable FROM o GROUP BY 1""")
def jobs_judged_coverage(spark, sf):
    """F13, D8, N7"""
    outputs = table(spark, sf, "documents").select("source", F.col("doc_id").alias("sample_id"))
    judged = outputs.join(_done(spark, sf), "sample_id", "left_semi")
    return J.judged_coverage(outputs, judged, ["source"]).withColumn("coverage", F.round("coverage", 6))


@query("SELECT DISTINCT lang AS task FROM documents WHERE lang IN ('de', 'fr')")
def jobs_refuse_mixed_tasks(spark, sf):
    """German and French stand for external tasks"""
    rows = table(spark, sf, "documents").select(F.col("lang").alias("task"))
    return J.refuse_mixed_tasks(rows, F.col("task").isin("de", "fr"))


_SPLIT = f"""halves AS (SELECT doc_id AS sample_id, '2024-01-0' || h AS date, CASE WHEN h = 1 THEN list_slice(l, 1, len(l) // 2) ELSE list_slice(l, len(l) // 2 + 1, len(l)) END AS part FROM (SELECT doc_id, {SQL_LINES} AS l FROM documents), (SELECT unnest([1, 2]) AS h)),
daily AS (SELECT sample_id, date, md5('sum' || chr(10) || array_to_string(list_transform(part, lambda x: 'User: ' || x || chr(10) || 'AI: '), chr(10))) AS summary FROM halves)"""


@query(f"""WITH {_SPLIT} SELECT sample_id, date, summary FROM daily UNION ALL SELECT sample_id, NULL, md5('sum' || chr(10) || string_agg(date || ': ' || summary, chr(10) ORDER BY date)) FROM daily GROUP BY 1""")
def jobs_daily_summaries(spark, sf):
    """the two halves of a document are two dates"""
    from evalspark.plans.summaries import daily_and_overall

    half = F.floor(F.size("l") / 2).cast("int")
    parts_of = F.array(F.struct(F.lit("2024-01-01").alias("date"), F.slice("l", F.lit(1), half).alias("part")),
                       F.struct(F.lit("2024-01-02").alias("date"), F.slice("l", half + 1, F.size("l")).alias("part")))
    halves = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), lines(F.col("text")).alias("l")).select("sample_id", F.inline(parts_of))
    pairs = F.transform("part", lambda x: F.struct(x.alias("query"), F.lit("").alias("response")))
    daily, overall, _, _ = daily_and_overall(halves.select("sample_id", "date", pairs.alias("pairs")), "sum", digest_model, **NO_WAIT)
    return daily.unionByName(overall.withColumn("date", F.lit(None).cast("string")))
