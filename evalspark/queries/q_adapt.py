"""Adapters over raw records written from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark import registry
from evalspark.functions.hashing import messages_sha256
from evalspark.operators import adapt as A

from evalspark.operators.retrieval import fidelity, pair_documents, summary_documents
from evalspark.queries import query, table
from evalspark.queries.standins import (
    DOC_MESSAGES_SQL, SQL_LINES, document_messages, line_turns, lines, messages, sql_collapse, sql_strip)
from evalspark.queries.q_dialogue import _PAIRS

SUBSETS = ["poison", "number_game", "hurt"]


def raw_dialogues(spark, sf):
    """Documents as raw dialogue records; some lack an id, a trigger or a judge field."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        (d + 1).cast("int").alias("row_index"), F.when(d % 5 != 0, d.cast("string")).alias("id"),
        line_turns(F.col("text")).alias("context_history"),
        F.when(d % 13 == 0, "  ").otherwise(F.col("source")).alias("final_trigger"),
        F.when(d % 4 != 0, F.col("lang")).alias("poisoned_fact"), F.when(d % 2 == 0, F.lit(" ")).otherwise("x").alias("objective_truth"),
        F.lit(None).cast("string").alias("gold_standard"),
        F.get(F.array(*[F.lit(s) for s in SUBSETS]), (d % 3).cast("int")).alias("subset"))


@query(f"""WITH {DOC_MESSAGES_SQL}, per AS (SELECT doc_id, count(*) AS n, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a,
  string_agg(role || chr(0) || content || chr(0), '' ORDER BY pos) AS body FROM doc_messages GROUP BY doc_id),
d AS (SELECT d.doc_id, ['poison','number_game','hurt'][d.doc_id % 3 + 1] AS subset, source, coalesce(n, 0) AS n, coalesce(u, 0) AS u, coalesce(a, 0) AS a, coalesce(body, '') AS body FROM documents d LEFT JOIN per USING (doc_id))
SELECT CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) ELSE subset || '_' || lpad(CAST(doc_id + 1 AS VARCHAR), 6, '0') END AS sample_id, 'memtrap_' || subset AS task,
 CASE WHEN doc_id % 13 = 0 THEN '' ELSE source END AS current_request, n AS messages_count, u AS user_turns, a AS assistant_turns, sha256(body) AS prior_sha256,
 CASE subset WHEN 'poison' THEN 'Safety' WHEN 'number_game' THEN 'Cognitive Bias' ELSE 'Trauma' END AS paper_category,
 CASE subset WHEN 'poison' THEN concat_ws(',', CASE WHEN doc_id % 4 = 0 THEN 'poisoned_fact' END, CASE WHEN doc_id % 2 = 0 THEN 'objective_truth' END) WHEN 'number_game' THEN 'gold_standard' ELSE '' END AS missing_judge_fields,
 concat_ws(',', CASE WHEN n = 0 THEN 'no usable turns' END, CASE WHEN doc_id % 13 = 0 THEN 'empty request' END) AS problems FROM d""")
def adapt_dialogue_samples(spark, sf):
    """C2, C6, F18"""
    raw = raw_dialogues(spark, sf)
    out = A.adapt_dialogue(raw, F.col("subset"))
    return out.select(
        "sample_id", "task", "current_request", F.size("ingest_messages").cast("bigint").alias("messages_count"),
        F.col("user_turns").cast("bigint").alias("user_turns"), F.col("assistant_turns").cast("bigint").alias("assistant_turns"),
        messages_sha256(F.col("ingest_messages")).alias("prior_sha256"), "paper_category",
        F.array_join("missing_judge_fields", ",").alias("missing_judge_fields"), F.array_join("problems", ",").alias("problems"))


_MEM = f"list_filter(list_transform({SQL_LINES}, lambda x: {sql_strip('x')}), lambda x: length(x) > 0)"


@query(f"""WITH d AS (SELECT doc_id, source, ['cross_domain','sycophancy'][doc_id % 2 + 1] AS subset, CASE WHEN doc_id % 6 = 0 THEN 'sycophancy' ELSE '' END AS ft, {_MEM} AS mem FROM documents),
e AS (SELECT *, CASE WHEN ft <> '' THEN ft ELSE subset END AS declared FROM d)
SELECT 'persistbench_' || declared || '_' || lpad(CAST(doc_id + 1 AS VARCHAR), CAST(greatest(4, length(CAST(doc_id + 1 AS VARCHAR))) AS INTEGER), '0') AS sample_id, 'persist_' || subset AS task, CAST(len(mem) AS BIGINT) AS top_k,
 concat_ws(',', CASE WHEN len(mem) = 0 THEN 'no memories' END, CASE WHEN len(list_distinct(mem)) <> len(mem) THEN 'duplicate memories' END,
  CASE WHEN doc_id % 11 = 0 THEN 'empty query' END, CASE WHEN declared <> subset THEN 'failure type differs' END) AS problems FROM e""")
def adapt_memory_samples(spark, sf):
    """C3"""
    d = F.col("doc_id")
    raw = table(spark, sf, "documents").select(
        (d + 1).cast("int").alias("row_index"), lines(F.col("text")).alias("memories"),
        F.when(d % 11 == 0, " ").otherwise(F.col("source")).alias("query"),
        F.when(d % 6 == 0, "sycophancy").otherwise("").alias("failure_type"),
        F.when(d % 2 == 0, "cross_domain").otherwise("sycophancy").alias("subset"))
    return A.adapt_memories(raw, F.col("subset")).select(
        "sample_id", "task", F.col("top_k").cast("bigint").alias("top_k"), F.array_join("problems", ",").alias("problems"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'memtrap_hurt' AS task, source AS source_file, doc_id + 1 AS row_index, lang AS current_request, md5(text) AS benchmark_row FROM documents""")
def adapt_wrapper_row(spark, sf):
    """C4"""
    samples = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("sample_id"), F.lit("memtrap_hurt").alias("task"), F.col("source").alias("source_file"),
        (F.col("doc_id") + 1).alias("row_index"), F.col("lang").alias("current_request"), F.md5("text").alias("benchmark_row"), "n_chars")
    return A.wrapper_row(samples)


@query(f"""WITH {DOC_MESSAGES_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS position,
 CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END AS speaker, md5(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || content) AS digest, false AS is_query FROM doc_messages""")
def adapt_context_turns(spark, sf):
    """Audit view of the messages"""
    turns = A.dialogue_context_turns(F.col("messages"))
    return document_messages(spark, sf).select("doc_id", F.posexplode(turns).alias("p", "t")).select(
        "doc_id", (F.col("p") + 1).cast("bigint").alias("position"), "t.speaker", F.md5("t.content").alias("digest"), "t.is_query")


@query(f"""WITH l AS (SELECT doc_id, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) AS pos FROM documents)
SELECT doc_id, 'naiverag_' || lpad(CAST(pos AS VARCHAR), CAST(greatest(2, length(CAST(pos AS VARCHAR))) AS INTEGER), '0') AS memory_id, CAST(pos AS INTEGER) AS retrieval_rank,
 {sql_strip("CASE WHEN pos % 3 = 0 THEN line || '!' ELSE line END")} AS content, {sql_strip("CASE WHEN line = '' THEN CASE WHEN pos % 3 = 0 THEN line || '!' ELSE line END ELSE line END")} AS raw_content,
 CASE WHEN pos % 2 = 0 THEN '{{"line":"' || pos || '"}}' ELSE '{{}}' END AS metadata FROM l""")
def adapt_canonical_memories(spark, sf):
    """C8"""
    retrieved = F.transform(lines(F.col("text")), lambda t, i: F.struct(
        F.when((i + 1) % 3 == 0, F.concat(t, F.lit("!"))).otherwise("").alias("used_content"), t.alias("content"),
        F.when((i + 1) % 2 == 0, F.create_map(F.lit("line"), (i + 1).cast("string"))).alias("metadata")))
    prefixes = F.lit({name: prefix for name, _, prefix, _ in registry.SYSTEMS}["naiveRAG"])
    return table(spark, sf, "documents").select("doc_id", F.explode(A.canonical_memories(retrieved, prefixes)).alias("m")).select(
        "doc_id", "m.memory_id", "m.retrieval_rank", "m.content", "m.raw_content", F.to_json("m.metadata").alias("metadata"))


def _alias_memories(spark, sf):
    """Documents whose lines sit under varying key names."""
    def one(t, i):
        return F.struct(
            F.when(i % 2 == 0, F.concat(F.lit("m"), (i + 1).cast("string"))).alias("memory_id"), F.concat(F.lit("i"), (i + 1).cast("string")).alias("id"),
            F.when(i % 4 == 0, t).when(i % 4 == 3, " ").alias("memory_text"), F.when(i % 4 == 1, t).alias("content"),
            F.when(i % 4 == 2, t).alias("text"), F.when(i % 4 == 3, t).alias("raw_content"))
    return table(spark, sf, "documents").select("doc_id", F.transform(lines(F.col("text")), one).alias("memories"))


_ALIAS = f"l AS (SELECT doc_id, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) - 1 AS i FROM documents)"


@query(f"""WITH {_ALIAS} SELECT doc_id, CASE WHEN i % 2 = 0 THEN 'm' ELSE 'i' END || (i + 1) AS memory_id, CASE WHEN i % 4 = 3 THEN ' ' ELSE line END AS memory_text FROM l""")
def adapt_slim_memories(spark, sf):
    """C10"""
    return _alias_memories(spark, sf).select("doc_id", F.explode(A.slim_memories(F.col("memories"))).alias("m")).select("doc_id", "m.*")


@query(f"""WITH {_ALIAS} SELECT doc_id, i AS position, {sql_strip('line')} AS memory_text FROM l""")
def adapt_memory_texts(spark, sf):
    """C11"""
    texts = F.transform("memories", lambda m: A.memory_text(m))
    return _alias_memories(spark, sf).select("doc_id", F.posexplode(texts).alias("p", "memory_text")).select(
        "doc_id", F.col("p").cast("bigint").alias("position"), "memory_text")


@query(f"""WITH d AS (SELECT doc_id, doc_id % 9 AS k, source, {SQL_LINES} AS mem FROM documents),
n AS (SELECT *, len(mem) AS n, len(list_filter(mem, lambda x: length({sql_strip('x')}) = 0)) AS blank FROM d)
SELECT CASE WHEN k = 1 THEN 'd' || doc_id WHEN k = 2 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS sample_id, CASE WHEN k = 4 THEN '' WHEN k = 5 THEN 'asked' ELSE source END AS current_request,
 concat_ws(',', CASE WHEN k = 2 THEN 'no sample_id' END, CASE WHEN k = 3 THEN 'no benchmark row' END, CASE WHEN k = 6 THEN 'unknown task' END, CASE WHEN k = 4 THEN 'empty request' END,
  CASE WHEN k = 7 THEN 'no memory list' END, CASE WHEN k <> 7 AND blank > 0 THEN 'empty memory' END,
  CASE WHEN k <> 7 AND NOT n BETWEEN 1 AND CASE WHEN doc_id % 2 = 0 THEN 16 ELSE 10 END THEN 'depth out of bounds' END, CASE WHEN k = 8 AND n > 1 THEN 'duplicate memory ids' END) AS problems,
 CASE WHEN k <> 7 THEN CAST(n AS BIGINT) END AS retrieved_count FROM n""")
def adapt_normalize_retrieval(spark, sf):
    """Eight refusal rules seeded by doc_id % 9"""
    d, k = F.col("doc_id"), F.col("doc_id") % 9
    ids = F.transform(lines(F.col("text")), lambda t, i: F.struct(
        F.when(k == 8, "same").when(i % 2 == 0, F.concat(F.lit("m"), i.cast("string"))).otherwise("").alias("memory_id"),
        F.lit("").alias("memory_text"), F.when(i % 2 == 0, t).otherwise("").alias("content"), t.alias("raw_content")))
    rows = table(spark, sf, "documents").select(
        F.when(k.isin(1, 2), "").otherwise(d.cast("string")).alias("sample_id"), F.when(k == 1, F.concat(F.lit("d"), d.cast("string"))).otherwise("").alias("id"),
        F.when(k == 6, "unheard_of").otherwise("memtrap_hurt").alias("task"), F.when(k.isin(4, 5), "").otherwise(F.col("source")).alias("current_request"),
        F.when(k == 5, "asked").otherwise("").alias("question"), (k != 3).alias("has_benchmark_row"),
        F.when(k != 7, ids).alias("retrieved_memories"), (d % 2 == 0).alias("external"))
    out = A.normalize_retrieval_rows(rows, [t[0] for t in registry.TASKS], F.col("external"))
    return out.select("sample_id", "current_request", F.array_join("problems", ",").alias("problems"),
                      F.when(F.col("retrieved_memories").isNotNull(), F.size("retrieved_memories").cast("bigint")).alias("retrieved_count"))


@query(f"""WITH {_ALIAS}, t AS (SELECT doc_id, string_agg(CASE WHEN i % 4 = 0 THEN line WHEN i % 4 = 3 THEN ' ' WHEN i % 4 = 1 THEN line ELSE '' END, chr(10) ORDER BY i) AS shown, string_agg(line, chr(10) ORDER BY i) AS given FROM l GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN given ELSE shown END) AS digest FROM t""")
def adapt_judge_memories(spark, sf):
    """A given set wins over the retrieved texts"""
    docs = _alias_memories(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    given = F.when(F.col("doc_id") % 3 == 0, lines(F.col("text"))).when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>"))
    return docs.select("doc_id", F.md5(F.array_join(A.judge_memories(given, F.col("memories")), "\n")).alias("digest"))


@query("""WITH r AS (SELECT source, lang AS task, CASE WHEN doc_id % 97 = 0 THEN 'messages' WHEN doc_id % 2 = 0 THEN 'raw' ELSE 'raw_dialogue_fallback' END AS mode FROM documents)
SELECT source, min(task) AS task, CASE WHEN count(DISTINCT task) = 1 THEN CAST(1 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS task_count,
 CASE WHEN bool_or(mode = 'messages') THEN 'messages' ELSE min(mode) END AS primary_ingest_mode FROM r GROUP BY source""")
def adapt_cell_identity(spark, sf):
    """C20"""
    d = F.col("doc_id")
    mode = F.when(d % 97 == 0, "messages").when(d % 2 == 0, "raw").otherwise("raw_dialogue_fallback")
    rows = table(spark, sf, "documents").select("source", F.col("lang").alias("task"), mode.alias("ingest_mode"))
    return A.cell_identity(rows, ["source"])


RELEASE_TASKS = ["personalized_memory_use", "valid_memory_selection", "memory_evidence_conflict",
                 "contextual_scope_control", "objective_fact_judgment", "unheard_of"]


@query(f"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, lang, source, {sql_strip('text')} AS t, text, {SQL_LINES} AS mem FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 10 <> 9 AS adapted, ['personalized_memory_use','valid_memory_selection','memory_evidence_conflict','contextual_scope_control','objective_fact_judgment','unheard_of'][k + 1] AS task_type,
 CASE WHEN k = 5 AND doc_id % 10 <> 9 THEN 'unsupported task' END AS problem, md5(CASE WHEN doc_id % 10 <> 9 THEN 'User: ' || t END) AS first_turn,
 mem[1] AS original_memory, CAST(len(mem) AS BIGINT) AS memories,
 CASE k WHEN 0 THEN 'applicable' WHEN 2 THEN 'applicable' WHEN 3 THEN 'partially_applicable' WHEN 4 THEN 'applicable' END AS applicability,
 CASE k WHEN 0 THEN lang WHEN 1 THEN coalesce(mem[2], '') WHEN 2 THEN source WHEN 3 THEN lang || source WHEN 4 THEN lang END AS probe,
 CASE WHEN k = 4 THEN CAST(json_object('correct_reason', lang, 'decisive_evidence', source, 'scope_limits', lang || source) AS VARCHAR) END AS open_rubric FROM d""")
def adapt_release_rows(spark, sf):
    """One field per task is probed, and the open rubric"""
    d, k = F.col("doc_id"), F.col("doc_id") % 6
    items = F.transform(lines(F.col("text")), lambda t, i: F.struct(
        F.lit("fact").alias("type"), t.alias("content"), F.when(i == 1, "outdated").otherwise("current").alias("status")))
    task = F.get(F.array(*[F.lit(t) for t in RELEASE_TASKS]), k.cast("int"))
    rubric = F.struct(F.col("lang").alias("correct_reason"), F.col("source").alias("decisive_evidence"), F.concat("lang", "source").alias("scope_limits"),
                      F.lit("shown").alias("supporting_evidence"))
    evaluation = F.struct(F.lit("ref").alias("reference_answer"), F.lit("pref").alias("preference_aligned_answer"), rubric.alias("rubric"))
    dialogue = F.array(F.struct(F.lit(" User ").alias("role"), F.col("text").alias("content")))
    row = F.struct(d.cast("string").alias("id"), task.alias("task"), F.lit("q").alias("question"),
                   F.when(d % 10 != 9, dialogue).alias("dialogue"), F.struct(items.alias("items")).alias("memory"),
                   F.when(d % 10 != 9, evaluation).otherwise(evaluation).alias("evaluation"),
                   F.struct(F.struct(F.col("lang").alias("split")).alias("source")).alias("metadata"))
    out = A.release_to_eval(table(spark, sf, "documents").select(F.parse_json(F.to_json(row)).alias("row")))
    field = F.col("fields")
    probe = F.coalesce(F.element_at(field, "generated_question.why_correct"), F.element_at(field, "old_preference"),
                       F.element_at(field, "generated_question.decisive_evidence"),
                       F.element_at(field, "generated_question.required_scope_limit"), F.element_at(field, "source_split"))
    return out.select("id", "adapted", "task_type", "problem", F.md5(F.get("dialogue_context_turns", F.lit(0))["content"]).alias("first_turn"),
                      "original_memory", F.size("extraction").cast("bigint").alias("memories"), "applicability", probe.alias("probe"),
                      F.element_at(field, "generated_question.open_answer_rubric").alias("open_rubric"))


@query(f"""WITH {_PAIRS} SELECT CAST(sample_id AS VARCHAR) || ':' || turn AS doc_key, 'Conversation content on 2024-01-0' || (1 + turn % 3) || ':[|User|]: ' || query || '; [|AI|]: ' || response AS page_content, 'dialogue' AS kind FROM pairs
UNION ALL SELECT CAST(doc_id AS VARCHAR) || ':summary', 'The summary of the conversation on ' || source || ' is: ' || text, 'summary' FROM documents WHERE text <> ''""")
def adapt_memory_documents(spark, sf):
    """Pair documents of conversations and summary documents"""
    from evalspark.operators.dialogue import dialogue_pairs

    pairs = dialogue_pairs(messages(spark, sf)).select(
        F.col("sample_id").cast("string").alias("store_id"), F.col("turn").alias("ordinal"), "query", "response",
        F.concat(F.lit("2024-01-0"), (F.col("turn") % 3 + 1).cast("string")).alias("date"))
    notes = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("store_id"), F.lit(0).cast("bigint").alias("ordinal"),
        F.col("source").alias("date"), F.col("text").alias("summary"))
    first = pair_documents(pairs).withColumn("doc_key", F.concat_ws(":", "store_id", "ordinal"))
    second = summary_documents(notes).withColumn("doc_key", F.concat("store_id", F.lit(":summary")))
    return first.unionByName(second).select("doc_key", "page_content", "kind")


@query(f"""WITH d AS (SELECT doc_id, {SQL_LINES} AS given, list_transform({SQL_LINES}, lambda x, i: CASE WHEN i % 4 = 0 THEN x || ' changed' WHEN i % 4 = 1 THEN '  ' || x || chr(10) ELSE x END) AS got FROM documents),
n AS (SELECT doc_id, given, got, list_transform(given, lambda x: {sql_collapse('x')}) AS w, list_transform(got, lambda x: {sql_collapse('x')}) AS g FROM d)
SELECT doc_id, CAST(len(given) AS BIGINT) AS given, CAST(len(got) AS BIGINT) AS retrieved, CAST(len(list_filter(g, lambda x: list_contains(w, x))) AS BIGINT) AS verbatim_matches,
 array_to_string(list_slice(list_filter(g, lambda x: length(x) > 0 AND NOT list_contains(w, x)), 1, 5), '|') AS unmatched FROM n""")
def adapt_raw_fidelity(spark, sf):
    """Given lines against lines re-wrapped or changed by position"""
    got = F.transform(lines(F.col("text")), lambda t, i: F.when((i + 1) % 4 == 0, F.concat(t, F.lit(" changed")))
                      .when((i + 1) % 4 == 1, F.concat(F.lit("  "), t, F.lit("\n"))).otherwise(t))
    docs = table(spark, sf, "documents").select("doc_id", fidelity(lines(F.col("text")), got).alias("f"))
    return docs.select("doc_id", F.col("f.given").cast("bigint").alias("given"), F.col("f.retrieved").cast("bigint").alias("retrieved"),
                       F.col("f.verbatim_matches").cast("bigint").alias("verbatim_matches"), F.array_join("f.unmatched", "|").alias("unmatched"))


@query("""SELECT conv_id AS sample_id, turn, CAST(to_json({'role': role, 'content': text, 'rank': turn}) AS VARCHAR) AS memory_json FROM conversations""")
def adapt_json_safe_memories(spark, sf):
    """C25"""
    return messages(spark, sf).select("sample_id", "turn", F.to_json(F.struct("role", "content", F.col("turn").alias("rank"))).alias("memory_json"))


@query("""SELECT c.conv_id, r.task, r.dataset, r.category, r.top_k, CASE WHEN r.task IS NULL THEN 'unknown task' END AS task_problem FROM conversations c LEFT JOIN (VALUES
 (0,'memtrap_poison','memtrapbench','Safety',10),(1,'memtrap_number_game','memtrapbench','Cognitive Bias',10),(2,'memtrap_hurt','memtrapbench','Trauma',10),
 (3,'memtrap_hallucination','memtrapbench','Task Boundary',10),(4,'memtrap_inertia','memtrapbench','Cognitive Bias',10),(5,'memtrap_unclear','memtrapbench','Task Boundary',10),
 (6,'persist_cross_domain','persistbench',NULL,NULL),(7,'persist_sycophancy','persistbench',NULL,NULL),(8,'persist_beneficial_memory_usage','persistbench',NULL,NULL)) r(i, task, dataset, category, top_k)
 ON r.i = c.conv_id % 10""".replace("SELECT c.conv_id, r.task", "SELECT c.conv_id, c.turn, coalesce(r.task, 'unheard_of') AS task"))
def adapt_registry_join(spark, sf):
    """Every conversation gets a task name; the tenth name is unknown and drops out"""
    names = F.array(*[F.lit(t[0]) for t in registry.TASKS], F.lit("unheard_of"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.get(names, (F.col("conv_id") % 10).cast("int")).alias("task"))
    return registry.with_task(rows).select("conv_id", "turn", "task", "dataset", registry.category(F.col("subset")).alias("category"), "top_k", "task_problem")


@query("SELECT DISTINCT 'unheard_of' AS task FROM conversations WHERE conv_id % 10 = 9")
def adapt_unknown_tasks(spark, sf):
    """Names outside the registry"""
    names = F.array(*[F.lit(t[0]) for t in registry.TASKS], F.lit("unheard_of"))
    rows = table(spark, sf, "conversations").select(F.get(names, (F.col("conv_id") % 10).cast("int")).alias("task"))
    return registry.unknown_tasks(rows)
