"""Text and hashing operators over whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import hashing, text as T
from evalspark.queries import query, table
from evalspark.queries.standins import (
    DOC_MESSAGES_SQL, SQL_LINES, document_messages, lines, sql_collapse, sql_strip)


@query(f"SELECT doc_id, md5({sql_collapse('text')}) AS digest, CAST(length({sql_collapse('text')}) AS BIGINT) AS n_chars FROM documents")
def text_collapse_whitespace(spark, sf):
    """J1"""
    flat = T.collapse_whitespace(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(flat).alias("digest"), F.length(flat).cast("bigint").alias("n_chars"))


@query(f"""WITH d AS (SELECT doc_id, {sql_collapse('text')} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE rtrim(left(t, 157), ' ') || '...' END AS short_text FROM d""")
def text_truncate(spark, sf):
    """J2"""
    return table(spark, sf, "documents").select("doc_id", T.truncate(F.col("text")).alias("short_text"))


TEMPLATE = "Language {{LANG}}.\nMemories:\n{{MEMORIES}}\nSource {{SOURCE}}{{SUFFIX}}"


@query("""WITH d AS (SELECT doc_id, 'Language ' || lang || '.' || chr(10) || 'Memories:' || chr(10) || text || chr(10)
  || 'Source ' || source || CASE WHEN doc_id % 7 = 0 THEN '{{OPEN_KEY}}' ELSE '' END AS t FROM documents)
SELECT doc_id, md5(t) AS digest, array_to_string(regexp_extract_all(t, '\\{\\{([A-Z_]+)\\}\\}', 1), ',') AS unresolved FROM d""")
def text_render_template(spark, sf):
    """J3"""
    suffix = F.when(F.col("doc_id") % 7 == 0, "{{OPEN_KEY}}").otherwise("")
    filled = T.render(F.lit(TEMPLATE), {"LANG": F.col("lang"), "MEMORIES": F.col("text"),
                                        "SOURCE": F.col("source"), "SUFFIX": suffix})
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(filled).alias("digest"), F.array_join(T.unresolved_placeholders(filled), ",").alias("unresolved"))


@query("SELECT doc_id, left(replace(replace(text, 'http://www', '[REDACTED]'), 'the the the', '[REDACTED]'), 2000) AS message FROM documents")
def text_redact_secrets(spark, sf):
    """Secrets longer than eight characters; the short one is left alone."""
    return table(spark, sf, "documents").select(
        "doc_id", T.redact(F.col("text"), ["http://www", "the the the", "the"]).alias("message"))


@query(f"""WITH m AS (SELECT doc_id, list_filter(list_transform({SQL_LINES}, lambda x: {sql_strip('x')}), lambda x: length(x) > 0) AS mem FROM documents)
SELECT doc_id, CAST(len(mem) AS BIGINT) AS memories,
  md5('<memories>' || chr(10) || array_to_string(list_transform(mem, lambda x: '- ' || x), chr(10)) || chr(10) || '</memories>') AS bullets,
  md5(CASE WHEN len(mem) = 0 THEN '[NO RETRIEVED MEMORIES]' ELSE array_to_string(list_transform(mem, lambda x, i: '### Memory ' || i || ':' || chr(10) || x), chr(10) || chr(10)) END) AS numbered,
  md5(array_to_string(list_transform(mem, lambda x, i: 'Memory m' || i || ': ' || x), chr(10) || chr(10))) AS identified
FROM m""")
def text_memory_blocks(spark, sf):
    """C7, C13, C14"""
    memories = F.filter(F.transform(lines(F.col("text")), T.strip), lambda m: F.length(m) > 0)
    docs = table(spark, sf, "documents").select("doc_id", memories.alias("mem"))
    named = F.transform("mem", lambda m, i: F.struct(
        F.concat(F.lit("m"), (i + 1).cast("string")).alias("memory_id"), m.alias("content")))
    return docs.select(
        "doc_id", F.size("mem").cast("bigint").alias("memories"), F.md5(T.bullet_memories(F.col("mem"))).alias("bullets"),
        F.md5(T.numbered_memories(F.col("mem"))).alias("numbered"), F.md5(T.identified_memories(named)).alias("identified"))


@query(f"""WITH m AS (SELECT doc_id, lang, source,
  list_filter(list_transform({SQL_LINES}, lambda x: {sql_strip('x')}), lambda x: length(x) > 0) AS mem FROM documents),
b AS (SELECT *, CASE WHEN len(mem) = 0 THEN '[NO RETRIEVED MEMORIES]' ELSE
  (CASE WHEN lang = 'de' THEN '根据当前用户的问题，与问题最相关的[回忆]是：' ELSE 'Based on the current question, the most relevant [memories] are:' END)
  || chr(10) || chr(10) || array_to_string(list_transform(mem, lambda x, i: '### Memory ' || i || CASE WHEN i % 2 = 1 THEN ' (2024-01-0' || (i % 9) || ')' ELSE '' END || ':' || chr(10) || x), chr(10) || chr(10)) END AS block FROM m)
SELECT doc_id, md5(
  CASE WHEN lang = 'de' THEN '用户的性格以及AI伴侣的回复策略为：' || source || chr(10) || chr(10) ELSE 'The personality of the user and the response strategy of the AI Companion are: ' || source || chr(10) || chr(10) END
  || CASE WHEN doc_id % 3 = 0 THEN '' WHEN lang = 'de' THEN '你和用户过去的回忆总结是：' || lang || chr(10) || chr(10) ELSE 'The summary of your past memories with the user is: ' || lang || chr(10) || chr(10) END
  || block) AS digest FROM b""")
def text_dated_context(spark, sf):
    """German documents use the second language."""
    memories = F.filter(F.transform(lines(F.col("text")), T.strip), lambda m: F.length(m) > 0)
    dated = F.transform(memories, lambda m, i: F.struct(
        F.when((i + 1) % 2 == 1, F.concat(F.lit("2024-01-0"), ((i + 1) % 9).cast("string"))).otherwise("").alias("date"), m.alias("content")))
    history = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang"))
    docs = table(spark, sf, "documents").withColumn("m", dated).withColumn("h", history)
    english = T.dated_context(F.col("source"), F.col("h"), F.col("m"), "en")
    other = T.dated_context(F.col("source"), F.col("h"), F.col("m"), "cn")
    return docs.select("doc_id", F.md5(F.when(F.col("lang") == "de", other).otherwise(english)).alias("digest"))


@query(f"""WITH {DOC_MESSAGES_SQL},
per AS (SELECT doc_id, string_agg(role || chr(0) || content || chr(0), '' ORDER BY pos) AS joined FROM doc_messages GROUP BY doc_id)
SELECT d.doc_id, sha256(d.text) AS text_sha256, sha256(coalesce(p.joined, '')) AS messages_sha256
FROM documents d LEFT JOIN per p USING (doc_id)""")
def hash_texts_and_messages(spark, sf):
    """J19"""
    return document_messages(spark, sf).select(
        "doc_id", hashing.sha256_text(F.col("text")).alias("text_sha256"),
        hashing.messages_sha256(F.col("messages")).alias("messages_sha256"))


@query("""SELECT doc_id, 'pm_' || left(sha1('A-MEM' || chr(0) || CAST(doc_id AS VARCHAR) || chr(0) || text || chr(0) || source), 24) AS user_id FROM documents""")
def hash_sample_user_id(spark, sf):
    """User id of a store."""
    return table(spark, sf, "documents").select("doc_id", hashing.sample_user_id(
        F.lit("A-MEM"), F.col("doc_id").cast("string"), F.col("text"), F.col("source")).alias("user_id"))


@query(f"""WITH {DOC_MESSAGES_SQL},
nb AS (SELECT doc_id, pos, role, content, lag(role) OVER w AS prev_role, lag(content) OVER w AS prev_content, lead(role) OVER w AS next_role
  FROM doc_messages WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
pairs AS (SELECT doc_id, pos,
  CASE WHEN role = 'assistant' THEN CASE WHEN prev_role <> 'assistant' THEN prev_content ELSE '' END ELSE content END AS q,
  CASE WHEN role = 'assistant' THEN content ELSE '' END AS r
  FROM nb WHERE role = 'assistant' OR next_role IS NULL OR next_role <> 'assistant'),
per AS (SELECT doc_id, count(*) AS n, string_agg(coalesce(q,'') || chr(0) || r || chr(0), '' ORDER BY pos) AS body FROM pairs GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.n, 0) AS pairs, left(sha1('MemoryBank' || chr(0) || d.lang || chr(0) || '0.2' || chr(0) || coalesce(p.body, '')), 24) AS digest
FROM documents d LEFT JOIN per p USING (doc_id)""")
def hash_store_digest(spark, sf):
    """Store digest over settings and nested pairs (nested form of G3)."""
    from evalspark.operators.dialogue import pair_messages

    pairs = document_messages(spark, sf).withColumn("pairs", pair_messages(F.col("messages")))
    return pairs.select("doc_id", F.size("pairs").cast("bigint").alias("pairs"), hashing.store_digest(
        [F.lit("MemoryBank"), F.col("lang"), F.lit("0.2")], F.col("pairs")).alias("digest"))


@query("""WITH p AS (SELECT a.doc_id, a.text AS l, b.text AS r FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND a.source IS NOT NULL)
SELECT doc_id, CASE WHEN l <> r THEN CAST(coalesce(list_position(list_transform(list_zip(string_split(l, ''), string_split(r, '')),
  lambda z: z[1] IS DISTINCT FROM z[2]), true), 0) AS BIGINT) - 1 END AS first_diff
FROM (SELECT doc_id, l || l AS l, l || CASE WHEN doc_id % 2 = 0 THEN r ELSE l END AS r FROM p)""")
def text_first_difference(spark, sf):
    """A document twice over against the document followed by the next one."""
    docs = table(spark, sf, "documents")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    pairs = docs.join(nxt, "doc_id")
    left = F.concat("text", "text")
    right = F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.col("other")).otherwise(F.col("text")))
    return pairs.select("doc_id", T.first_difference(left, right).cast("bigint").alias("first_diff"))
