"""Dialogue operators over conversations and document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import dialogue as D
from evalspark.queries import query, table
from evalspark.queries.standins import (
    DOC_MESSAGES_SQL, MESSAGES_SQL, RE2_WS, document_messages, messages, sql_strip)


@query(f"WITH {DOC_MESSAGES_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS position, role, content FROM doc_messages")
def dialogue_clean_messages(spark, sf):
    """C1"""
    return document_messages(spark, sf).select("doc_id", F.posexplode("messages").alias("p", "m")).select(
        "doc_id", (F.col("p") + 1).cast("bigint").alias("position"), "m.role", "m.content")


@query(f"""WITH {DOC_MESSAGES_SQL},
per AS (SELECT doc_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || content, chr(10) || chr(10) ORDER BY pos) AS t FROM doc_messages GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(t, '')) AS digest, CAST(length(coalesce(t, '')) AS BIGINT) AS n_chars FROM documents d LEFT JOIN per USING (doc_id)""")
def dialogue_prior_text(spark, sf):
    """C5"""
    text = D.prior_text(F.col("messages"))
    return document_messages(spark, sf).select("doc_id", F.md5(text).alias("digest"), F.length(text).cast("bigint").alias("n_chars"))


_PARSE = rf"""
cut AS (SELECT id, unnest(list_filter(string_split_regex(opened, '\n\n+'), lambda b: length(b) > 0)) AS block,
  generate_subscripts(list_filter(string_split_regex(opened, '\n\n+'), lambda b: length(b) > 0), 1) AS pos
  FROM (SELECT id, regexp_replace(array_to_string(list_transform(string_split_regex(whole, '\n+'), lambda x: {sql_strip('x')}), chr(10)),
    '(^|\n)((?i:user|assistant|system)[{RE2_WS}]*:)', '\1' || chr(10) || chr(10) || '\2', 'g') AS opened FROM whole_texts)),
parsed AS (SELECT id, pos,
  CASE WHEN regexp_matches(block, '^(?i:user|assistant|system)[{RE2_WS}]*:') THEN lower(regexp_extract(block, '^((?i:user|assistant|system))[{RE2_WS}]*:', 1)) ELSE 'user' END AS role,
  {sql_strip(f"regexp_replace(block, '^(?i:user|assistant|system)[{RE2_WS}]*:[{RE2_WS}]*', '')")} AS content FROM cut),
kept AS (SELECT * FROM parsed WHERE length(content) > 0)"""


@query(rf"""WITH whole_texts AS (SELECT doc_id AS id, {sql_strip('''CASE doc_id % 4 WHEN 0 THEN text
    WHEN 1 THEN regexp_replace(text, '\\n', chr(10) || 'User: ', 'g')
    WHEN 2 THEN regexp_replace(text, '\\. ', '.' || chr(10) || '  assistant :  ', 'g')
    ELSE regexp_replace(text, '\\n', chr(10) || '   ' || chr(10) || 'SYSTEM:' || chr(10), 'g') END''')} AS whole FROM documents), {_PARSE}
SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) AS BIGINT) AS position, role, md5(content) AS digest FROM kept
UNION ALL SELECT id, 1, 'user', md5(whole) FROM whole_texts WHERE length(whole) > 0 AND id NOT IN (SELECT id FROM kept)""")
def dialogue_parse_text(spark, sf):
    """Markers are written into three quarters of the documents."""
    text = F.col("text")
    marked = (
        F.when(F.col("doc_id") % 4 == 0, text)
        .when(F.col("doc_id") % 4 == 1, F.regexp_replace(text, "\n", "\nUser: "))
        .when(F.col("doc_id") % 4 == 2, F.regexp_replace(text, r"\. ", ".\n  assistant :  "))
        .otherwise(F.regexp_replace(text, "\n", "\n   \nSYSTEM:\n")))
    parsed = table(spark, sf, "documents").select("doc_id", F.posexplode(D.parse_dialogue(marked)).alias("p", "m"))
    return parsed.select("doc_id", (F.col("p") + 1).cast("bigint").alias("position"), "m.role", F.md5("m.content").alias("digest"))


@query(rf"""WITH cleaned AS (SELECT conv_id, turn, role, {sql_strip('text')} AS content FROM conversations WHERE length({sql_strip('text')}) > 0),
whole_texts AS (SELECT conv_id * 100000 + turn AS id, {sql_strip("CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || content")} AS whole FROM cleaned), {_PARSE},
per AS (SELECT id, count(*) AS n, min(role) AS role, min(content) AS content FROM kept GROUP BY id),
lossy AS (SELECT c.conv_id, bool_or(NOT coalesce(p.n = 1 AND p.role = c.role AND p.content = c.content, false)) AS lossy
  FROM cleaned c LEFT JOIN per p ON p.id = c.conv_id * 100000 + c.turn GROUP BY c.conv_id)
SELECT CAST(conv_id % 3 AS BIGINT) AS task, count(*) AS samples, count(*) FILTER (lossy) AS mangled, round(avg(CASE WHEN lossy THEN 1.0 ELSE 0.0 END), 6) AS rate FROM lossy GROUP BY 1""")
def dialogue_round_trip_loss(spark, sf):
    """F17"""
    rows = messages(spark, sf).select(
        (F.col("sample_id") % 3).alias("task"), "sample_id", "role", D.strip(F.col("content")).alias("content"))
    loss = D.round_trip_loss(rows.where(F.length("content") > 0), ["task"])
    return loss.withColumn("rate", F.round("rate", 6))


_PAIRS = f"""{MESSAGES_SQL},
nb AS (SELECT sample_id, turn, role, {sql_strip('content')} AS content FROM messages WHERE length({sql_strip('content')}) > 0),
nw AS (SELECT *, lag(role) OVER w AS prev_role, lag(content) OVER w AS prev_content, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn
  FROM nb WINDOW w AS (PARTITION BY sample_id ORDER BY turn)),
pairs AS (SELECT sample_id, turn, next_turn,
  CASE WHEN role = 'assistant' THEN CASE WHEN prev_role <> 'assistant' THEN prev_content ELSE '' END ELSE content END AS query,
  CASE WHEN role = 'assistant' THEN content ELSE '' END AS response
  FROM nw WHERE role = 'assistant' OR next_role IS NULL OR next_role <> 'assistant')"""


@query(f"WITH {_PAIRS} SELECT sample_id, turn, query, response FROM pairs")
def dialogue_pairs(spark, sf):
    """G3"""
    return D.dialogue_pairs(messages(spark, sf)).drop("next_turn")


@query(f"""WITH {_PAIRS}, tot AS (SELECT sample_id, count(*) AS n FROM messages GROUP BY sample_id),
ix AS (SELECT sample_id, turn, query, response, CASE WHEN response <> '' THEN turn ELSE coalesce(next_turn, n) END AS batch_index FROM pairs JOIN tot USING (sample_id))
SELECT *, strftime(make_timestamp((1700000000 + batch_index * 60) * 1000000), '%Y/%m/%d (%a) %H:%M') AS time_stamp FROM ix""")
def dialogue_turn_batches(spark, sf):
    """G4, C21 (minute spaced)"""
    return D.turn_batches(messages(spark, sf))


@query(f"""WITH {MESSAGES_SQL} SELECT sample_id, turn, strftime(make_timestamp((1700000000 + turn) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS time_stamp,
CAST(1700000000 + turn AS DOUBLE) AS float_time_stamp, 'Tue' AS weekday, 'dialogue' AS category, role AS subcategory, 'raw_dialogue' AS memory_class,
role || ': ' || {sql_strip('content')} AS memory, {sql_strip('content')} AS original_memory, {sql_strip('content')} AS compressed_memory, role AS speaker_id, role AS speaker_name
FROM messages WHERE length({sql_strip('content')}) > 0""")
def dialogue_raw_entries(spark, sf):
    """C23, C21 (second spaced)"""
    return D.raw_dialogue_entries(messages(spark, sf))


@query(f"""WITH {MESSAGES_SQL}, m AS (SELECT *, ['messages','raw','raw_dialogue_fallback'][sample_id % 3 + 1] AS mode FROM messages)
SELECT sample_id, turn, mode AS ingest_mode, CASE WHEN sample_id % 5 = 0 THEN 'repair' ELSE 'ingest=' || mode END AS ingest_identity,
CASE WHEN mode = 'messages' THEN role END AS role, CASE WHEN mode = 'messages' THEN content ELSE {sql_strip('content')} END AS content,
strftime(make_timestamp((1700000000 + turn) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS time_stamp
FROM m WHERE mode = 'messages' OR length({sql_strip('content')}) > 0""")
def dialogue_ingest_rows(spark, sf):
    """C22, C24"""
    modes = F.array(F.lit("messages"), F.lit("raw"), F.lit("raw_dialogue_fallback"))
    mode = F.get(modes, (F.col("sample_id") % 3).cast("int"))
    label = F.when(F.col("sample_id") % 5 == 0, "repair").otherwise("")
    return D.ingest_rows(messages(spark, sf), mode, label)


@query("""SELECT conv_id AS sample_id, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) AS turns
FROM conversations GROUP BY 1""")
def dialogue_turn_counts(spark, sf):
    """F18"""
    return messages(spark, sf).groupBy("sample_id").agg(
        F.count_if(F.col("role") == "user").alias("user_turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.count(F.lit(1)).alias("turns"))
