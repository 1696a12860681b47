"""Stand-ins: the given tables read as the tables the operators expect.

Each Spark builder has a SQL text of the same derivation for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.functions.text import WHITE_SPACE
from evalspark.queries import table

#: SQL literal of the white space set, and its RE2 class body.
SQL_WS = "||".join(f"chr({ord(c)})" for c in WHITE_SPACE)
RE2_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {SQL_WS})"


def sql_collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[{RE2_WS}]+', ' ', 'g'))"


# --- conversations as messages -------------------------------------------------------


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("sample_id"), "turn", "role", F.col("text").alias("content"))


MESSAGES_SQL = "messages AS (SELECT conv_id AS sample_id, turn, role, text AS content FROM conversations)"


# --- events as judge scores, calls and samples ------------------------------------------


def k_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


SQL_K = "CAST(json_extract(props, '$.k') AS INTEGER)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Judge scores: sample = user, task = event type, run = event_id % 3, score 1..5."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("task"), F.col("user_id").alias("sample_id"),
        (F.col("event_id") % 3).cast("int").alias("run_index"), (k_of(F.col("props")) % 5 + 1).alias("score"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id")


SCORES_SQL = (f"scores AS (SELECT event_type AS task, user_id AS sample_id, CAST(event_id % 3 AS INTEGER) AS run_index, "
              f"{SQL_K} % 5 + 1 AS score, ts, event_id FROM events)")

TASKS = ["click", "error", "purchase", "signup", "view"]


def expected_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Every user is expected in every task."""
    users = table(spark, sf, "events").select(F.col("user_id").alias("sample_id")).distinct()
    return users.withColumn("task", F.explode(F.array(*[F.lit(t) for t in TASKS])))


EXPECTED_SQL = ("expected AS (SELECT u.sample_id, t.task FROM (SELECT DISTINCT user_id AS sample_id FROM events) u, "
                "(SELECT unnest(['click','error','purchase','signup','view']) AS task) t)")


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Call log: stage = event type, success unless 'error', latency = value, tokens from k."""
    k = k_of(F.col("props"))
    ok = F.col("event_type") != "error"
    known = ok & (k % 10 != 0)
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(
        F.col("event_id").alias("call_id"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.col("user_id").alias("sample_id"), F.concat(F.lit("task"), (F.col("user_id") % 4).cast("string")).alias("task"),
        F.lit("generation").alias("phase"), F.element_at(F.array(F.lit("stage1"), F.lit("stage2"), F.lit("stage3")),
                                                          (F.col("event_id") % 3 + 1).cast("int")).alias("stage"),
        ok.alias("success"), F.col("ts").alias("request_started_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("bigint")).alias("response_received_at"),
        F.col("value").alias("latency_ms"), F.lit(0.0).alias("retry_sleep_ms"),
        F.when(known, k).cast("bigint").alias("input_tokens"), F.when(known, k * 2).cast("bigint").alias("output_tokens"),
        F.when(known, k * 3).cast("bigint").alias("total_tokens"),
        F.when(known & (k > 50), F.lit(1)).cast("bigint").alias("cached_input_tokens"),
        F.lit(None).cast("bigint").alias("reasoning_tokens"), known.alias("usage_available"),
        (F.col("event_id") % 4 + 1).cast("int").alias("attempt"))


CALLS_SQL = f"""calls AS (
  SELECT event_id AS call_id, strftime(ts, '%Y-%m-%d') AS run_id, user_id AS sample_id,
         'task' || CAST(user_id % 4 AS VARCHAR) AS task, 'generation' AS phase,
         ['stage1','stage2','stage3'][event_id % 3 + 1] AS stage, event_type <> 'error' AS success,
         ts AS request_started_at, make_timestamp(epoch_us(ts) + CAST(round(value * 1000) AS BIGINT)) AS response_received_at,
         value AS latency_ms, 0.0::DOUBLE AS retry_sleep_ms,
         CASE WHEN event_type <> 'error' AND {SQL_K} % 10 <> 0 THEN CAST({SQL_K} AS BIGINT) END AS input_tokens,
         CASE WHEN event_type <> 'error' AND {SQL_K} % 10 <> 0 THEN CAST({SQL_K} * 2 AS BIGINT) END AS output_tokens,
         CASE WHEN event_type <> 'error' AND {SQL_K} % 10 <> 0 THEN CAST({SQL_K} * 3 AS BIGINT) END AS total_tokens,
         CASE WHEN event_type <> 'error' AND {SQL_K} % 10 <> 0 AND {SQL_K} > 50 THEN CAST(1 AS BIGINT) END AS cached_input_tokens,
         CAST(NULL AS BIGINT) AS reasoning_tokens, event_type <> 'error' AND {SQL_K} % 10 <> 0 AS usage_available,
         CAST(event_id % 4 + 1 AS INTEGER) AS attempt
  FROM events)"""


# --- documents as nested records ---------------------------------------------------------


def lines(text: Column) -> Column:
    return F.split(text, "\n")


SQL_LINES = "string_split(text, chr(10))"

# Roles given to the lines of a document, by position.
LINE_ROLES = ["user", "assistant", " Human ", "SYSTEM", ""]


def line_turns(text: Column) -> Column:
    """A document's lines as ``context_history`` turns."""
    roles = F.array(*[F.lit(r) for r in LINE_ROLES])
    return F.transform(lines(text), lambda t, i: F.struct(
        t.alias("content"), F.get(roles, i % len(LINE_ROLES)).alias("role")))


SQL_LINE_ROLE = "(['user','assistant','user','system','user'])[(pos - 1) % 5 + 1]"


def document_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their cleaned line messages as one nested column."""
    from evalspark.operators.dialogue import clean_messages

    return table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "text", clean_messages(line_turns(F.col("text"))).alias("messages"))


#: Cleaned line messages exploded: doc_id, pos (1-based raw line), role, content.
DOC_MESSAGES_SQL = f"""doc_lines AS (
  SELECT doc_id, lang, source, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) AS pos FROM documents),
doc_messages AS (
  SELECT doc_id, lang, source, pos, {SQL_LINE_ROLE} AS role, {sql_strip('line')} AS content FROM doc_lines
  WHERE length({sql_strip('line')}) > 0)"""
