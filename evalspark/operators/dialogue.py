"""Dialogue operators: message clean-up, the text parser, pairing, timestamps, ingest rows.

Nested forms work on one record's own array and need no shuffle. Exploded forms take a
message table (``sample_id, turn, role, content``) and use chunked windows, so one very
long dialogue does not become one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions.binding import bind
from evalspark.functions.text import WS, is_blank, strip
from evalspark.operators.ordered import int_chunk, with_neighbours

# Known roles, the label of each role, the first synthetic timestamp.
ROLES = ("user", "assistant", "system")
EPOCH_BASE = 1_700_000_000
MARKER = rf"(?i)^(user|assistant|system)[{WS}]*:[{WS}]*"


def clean_role(role: Column) -> Column:
    lowered = F.lower(strip(F.coalesce(F.when(role != "", role), F.lit("user"))))
    return F.when(lowered.isin(*ROLES), lowered).otherwise("user")


def clean_messages(turns: Column) -> Column:
    """Trimmed non-empty turns with a known role, as ``array<struct(role, content)>``."""
    kept = F.filter(F.coalesce(turns, F.array().cast("array<struct<content:string,role:string>>")),
                    lambda t: t.isNotNull() & ~is_blank(t["content"]))
    return F.transform(kept, lambda t: F.struct(
        clean_role(t["role"]).alias("role"), strip(t["content"]).alias("content")))


def speaker(role: Column) -> Column:
    return F.when(role == "user", "User").otherwise("Assistant")


def prior_text(messages: Column) -> Column:
    """The whole dialogue as one text, one labelled paragraph per message."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(speaker(m["role"]), F.lit(": "), m["content"])), "\n\n")


def parse_dialogue(text: Column) -> Column:
    """Dialogue text to ``array<struct(role, content)>``.

    A role marker line opens a message, other lines continue it, a line of white space
    closes it; a text without any message is one user message. Lines are joined back
    with blocks separated by empty lines, so one split yields the messages in order.
    """
    def message(block: Column) -> Column:
        role = F.lower(F.regexp_extract(block, MARKER, 1))
        return bind(role, lambda r: F.struct(
            F.when(r != "", r).otherwise("user").alias("role"),
            F.when(r != "", strip(F.regexp_replace(block, MARKER, ""))).otherwise(block).alias("content")))

    def read(whole: Column) -> Column:
        body = F.array_join(F.transform(F.split(whole, "\n+"), strip), "\n")
        opened = F.regexp_replace(body, rf"(?i)(^|\n)(?=(?:user|assistant|system)[{WS}]*:)", "$1\n\n")
        blocks = F.filter(F.split(opened, "\n\n+"), lambda b: F.length(b) > 0)
        messages = F.filter(F.transform(blocks, message), lambda m: F.length(m["content"]) > 0)
        lone = F.array(F.struct(F.lit("user").alias("role"), whole.alias("content")))
        kept = F.filter(lone, lambda m: F.length(m["content"]) > 0)
        return bind(messages, lambda found: F.when(F.size(found) > 0, found).otherwise(kept))

    return bind(strip(F.coalesce(text, F.lit(""))), read)


def round_trip_lossy(role: Column, content: Column) -> Column:
    """Whether writing one message as text and parsing it back changes it.

    Every message starts with a marker line, so messages of a dialogue parse
    independently and a dialogue is lossy exactly when one of its messages is. That turns
    the sample-level audit into a row test plus a combinable OR.
    """
    parsed = parse_dialogue(F.concat(speaker(role), F.lit(": "), content))
    same = (F.size(parsed) == 1) & (F.get(parsed, F.lit(0))["role"] == role) & (
        F.get(parsed, F.lit(0))["content"] == content)
    return ~F.coalesce(same, F.lit(False))


def round_trip_loss(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Samples, mangled samples and rate per ``keys`` from cleaned messages."""
    per_sample = messages.groupBy(*keys, "sample_id").agg(
        F.bool_or(round_trip_lossy(F.col("role"), F.col("content"))).alias("lossy"))
    return per_sample.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("lossy").alias("mangled"),
        F.avg(F.col("lossy").cast("double")).alias("rate"))


def dialogue_pairs(messages: DataFrame, chunk_turns: int = 65536) -> DataFrame:
    """Exploded messages to ``(query, response)`` pairs, keyed by the closing turn.

    Blank turns are dropped. An assistant turn answers the turn before it; any other turn
    stands alone when no assistant turn follows.
    """
    rows = messages.where(~is_blank(F.col("content"))).select(
        "sample_id", "turn", (F.lower("role") == "assistant").alias("is_reply"), strip(F.col("content")).alias("content"))
    linked = with_neighbours(rows, ["sample_id"], ["turn"], int_chunk(F.col("turn"), chunk_turns),
                             ["is_reply", "content", "turn"])
    answers = F.col("is_reply")
    lone = ~F.coalesce(F.col("next.is_reply"), F.lit(False))
    asked = F.when(~F.col("prev.is_reply"), F.col("prev.content"))
    return linked.where(answers | lone).select(
        "sample_id", "turn",
        F.when(answers, F.coalesce(asked, F.lit(""))).otherwise(F.col("content")).alias("query"),
        F.when(answers, F.col("content")).otherwise("").alias("response"),
        F.col("next.turn").alias("next_turn"))


def turn_batches(messages: DataFrame, chunk_turns: int = 65536) -> DataFrame:
    """Pairs with the minute-spaced timestamp of the turn that closed them.

    The index is the assistant turn's own, else the next non-blank turn's, else the
    message count of the sample; it counts blank turns too.
    """
    totals = messages.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_total"))
    pairs = dialogue_pairs(messages, chunk_turns)
    index = F.when(F.col("response") != "", F.col("turn")).otherwise(F.coalesce("next_turn", "_total"))
    return pairs.join(totals, "sample_id").select(
        "sample_id", "turn", "query", "response", index.alias("batch_index"),
        batch_timestamp(index).alias("time_stamp"))


def pair_messages(messages: Column) -> Column:
    """Nested form of :func:`dialogue_pairs` for one record's ``array<struct(role, content)>``."""
    def pair_up(kept: Column) -> Column:
        n = F.size(kept)

        def reply(i: Column) -> Column:
            return F.coalesce(F.lower(F.get(kept, i)["role"]) == "assistant", F.lit(False))

        def pair(i: Column) -> Column:
            own = strip(F.get(kept, i)["content"])
            before = F.when((i > 0) & ~reply(i - 1), strip(F.get(kept, i - 1)["content"]))
            return F.struct(
                F.when(reply(i), F.coalesce(before, F.lit(""))).otherwise(own).alias("query"),
                F.when(reply(i), own).otherwise("").alias("response"))

        indices = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(indices, lambda i: reply(i) | ~reply(i + 1)), pair)

    return bind(F.filter(messages, lambda m: ~is_blank(m["content"])), pair_up)


def turn_timestamp(index: Column) -> Column:
    """Second-spaced synthetic timestamp, ISO text in UTC."""
    return F.date_format(F.timestamp_seconds(F.lit(EPOCH_BASE) + index), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def batch_timestamp(index: Column) -> Column:
    """Minute-spaced synthetic timestamp with the day's name."""
    return F.date_format(F.timestamp_seconds(F.lit(EPOCH_BASE) + index * 60), "yyyy/MM/dd (EEE) HH:mm")


def raw_dialogue_entries(messages: DataFrame) -> DataFrame:
    """One memory entry per non-blank message, text kept verbatim."""
    content = strip(F.col("content"))
    return messages.where(~is_blank(F.col("content"))).select(
        "sample_id", "turn",
        turn_timestamp(F.col("turn")).alias("time_stamp"),
        (F.lit(EPOCH_BASE) + F.col("turn")).cast("double").alias("float_time_stamp"),
        F.lit("Tue").alias("weekday"), F.lit("dialogue").alias("category"),
        F.col("role").alias("subcategory"), F.lit("raw_dialogue").alias("memory_class"),
        F.concat("role", F.lit(": "), content).alias("memory"),
        content.alias("original_memory"), content.alias("compressed_memory"),
        F.col("role").alias("speaker_id"), F.col("role").alias("speaker_name"))


def ingest_rows(messages: DataFrame, mode: Column, label: Column | None = None) -> DataFrame:
    """Document rows by ingest mode: ``messages`` keeps the role, ``raw`` drops it and blanks."""
    raw = mode != "messages"
    tag = F.concat(F.lit("ingest="), mode)
    identity = tag if label is None else F.coalesce(F.when(label != "", label), tag)
    content = F.col("content")
    return messages.where(~raw | ~is_blank(content)).select(
        "sample_id", "turn", mode.alias("ingest_mode"), identity.alias("ingest_identity"),
        F.when(raw, F.lit(None).cast("string")).otherwise(F.col("role")).alias("role"),
        F.when(raw, strip(content)).otherwise(content).alias("content"),
        turn_timestamp(F.col("turn")).alias("time_stamp"))
