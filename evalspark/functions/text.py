"""Text expressions: trimming, normalising, rendering, context blocks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() and \s treat as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: The same set as a Java regex class body.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

NO_MEMORIES = "[NO RETRIEVED MEMORIES]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """NULL or white space only; stops at the first other character."""
    return ~F.coalesce(text.rlike(f"[^{WS}]"), F.lit(False))


def non_blank(text: Column) -> Column:
    """The text, or NULL when it is blank."""
    return F.when(~is_blank(text), text)


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space become one space; case and punctuation stay.

    A lone space, by far the commonest run, is skipped rather than replaced by itself.
    """
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}&&[^ ]][{WS}]*| [{WS}]+", " "))


def truncate(text: Column, limit: int = 160, ellipsis: str = "...") -> Column:
    flat = collapse_whitespace(text)
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - len(ellipsis))), F.lit(ellipsis))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def render(template: Column, values: dict[str, Column]) -> Column:
    """Fill ``{{KEY}}`` placeholders in the given order."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), value)
    return template


def unresolved_placeholders(rendered: Column) -> Column:
    """Names still open after :func:`render`; an empty array means a complete prompt."""
    return F.regexp_extract_all(rendered, F.lit(r"\{\{([A-Z_]+)\}\}"), F.lit(1))


def redact(text: Column, secrets: Iterable[str], limit: int = 2000) -> Column:
    """Replace secret values longer than eight characters, then cap an error message."""
    for secret in secrets:
        if len(secret) > 8:
            text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    return F.substring(text, 1, limit)


def first_difference(left: Column, right: Column) -> Column:
    """0-based position of the first differing character, NULL when equal.

    Binary search over prefix lengths: each step compares two prefixes, so a text of n
    characters costs log2(n) comparisons instead of one array element per character.
    """
    shorter = F.least(F.length(left), F.length(right))
    bounds = F.struct(F.lit(0).alias("lo"), shorter.alias("hi"))

    def halve(state: Column, _step: Column) -> Column:
        mid = F.ceil((state["lo"] + state["hi"]) / 2).cast("int")
        same = F.left(left, mid) == F.left(right, mid)
        return F.when(state["lo"] >= state["hi"], state).otherwise(
            F.when(same, F.struct(mid.alias("lo"), state["hi"].alias("hi")))
            .otherwise(F.struct(state["lo"].alias("lo"), (mid - 1).alias("hi"))))

    steps = F.sequence(F.lit(1), F.lit(32))
    return F.when(left != right, F.aggregate(steps, bounds, halve)["lo"])


def bullet_memories(memories: Column) -> Column:
    """The ``<memories>`` block: one bullet per memory."""
    bullets = F.array_join(F.transform(memories, lambda m: F.concat(F.lit("- "), m)), "\n")
    return F.concat(F.lit("<memories>\n"), bullets, F.lit("\n</memories>"))


def numbered_memories(memories: Column) -> Column:
    """``### Memory i:`` blocks, or the marker for an empty list."""
    blocks = F.transform(
        memories,
        lambda m, i: F.concat(F.lit("### Memory "), (i + 1).cast("string"), F.lit(":\n"), strip(m)),
    )
    return F.when(F.size(memories) > 0, strip(F.array_join(blocks, "\n\n"))).otherwise(NO_MEMORIES)


def identified_memories(memories: Column) -> Column:
    """``Memory <id>: <text>`` blocks from structs with ``memory_id`` and ``content``."""
    return F.array_join(
        F.transform(memories, lambda m: F.concat(F.lit("Memory "), m["memory_id"], F.lit(": "), m["content"])),
        "\n\n",
    )


# Section headings of the dated-memory context, by language.
CONTEXT_HEADINGS = {
    "en": {
        "personality": "The personality of the user and the response strategy of the AI Companion are: ",
        "history": "The summary of your past memories with the user is: ",
        "memories": "Based on the current question, the most relevant [memories] are:",
    },
    "cn": {
        "personality": "用户的性格以及AI伴侣的回复策略为：",
        "history": "你和用户过去的回忆总结是：",
        "memories": "根据当前用户的问题，与问题最相关的[回忆]是：",
    },
}


def dated_context(personality: Column, history: Column, memories: Column, language: str = "en") -> Column:
    """Personality, overall history and dated memories as one context text.

    ``memories`` holds structs with ``date`` and ``content``; absent sections vanish.
    """
    head = CONTEXT_HEADINGS[language]

    def block(m: Column, i: Column) -> Column:
        label = F.concat(
            F.lit("### Memory "), (i + 1).cast("string"),
            F.when(F.coalesce(m["date"], F.lit("")) != "", F.concat(F.lit(" ("), m["date"], F.lit(")")))
            .otherwise(""),
            F.lit(":\n"),
        )
        return F.concat(label, strip(F.coalesce(m["content"], F.lit(""))))

    listed = F.concat(F.lit(head["memories"] + "\n\n"), F.array_join(F.transform(memories, block), "\n\n"))
    sections = F.concat_ws(
        "\n\n",
        F.concat(F.lit(head["personality"]), strip(non_blank(personality))),
        F.concat(F.lit(head["history"]), strip(non_blank(history))),
        F.when(F.size(memories) > 0, listed).otherwise(NO_MEMORIES),
    )
    return strip(sections)
