"""Quality rules as a bitmask ledger, in DataFrame functions only.

``rule_ledger`` evaluates every rule once per document and keeps the measurements and one
long of failure bits. A policy is a version with a mask of the rules it applies; verdicts,
policy comparisons and ablations are bit operations and sums over the ledger, without
reading a text again.

Every measure is computed inside the document's row, so no key can be hot and nothing is
shuffled. Repeated word windows are found by sorting the row's window hashes (two
independent hashes, 96 bits) with their places; only neighbours are compared.

Cases: a null text has no words and fails ``few_words``; equal documents get equal rows;
an empty table gives an empty ledger; other columns are passed through by ``rule_ledger``
unless they carry the name of a measure, which then wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions.binding import bind

BLANK = r"[\x20\x09-\x0D]"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measures; its bit is its place in ``RULES``."""

    name: str
    failed: str


RULES = [
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbol_heavy", "5 * n_symbols > 2 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("long_words", "n_words > 0 AND word_chars > 24 * n_words"),
    Rule("short_words", "n_words >= 10 AND 2 * word_chars < 3 * n_words"),
]
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Policies by version: the bits that reject a document.
POLICIES = {
    1: mask_of("few_words", "repeated_words"),
    2: mask_of("few_words", "repeated_words", "symbol_heavy", "duplicate_lines", "long_words", "short_words"),
}
LATEST = max(POLICIES)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def _repeated_words(words: Column) -> Column:
    """Words inside any window of five words that stands in the text at least twice."""
    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        def key(i: Column) -> Column:
            five = [F.get(w, i + k) for k in range(WINDOW)]
            return F.struct(F.xxhash64(*five).alias("a"), F.hash(*five).alias("b"), i.alias("at"))
        return F.when(F.size(w) >= WINDOW, F.sort_array(F.transform(starts, key)))

    def covered(found: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return (x["a"] == y["a"]) & (x["b"] == y["b"])
        repeated = F.filter(found, lambda x, i: F.coalesce(same(x, F.get(found, i - 1)) , F.lit(False))
                            | F.coalesce(same(x, F.get(found, i + 1)), F.lit(False)))
        places = F.sort_array(F.transform(repeated, lambda x: x["at"]))
        return bind(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0).cast("bigint"), lambda total, x: total + x))

    # bound first: a filter on a measure puts this expression where no projection holds the words
    return bind(words, lambda w: F.coalesce(bind(windows(w), covered), F.lit(0).cast("bigint")))


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of a text column."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    kept = [c for c in df.columns if c not in MEASURES]
    rows = df.select(*kept, words_of(F.col(text)).alias("_words"), lines.alias("_lines"), body.alias("_body"))
    return rows.select(
        *kept,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("_body", BLANK + "+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_body", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        bind(F.col("_lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        _repeated_words(F.col("_words")).alias("n_repeat_words"))


def rule_ledger(df: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The measures and ``failed_bits``: bit i is set where rule i fails."""
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return with_measures(df, text).withColumn("failed_bits", bits)


def apply_policy(ledger: DataFrame, version: int = LATEST, name: str = "kept") -> DataFrame:
    """Add the verdict of a policy version: kept where no bit of its mask is set."""
    return ledger.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(ledger: DataFrame, version: int = LATEST) -> DataFrame:
    """Per rule of a policy: documents failing it, and those that only it rejects.

    One aggregate with a fixed number of sums; ``rescued`` are the documents that the policy
    without the rule would keep.
    """
    mask = POLICIES[version]
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask))
    used = [(i, rule) for i, rule in enumerate(RULES) if mask >> i & 1]
    sums = [F.coalesce(F.sum((bits.bitwiseAND(F.lit(1 << i)) != 0).cast("bigint")), F.lit(0)).alias(f"failed_{i}") for i, _ in used]
    sums += [F.coalesce(F.sum((bits == F.lit(1 << i)).cast("bigint")), F.lit(0)).alias(f"rescued_{i}") for i, _ in used]
    totals = ledger.agg(F.count(F.lit(1)).alias("n_docs"), *sums)
    rows = F.array(*[F.struct(F.lit(version).alias("version"), F.lit(rule.name).alias("rule"), F.col("n_docs"),
                              F.col(f"failed_{i}").alias("failed"), F.col(f"rescued_{i}").alias("rescued")) for i, rule in used])
    return totals.select(F.inline(rows))
