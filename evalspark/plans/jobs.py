"""Jobs a user runs: compositions of the operators over tables of one experiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions.stats import share
from evalspark.operators import checks as C, metrics as M, selection as S
from evalspark.registry import COVERAGE_GATE
from evalspark.session import cut_lineage


def merge_parts(parts: DataFrame, expected: DataFrame, keys: list[str], priority: list[str]) -> tuple[DataFrame, DataFrame]:
    """Newest row per sample, and a one-row-per-cell gate: rows, expected, missing, duplicates.

    ``parts`` and ``expected`` carry the cell columns ``keys`` and ``sample_id``.
    """
    merged = S.newest_part(parts, [*keys, "sample_id"], priority)
    counted = merged.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("copies") - 1).alias("duplicate_records"))
    wanted = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"))
    gate = wanted.join(counted, keys, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return merged, gate.withColumns({"missing": F.col("expected") - F.col("rows"), "complete": F.col("expected") == F.col("rows"),
                                     "duplicate_records": F.coalesce("duplicate_records", F.lit(0))})


def repair_manifest(overlaid: DataFrame, keys: list[str], memories: str = "retrieved_memories") -> DataFrame:
    """Repair counts per cell and in total (keys NULL) from the result of an overlay."""
    empty_now = F.size(memories) == 0
    return overlaid.rollup(*keys).agg(
        F.count_if("was_empty").alias("empty_primary"), F.count_if("replaced").alias("repaired"),
        F.count_if(F.col("replaced") & empty_now).alias("still_empty"),
        F.count_if(~F.col("was_empty")).alias("preserved"),
        F.count_if(~F.col("was_empty") & F.col("changed")).alias("wrongly_changed"))


def external_summary(dimensions: DataFrame, rates: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Flat report rows with each cell's reportability.

    ``counts`` holds ``source_n, retrieved_n, judged_n`` per cell. A rate cell is gated
    by the coverage of its largest K, a dimension cell by its judge coverage.
    """
    final = rates.groupBy(*keys).agg(F.max_by("coverage", "k").alias("final_coverage"))
    cells = counts.join(final, keys, "left")
    gate = F.coalesce("final_coverage", share(F.col("judged_n"), F.col("retrieved_n")))
    cells = cells.select(*keys, "source_n", "retrieved_n", "judged_n",
                         M.reportability(F.col("source_n"), F.col("retrieved_n"), F.col("judged_n"), gate).alias("r"))
    flat = M.flatten_metrics(dimensions, rates)
    return flat.join(cells.select(*keys, "source_n", "retrieved_n", "judged_n", "r.reportable", "r.status"), keys, "left")


def native_report(selected: DataFrame, judged: DataFrame, methods: list[str], staged: str) -> DataFrame:
    """Comparison report: method and task rates, macro rates, paired outcomes, as long rows."""
    grid = M.method_table(selected, judged, methods)
    rates = grid.select("method", "task", F.lit("pass_rate").alias("measure"), F.col("pass_rate").alias("value"))
    macro = M.pass_macro(grid, "pass_rate", F.col("complete"), ["method"]).select(
        "method", F.lit(None).cast("string").alias("task"), F.lit("macro_task_pass").alias("measure"), F.col("macro_task_pass").alias("value"))
    chosen = judged.join(selected.select("sample_id"), "sample_id", "left_semi")
    report = rates.unionByName(macro)
    for other in methods:
        if other == staged:
            continue
        pair = M.paired_outcomes(chosen.where(F.col("method") == staged), chosen.where(F.col("method") == other))
        names = ["paired_n", "wins", "losses", "ties", "net_wins"]
        rows = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names])
        report = report.unionByName(pair.select(F.lit(f"{staged}_vs_{other}").alias("method"), F.lit(None).cast("string").alias("task"), F.inline(rows)))
    return report


def validation_report(found: list[DataFrame], limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """All findings' counts per group, and the capped detail rows. A fail count over 0 fails the run.

    The findings are written once; both reports read that table instead of checking twice.
    """
    everything = cut_lineage(reduce(lambda a, b: a.unionByName(b), found))
    return C.finding_counts(everything), C.capped_findings(everything, limit)


def judged_coverage(outputs: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """Judged over generated rows per cell with the publication gate."""
    joined = M.coverage(outputs, judged, keys)
    ratio = share(F.col("done"), F.col("expected"))
    return joined.withColumns({"coverage": ratio, "reportable": ratio >= COVERAGE_GATE})


def refuse_mixed_tasks(rows: DataFrame, external: Column) -> DataFrame:
    """Task names that may not enter a native stage, once each; an empty frame lets it run."""
    return rows.where(external).select("task").distinct()
