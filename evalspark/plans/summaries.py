"""Two-level text rollup: one summary per date, then one over all dates of a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.plans.modelcalls import ModelFactory, call_model, last_attempt
from evalspark.session import cut_lineage


def pairs_text(pairs: Column, user: str = "User", assistant: str = "AI") -> Column:
    """The transcript of one record's ``array<struct(query, response)>``."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(
        F.lit(f"{user}: "), p["query"], F.lit(f"\n{assistant}: "), p["response"])), "\n")


def summarize(records: DataFrame, keys: list[str], system: str, text: Column, factory: ModelFactory,
              stage: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One model call per record: ``(keys, summary)``, the call log, and ``(keys, stage, error)`` of failed records."""
    asked = records.select(*keys, F.to_json(F.struct(*keys)).alias("call_key"), F.lit(system).alias("system"), text.alias("user"))
    log = cut_lineage(call_model(asked, factory, stage, **options))
    outcome = last_attempt(log).select("call_key", "stage", "success", F.col("text").alias("summary"), "error")
    named = asked.select("call_key", *keys).join(outcome, "call_key")
    return named.where("success").select(*keys, "summary"), log, named.where("NOT success").select(*keys, "stage", "error")


def daily_and_overall(records: DataFrame, system: str, factory: ModelFactory,
                      **options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Daily summaries, then one overall summary per complete sample: ``(daily, overall, calls, failures)``.

    ``records(sample_id, date, pairs)`` holds one row per sample and date. Only the short
    daily summaries are regrouped, one per date, never the dialogue itself. A sample with a
    failed day gets no overall summary but a row in ``failures(sample_id, stage, error)``.
    """
    daily, first, failed = summarize(records, ["sample_id", "date"], system, pairs_text(F.col("pairs")), factory, "daily_summary", **options)
    incomplete = failed.select("sample_id").distinct()
    dated = (daily.join(incomplete, "sample_id", "left_anti").groupBy("sample_id")
             .agg(F.array_sort(F.collect_list(F.struct("date", "summary"))).alias("days")))
    text = F.array_join(F.transform("days", lambda d: F.concat(d["date"], F.lit(": "), d["summary"])), "\n")
    overall, second, lost = summarize(dated, ["sample_id"], system, text, factory, "overall_summary", **options)
    held = incomplete.select("sample_id", F.lit("overall_summary").alias("stage"), F.lit("daily summaries are missing").alias("error"))
    failures = failed.drop("date").unionByName(lost).unionByName(held)
    return daily, overall, first.unionByName(second), failures
