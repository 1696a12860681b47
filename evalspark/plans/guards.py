"""Input guards: what must hold before an arm makes its first paid call.

The rules run over the whole input as joins and counts. Every broken rule is a finding
``(check, sample_id, detail)``; with a single finding the arm makes no call and returns the findings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

FINDINGS = "check string, sample_id string, detail string"


@dataclass(frozen=True)
class Guard:
    """What a run declares: its arm, the digests of its prompts by name, and its config's fingerprint.

    A null leaves the rule out; ids are always checked.
    """

    arm: str | None = None
    prompt_hashes: dict[str, str] = field(default_factory=dict)
    fingerprint: str | None = None

    def findings(self, rows: DataFrame, done: DataFrame) -> DataFrame:
        """Broken rules of the rows to run and of the records that the run would continue.

        ``rows`` carries ``arm`` where an arm is declared; ``done`` carries ``prompt_hashes`` (a map) and
        ``run_fingerprint`` where they are. A record without them is no proof that it fits, so it counts as drift.
        """
        found = _repeated(rows, "duplicate_ids").unionByName(_repeated(done, "duplicate_records"))
        if self.arm is not None:
            found = found.unionByName(_broken(rows, "wrong_arm", ~F.col("arm").eqNullSafe(F.lit(self.arm)), F.concat(F.lit("arm "), _shown(F.col("arm")))))
        for name, digest in sorted(self.prompt_hashes.items()):
            kept = F.col("prompt_hashes")[name]
            found = found.unionByName(_broken(done, "prompt_drift", ~kept.eqNullSafe(F.lit(digest)), F.concat(F.lit(f"{name} "), _shown(kept))))
        if self.fingerprint is not None:
            kept = F.col("run_fingerprint")
            found = found.unionByName(_broken(done, "config_drift", ~kept.eqNullSafe(F.lit(self.fingerprint)), _shown(kept)))
        return found


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("none"))


def _broken(rows: DataFrame, check: str, bad: Column, detail: Column) -> DataFrame:
    return rows.where(bad).select(F.lit(check).alias("check"), F.col("sample_id").cast("string").alias("sample_id"), detail.alias("detail"))


def _repeated(rows: DataFrame, check: str) -> DataFrame:
    counts = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    return _broken(counts, check, (F.col("_n") > 1) | F.col("sample_id").isNull(), F.concat(F.col("_n").cast("string"), F.lit(" rows")))


def gate(findings: DataFrame, passed: Callable[[], object], refused: Callable[[], object]) -> object:
    """``passed()`` when there is no finding, else ``refused()``."""
    return passed() if findings.isEmpty() else refused()
