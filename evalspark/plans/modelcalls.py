"""Model-call passes: a user's function applied to prompt rows, partition by partition.

A factory runs once per thread of a task (one client each). A failed call never
fails a task: it becomes an ``error`` column. Every finished key goes to the pass's journal
before its rows are handed on, so an attempt that follows a lost one calls only for the keys that
are left. The pass output is written before it is read twice, because calling a model again would
give other rows and cost money.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from evalspark.functions.replies import TRANSIENT_MARKERS
from evalspark.plans.journal import Journal
from evalspark.session import cut_lineage, ensure_checkpoint_dir

#: Rows a task gathers before it hands them on.
FLUSH = 256
#: Prompts of a task.
TASK_ROWS = 2_000
#: ``factory()`` returns ``call(system, user, stage) -> str | dict``. A dict may hold ``text``
#: and the token counts of ``USAGE``.
ModelFactory = Callable[[], Callable[[str, str, str], "str | dict"]]
USAGE = ["input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "reasoning_tokens"]
CALL_SCHEMA = (
    "call_key string, stage string, attempt int, success boolean, text string, request_started_at timestamp, "
    "response_received_at timestamp, latency_ms double, retry_sleep_ms double, "
    + ", ".join(f"{name} bigint" for name in USAGE) + ", usage_available boolean, error_type string, error string")


def backoff_seconds(attempt: int, error: str, max_wait: float = 120.0) -> float:
    """Exponential wait that honours a ``retry_after`` hint in the error text."""
    wait = min(max_wait, 2.0 ** min(attempt, 6))
    hint = re.search(r"['\"]retry_after['\"]\s*:\s*(\d+)", error)
    return min(max_wait, max(wait, float(hint.group(1)))) if hint else wait


def worth_retrying(error: Exception) -> bool:
    """An empty reply, or a transient failure by its status or its message."""
    status = getattr(error, "status_code", None)
    if isinstance(error, EmptyReply) or status == 429 or (isinstance(status, int) and 500 <= status <= 599):
        return True
    return any(marker in str(error).lower() for marker in TRANSIENT_MARKERS)


class EmptyReply(ValueError):
    """The model answered with nothing but white space."""


def _readable(error: Exception, secrets: Iterable[str], limit: int = 2000) -> str:
    text = str(error)
    for secret in secrets:
        if len(secret) > 8:
            text = text.replace(secret, "[REDACTED]")
    return text[:limit]


def call_model(prompts: DataFrame, factory: ModelFactory, stage: str, attempts: int = 5,
               wait_seconds: Callable[[int, str], float] = backoff_seconds, partitions: int | None = None,
               concurrency: int = 8, secrets: Iterable[str] = (),
               retry: Callable[[Exception], bool] = worth_retrying, journal: str | None = None) -> DataFrame:
    """Call the model for ``prompts(call_key, system, user)``; one row per attempt.

    An empty reply counts as a failure, and only failures that ``retry`` accepts are tried
    again. The last attempt of a key tells whether it succeeded. Rows are spread by key over
    ``partitions`` tasks (by default one for ``TASK_ROWS`` prompts, and as many as there are cores
    when there are fewer), and each task keeps up to ``concurrency`` calls open, each thread with a
    client of its own. A task holds only the open calls and a batch of ``FLUSH`` rows, and
    hands rows on as they come. ``secrets`` are struck out of error texts.

    ``journal`` names a folder that all tasks share; by default the pass has one of its own below
    the checkpoint folder. Naming the folder of a pass that failed continues it: finished keys give
    their rows again without a call.
    """
    session = prompts.sparkSession
    if partitions is None:
        rows = prompts.select("call_key").count()
        if rows == 0:  # nothing to ask, so nothing is rendered or moved
            return session.range(0).select(F.from_json(F.lit("{}"), CALL_SCHEMA).alias("_r")).select("_r.*")
        partitions = max(1, -(-rows // TASK_ROWS), min(rows, session.sparkContext.defaultParallelism))
    record = Journal(journal or f"{ensure_checkpoint_dir(session)}/calls/{uuid.uuid4().hex}")
    prompts = prompts.select("call_key", "system", "user").repartition(record.tasks(partitions), "call_key")
    hidden = tuple(secrets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = threading.local()
        task = TaskContext.get().partitionId()
        paid, writer = record.finished(task), record.writer(task)

        def ask(key: str, system: str, user: str) -> list[dict]:
            if not hasattr(local, "call"):
                local.call = factory()
            rows = []
            for attempt in range(1, attempts + 1):
                started, clock, again = datetime.now(timezone.utc), time.perf_counter(), False
                row = {"call_key": key, "stage": stage, "attempt": attempt, "retry_sleep_ms": 0.0,
                       "usage_available": False, **dict.fromkeys(USAGE)}
                try:
                    reply = local.call(system, user, stage)
                    reply = reply if isinstance(reply, dict) else {"text": reply}
                    text = str(reply.get("text") or "").strip()
                    if not text:
                        raise EmptyReply("empty response")
                    row.update(success=True, text=text, error_type=None, error=None)
                    row.update({u: reply.get(u) for u in USAGE})
                    row["usage_available"] = any(reply.get(u) is not None for u in USAGE[:3])
                except Exception as exc:  # noqa: BLE001 - the error is data
                    again = attempt < attempts and retry(exc)
                    kind = "ValueError" if isinstance(exc, EmptyReply) else type(exc).__name__
                    row.update(success=False, text=None, error_type=kind, error=_readable(exc, hidden))
                row.update(request_started_at=started, response_received_at=datetime.now(timezone.utc),
                           latency_ms=round((time.perf_counter() - clock) * 1000, 3))
                rows.append(row)
                if not again:
                    writer.record(rows)
                    return rows
                pause = wait_seconds(attempt, row["error"])
                row["retry_sleep_ms"] = pause * 1000.0
                time.sleep(pause)
            return rows

        def framed(rows: list[dict]) -> pd.DataFrame:
            frame = pd.DataFrame(rows, columns=[f.split()[0] for f in CALL_SCHEMA.split(", ")])
            for name in USAGE:
                frame[name] = frame[name].astype("Int64")
            return frame

        done: list[dict] = []
        try:
            with ThreadPoolExecutor(concurrency) as pool:
                open_calls: deque = deque()
                for batch in batches:
                    for row in zip(batch["call_key"], batch["system"], batch["user"]):
                        if row[0] in paid:
                            done += paid.pop(row[0])
                        else:
                            open_calls.append(pool.submit(ask, *row))
                        while len(open_calls) >= 2 * concurrency:
                            done += open_calls.popleft().result()
                        if len(done) >= FLUSH:
                            yield framed(done)
                            done = []
                while open_calls:
                    done += open_calls.popleft().result()
        finally:
            writer.close()
        if done:
            yield framed(done)

    return prompts.mapInPandas(run, CALL_SCHEMA)


def last_attempt(calls: DataFrame) -> DataFrame:
    """Outcome per key: the highest attempt."""
    rest = [c for c in calls.columns if c not in ("call_key", "stage")]
    return calls.groupBy("call_key", "stage").agg(F.max_by(F.struct(*rest), "attempt").alias("_r")).select(
        "call_key", "stage", "_r.*")


def validated_pass(prompts: DataFrame, factory: ModelFactory, stage: str,
                   check: Callable[[DataFrame], DataFrame], rounds: int = 3, **call_options) -> tuple[DataFrame, DataFrame]:
    """Model pass whose replies must satisfy ``check``; failed keys are asked again.

    ``check`` receives prompts joined with ``text`` and adds ``problem`` (NULL = valid)
    and whatever it parses. Returns ``(accepted, calls)``; keys that fail every round are
    in neither's accepted rows and can be listed with an anti join. Each round handles
    only the rows the round before refused, so the loop has a fixed number of rounds and
    never looks at row contents on the driver. A round writes keys and what it learned of them; the
    prompt rows themselves are joined again where they are read.
    """
    accepted, calls = validated_replies(prompts, factory, stage, check, rounds, **call_options)
    return prompts.drop("system", "user").join(accepted, "call_key"), calls


def validated_replies(prompts: DataFrame, factory: ModelFactory, stage: str,
                      check: Callable[[DataFrame], DataFrame], rounds: int = 3, **call_options) -> tuple[DataFrame, DataFrame]:
    """:func:`validated_pass` whose accepted rows hold the key, ``text``, ``problem`` and what ``check`` parsed only.

    Of the prompts' columns only those that ``check`` reads are moved, so it should read narrow ones.
    """
    todo, accepted, calls = prompts, None, None
    for number in range(1, rounds + 1):
        log = cut_lineage(call_model(todo, factory, stage, **call_options).withColumn("round", F.lit(number)))
        replies = last_attempt(log.drop("round")).where("success").select("call_key", "text")
        checked = check(todo.join(replies, "call_key", "left"))
        judged = cut_lineage(checked.select("call_key", *[c for c in checked.columns if c not in prompts.columns]))
        good = judged.where("text IS NOT NULL AND problem IS NULL")
        accepted = good if accepted is None else accepted.unionByName(good)
        calls = log if calls is None else calls.unionByName(log)
        refused = judged.where("text IS NULL OR problem IS NOT NULL").select("call_key")
        if number < rounds:
            if refused.isEmpty():
                break
            todo = prompts.join(refused, "call_key", "left_semi")
    return accepted, calls


def failure_ledger(prompts: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per key whose last attempt failed: error type and text."""
    failed = last_attempt(calls.drop("round") if "round" in calls.columns else calls).where(~F.col("success"))
    return prompts.select("call_key").join(failed.select("call_key", "stage", "attempt", "error_type", "error"), "call_key")
