"""Digests and fingerprints. Inputs are plain UTF-8 concatenations, never engine internals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def messages_sha256(messages: Column) -> Column:
    """Digest of an ordered array of ``struct(role, content)``."""
    parts = F.transform(messages, lambda m: F.concat(m["role"], F.lit("\x00"), m["content"], F.lit("\x00")))
    return F.sha2(F.array_join(parts, ""), 256)


def nul_separated_sha1(parts: Sequence[Column], length: int = 24) -> Column:
    """First ``length`` hex digits of the SHA-1 of the parts joined by NUL."""
    return F.left(F.sha1(F.concat_ws("\x00", *parts)), F.lit(length))


def sample_user_id(method: Column, sample_key: Column, prior: Column, question: Column) -> Column:
    return F.concat(F.lit("pm_"), nul_separated_sha1([method, sample_key, prior, question]))


def store_digest(settings: Sequence[Column], pairs: Column) -> Column:
    """Key of a memory store: settings, then every ``struct(query, response)`` in order.

    Every part, the last included, is followed by NUL, so no two part lists collide.
    """
    head = F.concat(*[F.concat(F.coalesce(s, F.lit("")), F.lit("\x00")) for s in settings])
    body = F.array_join(
        F.transform(pairs, lambda p: F.concat(p["query"], F.lit("\x00"), p["response"], F.lit("\x00"))), "")
    return F.left(F.sha1(F.concat(head, body)), F.lit(24))


def fingerprint(fields: Sequence[str]) -> Column:
    """SHA-256 over named columns in name order; NULL differs from every text."""
    parts = [
        F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.lit("'"), F.col(name).cast("string"), F.lit("'")), F.lit("null")))
        for name in sorted(fields)
    ]
    return F.sha2(F.concat_ws("\n", *parts), 256)
