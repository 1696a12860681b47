"""Chat formatting with loss masks aligned by character offsets.

A whole conversation is rendered once, encoded once with offsets, and the tokens under the
loss are found by binary search of the sorted turn spans among the sorted token spans.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` per turn. The three marks are added
to the tokenizer, so a mark is always one token and never shares a token with a text. Inside
roles and texts every ``<|`` gets a backslash (``<|`` with n backslashes between gets n + 1),
so no text can spell a mark and the step is undone exactly.

Conversations are ordered streams: rows are dealt by ``conv_id`` and sorted inside the
partition, and a worker holds one block of turns (``BLOCK_CHARS``), never a whole
partition. A longer conversation comes out as several blocks; marks are hard borders of
the tokenizer, so the tokens are those of one encoding. One conversation's digest is a
chain over its turns, so one conversation is read by one task, as a stream.

Cases: a null text or role is empty; a null turn sorts first; equal turns keep every row,
ordered by role and text; a null ``conv_id`` is a conversation of its own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Characters of rendered text per block.
BLOCK_CHARS = 1 << 20

_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
BLOCK_SCHEMA = ("conv_id {kind}, block int, formatted string, n_turns int, ids array<int>, loss_mask array<byte>, "
                "loss_starts array<int>, loss_ends array<int>")


def escape(text: str) -> str:
    return _OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text, as roles and texts."""
    turns = []
    for turn in formatted.split(START)[1:]:
        role, text = turn[:-len(END)].split(SEP, 1)
        turns.append((unescape(role), unescape(text)))
    return turns


_tokenizers: dict = {}


def tokenizer(path: str):
    """The vocabulary with the three marks as special tokens and untrimmed offsets."""
    if path not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        made.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (START, SEP, END)])
        _tokenizers[path] = made
    return _tokenizers[path]


def masked_spans(span_starts: np.ndarray, span_ends: np.ndarray, token_starts: np.ndarray,
                 token_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token mask of sorted spans, and the characters that each span's tokens cover."""
    first = np.searchsorted(token_starts, span_starts, "left")
    last = np.searchsorted(token_starts, span_ends, "left")
    change = np.zeros(len(token_starts) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    mask = np.cumsum(change[:-1]) > 0
    full = first < last
    return mask, token_starts[first[full]], np.maximum.accumulate(token_ends)[last[full] - 1] if full.any() else token_ends[:0]


def _render(path: str, loss_role: str, conv_id, block: int, turns: list[tuple[str, str]]) -> tuple:
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == loss_role:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    formatted = "".join(parts)
    coded = tokenizer(path).encode(formatted, add_special_tokens=False)
    offsets = np.array(coded.offsets, np.int64).reshape(-1, 2)
    mask, covered_from, covered_to = masked_spans(np.array(starts, np.int64), np.array(ends, np.int64), offsets[:, 0], offsets[:, 1])
    return conv_id, block, formatted, len(turns), coded.ids, mask.astype(np.int8), covered_from, covered_to


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    types = [kind, pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["conv_id", "block", "formatted", "n_turns", "ids", "loss_mask", "loss_starts", "loss_ends"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _blocks(path: str, loss_role: str, block_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, block, turns, size, out, out_chars = None, 0, [], 0, [], 0
    kind = pa.int64()
    for batch in batches:
        kind = batch.column(0).type
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if turns and (conv_id != current or size >= block_chars):
                out.append(_render(path, loss_role, current, block, turns))
                out_chars += size
                block = block + 1 if conv_id == current else 0
                turns, size = [], 0
                if out_chars >= block_chars:
                    yield _batch(out, kind)
                    out, out_chars = [], 0
            current = conv_id
            turns.append((role or "", text or ""))
            size += len(text or "") + 32
    if turns:
        out.append(_render(path, loss_role, current, block, turns))
    if out:
        yield _batch(out, kind)


def format_conversations(df: DataFrame, path: str, loss_role: str = "assistant", order: list[str | Column] | None = None,
                         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rendered text, token ids and loss mask per conversation block, blocks of one conversation in order.

    ``loss_starts`` and ``loss_ends`` are the characters of ``formatted`` under the mask, read
    back from the masked tokens.
    """
    kind = df.schema["conv_id"].dataType.simpleString()
    ordered = (df.repartition(F.col("conv_id"))
               .sortWithinPartitions("conv_id", *(order or ["turn", "role", "text"])).select("conv_id", "role", "text"))
    return ordered.mapInArrow(lambda batches: _blocks(path, loss_role, block_chars, batches), BLOCK_SCHEMA.format(kind=kind))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, rows = None, []
    kind = pa.int64()

    def close() -> None:
        conv_id, n_turns, turns_hash, loss_chars, loss_hash, chars = state
        rows.append((conv_id, n_turns, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars))

    def made() -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        kind = batch.column(0).type
        fields = ("conv_id", "block", "formatted", "loss_starts", "loss_ends")
        for conv_id, block, formatted, starts, ends in zip(*(batch.column(c).to_pylist() for c in fields)):
            if block == 0:
                if state:
                    close()
                state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for a, b in zip(starts, ends):
                text = unescape(formatted[a:b])
                state[3] += len(text)
                state[4].update(text.encode("utf-8", "surrogatepass"))
            state[5] += len(formatted)
        if rows:
            yield made()
            rows = []
    if state:
        close()
        yield made()


def conversation_digests(blocks: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rendered blocks in their order."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    return blocks.mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                       "loss_sha256 string, formatted_chars long")
