"""Token files: ids of documents in key order, Re-Pair compressed per shard.

Documents are dealt in ranges of their key and sorted, so that (part, seq) is the global
order. A worker encodes its documents and closes a shard after ``SHARD_TOKENS`` ids. A
shard is a grammar: pairs that occur often are replaced by nonterminals, again and again,
with thresholds that fall by a fixed factor, at each of them until no pair reaches it;
rules only name earlier symbols. The file stores rules, expansion lengths (through which any
place is found without decoding what is before it), the symbol string and the documents'
lengths.

Files are rows of a Parquet table (one shard per row, ``payload`` in the layout below), so
Spark's own committer handles lost executors and any store that Spark reaches can hold
them. Where each document starts follows from sums over shards; no payload is moved.

Payload, little endian: ``RPG1``, u32 vocabulary size, u32 documents, u32 rules, u32
symbols, u8 bytes per symbol (2 or 4), then document lengths u32, rule pairs u32, rule
expansion lengths u32, symbols.

Cases: a null text has no ids but its end id; repeated keys keep every row, ordered by a
hash of the text; null keys come first; an empty table gives no shards; other columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from evalspark.llm import arrays as A
from evalspark.operators.ordered import with_running_sum

END_ID = 1
#: Ids after which a shard is closed, at the end of a document.
SHARD_TOKENS = 1 << 19
#: A pair is replaced while it occurs at least this often in a shard.
MIN_COUNT = 24
#: Factor between the thresholds of two rounds.
FALL = 8
#: Buckets of the cheap upper bound of pair counts.
_BUCKETS = 1 << 18
#: Words a worker remembers; bounds memory, not the input.
RECENT_WORDS = 600_000

_MAGIC = b"RPG1"
_ADDED_OPENING = "<|"
#: Words that are encoded alone: with a digit, or near an added token.
_APART = re.compile(r"[0-9]|<\|")
#: Bytes of text encoded at once.
STRETCH = 6 << 20


# --- encoding --------------------------------------------------------------------------


class WordEncoder:
    """Ids by the tokenizers library, each distinct word of a stretch of text encoded once.

    The vocabulary's split always cuts at ASCII white space, and between an ASCII letter and
    an ASCII mark, so a text's ids are those of its words in turn.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self.size = self._tokenizer.get_vocab_size()
        #: A digit is a word of one id; it parts the words of one call.
        self._parting = self._plain(["0"])[0]
        suffix = json.loads(self._tokenizer.to_str())["model"].get("end_of_word_suffix")
        #: Whether an id ends a run of letters.
        self._ends = np.zeros(self.size + 1, bool)
        self._ends[[i for token, i in self._tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self._known: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, np.uint32) for found in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        known = self._known
        if len(known) + len(words) > RECENT_WORDS:
            newest = list(islice(known.items(), len(known) // 2, None))
            known.clear()
            known.update(newest)
        alone = [w for w in words if len(self._parting) != 1 or _APART.search(w)]
        known.update(zip(alone, (ids.tobytes() for ids in self._plain(alone))))
        # words of letters end with their only id of that kind, so nothing need part them
        letters = [w for w in words if w.isalpha() and w.lower().isalpha()]
        groups = [letters[i:i + 200] for i in range(0, len(letters), 200)]
        for group, ids in zip(groups, self._plain([" ".join(g) for g in groups])):
            ends = (np.flatnonzero(self._ends[ids]) + 1).tolist()
            if len(ends) == len(group):
                raw, start = ids.tobytes(), 0
                for word, end in zip(group, ends):
                    known[word] = raw[4 * start:4 * end]
                    start = end
        together = [w for w in words if w not in known]
        groups = [together[i:i + 200] for i in range(0, len(together), 200)]
        for group, ids in zip(groups, self._plain([" 0 ".join(g) for g in groups])):
            ends = np.append(np.flatnonzero(ids == self._parting[0]), len(ids)).tolist()
            raw, start = ids.tobytes(), 0
            for word, end in zip(group, ends):
                known[word] = raw[4 * start:4 * end]
                start = end + 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, end to end, and the number of ids per row."""
        if not pc.any(pc.match_substring(texts, _ADDED_OPENING)).as_py():  # an added token is one word
            texts = pc.replace_substring_regex(texts, r"([A-Za-z])([!-/:-@\[-`{-~])", r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self._known
        new = [w for w in distinct if w not in known]
        if new:
            self._learn(new)
            if any(w not in known for w in distinct):  # dropped with the oldest
                known.clear()
                self._learn(distinct)
        parts = list(map(known.__getitem__, distinct))
        flat = np.frombuffer(b"".join(parts), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        which = words.indices.to_numpy()
        per_word = sizes[which]
        borders = np.concatenate([[0], np.cumsum(per_word)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return take_runs(flat, (np.cumsum(sizes) - sizes)[which], per_word), np.diff(borders)


def take_runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start + size]``, end to end."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


# --- grammar -----------------------------------------------------------------------------


def _frequent_pairs(symbols: np.ndarray, spots: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs found at least ``least`` times at ``spots``, sorted; the places where they stand, and which stands there."""
    keys = symbols[spots].astype(np.uint64) << np.uint64(32) | symbols[spots + 1]
    buckets = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int32)
    near = np.flatnonzero(np.bincount(buckets, minlength=_BUCKETS)[buckets] >= least)
    if len(near) < least:
        return keys[:0], near[:0], near[:0]
    keys = keys[near]
    by = np.argsort(keys)
    ordered = keys[by]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.flatnonzero(fresh)
    frequent = np.diff(starts, append=len(keys)) >= least
    which = np.cumsum(fresh) - 1
    standing = frequent[which]
    number = np.full(len(keys), -1, np.int64)
    number[by[standing]] = (np.cumsum(frequent) - 1)[which[standing]]
    places = np.flatnonzero(number >= 0)
    return ordered[starts[frequent]], spots[near[places]], number[places]


def compress(ids: np.ndarray, vocabulary: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(symbols, rules, expansion lengths)``; nonterminal k is ``vocabulary + k``."""
    symbols = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    made, least = 0, max(min_count, len(ids) // 64)
    while True:
        spots = np.arange(max(len(symbols) - 1, 0))
        while len(spots):
            chosen, places, which = _frequent_pairs(symbols, spots, least)
            if not len(chosen):
                break
            # in a run of overlapping pairs every second one is taken
            order = np.arange(len(places))
            new_run = np.ones(len(places), bool)
            new_run[1:] = np.diff(places) > 1
            taken = (order - np.maximum.accumulate(np.where(new_run, order, 0))) % 2 == 0
            # half of all places are taken, so some pair keeps half of its own; pairs that keep fewer wait
            used = 2 * np.bincount(which[taken], minlength=len(chosen)) >= least
            taken &= used[which]
            at, chosen = places[taken], chosen[used]
            symbols[at] = vocabulary + made + (np.cumsum(used) - 1)[which[taken]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            # other pairs only get rarer: what can still be frequent holds a new symbol or was not taken
            again = np.zeros(len(symbols), bool)
            again[places] = True
            again[np.maximum(at - 1, 0)] = True
            symbols = symbols[keep]
            spots = np.flatnonzero(again[keep][:-1])
            rules.append(np.stack([(chosen >> np.uint64(32)), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
            made += len(chosen)
        if least == min_count:
            break
        least = max(min_count, least // FALL)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    lengths = np.ones(vocabulary + made, np.uint32)
    done = vocabulary
    for block in rules:
        lengths[done:done + len(block)] = lengths[block[:, 0]] + lengths[block[:, 1]]
        done += len(block)
    return symbols, table, lengths[vocabulary:]


def expand(symbols: np.ndarray, rules: np.ndarray, rule_lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids of a symbol string; every pass opens one level of rules, and only what is not yet an id."""
    lengths = np.ones(len(symbols), np.int64)
    inner = symbols >= vocabulary
    lengths[inner] = rule_lengths[symbols[inner] - vocabulary]
    ends = np.cumsum(lengths)
    places = ends - lengths
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    while len(symbols):
        inner = symbols >= vocabulary
        out[places[~inner]] = symbols[~inner]
        places, pairs = places[inner], rules[symbols[inner] - vocabulary]
        first = pairs[:, 0]
        nested = first >= vocabulary
        sizes = np.ones(len(first), np.int64)
        sizes[nested] = rule_lengths[first[nested] - vocabulary]
        symbols, places = pairs.ravel(), np.stack([places, places + sizes], 1).ravel()
    return out


def pack(ids: np.ndarray, document_lengths: np.ndarray, vocabulary: int, min_count: int = MIN_COUNT) -> bytes:
    symbols, rules, lengths = compress(ids, vocabulary, min_count)
    width = 2 if vocabulary + len(rules) <= 1 << 16 else 4
    head = np.array([vocabulary, len(document_lengths), len(rules), len(symbols)], "<u4").tobytes()
    return b"".join([_MAGIC, head, bytes([width]), document_lengths.astype("<u4").tobytes(), rules.astype("<u4").tobytes(),
                     lengths.astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes()])


class Shard:
    """A packed shard, opened for whole or random access."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != _MAGIC:
            raise ValueError("not a token shard")
        self.vocabulary, docs, rules, symbols = (int(x) for x in np.frombuffer(payload, "<u4", 4, 4))
        width, at = payload[20], 21
        self.document_lengths = np.frombuffer(payload, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        self.rules = np.frombuffer(payload, "<u4", 2 * rules, at).reshape(-1, 2)
        at += 8 * rules
        self.rule_lengths = np.frombuffer(payload, "<u4", rules, at)
        at += 4 * rules
        self.symbols = np.frombuffer(payload, f"<u{width}", symbols, at).astype(np.uint32)
        self.ends = np.cumsum(self.document_lengths)
        self._symbol_ends: np.ndarray | None = None

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.rule_lengths, self.vocabulary)

    def read(self, start: int, size: int) -> np.ndarray:
        """Ids ``start`` to ``start + size``, opening only the symbols that cover them."""
        if size <= 0:
            return np.zeros(0, np.uint32)
        if self._symbol_ends is None:
            lengths = np.concatenate([np.ones(self.vocabulary, np.int64), self.rule_lengths])
            self._symbol_ends = np.cumsum(lengths[self.symbols])
        first = int(np.searchsorted(self._symbol_ends, start, "right"))
        last = int(np.searchsorted(self._symbol_ends, start + size, "left")) + 1
        before = int(self._symbol_ends[first - 1]) if first else 0
        return expand(self.symbols[first:last], self.rules, self.rule_lengths, self.vocabulary)[start - before:start - before + size]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.ends[k] - self.document_lengths[k]), int(self.document_lengths[k]))


# --- files -------------------------------------------------------------------------------

_encoders: dict[str, WordEncoder] = {}


def _shards(path: str, end_id: int, shard_tokens: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    encoder = _encoders[path]
    part, seq = TaskContext.get().partitionId(), 0
    keys: list[pa.Array] = []
    streams: list[np.ndarray] = []
    sizes: list[np.ndarray] = []

    def close() -> pa.RecordBatch:
        nonlocal seq, keys, streams, sizes
        ids, lengths = np.concatenate(streams), np.concatenate(sizes)
        names = pa.concat_arrays(keys)
        row = pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()),
             pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
             pa.array([pack(ids, lengths, encoder.size)], pa.binary())], ["part", "seq", "n_tokens", "keys", "payload"])
        seq += 1
        keys, streams, sizes = [], [], []
        return row

    held = 0
    for batch in batches:
        texts = batch.column(1).fill_null("")
        for first, last in A.stretches(texts, STRETCH):
            ids, counts = encoder.encode(texts.slice(first, last - first))
            lengths = counts + 1
            ends = np.cumsum(lengths)
            stream = np.full(len(ids) + len(counts), end_id, np.uint32)
            inner = np.ones(len(stream), bool)
            inner[ends - 1] = False
            stream[inner] = ids
            at, done = 0, 0
            while at < len(lengths):
                upto = min(len(lengths), max(at + 1, int(np.searchsorted(ends, done + shard_tokens - held, "left")) + 1))
                keys.append(batch.column(0).slice(first + at, upto - at))
                streams.append(stream[done:ends[upto - 1]])
                sizes.append(lengths[at:upto])
                held += int(ends[upto - 1]) - done
                at, done = upto, int(ends[upto - 1])
                if held >= shard_tokens:
                    yield close()
                    held = 0
    if keys:
        yield close()


def write_token_files(df: DataFrame, path: str, folder: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
                      key: str = "doc_id", text: str = "text") -> None:
    """Encode all documents and write their shards, in ascending key order, below ``folder``."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    tie = F.xxhash64("text")  # splits a key that many rows share
    ordered = rows.repartitionByRange("key", tie).sortWithinPartitions("key", tie)
    (ordered.mapInArrow(lambda b: _shards(path, end_id, shard_tokens, b),
                        f"part int, seq int, n_tokens long, keys array<{kind}>, payload binary").write.parquet(folder))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            shard = Shard(batch.column("payload")[r].as_py())
            ids = shard.ids().astype("<u4")
            keys = batch.column("keys")[r].values
            starts = shard.ends - shard.document_lengths
            checks = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), shard.ends.tolist())]
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch.column("part")[r].as_py(), np.int32)), pa.array(np.full(n, batch.column("seq")[r].as_py(), np.int32)),
                 keys, pa.array(starts), pa.array(shard.document_lengths), pa.array(checks, pa.int64())],
                ["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files: where it starts among all ids, its ids' number and checksum."""
    files = spark.read.parquet(folder)
    kind = files.schema["keys"].dataType.elementType.simpleString()
    docs = (files.select("part", "seq", "keys", "payload").mapInArrow(
        _documents, f"part int, seq int, doc_id {kind}, start long, n_tokens long, ids_crc32 long"))
    places = with_running_sum(files.select("part", "seq", F.col("n_tokens").alias("_n")), [], ["seq"], F.col("part").cast("bigint"),
                              F.col("_n"), "_upto").select("part", "seq", (F.col("_upto") - F.col("_n")).alias("_before"))
    return (docs.join(places, ["part", "seq"])
            .select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32"))
