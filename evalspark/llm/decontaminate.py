"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

A window is ``window`` consecutive words of an item (or a whole shorter item). A document
holds it only if it holds all its shingles, so one necessary prefix token is enough to
find it: the shingle of the window that is rarest in the documents. The steps:

1. windows and their shingles, one row per distinct window text;
2. a scan counts the benchmark's shingles in the documents (partial counts per piece of
   text). A bitmap of fixed size (``BITMAP_BITS``, 2 MB) lets other shingles go at once; it
   only ever lets too much through;
3. each window keeps its rarest shingle; a window with a shingle of count zero is out;
4. a second scan finds the kept prefix tokens and notes the words around each;
5. candidates join windows on the token; the position bound puts the window's start at
   ``place - offset``, the length bound keeps it inside the document, and the words are
   compared one by one.

Nothing of the documents or the benchmark is broadcast but the bitmap. Candidates are rows,
so a passage in a third of all documents is a large join key that the engine splits; only
one document's own hits are gathered, which its length bounds.

Cases: null texts have no words; an item without words has no window; a repeated item id
counts once; a null item id is the text ``null``; equal documents are separate rows; empty
tables give no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalspark.llm import arrays as A
from evalspark.session import cut_lineage

WINDOW = 10
SHINGLE = 5
BITMAP_BITS = 24

WINDOW_SCHEMA = "item string, window array<string>, hashes array<long>"
CANDIDATE_SCHEMA = "doc_id {kind}, n_words long, found array<struct<place:int,hash:long,around:array<string>,anchor:int>>"


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for first, data, offsets in A.pieces(column):
        starts, ends, rows = A.word_bounds(data, offsets, A.ALPHANUMERIC)
        yield first, len(offsets) - 1, data, starts, ends, rows, A.word_hashes(data, starts, ends, lower=True)


def _text(data: np.ndarray, a: int, b: int) -> str:
    return A.LOWER[data[a:b]].tobytes().decode()


def _windows(window: int, shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column(0).to_pylist()
        for first, n, data, starts, ends, rows, hashes in _words(batch.column(1)):
            out: list[tuple] = []
            borders = np.searchsorted(rows, np.arange(n + 1))
            for r in range(n):
                a, b = int(borders[r]), int(borders[r + 1])
                words = [_text(data, starts[i], ends[i]) for i in range(a, b)]
                size = min(window, b - a)
                k = min(shingle, size)
                grams = A.ngram_hashes(hashes[a:b], k).astype(np.int64) if size else []
                for i in range(b - a - size + 1 if size else 0):
                    out.append((items[first + r], words[i:i + size], grams[i:i + size - k + 1].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.string())),
                 pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["item", "window", "hashes"])


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Every window of every item with its shingle hashes."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return items.mapInArrow(lambda b: _windows(window, shingle, b), WINDOW_SCHEMA)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


#: Every byte with its bits in reverse: words are filled from the low bit on, packed bits are read from the high one.
_REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), axis=1).ravel()


def hash_bitmap(hashes: DataFrame, column: str = "hash") -> np.ndarray:
    """Packed bits of the top of every hash. At most ``2**BITMAP_BITS / 64`` words reach the driver, which never unpacks them."""
    slot = F.shiftrightunsigned(F.col(column), 64 - BITMAP_BITS)
    words = (hashes.groupBy(F.shiftright(slot, 6).alias("at"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow())
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bitmap[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return _REVERSED[bitmap.view(np.uint8)]


def _grams(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of ``k`` words and the places where they start, inside rows only."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    places = np.flatnonzero(rows[:len(rows) - k + 1] == rows[k - 1:])
    return A.ngram_hashes(hashes, k)[places], places


def _counts(packed: np.ndarray, sizes: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bitmap = np.unpackbits(packed).view(bool)
    for batch in batches:
        for _, _, _, _, _, rows, hashes in _words(batch.column(0)):
            for k in sizes:
                grams, _ = _grams(hashes, rows, k)
                values, counts = np.unique(grams[bitmap[_slot(grams)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], ["hash", "n"])


def _candidates(packed: np.ndarray, sizes: list[int], reach: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bitmap = np.unpackbits(packed).view(bool)
    found_type = pa.list_(pa.struct([("place", pa.int32()), ("hash", pa.int64()), ("around", pa.list_(pa.string())), ("anchor", pa.int32())]))
    for batch in batches:
        for first, n, data, starts, ends, rows, hashes in _words(batch.column(1)):
            borders = np.searchsorted(rows, np.arange(n + 1))
            found: list[list] = [[] for _ in range(n)]
            for k in sizes:
                grams, places = _grams(hashes, rows, k)
                hits = np.flatnonzero(bitmap[_slot(grams)])
                for at, value in zip(places[hits].tolist(), grams[hits].astype(np.int64).tolist()):
                    r = int(rows[at])
                    a, b = max(int(borders[r]), at - reach), min(int(borders[r + 1]), at + reach)
                    found[r].append({"place": at - int(borders[r]), "hash": value, "anchor": at - a,
                                     "around": [_text(data, starts[i], ends[i]) for i in range(a, b)]})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), pa.array(np.diff(borders), pa.int64()), pa.array(found, found_type)],
                ["doc_id", "n_words", "found"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document: words, words inside any benchmark window, and the items whose windows occur."""
    windows = cut_lineage(item_windows(benchmark, window, shingle))
    texts = windows.groupBy("window").agg(F.first("hashes").alias("hashes"))
    grams = texts.select("window", F.size("window").alias("size"), F.posexplode("hashes").alias("offset", "hash"))
    sizes = sorted(r.k for r in grams.select(F.least("size", F.lit(shingle)).alias("k")).distinct().collect())
    docs = documents.select("doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()

    wanted = hash_bitmap(grams)
    counts = (docs.select("text").mapInArrow(lambda b: _counts(wanted, sizes, b), "hash long, n long")
              .groupBy("hash").agg(F.sum("n").alias("n")))
    ranked = (grams.join(counts, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
              .groupBy("window").agg(F.min(F.struct("n", "hash", "offset")).alias("rarest"))
              .where(F.col("rarest.n") > 0).select("window", "rarest.hash", "rarest.offset"))
    prefixes = cut_lineage(ranked)

    tokens = hash_bitmap(prefixes)
    scanned = docs.mapInArrow(lambda b: _candidates(tokens, sizes, window, b), CANDIDATE_SCHEMA.format(kind=kind))
    scanned = cut_lineage(scanned.withColumn("row", F.monotonically_increasing_id()))
    candidates = scanned.select("row", F.inline("found"))
    start = F.col("anchor") - F.col("offset")
    inside = (start >= 0) & (start + F.size("window") <= F.size("around"))
    hits = (candidates.join(prefixes, "hash")
            .where(inside & (F.when(inside, F.slice("around", start + 1, F.size("window"))) == F.col("window")))
            .select("row", "window", (F.col("place") - F.col("offset")).alias("start")))
    hits = cut_lineage(hits)

    covered = hits.groupBy("row").agg(F.size(F.array_distinct(F.flatten(F.collect_set(
        F.sequence("start", F.col("start") + F.size("window") - 1))))).cast("bigint").alias("n_hit"))
    items = (hits.select("row", "window").distinct().join(windows.select("window", "item").distinct(), "window")
             .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items")))
    return (scanned.drop("found").join(covered, "row", "left").join(items, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))
