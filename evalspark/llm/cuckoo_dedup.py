"""Exact duplicates by sharded cuckoo-filter indexes of live digests.

Two texts are equal when they are identical without their white space. Of equal texts the
row with the most code points stays, then the one with the smallest id.

A shard is a cuckoo filter: a table of buckets of four 16-bit fingerprints. A digest has two
buckets, the second found from the first and the fingerprint alone, so an entry can be moved
without its key. Beside every fingerprint stands its bucketed content (the whole digest of the
normalised text and that text's length); a fingerprint that matches counts only when the
content is the same. An insertion into full buckets moves entries on; when the chain of moves
gets too long the table overflows, doubles, and is filled again from the stored keys. A digest
whose last document is deleted leaves the table.

On Spark:

* one scan normalises and digests the texts where they lie; only 60 bytes a document move on;
* a task folds equal digests before they are shuffled, so a text with a third of all copies is
  one row per task;
* digests are dealt to shards by their own bits, ``SHARD_ROWS`` documents to a shard at most on
  average; a shard is one worker's index, filled as a stream;
* groups that hold more than a thousandth of all rows are at most a thousand: they are broadcast
  to the rows, and only the rest are joined by digest, so no join key is hot.

``LiveIndex`` keeps the same shards in a folder, version by version, and takes insertions and
deletions; a version appears only when it is written whole.

Cases: a null text is empty, and all texts without words are equal; equal rows under one id
are separate rows, of which one stays; a null id stands after every other id; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.session import cut_lineage

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SLOTS = 4
#: Moves before a table counts as overflowing.
MOVES = 200
#: Documents per shard.
SHARD_ROWS = 200_000
#: Digests a task folds before it hands them on.
FOLDED = 100_000
#: Groups above this share of all rows are broadcast: there are at most so many.
HEAVY = 1000

KEY_BYTES = 40
MEMBERS = "row long, doc_id {kind}, n_chars long, key binary"
ENTRIES = "shard int, key binary, n long, n_chars long, doc_id {kind}, row long, stale boolean"


class CuckooIndex:
    """Live keys of one shard. Values stand beside their keys."""

    def __init__(self, buckets: int = 64) -> None:
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets, self.size = buckets, 0
        self.prints = bytearray(2 * SLOTS * buckets)
        self._marks = memoryview(self.prints).cast("H")
        self._keys: list[bytes | None] = [None] * (SLOTS * buckets)
        self._values: list = [None] * (SLOTS * buckets)
        self._turn = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        """Fingerprint (never 0) and first slots of the two buckets; bits apart from those of the shard."""
        mark = (int.from_bytes(key[8:10], "little") or 1)
        first = int.from_bytes(key[10:16], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def may_hold(self, key: bytes) -> bool:
        """The filter's answer: false is certain, true needs the content."""
        mark, first, second = self._places(key)
        marks = self._marks
        return any(marks[SLOTS * b + s] == mark for b in (first, second) for s in range(SLOTS))

    def find(self, key: bytes) -> int:
        """Slot of a key, or -1: fingerprints first, content only where they match."""
        mark, first, second = self._places(key)
        marks, keys = self._marks, self._keys
        for start in (SLOTS * first, SLOTS * second):
            for slot in range(start, start + SLOTS):
                if marks[slot] == mark and keys[slot] == key:
                    return slot
        return -1

    def get(self, key: bytes):
        slot = self.find(key)
        return None if slot < 0 else self._values[slot]

    def insert(self, key: bytes, value) -> None:
        """Add a key that is not in the index."""
        while (homeless := self._settle(key, value)) is not None:
            key, value = homeless
            self._grow()
        self.size += 1

    def _settle(self, key: bytes, value) -> tuple[bytes, object] | None:
        """Put a key into a bucket, moving others on; returns the one left over when the table overflows."""
        marks, keys, values = self._marks, self._keys, self._values
        mark, first, second = self._places(key)
        for start in (SLOTS * first, SLOTS * second):
            for slot in range(start, start + SLOTS):
                if not marks[slot]:
                    marks[slot], keys[slot], values[slot] = mark, key, value
                    return None
        bucket = first
        for _ in range(MOVES):
            self._turn += 1
            slot = SLOTS * bucket + (self._turn * 7 >> 2) % SLOTS
            mark, marks[slot] = marks[slot], mark
            key, keys[slot] = keys[slot], key
            value, values[slot] = values[slot], value
            bucket = self._other(bucket, mark)
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not marks[slot]:
                    marks[slot], keys[slot], values[slot] = mark, key, value
                    return None
        return key, value

    def _grow(self) -> None:
        """Double the table and fill it again from the stored keys."""
        stored, size, buckets = list(self.items()), self.size, self.buckets
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._settle(key, value) is None for key, value in stored):
                self.size = size
                return

    def replace(self, key: bytes, value) -> None:
        self._values[self.find(key)] = value

    def delete(self, key: bytes) -> bool:
        """Take a key out; false if it is not there."""
        slot = self.find(key)
        if slot < 0:
            return False
        self._marks[slot], self._keys[slot], self._values[slot] = 0, None, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self._keys, self._values) if k is not None)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(2), "")
        keys = []
        for text in texts.cast(pa.large_binary()):
            body = text.as_py().translate(None, BLANKS)
            keys.append(hashlib.sha256(body).digest() + len(body).to_bytes(KEY_BYTES - 32, "little"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pc.utf8_length(texts).cast(pa.int64()), pa.array(keys, pa.binary())], ["row", "doc_id", "n_chars", "key"])


def describe(documents: DataFrame) -> DataFrame:
    """A number of its own, the code points and the content key of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(_describe, MEMBERS.format(kind=kind))


def text_sha256(key: Column) -> Column:
    return F.lower(F.hex(F.substring(key, 1, 32)))


def _before(x: tuple, y: tuple) -> bool:
    """Whether (n_chars, doc_id, row) ``x`` stays rather than ``y``."""
    if x[0] != y[0]:
        return x[0] > y[0]
    return (x[1] is None, x[1] if x[1] is not None else 0, x[2]) < (y[1] is None, y[1] if y[1] is not None else 0, y[2])


def _shard_of(key: bytes, shards: int) -> int:
    return int.from_bytes(key[:8], "little") % shards


def _folded(shards: int, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal digests of a task as one row."""
    groups: dict[bytes, list] = {}

    def out() -> pa.RecordBatch:
        entries = [(_shard_of(k, shards), k, g[0], *g[1], False) for k, g in groups.items()]
        return _entry_batch(entries, kind)
    for batch in batches:
        for row, doc_id, n_chars, key in zip(*(batch.column(i).to_pylist() for i in range(4))):
            mine = (n_chars, doc_id, row)
            group = groups.get(key)
            if group is None:
                groups[key] = [1, mine]
            else:
                group[0] += 1
                if _before(mine, group[1]):
                    group[1] = mine
        if len(groups) >= FOLDED:
            yield out()
            groups = {}
    if groups:
        yield out()


def _entry_batch(entries: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), kind, pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries), types)],
                                      ["shard", "key", "n", "n_chars", "doc_id", "row", "stale"])


def _run_shards(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Live entries of each shard after all its changes; ``n`` below 0 is a deletion.

    Rows come by shard. Deleting a group's best member makes the entry stale: its best one must be
    looked up among the members that are left.
    """
    current, index = None, CuckooIndex()

    def live() -> Iterator[pa.RecordBatch]:
        entries = []
        for key, (n, best, stale) in index.items():
            entries.append((current, key, n, *best, stale))
            if len(entries) == FOLDED:
                yield _entry_batch(entries, kind)
                entries = []
        if entries:
            yield _entry_batch(entries, kind)
    for batch in batches:
        for shard, key, n, n_chars, doc_id, row, stale in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != current:
                if current is not None:
                    yield from live()
                current, index = shard, CuckooIndex()
            mine, known = (n_chars, doc_id, row), index.get(key) if index.may_hold(key) else None
            if known is None:
                if n > 0:
                    index.insert(key, (n, mine, stale))
            elif n < 0:
                if known[0] + n <= 0:
                    index.delete(key)
                else:
                    index.replace(key, (known[0] + n, known[1], known[2] or not _before(known[1], mine)))
            else:
                index.replace(key, (known[0] + n, mine if known[2] and not stale or _before(mine, known[1]) else known[1], known[2] or stale))
    if current is not None:
        yield from live()


def _changed(changes: DataFrame, shards: int, id_type: str) -> DataFrame:
    """Entries by shard after ``changes``, which hold the live entries as well."""
    kind = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()
    # stored entries and insertions first: a deletion needs the key
    ordered = changes.repartition(shards, "shard").sortWithinPartitions("shard", F.col("n") < 0)
    return ordered.mapInArrow(lambda b: _run_shards(kind, b), ENTRIES.format(kind=id_type))


def _folded_changes(members: DataFrame, shards: int, id_type: str) -> DataFrame:
    kind = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()
    return members.select("row", "doc_id", "n_chars", "key").mapInArrow(lambda b: _folded(shards, kind, b), ENTRIES.format(kind=id_type))


def _shards_for(rows: int) -> int:
    return max(8, -(-rows // SHARD_ROWS))


def _decided(members: DataFrame, entries: DataFrame, rows: int) -> DataFrame:
    """Every member with its group's size and the row that stays."""
    groups = entries.where("n > 1").select(F.col("key").alias("_key"), F.col("n").alias("_n"), F.col("doc_id").alias("_keep"), F.col("row").alias("_row"))
    limit = max(rows // HEAVY, 1)
    heavy = F.broadcast(groups.where(F.col("_n") > limit)).alias("h")
    light = groups.where(F.col("_n") <= limit).alias("l")
    marked = members.alias("m").join(heavy, F.col("m.key") == F.col("h._key"), "left")
    # a row whose group is known looks for none: its key is one of its own
    own = F.when(F.col("h._n").isNull(), F.col("m.key")).otherwise(F.col("m.row").cast("string").cast("binary"))
    joined = marked.withColumn("_own", own).join(light, F.col("_own") == F.col("l._key"), "left")
    size = F.coalesce("h._n", "l._n", F.lit(1)).cast("bigint")
    stays = F.coalesce("h._row", "l._row", "m.row")
    keep = F.when(F.col("h._n").isNotNull(), F.col("h._keep")).when(F.col("l._n").isNotNull(), F.col("l._keep")).otherwise(F.col("m.doc_id"))
    return joined.select(F.col("m.row").alias("row"), F.col("m.doc_id").alias("doc_id"), keep.alias("keep_id"), size.alias("group_size"),
                         (F.col("m.row") == stays).alias("kept"), text_sha256(F.col("m.key")).alias("text_sha256"))


def exact_groups(documents: DataFrame) -> DataFrame:
    """One row per document: the document that stays for it, its group's size and its digest."""
    members = cut_lineage(describe(documents))
    rows = members.count()
    shards = _shards_for(rows)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    entries = cut_lineage(_changed(_folded_changes(members, shards, id_type), shards, id_type))
    return _decided(members, entries, rows).drop("row")


@dataclass(frozen=True)
class LiveIndex:
    """Shards in a folder: version by version the live entries and the members behind them."""

    spark: SparkSession
    folder: str
    version: int
    shards: int

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self.version:06d}/entries")

    def members(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self.version:06d}/members")

    def groups(self) -> DataFrame:
        """One row per live document, as ``exact_groups`` gives it."""
        members = self.members()
        return _decided(members, self.entries(), members.count()).drop("row")

    @classmethod
    def create(cls, documents: DataFrame, folder: str) -> LiveIndex:
        members = cut_lineage(describe(documents))
        shards = _shards_for(members.count())
        id_type = documents.schema["doc_id"].dataType.simpleString()
        return cls(documents.sparkSession, folder, 0, shards)._written(
            members, _changed(_folded_changes(members, shards, id_type), shards, id_type), shards)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LiveIndex:
        """The newest whole version: its mark is written after its tables."""
        marks = spark.read.text(f"{folder}/marks").select(F.from_json("value", "version int, shards int").alias("m")).select("m.*")
        newest = marks.orderBy(F.desc("version")).first()
        return cls(spark, folder, newest.version, newest.shards)

    def _written(self, members: DataFrame, entries: DataFrame, shards: int) -> LiveIndex:
        place = f"{self.folder}/v{self.version + 1:06d}"
        members.write.mode("overwrite").parquet(f"{place}/members")
        entries.write.mode("overwrite").parquet(f"{place}/entries")
        mark = json.dumps({"version": self.version + 1, "shards": shards})
        self.spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/marks")
        return LiveIndex(self.spark, self.folder, self.version + 1, shards)

    def insert(self, documents: DataFrame) -> LiveIndex:
        """The next version, with more documents; only they are read as texts."""
        members = self.members()
        above = members.agg(F.coalesce(F.max("row") + 1, F.lit(0)).alias("r")).first().r
        added = cut_lineage(describe(documents).withColumn("row", F.col("row") + F.lit(above)))
        return self._next(members.unionByName(added), _folded_changes(added, self.shards, self._id_type()))

    def delete(self, doc_ids: DataFrame) -> LiveIndex:
        """The next version, without the rows of these ids (a column ``doc_id``)."""
        members, gone = self.members(), doc_ids.select("doc_id").distinct()
        lost = cut_lineage(members.join(gone, "doc_id", "left_semi"))
        left = members.join(lost.select("row"), "row", "left_anti")
        return self._next(left, _folded_changes(lost, self.shards, self._id_type()).withColumn("n", -F.col("n")))

    def _id_type(self) -> str:
        return self.members().schema["doc_id"].dataType.simpleString()

    def _next(self, members: DataFrame, changes: DataFrame) -> LiveIndex:
        id_type, members = self._id_type(), cut_lineage(members)
        live = cut_lineage(_changed(self.entries().unionByName(changes), self.shards, id_type))
        stale = live.where("stale").select("key")
        best = _folded_changes(members.join(stale, "key", "left_semi"), self.shards, id_type)
        mended = live.where("NOT stale").unionByName(_changed(best, self.shards, id_type))
        return self._written(members, mended, self.shards)
