"""Removal of repeated byte strings, found with suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts somewhere else, in
the same document or another. All such strings are found, in these steps:

1. Routing. Every window of ``length`` bytes is named by the smallest hash of the ``ROUTE``
   byte strings inside it. Equal windows have equal names, so windows are only compared
   under one name. A scan counts the naming strings with what stands half a window to their
   left or right; equal windows agree on one of the two, so what is met once repeats nowhere.
2. Segments. Consecutive windows under one name form a segment. A second scan notes where
   segments stand whose surroundings were met again (a bitmap of fixed size decides; it only
   ever lets too much through). Equal segments are one segment with a count.
3. Shards. A third scan cuts out the bytes of the segments that share their name with others
   and deals them by name into shards of bounded size. Each shard gets a suffix
   array by Larsson-Sadakane refinement: ranks by the first 7 bytes, then ranks of twice the
   depth from pairs of ranks, touching only groups that are not yet single. Common prefixes
   follow Kasai: along the text the value falls by one while the predecessor moves along, so
   only the heads of such runs, and where one goes on after a byte that differs, are compared
   byte by byte.
4. A name with more than ``SPLIT`` segments is dealt over several shards. Their windows
   meet again, one per shard and distinct window, sorted by fingerprint, and binary search
   counts how many shards hold each.
5. Repeats go back to the texts that hold the segments; their union is cut out.

Copies of a text are one text up to the last step, so a large group of copies adds rows of
a few bytes. Workers hold one piece of text or one shard.

Cases: a null text is empty; shorter texts than ``length`` stay whole; repeated rows are
copies of each other and go whole if they are long enough; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evalspark.llm import arrays as A
from evalspark.session import cut_lineage

LENGTH = 400
#: Bytes whose hashes name a window.
ROUTE = 96
#: Size of the bitmap of names, in bits: 8 MB.
ROUTE_BITS = 26
TEXT_BITS = 24
#: Bytes of one shard's segments, and segments from which a name is split.
SHARD_BYTES = 2 << 20
SPLIT = 2000
#: Segments whose bytes a worker knows it has already sent; bounds memory only.
RECENT = 200_000
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- routing -------------------------------------------------------------------------------


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` consecutive values."""
    join = np.minimum if least else np.maximum
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, _MOST if least else 0, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    ahead = join.accumulate(blocks, axis=1).ravel()
    behind = join.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return join(behind[:n - width + 1], ahead[width - 1:n])


def _names(data: np.ndarray, offsets: np.ndarray, length: int, route: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name of the window at every byte, whether the window lies in one text, and the hashes at every byte."""
    n, width = len(data), length - route + 1
    sizes = np.diff(offsets)
    left = np.repeat(offsets[1:], sizes) - np.arange(n)  # bytes up to the end of the text
    running = A.prefix_hash(data)
    _, down = A.powers(n + 1)
    hashes = A.mix((running[route:] - running[:-route]) * down[:n - route + 1])
    hashes[left[:n - route + 1] < route] = _MOST
    names = _sliding(hashes, width, True)[:n - length + 1]
    return names, left[:n - length + 1] >= length, hashes


def _has(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Bits of a packed bitmap, which stays packed."""
    return (packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 > 0


def _long_texts(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, offsets in A.pieces(column):
        if (np.diff(offsets) >= length).any():
            yield first, data, offsets


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, route: int) -> tuple[np.ndarray, ...]:
    """Names and validity of all windows; the places that name some window, and two hashes around each.

    A window reaches at least half of what it has beside its naming bytes to their left or to
    their right. So two equal windows also agree on the hash that is extended to the left, or
    on the one extended to the right, which few unequal windows do.
    """
    width, half = length - route + 1, (length - route) // 2
    names, inside, hashes = _names(data, offsets, length, route)
    # a place names a window if its hash is the largest name among the windows over it
    over = np.zeros(len(names) + 2 * (width - 1), np.uint64)
    over[width - 1:len(names) + width - 1] = np.where(inside, names, np.uint64(0))
    named = _sliding(over, width, False)
    places = np.flatnonzero(hashes[:len(named)] == named[:len(hashes)])
    text = np.searchsorted(offsets, places, "right") - 1
    running = A.prefix_hash(data)
    leftward = A.span_hashes(running, np.maximum(places - half, 0), places + route)
    leftward = np.where(places - half >= offsets[text], leftward, np.uint64(0))
    until = np.minimum(places + route + half, len(data))
    rightward = np.where(places + route + half <= offsets[text + 1], A.mix(~A.span_hashes(running, places, until)), np.uint64(0))
    return names, inside, places, leftward, rightward


def _count_anchors(length: int, route: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in _long_texts(batch.column(0), length):
            _, _, _, leftward, rightward = _anchors(data, offsets, length, route)
            both = np.concatenate([leftward, rightward])
            values, counts = np.unique(both[both != 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["anchor", "n"])


def _text_key(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _segments(length: int, route: int, packed: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """``(bytes, offsets, name per window, first window, last window, text)`` of the segments worth comparing."""
    width = length - route + 1
    for _, data, offsets in _long_texts(column, length):
        names, inside, places, leftward, rightward = _anchors(data, offsets, length, route)
        met = np.zeros(len(data) + 1, np.int64)
        known = [(h != 0) & _has(packed, (h >> np.uint64(64 - ROUTE_BITS)).astype(np.int64)) for h in (leftward, rightward)]
        met[places[known[0] | known[1]] + 1] = 1
        met = np.cumsum(met)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (names[1:] != names[:-1])
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | (names[1:] != names[:-1])
        starts, lasts = np.flatnonzero(begins), np.flatnonzero(ends)
        worth = met[np.minimum(lasts + width, len(data))] > met[starts]
        starts, lasts = starts[worth], lasts[worth]
        yield data, offsets, names, starts, lasts, np.searchsorted(offsets, starts, "right") - 1


def _segment_key(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _place_segments(length: int, route: int, packed: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the segments stand; their bytes stay where they are."""
    for batch in batches:
        for data, offsets, names, starts, lasts, texts in _segments(length, route, packed, batch.column(0)):
            keys = {t: _text_key(data[offsets[t]:offsets[t + 1]].tobytes()) for t in np.unique(texts).tolist()}
            pieces = [_segment_key(data[a:b + length].tobytes()) for a, b in zip(starts.tolist(), lasts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[t] for t in texts.tolist()], pa.binary()), pa.array((starts - offsets[texts]).astype(np.int32)),
                 pa.array((lasts - starts + 1).astype(np.int32)), pa.array(names[starts].view(np.int64)), pa.array(pieces, pa.binary())],
                ["text_key", "start", "windows", "name", "segment"])


def _cut_segments(length: int, route: int, packed: np.ndarray, wanted: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments, once per task as far as it remembers."""
    sent: set[bytes] = set()
    for batch in batches:
        for data, _, names, starts, lasts, _ in _segments(length, route, packed, batch.column(0)):
            out: list[list] = [[], [], []]
            for a, b in zip(starts.tolist(), lasts.tolist()):
                piece = data[a:b + length].tobytes()
                key = _segment_key(piece)
                if key not in sent and _has(wanted, _key_slots([key], ROUTE_BITS))[0]:
                    if len(sent) >= RECENT:
                        sent.clear()
                    sent.add(key)
                    for column, value in zip(out, (int(names[a].astype(np.int64)), key, piece)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                                             ["name", "segment", "bytes"])


# --- suffix arrays ---------------------------------------------------------------------------


def suffix_array(data: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` bytes.

    ``left`` holds the bytes up to the end of each suffix's string; a string's end sorts first.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.int64) + 1, np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | np.where(left > j, padded[j:n + j], 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0))
    open_at = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]])))
    h = 7
    while h < depth and len(open_at):
        suffixes = order[open_at]
        beyond = np.where(left[suffixes] > h, rank[np.minimum(suffixes + h, n - 1)] + 1, 0)
        key = rank[suffixes] * (n + 1) + beyond
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        order[open_at] = suffixes
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffixes] = open_at[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        open_at = open_at[~(fresh & np.concatenate([fresh[1:], [True]]))]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it (0 for the first)."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    new_string = np.concatenate([[True], left[1:] != left[:-1] - 1])
    runs = np.concatenate([[True], before[1:] != before[:-1] + 1]) | new_string | (before < 0)
    runs |= new_string[np.maximum(before, 0)]
    # the fall by one ends at the first byte that differs; where equal bytes begin again, so does a run
    equal = data == data[np.maximum(before, 0)]
    runs[1:] |= equal[1:] & ~equal[:-1]
    heads = np.flatnonzero(runs)
    other = before[heads]
    limit = np.where(other >= 0, np.minimum(left[heads], left[np.maximum(other, 0)]), 0)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    common = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        same = words[heads[live] + common[live]] == words[other[live] + common[live]]
        step = np.where(same.all(1), 8, np.argmin(same, 1))
        common[live] += step
        live = live[(step == 8) & (common[live] < limit[live])]
    common = np.minimum(common, limit)
    run = np.cumsum(runs) - 1
    along = np.maximum(common[run] - (np.arange(n) - heads[run]), 0)
    return along[order]


def repeated_windows(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the segments end to end: which windows repeat, the suffix order of all windows, and where a new distinct one begins."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))
    order = suffix_array(data, left, length)
    same = common_prefixes(data, left, order) >= length
    repeat = np.zeros(len(data), bool)
    repeat[order[same]] = True
    repeat[order[np.flatnonzero(same) - 1]] = True
    whole = left[order] >= length
    return repeat, order[whole], ~same[whole], ends - sizes, data


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    change = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"a": a, "b": b} for a, b in zip(change[::2].tolist(), (change[1::2] - 1).tolist())]


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_MEETING = pa.list_(pa.struct([("hi", pa.int64()), ("lo", pa.int64()), ("segment", pa.binary()), ("at", pa.int32()), ("done", pa.bool_())]))
SHARD_SCHEMA = ("segment binary, spans array<struct<a:int,b:int>>, "
                "meeting array<struct<hi:bigint,lo:bigint,segment:binary,at:int,done:boolean>>")


def _meeting(keys: list[bytes], begins: np.ndarray, order: np.ndarray, fresh: np.ndarray, repeat: np.ndarray, data: np.ndarray,
             length: int) -> list[dict]:
    """One entry per distinct window of the shard, with a fingerprint of 128 bits."""
    chosen = order[fresh]
    hi = A.span_hashes(A.prefix_hash(data), chosen, chosen + length).view(np.int64)
    lo = A.span_hashes(A.prefix_hash(data, A.mix(A._BYTE_VALUES.copy())), chosen, chosen + length).view(np.int64)
    which = np.searchsorted(begins, chosen, "right") - 1
    return [{"hi": a, "lo": b, "segment": keys[w], "at": int(p - begins[w]), "done": d} for a, b, w, p, d in
            zip(hi.tolist(), lo.tolist(), which.tolist(), chosen.tolist(), repeat[chosen].tolist())]


def _solve(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards from rows sorted by name, part and segment; several tasks may have sent one segment."""
    held: list[tuple] = []
    size = 0

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        keys = [r[2] for r in rows]
        repeat, order, fresh, begins, data = repeated_windows([r[3] for r in rows], length)
        spans = [_runs(repeat[at:at + len(r[3]) - length + 1]) for r, at in zip(rows, begins.tolist())]
        meeting: list = [None] * len(rows)
        if rows[0][1]:
            meeting[0] = _meeting(keys, begins, order, fresh, repeat, data, length)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(spans, _SPANS), pa.array(meeting, _MEETING)], ["segment", "spans", "meeting"])

    for batch in batches:
        fields = (batch.column(c).to_pylist() for c in ("name", "salt", "is_split", "segment", "bytes"))
        for name, salt, is_split, segment, piece in zip(*fields):
            group = (name, salt)
            if held and group == held[-1][0] and segment == held[-1][2]:
                continue
            # a split name's shard stands alone; other names share shards, each whole
            if held and group != held[-1][0] and (size >= SHARD_BYTES or is_split or held[-1][1]):
                yield solve(held)
                held, size = [], 0
            held.append((group, is_split, segment, piece))
            size += len(piece)
    if held:
        yield solve(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fingerprint: the windows that several shards hold, by binary search."""
    carry: list[pa.RecordBatch] = []

    def repeats(table: pa.Table) -> pa.Table:
        pair = np.empty(table.num_rows, [("hi", np.int64), ("lo", np.int64)])
        pair["hi"], pair["lo"] = table.column("hi").to_numpy(), table.column("lo").to_numpy()
        holders = np.searchsorted(pair, pair, "right") - np.searchsorted(pair, pair, "left")
        return table.filter(pa.array((holders > 1) & ~table.column("done").to_numpy())).select(["segment", "at"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*carry, batch])
        hi = table.column("hi").to_numpy()
        border = int(np.searchsorted(hi, hi[-1], "left"))  # the last fingerprints may go on in the next batch
        yield from repeats(table.slice(0, border)).to_batches()
        carry = table.slice(border).to_batches()
    if carry:
        yield from repeats(pa.Table.from_batches(carry)).to_batches()


# --- texts -----------------------------------------------------------------------------------


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of the top of every ``hash``; the driver gets ``2**bits / 64`` words at most."""
    slot = F.shiftrightunsigned(F.col("hash"), 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = hashes.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return np.packbits(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _key_slots(keys: list[bytes], bits: int) -> np.ndarray:
    return (np.frombuffer(b"".join(k[:8] for k in keys), ">u8").astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _chosen(packed: np.ndarray, hit: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], list[bytes]]]:
    """Ids, texts and keys of the rows from whose text something may be cut, or of all others; a piece at a time."""
    for batch in batches:
        for first, last in A.stretches(batch.column(1), A.PIECE):
            texts = [(t or "").encode() for t in batch.column(1).slice(first, last - first).to_pylist()]
            keys = [_text_key(t) for t in texts]
            at = np.flatnonzero(_has(packed, _key_slots(keys, TEXT_BITS)) == hit)
            yield batch.column(0).slice(first, last - first).take(pa.array(at)), [texts[i] for i in at], [keys[i] for i in at]


def _with_keys(packed: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows from whose text something may be cut, with its key and bytes."""
    for ids, texts, keys in _chosen(packed, True, batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], ["doc_id", "text_key", "bytes"])


def _result(ids: pa.Array, sizes: list[int], removed: list[int], spans: list[int], kept: list[bytes], with_text: bool) -> pa.RecordBatch:
    columns = [ids, *[pa.array(v, pa.int64()) for v in (sizes, removed, spans)], pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
    if with_text:
        columns.append(pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"][:len(columns)])


def _whole(packed: np.ndarray, with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the other texts, which stay as they are and are not moved."""
    for ids, texts, _ in _chosen(packed, False, batches):
        none = [0] * len(texts)
        yield _result(ids, [len(t) for t in texts], none, none, texts, with_text)


def _cut(length: int, with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in A.stretches(batch.column("bytes"), A.PIECE):
            part = batch.slice(first, last - first)
            texts, removed, spans, kept = part.column("bytes").to_pylist(), [], [], []
            for text, found in zip(texts, part.column("found").to_pylist()):
                if not found:
                    removed.append(0)
                    spans.append(0)
                    kept.append(text)
                    continue
                change = np.zeros(len(text) + 1, np.int32)
                for place in found:
                    for span in place["spans"]:
                        change[place["start"] + span["a"]] += 1
                        change[place["start"] + span["b"] + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield _result(part.column("doc_id"), [len(t) for t in texts], removed, spans, kept, with_text)


def _head(key: str) -> Column:
    """The first eight bytes of a key as a number."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("bigint")


def repeated_segments(documents: DataFrame, length: int = LENGTH, route: int = ROUTE, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """``(places, repeats)``: where segments stand in texts, and the repeated windows of each segment."""
    texts = documents.select("text")
    anchors = texts.mapInArrow(lambda b: _count_anchors(length, route, b), "anchor long, n long")
    again = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("anchor").alias("hash"))
    packed = _bitmap(again, ROUTE_BITS)
    places = cut_lineage(texts.mapInArrow(lambda b: _place_segments(length, route, packed, b),
                                          "text_key binary, start int, windows int, name long, segment binary"))
    segments = places.groupBy("name", "segment").agg(F.count(F.lit(1)).alias("copies"), F.max("windows").alias("windows"))
    per_name = segments.groupBy("name").agg(F.count(F.lit(1)).alias("n_segments"))
    counted = cut_lineage(segments.join(per_name, "name"))
    # every window of a segment that stands in several places repeats
    whole = counted.where("copies > 1").select("segment", F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") - 1).alias("b"))).alias("spans"))
    # one segment under its name, in several places, has nothing else to be compared with
    compared = counted.where("n_segments > 1 OR copies = 1")
    wanted = _bitmap(compared.select(_head("segment").alias("hash")), ROUTE_BITS)
    large = counted.where(F.col("n_segments") > split).select("name", "n_segments").distinct()
    shards = F.ceil(F.coalesce("n_segments", F.lit(1)) / split)
    dealt = (texts.mapInArrow(lambda b: _cut_segments(length, route, packed, wanted, b), "name long, segment binary, bytes binary")
             .join(large, "name", "left")
             .select("name", F.pmod(F.xxhash64("segment"), shards).alias("salt"), F.col("n_segments").isNotNull().alias("is_split"), "segment", "bytes")
             .repartition("name", "salt").sortWithinPartitions("name", "salt", "segment"))
    solved = cut_lineage(dealt.mapInArrow(lambda b: _solve(length, b), SHARD_SCHEMA))
    met = (solved.where("meeting is not null").select(F.inline("meeting"))
           .repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo").mapInArrow(_meet, "segment binary, at int"))
    crossing = met.select("segment", F.array(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("spans"))
    repeats = solved.select("segment", "spans").where(F.size("spans") > 0).unionByName(whole).unionByName(crossing)
    return places.select("text_key", "start", "segment"), repeats


def remove_repeats(documents: DataFrame, length: int = LENGTH, route: int = ROUTE, split: int = SPLIT, with_text: bool = False) -> DataFrame:
    """Per document: its bytes, what was removed in how many runs, and a digest of what is left.

    ``with_text`` adds what is left as ``text``; a character that a removed run begins or ends in shows as U+FFFD there.
    """
    places, repeats = repeated_segments(documents, length, route, split)
    found = cut_lineage(places.distinct().join(repeats, "segment").groupBy("text_key")
                        .agg(F.collect_list(F.struct("start", "spans")).alias("found")))
    packed = _bitmap(found.select(_head("text_key").alias("hash")), TEXT_BITS)
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
    texts = documents.select("doc_id", "text")
    hit = texts.mapInArrow(lambda b: _with_keys(packed, b), f"doc_id {kind}, text_key binary, bytes binary")
    cut = hit.join(found, "text_key", "left").mapInArrow(lambda b: _cut(length, with_text, b), schema)
    return texts.mapInArrow(lambda b: _whole(packed, with_text, b), schema).unionByName(cut)
