"""Trie of conversation prefixes as member intervals over sorted conversations.

Conversations are sorted by their turns, so the members of any prefix stand together. With the
common prefix lengths of neighbours in a sparse table of range minima, a prefix of depth d at
place i finds its interval by two independent binary searches: left and right as far as no
common prefix is shorter than d. No stack and no walk is needed, all prefixes are searched at
once, and everything a node reports is read off its interval:

* its smallest member by a range minimum over the ids;
* its children are the places in the interval where the common prefix is exactly d long and a
  turn follows; its leaves are the ends of conversations that the next one does not extend;
* the code points saved below it are a difference of running sums over the neighbours'
  common prefixes, as a turn shared by neighbours is a turn saved.

On Spark the turns become 16-byte digests and lengths first, so texts are neither shuffled nor
sorted. Conversations are dealt by range of (turns, id): a first turn, or a whole conversation,
that a third of all rows share is spread over as many parts as it fills. Only prefixes of a
part's first and last conversation can reach into another part. They come out as partial
sums (at most one row per part and prefix) that are added up before the parts write their nodes.

A conversation's turns are gathered into one row of 36 bytes a turn; its texts are not. The
conversations that end at a node are digested as one stream of ids, in order: inside a part at
once, across parts from one text per part.

Cases: a null role or text is empty; a null turn stands first; equal turns of a conversation keep
every row, in the order of their digests; equal conversations are separate members; rows
without a ``conv_id`` belong to no conversation and are left out; an empty table has no node, not
even the root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evalspark.functions.binding import bind
from evalspark.session import cut_lineage

KEY_BYTES = 16
#: Conversations and turns of a part, at most about; small inputs get smaller parts, so that all cores have some.
PART_ROWS = 50_000
PART_TURNS = 500_000
SMALL_PART_ROWS = 2_000

NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")
PARTIAL = ("part int, prefix binary, depth long, low long, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, ends string")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the digest and the code points of every turn, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the role's length keeps role and text apart
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.substring(digest, 1, KEY_BYTES).alias("key"), F.length(text).cast("bigint").alias("chars")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["key"], x["chars"])).alias("turns"))


def with_shared_heads(found: DataFrame) -> DataFrame:
    """Conversations whose first turns are replaced by those of the first one of their hundred."""
    heads = found.where("conv_id % 100 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 5).alias("_head"))
    n = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    joined = found.join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("_base"), "left")
    rest = F.when(F.size("turns") > n, F.slice("turns", n + 1, F.greatest(F.size("turns") - n, F.lit(0))))
    nothing = F.slice("turns", 1, 0)
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("_head", F.lit(1), n), nothing), F.coalesce(rest, nothing)).alias("turns"))


class RangeMinimum:
    """Sparse table of minima over power-of-two stretches."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels, width = [values], 1
        while 2 * width <= len(values):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Smallest value between two places, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            mine = level == k
            out[mine] = np.minimum(self.levels[k][first[mine]], self.levels[k][last[mine] + 1 - (1 << k)])
        return out

    def right_extent(self, place: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Last place up to which no value behind ``place`` is below ``least``."""
        at = place.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at + (1 << k) < len(self.levels[0])
            ahead = np.where(fits, at + 1, 0)
            fits &= self.levels[k][np.minimum(ahead, len(self.levels[k]) - 1)] >= least
            at += fits.astype(at.dtype) << k
        return at

    def left_extent(self, place: np.ndarray, least: np.ndarray) -> np.ndarray:
        """First place from which on no value up to ``place`` is below ``least``."""
        at = place.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at - (1 << k) >= 0
            behind = np.where(fits, at + 1 - (1 << k), 0)
            fits &= self.levels[k][np.minimum(behind, len(self.levels[k]) - 1)] >= least
            at -= fits.astype(at.dtype) << k
        return at


class Part:
    """A stretch of sorted conversations, and how far its ends agree with their neighbours (-1: no neighbour)."""

    def __init__(self, rows: pa.Table, before: int, after: int) -> None:
        rows = rows.combine_chunks().sort_by("at")
        self.ids = rows["conv_id"].to_numpy()
        lists = rows["turns"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.n = n = len(self.ids)
        self.size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        turns = lists.flatten()
        self.keys = np.frombuffer(b"".join(turns.field("key").to_pylist()), np.uint64).reshape(-1, KEY_BYTES // 8)
        chars = turns.field("chars").to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.upto = np.concatenate([[0], np.cumsum(chars)])
        self.before, self.after = before, after
        self.common = np.empty(n, np.int64)
        self.common[0] = before
        self.common[1:] = self._common()
        self.table = RangeMinimum(self.common)
        self.lowest = RangeMinimum(self.ids)
        following = np.append(self.common[1:], after)
        self.leaf_sum = np.concatenate([[0], np.cumsum(following < self.size)])
        at = np.maximum(self.common, 0)
        self.saved_sum = np.concatenate([[0], np.cumsum(self._chars(np.arange(n), at))])
        opening = self.size > self.common
        # places that open a child, by the depth where they leave the row before
        self._open = np.sort(self.common[opening] * n + np.flatnonzero(opening))
        # equal conversations stand together: the last place of each one's copies
        first = np.flatnonzero(self.common != self.size)
        ends = np.append(first[1:], n) if len(first) and first[0] == 0 else np.append(first, n)
        firsts = first if len(first) and first[0] == 0 else np.concatenate([[0], first])
        self.copies_end = np.repeat(ends, ends - firsts)

    def _chars(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Code points in the first turns of a conversation."""
        return self.upto[self.start[row] + depth] - self.upto[self.start[row]]

    def _common(self) -> np.ndarray:
        """Common prefix of each conversation with the one before."""
        both = np.minimum(self.size[1:], self.size[:-1])
        owner = np.repeat(np.arange(len(both)), both)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(both) - both, both)
        equal = (self.keys[self.start[owner] + within] == self.keys[self.start[owner + 1] + within]).all(1)
        out = both.copy()
        np.minimum.at(out, owner[~equal], within[~equal])
        return out

    def borders(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and depth of the prefixes that reach into another part."""
        right = np.arange(self.after + 1)
        left = np.arange(self.before + 1)
        if len(left):  # those of the last conversation may be prefixes of the first one, too
            reach = self.table.left_extent(np.full(len(right), self.n - 1), right)
            right = right[~((reach == 0) & (right <= self.before))]
        return (np.concatenate([np.zeros(len(left), np.int64), np.full(len(right), self.n - 1)]),
                np.concatenate([left, right]))

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and depth of every prefix, at the first conversation that has it; the root of the first part too."""
        least = self.common + 1
        n = np.maximum(self.size - least + 1, 0)
        place = np.repeat(np.arange(self.n), n)
        return place, np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + least[place]

    def nodes(self, place: np.ndarray, depth: np.ndarray) -> dict[str, np.ndarray]:
        """What the part knows of some prefixes."""
        left, right = self.table.left_extent(place, depth), self.table.right_extent(place, depth)
        # the first row of a part may go on with a prefix of the part before
        n = self.n
        joined = self.common[left] >= depth
        opened = np.searchsorted(self._open, depth * n + right, "right") - np.searchsorted(self._open, depth * n + left, "left")
        opened += ~joined & (self.size[left] > depth)
        first = left + ~joined
        upper = np.where(depth > 0, self._chars(left, np.maximum(depth - 1, 0)), 0)
        saved = self.saved_sum[right + 1] - self.saved_sum[first] - (right + 1 - first) * upper
        return {"left": left, "right": right, "depth": depth, "low": self.lowest(left, right), "n_convs": right - left + 1,
                "n_children": opened, "n_leaves": self.leaf_sum[right + 1] - self.leaf_sum[left], "saved_tokens": saved}

    def ends(self, left: int, depth: int) -> str:
        """Ids of the conversations that end at a prefix, in ascending order."""
        if self.size[left] != depth:
            return ""
        return ",".join(map(str, self.ids[left:self.copies_end[left]].tolist()))

    def prefix(self, place: int, depths: list[int]) -> list[bytes]:
        """Digests of a conversation's prefixes; depths ascend."""
        data = self.keys[self.start[place]:self.start[place + 1]].tobytes()
        state, at, out = hashlib.blake2b(digest_size=16), 0, []
        for depth in depths:
            state.update(data[at * KEY_BYTES:depth * KEY_BYTES])
            at = depth
            out.append(state.digest())
        return out


def _edge_values(edge: pa.Table) -> tuple[int, int, int]:
    row = edge.slice(0, 1).to_pylist()[0]
    return row["part"], row["before"], row["after"]


def _partials(rows: pa.Table, edge: pa.Table) -> pa.Table:
    number, before, after = _edge_values(edge)
    part = Part(rows, before, after)
    place, depth = part.borders()
    found = part.nodes(place, depth)
    split = before + 1
    prefixes = part.prefix(0, depth[:split].tolist()) + part.prefix(part.n - 1, depth[split:].tolist())
    ends = [part.ends(a, d) for a, d in zip(found["left"].tolist(), depth.tolist())]
    columns = [pa.array(np.full(len(place), number), pa.int32()), pa.array(prefixes, pa.binary())]
    columns += [pa.array(found[c]) for c in ("depth", "low", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return pa.Table.from_arrays(columns + [pa.array(ends, pa.string())],
                                ["part", "prefix", "depth", "low", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"])


def _part_nodes(rows: pa.Table, edge: pa.Table) -> pa.Table:
    """The nodes that begin in a part; those that reach over its borders have their totals in ``edge``."""
    number, before, after = _edge_values(edge)
    part = Part(rows, before, after)
    shared = {(r["prefix"]): r for r in edge.to_pylist() if r["prefix"] is not None}
    place, depth = part.candidates()
    found = part.nodes(place, depth)
    left, right = found["left"], found["right"]
    # the parent's smallest id: from the part itself, or from the totals of a prefix that crosses a border
    up = np.maximum(depth - 1, 0)
    low_up = part.lowest(part.table.left_extent(place, up), part.table.right_extent(place, up))
    over_left = up <= np.where(part.table.left_extent(place, up) == 0, before, -1)
    over_right = up <= np.where(part.table.right_extent(place, up) == part.n - 1, after, -1)
    ends = [hashlib.sha256(part.ends(a, d).encode()).hexdigest() if s == d else EMPTY_SHA
            for a, d, s in zip(left.tolist(), depth.tolist(), part.size[left].tolist())]
    out = {c: found[c].copy() for c in ("low", "n_convs", "n_children", "n_leaves", "saved_tokens")}
    border_left = part.prefix(0, list(range(before + 1)))
    border_right = part.prefix(part.n - 1, list(range(after + 1)))
    for i in np.flatnonzero(over_left | over_right).tolist():
        low_up[i] = shared[(border_left if over_left[i] else border_right)[up[i]]]["low"]
    for i in np.flatnonzero((right == part.n - 1) & (depth <= after)).tolist():
        total = shared[border_right[depth[i]]]
        ends[i] = total["ends_sha256"]
        for c in out:
            out[c][i] = total[c]
    parent = pa.array(low_up, mask=depth == 0)
    return pa.Table.from_arrays(
        [pa.array(out["low"]), pa.array(depth), parent, *[pa.array(out[c]) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
         pa.array(ends, pa.string())],
        ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per prefix of texts that come in order, joined by commas."""
    current, state, rows = None, None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.string()))], ["prefix", "ends_sha256"])
    for batch in batches:
        for prefix, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if prefix != current:
                if state is not None:
                    rows.append((current, state.hexdigest()))
                current, state, ids = prefix, hashlib.sha256(), 0
            state.update(("," if ids else "").encode() + ends.encode())
            ids += 1
        if rows:
            yield made()
            rows = []
    if state is not None:
        rows.append((current, state.hexdigest()))
        yield made()


def _agreement(x: Column, y: Column) -> Column:
    """Length of the common prefix of two arrays of turns; -1 where there is no second one."""
    equal = F.zip_with(x, y, lambda a, b: F.coalesce(a["key"] == b["key"], F.lit(False)))
    length = bind(equal, lambda e: F.when(F.array_position(e, False) > 0, F.array_position(e, False) - 1).otherwise(F.size(e).cast("bigint")))
    return F.when(y.isNull(), F.lit(-1).cast("bigint")).otherwise(length)


def prefix_trie(found: DataFrame, part_rows: int = PART_ROWS, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per node of the trie of ``(conv_id, turns)``, as ``sequences`` gives them."""
    found = cut_lineage(found)
    total = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("turns")), F.lit(0)).alias("t")).first()
    spread = 4 * found.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-total.n // part_rows), -(-total.t // part_turns), min(spread, -(-total.n // SMALL_PART_ROWS)))
    keys = F.transform("turns", lambda t: t["key"])
    ordered = (found.withColumn("_order", keys).repartitionByRange(parts, "_order", "conv_id").sortWithinPartitions("_order", "conv_id")
               .select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "conv_id", "turns"))
    ordered = cut_lineage(ordered)

    # one row per part: its outermost conversations, and how far they agree with their neighbours
    outer = ordered.groupBy("part").agg(F.min_by("turns", "at").alias("head"), F.max_by("turns", "at").alias("tail"))
    along = W.orderBy("part")
    edges = cut_lineage(outer.select("part", _agreement(F.col("head"), F.lag("tail").over(along)).alias("before"),
                                     _agreement(F.col("tail"), F.lead("head").over(along)).alias("after")))
    partial = cut_lineage(ordered.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(_partials, PARTIAL))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    digests = (partial.where("ends != ''").select("prefix", "part", "ends").repartition("prefix").sortWithinPartitions("prefix", "part")
               .select("prefix", "ends").mapInArrow(_joined_ends, "prefix binary, ends_sha256 string"))
    totals = (partial.groupBy("prefix").agg(F.min("low").alias("low"), *sums).join(digests, "prefix", "left")
              .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))))
    known = edges.join(partial.select("part", "prefix").join(totals, "prefix"), "part", "left")
    return ordered.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_part_nodes, NODES)
