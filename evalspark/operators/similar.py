"""Exact similar-entry search inside a store, without scoring every pair or emitting any.

1. Equal vectors collapse to one, keeping their lowest ordinals: a store made mostly of
   copies costs as much as its distinct vectors.
2. Distinct vectors go into a metric tree (``metric_tree.py``) whose leaves are blocks of
   bounded size. Walking it in pairs leaves the pairs of blocks whose balls are close enough.
   Neighbouring blocks form groups of bounded size.
3. Every group is searched by itself first. From then on a vector that has ``keep + 1`` hits has a
   floor: only scores that reach the lowest of them count.
4. Pairs of groups with close blocks are tiles, worked on once for both directions. In a tile a vector
   meets only the blocks whose balls lie within the angle of its floor, in single precision first;
   what may reach the floor is scored in double precision. A tile returns at most ``keep + 1``
   rows per vector.
Pivots, groups and floors affect speed only, never results.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evalspark.functions.vectors import l2_normalize
from evalspark.operators.metric_tree import SLACK, Tree, close_blocks, grow
from evalspark.session import cut_lineage

#: Blocks' worth of vectors in a group.
GROUP = 16
#: Rows that are scored at a time.
SLICE = 1024
#: Candidates per row of a slice that are scored one by one; where more pass, the slice is scored whole.
ROOM = 32
TILE = ["store_id", "home", "guest"]
HIT_SCHEMA = "store_id {store}, uid {ordinal}, member {ordinal}, score double"


def _best_of_slice(own: np.ndarray, others: np.ndarray, floor: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs scored in double precision; ``keep + 1`` a row, a lower column first."""
    scores = np.round(own @ others.T, 9)
    if keep + 1 < scores.shape[1]:
        floor = np.maximum(floor, np.partition(scores, -(keep + 1), axis=1)[:, -(keep + 1)])
    above = scores > floor[:, None]
    level = scores == floor[:, None]
    level &= np.cumsum(level, axis=1) <= (keep + 1 - above.sum(axis=1))[:, None]
    rows, columns = np.nonzero(above | level)
    return rows, columns, scores[rows, columns]


def _reaching(own: np.ndarray, others: np.ndarray, floor: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the pairs that reach the row's floor; the ``keep + 1`` best of a row are among them."""
    found = []
    rough = others.astype(np.float32)
    # what single precision can lose in a sum of products
    slack = 1.2e-7 * (others.shape[1] + 8)
    for start in range(0, len(own), SLICE):
        part, low = own[start:start + SLICE], floor[start:start + SLICE]
        rows, columns = np.nonzero(part.astype(np.float32) @ rough.T >= (low - slack).astype(np.float32)[:, None])
        if len(rows) > ROOM * len(part):
            rows, columns, scores = _best_of_slice(part, others, low, keep)
        else:
            scores = np.round(np.einsum("ij,ij->i", part[rows], others[columns]), 9)
        enough = scores >= low[rows]
        found.append((rows[enough] + start, columns[enough], scores[enough]))
    return tuple(np.concatenate(column) for column in zip(*found))


class _Block:
    """A block's vectors in ordinal order, their floors and their best hits so far."""

    def __init__(self, ranks: np.ndarray, vectors: np.ndarray, floor: np.ndarray) -> None:
        order = np.argsort(ranks)
        self.ranks, self.vectors, self.floor = ranks[order], vectors[order], floor[order]
        middle = vectors.sum(axis=0)
        length = np.linalg.norm(middle)
        self.centre = middle / length if length else self.vectors[0]
        self.radius = self._angles(self.centre).max()
        self.rows, self.members, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def _angles(self, centre: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(self.vectors @ centre, -1.0, 1.0))

    def meet(self, other: _Block, keep: int) -> None:
        """Hits of this block's vectors among another's."""
        reach = np.arccos(np.clip(self.floor - 1e-9, -1.0, 1.0))
        close = np.flatnonzero(self._angles(other.centre) <= other.radius + reach + SLACK)
        if not len(close):
            return
        rows, columns, scores = _reaching(self.vectors[close], other.vectors, self.floor[close], keep)
        if not len(rows):
            return
        rows = np.concatenate([self.rows, close[rows]])
        members, scores = np.concatenate([self.members, other.ranks[columns]]), np.concatenate([self.scores, scores])
        order = np.lexsort((members, -scores, rows))
        rows, members, scores = rows[order], members[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        full = place == keep
        self.floor[rows[full]] = np.maximum(self.floor[rows[full]], scores[full])
        kept = place <= keep
        self.rows, self.members, self.scores = rows[kept], members[kept], scores[kept]


def _blocks(frames: list[pd.DataFrame]) -> tuple[np.ndarray, list[list[_Block]]]:
    """The ordinals of all frames in order, and the blocks of each frame; a block knows its ordinals by their place."""
    uids, ranks = np.unique(np.concatenate([frame["uid"].to_numpy() for frame in frames]), return_inverse=True)
    out, start = [], 0
    for frame in frames:
        own, start = ranks[start:start + len(frame)], start + len(frame)
        vectors, floor = np.stack(frame["vector"]), frame["floor"].to_numpy(dtype=np.float64)
        places = frame.groupby(["leaf", "part"], sort=True).indices.values()
        out.append([_Block(own[at], vectors[at], floor[at]) for at in places])
    return uids, out


def _hits(store, uids: np.ndarray, blocks: Iterable[_Block]) -> pd.DataFrame:
    parts = [pd.DataFrame({"store_id": store, "uid": uids[b.ranks[b.rows]], "member": uids[b.members], "score": b.scores})
             for b in blocks if len(b.rows)]
    return pd.concat(parts) if parts else pd.DataFrame({"store_id": [], "uid": [], "member": [], "score": []}, dtype=object)


def _best_of_group(keep: int):
    def best(members: pd.DataFrame) -> pd.DataFrame:
        uids, (blocks,) = _blocks([members])
        for own in blocks:
            own.meet(own, keep)
        for own in blocks:
            for other in blocks:
                if other is not own:
                    own.meet(other, keep)
        return _hits(members["store_id"].iloc[0], uids, blocks)
    return best


def _best_of_tile(keep: int):
    def best(home: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        if home.empty or guests.empty:  # a part that the hash gave no row
            return _hits(None, np.empty(0), [])
        uids, (left, right) = _blocks([home, guests])
        for own, others in ((left, right), (right, left)):
            for block in own:
                for other in others:
                    block.meet(other, keep)
        return _hits(home["store_id"].iloc[0], uids, left + right)
    return best


def _close_hits(tree: Tree, threshold: float, keep: int, block: int, schema: str) -> DataFrame:
    """At most ``keep + 1`` rows per vector, from its group and from each tile; a vector is among its own."""
    reach = float(np.arccos(np.clip(threshold - 1e-9, -1.0, 1.0)))
    place = ["store_id", "leaf", "part"]
    # over blocks, not rows; neighbours in the tree stand side by side
    before = F.sum("n").over(W.partitionBy("store_id").orderBy("leaf", "part")) - F.col("n")
    groups = cut_lineage(tree.rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).select(
        *place, F.floor(before / (GROUP * block)).alias("group")))
    grouped = tree.rows.join(groups, place)
    own = cut_lineage(grouped.withColumn("floor", F.lit(float(threshold))).groupBy("store_id", "group").applyInPandas(_best_of_group(keep), schema))

    def side(name: str) -> DataFrame:
        return groups.select("store_id", F.col("leaf").alias(name), F.col("part").alias(f"{name}_part"), F.col("group").alias(f"{name}_group"))
    pairs = close_blocks(tree, reach).join(side("a"), ["store_id", "a", "a_part"]).join(side("b"), ["store_id", "b", "b_part"])
    apart = pairs.where(F.col("a_group") != F.col("b_group")).withColumns(
        {"home": F.least("a_group", "b_group"), "guest": F.greatest("a_group", "b_group")})
    visits = cut_lineage(apart.select("store_id", "home", "guest", F.explode(F.array(*[
        F.struct(F.col(c).alias("leaf"), F.col(f"{c}_part").alias("part"), F.col(f"{c}_group").alias("group")) for c in "ab"])).alias("v")
    ).select(*TILE, "v.*").distinct())
    if visits.isEmpty():
        return own
    floors = own.groupBy("store_id", "uid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == keep + 1)
    rows = cut_lineage(tree.rows.join(floors.drop("n"), ["store_id", "uid"], "left").withColumn("floor", F.coalesce("floor", F.lit(float(threshold)))))

    def shipped(where: str) -> DataFrame:
        # named anew: both sides of the cogroup come from the same rows
        sent = rows.join(visits.where(F.col("group") == F.col(where)), place)
        return sent.select(*[F.col(c).alias(c) for c in [*TILE, "leaf", "part", "uid", "vector", "floor"]])
    across = shipped("home").groupBy(*TILE).cogroup(shipped("guest").groupBy(*TILE)).applyInPandas(_best_of_tile(keep), schema)
    return own.unionByName(across)


def similar_entries(entries: DataFrame, threshold: float = 0.8, keep: int = 10, pivots: int = 32,
                    block: int = 2048) -> DataFrame:
    """The ``keep`` most similar other entries of each entry with cosine >= ``threshold``.

    ``entries(store_id, ordinal, vector)``; zero vectors have no direction and no
    neighbours. A node of the tree is split around at most ``pivots`` of its vectors, a block
    holds about ``block``. Ranks are by score (nine digits), then ordinal. Result:
    ``store_id, ordinal, other, score, rank``.
    """
    # written once: the vectors may come from an embedding model
    unit = cut_lineage(entries.select("store_id", "ordinal", l2_normalize(F.col("vector")).alias("vector")))
    unit = unit.where(F.exists("vector", lambda x: x != 0))
    copies = unit.withColumn("_n", F.row_number().over(W.partitionBy("store_id", "vector").orderBy("ordinal")))
    # keep + 1 ordinals of a set of copies are enough for any entry's own list
    distinct = cut_lineage(
        copies.where(F.col("_n") <= keep + 1).groupBy("store_id", "vector")
        .agg(F.array_sort(F.collect_list("ordinal")).alias("ordinals")).withColumn("uid", F.col("ordinals")[0]))

    kinds = dict(entries.dtypes)
    schema = HIT_SCHEMA.format(store=kinds["store_id"], ordinal=kinds["ordinal"])
    hits = _close_hits(grow(distinct.select("store_id", "uid", "vector"), block, max(pivots, 2)), threshold, keep, block, schema)

    best = W.partitionBy("store_id", "uid").orderBy(F.col("score").desc(), "member")
    top = hits.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep + 1)
    expanded = top.join(distinct.select("store_id", F.col("uid").alias("member"), "ordinals"), ["store_id", "member"]).select(
        "store_id", "uid", "score", F.explode("ordinals").alias("other"))
    ranked = W.partitionBy("store_id", "uid").orderBy(F.col("score").desc(), "other")
    candidates = expanded.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= keep + 1).drop("_r")

    named = unit.join(distinct.select("store_id", "vector", "uid"), ["store_id", "vector"]).select("store_id", "ordinal", "uid")
    own = W.partitionBy("store_id", "ordinal").orderBy(F.col("score").desc(), "other")
    return (named.join(candidates, ["store_id", "uid"]).where(_different("ordinal", "other"))
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= keep)
            .select("store_id", "ordinal", "other", "score", "rank"))


def _different(left: str, right: str) -> Column:
    return F.col(left) != F.col(right)
