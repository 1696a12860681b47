"""A metric tree over unit vectors, grown and walked as Spark jobs.

*Growing*: every node with more rows than a block is split around pivots of its own until
it fits, one job per level. Pivots are the node's rows with the lowest hashes, found by a
ranked window that keeps a few rows per map task; vectors meet them in chunks of bounded
size, so a node of any size is split by many tasks.

*Walking*: pairs of nodes start at the roots and go down one level at a time. A pair whose
balls lie further apart than the sum of both radii and the reach has no close vectors, by
the triangle inequality on angles, and none of its descendants is looked at.

A node that ``LEVELS`` splits did not bring below a block is cut by hash: its parts share
its ball, so the walk stays exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evalspark.functions.vectors import cosine
from evalspark.session import cut_lineage

ROOT = ""
LEVELS = 16
CHUNK = 4096
# floating-point slack of an angle near zero
SLACK = 1e-5


@dataclass
class Tree:
    """``rows(store_id, uid, vector, leaf, part)`` and the nodes of every level.

    ``levels[i]`` holds ``store_id, above, node, centre, radius``: the nodes below ``above``
    after split ``i``; a node that was not split stands below itself. ``parts(store_id, leaf,
    parts)`` says into how many parts a leaf is cut.
    """

    rows: DataFrame
    levels: list[DataFrame]
    parts: DataFrame


def _split(centres: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Each row of a chunk under its nearest centre, ties to the first."""
    if rows.empty or centres.empty:
        return pd.DataFrame({"store_id": [], "uid": [], "vector": [], "node": [], "angle": []}, dtype=object)
    centres = centres.sort_values("rank")
    vectors = np.stack(rows["vector"])
    angles = np.arccos(np.clip(vectors @ np.stack(centres["centre"]).T, -1.0, 1.0))
    best = angles.argmin(axis=1)
    return pd.DataFrame({"store_id": rows["store_id"], "uid": rows["uid"], "vector": rows["vector"],
                         "node": centres["child"].to_numpy()[best], "angle": angles[np.arange(len(best)), best]})


def _choose_centres(rows: DataFrame, big: DataFrame, level: int, fanout: int, block: int) -> DataFrame:
    """Up to ``fanout`` rows of every node to be split, twice as many as blocks it fills."""
    lowest = W.partitionBy("store_id", "node").orderBy(F.xxhash64("uid", F.lit(level)), "uid")
    ranked = rows.withColumn("rank", F.row_number().over(lowest)).where(F.col("rank") <= fanout)
    wanted = F.greatest(F.lit(2), F.ceil(2 * F.col("n") / block))
    return ranked.join(big, ["store_id", "node"]).where(F.col("rank") <= wanted).select(
        "store_id", "node", "rank", F.col("vector").alias("centre"), "chunks",
        F.concat("node", F.lit("/"), F.col("rank").cast("string")).alias("child"))


def grow(vectors: DataFrame, block: int, fanout: int) -> Tree:
    """The tree of ``vectors(store_id, uid, vector)``, distinct unit vectors per store."""
    kinds = dict(vectors.dtypes)
    schema = f"store_id {kinds['store_id']}, uid {kinds['uid']}, vector array<double>, node string, angle double"
    pending = vectors.select("store_id", "uid", "vector", F.lit(ROOT).alias("node"))
    roots = vectors.select("store_id").distinct().select(
        "store_id", F.lit(ROOT).alias("above"), F.lit(ROOT).alias("node"), F.lit(None).cast("array<double>").alias("centre"),
        F.lit(0.0).alias("radius"))
    leaves, levels, standing = [], [], cut_lineage(roots)
    for level in range(LEVELS):
        sizes = pending.groupBy("store_id", "node").agg(F.count(F.lit(1)).alias("n"))
        big = cut_lineage(sizes.where(F.col("n") > block).withColumn("chunks", F.ceil(F.col("n") / CHUNK)))
        if big.isEmpty():
            break
        leaves.append(pending.join(big, ["store_id", "node"], "left_anti"))
        centres = cut_lineage(_choose_centres(pending, big, level, fanout, block))
        dealt = pending.join(big, ["store_id", "node"]).withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")))
        spread = centres.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        keys = ["store_id", "node", "chunk"]
        pending = cut_lineage(spread.groupBy(*keys).cogroup(dealt.drop("n", "chunks").groupBy(*keys)).applyInPandas(_split, schema))

        radii = pending.groupBy("store_id", "node").agg(F.max("angle").alias("radius"))
        born = centres.select("store_id", F.col("node").alias("above"), F.col("child").alias("node"), "centre").join(
            radii, ["store_id", "node"]).select("store_id", "above", "node", "centre", "radius")
        unsplit = standing.join(big.select("store_id", "node"), ["store_id", "node"], "left_anti")
        standing = cut_lineage(born.unionByName(unsplit.select("store_id", F.col("node").alias("above"), "node", "centre", "radius")))
        levels.append(standing)
        pending = pending.drop("angle")
    leaves.append(pending)

    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    parts = cut_lineage(rows.groupBy("store_id", F.col("node").alias("leaf")).agg(
        F.ceil(F.count(F.lit(1)) / block).alias("parts")))
    placed = rows.withColumnRenamed("node", "leaf").join(parts, ["store_id", "leaf"])
    part = F.pmod(F.xxhash64("uid"), F.col("parts"))
    return Tree(cut_lineage(placed.select("store_id", "uid", "vector", "leaf", part.alias("part"))), levels, parts)


def within(left: Column, right: Column, bound: Column) -> Column:
    """Whether two unit vectors lie within an angle; true where both are missing."""
    near = F.acos(F.least(F.greatest(cosine(left, right), F.lit(-1.0)), F.lit(1.0))) <= bound + SLACK
    return left.isNull() | near


def close_leaves(tree: Tree, reach: float) -> DataFrame:
    """Pairs of leaves that can hold vectors within ``reach``, each pair once.

    ``store_id, a, b, centre, radius``: the ball is the one of ``a``; ``a = b`` is among them.
    """
    pairs = tree.parts.select("store_id").distinct().select(
        "store_id", F.lit(ROOT).alias("a"), F.lit(ROOT).alias("b"),
        F.lit(None).cast("array<double>").alias("centre"), F.lit(0.0).alias("radius"))
    for level in tree.levels:
        left, right = (level.select("store_id", F.col("above").alias(side), F.col("node").alias(f"{side}_node"),
                                    F.col("centre").alias(f"{side}_centre"), F.col("radius").alias(f"{side}_radius")) for side in "ab")
        below = pairs.select("store_id", "a", "b").join(left, ["store_id", "a"]).join(right, ["store_id", "b"])
        once = below.where((F.col("a") != F.col("b")) | (F.col("a_node") <= F.col("b_node")))
        bound = F.col("a_radius") + F.col("b_radius") + reach
        near = (F.col("a_node") == F.col("b_node")) | within(F.col("a_centre"), F.col("b_centre"), bound)
        pairs = cut_lineage(once.where(near).select(
            "store_id", F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_centre").alias("centre"), F.col("a_radius").alias("radius")))
    return pairs


def close_blocks(tree: Tree, reach: float) -> DataFrame:
    """``close_leaves`` with the parts of both: ``a, a_part, b, b_part``, each pair once."""
    def parts(side: str) -> DataFrame:
        number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
        return tree.parts.select("store_id", F.col("leaf").alias(side), number.alias(f"{side}_part"))

    pairs = close_leaves(tree, reach).join(parts("a"), ["store_id", "a"]).join(parts("b"), ["store_id", "b"])
    return pairs.where((F.col("a") != F.col("b")) | (F.col("a_part") <= F.col("b_part")))
