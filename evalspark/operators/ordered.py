"""Order-dependent operators that never put one key's rows into one task.

A plain window sorts a whole key in one task. Here every key is cut into chunks of its
order column: the inner work happens per (key, chunk), and only one summary row per
chunk is windowed over the key. A key with a third of all rows is spread over as many
tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Positions per chunk for dense integer orders, and chunks per block of totals.
CHUNK = 65536
BLOCK = 4096


def int_chunk(position: Column, size: int = CHUNK) -> Column:
    return F.floor(position / F.lit(size)).cast("bigint")


def time_chunk(ts: Column, seconds: int = 60) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds)).cast("bigint")


def _keyed_window(keys: Sequence[str], order: Column) -> W:
    return (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(order)


def with_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                    payload: Sequence[str], previous: str = "prev", following: str = "next") -> DataFrame:
    """Add structs of ``payload`` taken from the previous and the next row of the key.

    Only the first and last row of a chunk lack a neighbour inside it. Those edge rows
    (two per chunk) are windowed again over the key, where the row before a chunk's
    first is the last of the chunk before; all other rows are complete. Both branches
    read one shuffle.
    """
    rows = df.withColumn("_chunk", chunk).withColumn("_row", F.struct(*payload))
    inner = W.partitionBy(*keys, "_chunk").orderBy(*order)
    rows = rows.withColumn(previous, F.lag("_row").over(inner)).withColumn(following, F.lead("_row").over(inner))
    at_edge = F.col(previous).isNull() | F.col(following).isNull()
    outer = W.partitionBy(*keys).orderBy("_chunk", *order)
    edges = rows.where(at_edge).withColumns({
        previous: F.coalesce(previous, F.lag("_row").over(outer)),
        following: F.coalesce(following, F.lead("_row").over(outer))})
    return rows.where(~at_edge).unionByName(edges).drop("_chunk", "_row")


def with_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                     value: Column, name: str) -> DataFrame:
    """Add the inclusive running sum of ``value`` along the key's order.

    Chunk totals are summed in blocks of ``BLOCK`` chunks, and only block totals are windowed
    over the key, so no task holds more than a chunk, a block, or one row per block.
    """
    df = df.withColumn("_chunk", chunk).withColumn("_v", value)
    inner = (W.partitionBy(*keys, "_chunk").orderBy(*order)
             .rowsBetween(W.unboundedPreceding, W.currentRow))
    totals = df.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_t"))
    totals = totals.withColumn("_block", int_chunk(F.col("_chunk"), BLOCK))
    blocks = totals.groupBy(*keys, "_block").agg(F.sum("_t").alias("_b"))
    before = _keyed_window(keys, F.col("_block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy(*keys, "_block").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = (totals.withColumn("_in", F.coalesce(F.sum("_t").over(within), F.lit(0))).join(blocks, [*keys, "_block"])
              .select(*keys, "_chunk", (F.col("_in") + F.col("_base")).alias("_offset")))
    return (
        df.withColumn(name, F.sum("_v").over(inner))
        .join(totals, [*keys, "_chunk"])
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_chunk", "_v", "_offset")
    )


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                  name: str = "position") -> DataFrame:
    """Add the 1-based dense position of every row along the key's order."""
    return with_running_sum(df, keys, order, chunk, F.lit(1).cast("bigint"), name)


#: Buckets of a refinement pass, magnitude classes of a factor of two, passes after the
#: first: doubles of one class need 47 bits, three passes resolve 48.
BUCKETS = 1 << 16
CLASSES = 64
PASSES = 3
#: Parts that a key's distinct values are dealt over when they meet the key's targets.
SALTS = 16


def _magnitude(x: Column) -> Column:
    """A class that never falls while ``x`` rises: sign and logarithm, infinities and NaN outermost."""
    size = F.floor(F.log2(F.abs(x)) * CLASSES).cast("int") + 70000
    infinity = F.lit(float("inf"))
    return (F.when(F.isnan(x), F.lit(200000)).when(x == 0, F.lit(0)).when(x == infinity, F.lit(150000))
            .when(x == -infinity, F.lit(-150000)).otherwise(F.when(x > 0, size).otherwise(-size)))


def _rank_within(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_below``, the values in buckets before this one. A key has a bounded number of buckets."""
    before = _keyed_window(keys, F.col("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_below", F.coalesce(F.sum("_c").over(before), F.lit(0)))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probabilities: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact order statistics per key without collecting or sorting a key's values.

    ``probabilities`` maps output names to ``("disc", p)`` (nearest rank) or ``("cont", p)``
    (linear interpolation, 0.5 is the median). Equal values become one row with a count. The
    first pass counts them by sign and magnitude class and keeps, per wanted rank, the class
    that holds it and the rank inside; every further pass cuts the range between the least
    and greatest value found there into ``BUCKETS`` equal parts and counts again, until one double
    is left. Counts combine map-side, windows see buckets only (at most ``BUCKETS``, 280,000
    classes in the first pass), buckets cover the whole range, so no rank can be missed, and keys of
    every size take the same path. NULL values are left out, NaN counts as greatest, a key
    without a value has no row; NULL is a key of its own.
    """
    keyed = [f"_k_{k}" for k in keys]
    values = (df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
              .groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")))
    bounds = [F.sum("_c").alias("_c"), F.min("_x").alias("low"), F.max("_x").alias("high")]
    classes = _rank_within(values.groupBy(*keys, _magnitude(F.col("_x")).alias("_bucket")).agg(*bounds), keys)
    everything = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0)))
    classes = classes.withColumn("_n", F.sum("_c").over(everything))
    n, wanted = F.col("_n"), []
    for name, (kind, p) in probabilities.items():
        if kind == "disc":
            ranks, weight = [F.greatest(F.ceil(n * p), F.lit(1))], F.lit(0.0)
        else:
            first = F.floor((n - 1) * p) + 1
            ranks, weight = [first, F.least(first + 1, n)], (n - 1) * p - F.floor((n - 1) * p)
        wanted += [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), weight.cast("double").alias("weight"),
                            rank.cast("bigint").alias("rank")) for side, rank in enumerate(ranks)]
    place = ["name", "side", "weight"]
    targets = classes.select(*keys, "_c", "_below", "low", "high", F.inline(F.array(*wanted)))
    for done in range(PASSES + 1):
        here = (F.col("rank") > F.col("_below")) & (F.col("rank") <= F.col("_below") + F.col("_c"))
        targets = targets.where(here).select(*keys, *place, (F.col("rank") - F.col("_below")).alias("rank"), "low", "high")
        if done == PASSES:
            break
        # one small row per key holds all its targets; salted, so that a hot key's values stay apart
        packed = targets.groupBy(*keys).agg(F.collect_list(F.struct(*place, "rank", "low", "high")).alias("_t")).select(
            *[F.col(k).alias(c) for k, c in zip(keys, keyed)], "_t",
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_k_salt"))
        met = F.pmod(F.hash("_x"), F.lit(SALTS)) == F.col("_k_salt")
        for k, c in zip(keys, keyed):
            met = met & F.col(k).eqNullSafe(F.col(c))
        x = F.col("_x")
        inside = values.join(packed, met).select(*keys, "_x", "_c", F.inline(
            F.filter("_t", lambda t: x.between(t["low"], t["high"]))))
        part = F.floor((x - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS).cast("int")
        bucket = F.when(F.col("low") == F.col("high"), F.lit(0)).otherwise(part)
        counted = (inside.withColumn("_bucket", bucket).groupBy(*keys, *place, "rank", "_bucket").agg(*bounds))
        targets = _rank_within(counted, [*keys, *place, "rank"])
    outputs = []
    for name in probabilities:
        def side(i: int, name: str = name) -> Column:
            return F.max(F.when((F.col("name") == name) & (F.col("side") == i), F.col("low")))
        weight = F.max(F.when(F.col("name") == name, F.col("weight")))
        outputs.append(F.when(weight > 0, side(0) + (side(1) - side(0)) * weight).otherwise(side(0)).alias(name))
    return targets.groupBy(*keys).agg(*outputs)
