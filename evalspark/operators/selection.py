"""Row selection, resume and merge: anti joins, stratified picks, positions, set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.operators.ordered import int_chunk, with_neighbours, with_position


def only_ids(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a named id, and the named ids that no row has."""
    return rows.join(ids, "sample_id", "left_semi"), ids.join(rows, "sample_id", "left_anti")


def without_ids(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a named id, and the ids that were dropped."""
    return rows.join(ids, "sample_id", "left_anti"), rows.join(ids, "sample_id", "left_semi").select("sample_id")


def split_empty_retrieval(rows: DataFrame, external: Column) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and external rows whose memory list is empty with the reason."""
    empty = F.coalesce(external & (F.size("retrieved_memories") == 0), F.lit(False))
    excluded = rows.where(empty).select("sample_id", "task", F.lit("empty_retrieval").alias("reason"))
    return rows.where(~empty), excluded


def pending(rows: DataFrame, *done: DataFrame) -> DataFrame:
    """Rows whose id no earlier attempt finished, whatever shard or store it went to."""
    finished = done[0].select("sample_id")
    for other in done[1:]:
        finished = finished.unionByName(other.select("sample_id"))
    return rows.join(finished, "sample_id", "left_anti")


def newest_part(rows: DataFrame, keys: list[str], priority: list[str]) -> DataFrame:
    """One row per sample by the largest priority tuple, with the number of copies.

    ``max_by`` combines map-side, so a sample copied into every shard costs one row per
    task instead of a sorted group.
    """
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*priority)).alias("_r"), F.count(F.lit(1)).alias("copies")
    ).select(*keys, "_r.*", "copies")


def duplicate_audit(rows: DataFrame, keys: list[str], priority: list[str], shard: str, examples: int = 20) -> DataFrame:
    """Kept and replaced shard of duplicated samples; ``examples`` bounds the report."""
    rank = F.struct(*priority)
    grouped = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), F.max_by(shard, rank).alias("kept_shard"),
        F.min_by(shard, rank).alias("oldest_shard"))
    return grouped.where("copies > 1").orderBy(*keys).limit(examples)


def merge_finished(expected: DataFrame, existing: DataFrame, cached: DataFrame) -> DataFrame:
    """Existing and cached records against the expected ids; an existing record wins.

    ``status`` is ``merged``, ``missing`` (expected, no record) or ``unexpected``.
    """
    records = existing.withColumn("_rank", F.lit(1)).unionByName(cached.withColumn("_rank", F.lit(0)))
    rest = [c for c in existing.columns if c != "sample_id"]
    best = records.groupBy("sample_id").agg(
        F.max_by(F.struct(*rest), "_rank").alias("_r"), F.max("_rank").alias("_rank"),
        F.count(F.lit(1)).alias("record_count"))
    joined = expected.select("sample_id", "position").join(best, "sample_id", "full")
    status = (F.when(F.col("position").isNull(), "unexpected").when(F.col("_rank").isNull(), "missing")
              .otherwise("merged"))
    return joined.select("sample_id", "position", "_r.*", status.alias("status"),
                         F.when(F.col("_rank") == 1, "existing").when(F.col("_rank") == 0, "cache").alias("origin"))


def overlapping_ids(existing: DataFrame, cached: DataFrame) -> DataFrame:
    return existing.select("sample_id").intersect(cached.select("sample_id"))


def unexpected_ids(found: DataFrame, expected: DataFrame) -> DataFrame:
    return found.select("sample_id").distinct().join(expected, "sample_id", "left_anti")


def mergeable_cache(cached: DataFrame, merged: DataFrame, columns: list[str]) -> DataFrame:
    """Cached rows to keep: those not yet merged, or merged with different content."""
    def digest(df: DataFrame) -> DataFrame:
        return df.withColumn("_digest", F.sha2(F.to_json(F.struct(*columns)), 256))
    return (digest(cached).join(digest(merged).select("sample_id", "_digest"), ["sample_id", "_digest"], "left_anti")
            .drop("_digest"))


def stratified(rows: DataFrame, per_task: int, position: str, seed: int | None = None, max_position: int = 1 << 16) -> DataFrame:
    """First, or seeded, ``per_task`` rows of every task.

    Seeded picks order by ``md5(seed:id)``. The rank filter prunes inside each map task,
    so a task with most of the rows ships only ``per_task`` of them per task.
    """
    from pyspark.sql import Window as W

    key = F.col(position) if seed is None else F.md5(F.concat(F.lit(f"{seed}:"), F.col("sample_id").cast("string")))
    order = W.partitionBy("task").orderBy(key, F.col(position))
    return rows.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= per_task)


def short_strata(tasks: DataFrame, rows: DataFrame, per_task: int) -> DataFrame:
    """Tasks with fewer rows than asked for."""
    counts = rows.groupBy("task").agg(F.count(F.lit(1)).alias("available"))
    return (tasks.select("task").join(counts, "task", "left")
            .select("task", F.coalesce("available", F.lit(0)).alias("available")).where(F.col("available") < per_task))


def eligible_ids(methods: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Ids with an output *and* a valid judgement in every method.

    ``methods`` holds ``(outputs(sample_id), judged(sample_id, passed))``.
    """
    result = None
    for outputs, judged in methods:
        valid = judged.where("passed IS NOT NULL").select("sample_id")
        available = outputs.select("sample_id").join(valid, "sample_id", "left_semi")
        result = available.distinct() if result is None else result.join(available, "sample_id", "left_semi")
    return result


def duplicate_ids(rows: DataFrame, order: str) -> DataFrame:
    """Repeated ids with the position of their second occurrence (first-repeat order).

    Two combinable minima replace a sort of each group: the first position, then the
    lowest one above it.
    """
    first = rows.groupBy("sample_id").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = rows.join(first, "sample_id").where(F.col(order) > F.col("_first"))
    return later.groupBy("sample_id").agg(F.first("copies").alias("copies"), F.min(order).alias("second_position"))


def first_divergence(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered-prefix check: first position where ``left`` differs from ``right``.

    Both carry ``position`` (1-based) and ``sample_id``. NULL means a clean prefix.
    """
    joined = left.join(right.withColumnRenamed("sample_id", "_right"), [*keys, "position"], "left")
    differs = ~F.col("sample_id").eqNullSafe(F.col("_right"))
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.when(differs, F.col("position"))).alias("first_divergence"))


def first_out_of_order(rows: DataFrame, keys: list[str], position: str, value: str, chunk: int = 65536) -> DataFrame:
    """First position whose value is below the one before it, per key; NULL when sorted."""
    linked = with_neighbours(rows.select(*keys, position, value), keys, [position], int_chunk(F.col(position), chunk), [value])
    return linked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.when(F.col(f"prev.{value}") > F.col(value), F.col(position))).alias("first_out_of_order"))


def shard_of(row_index: Column, total: Column, shards: int) -> Column:
    """Contiguous shard of a 1-based row number, ``ceil(total / shards)`` rows each."""
    return F.floor((row_index - 1) / F.ceil(total / F.lit(shards))).cast("int")


def dense_row_index(rows: DataFrame, order: str, chunk: int = 65536) -> DataFrame:
    """1-based dense row number along an integer order column, without a one-task window."""
    return with_position(rows, [], [order], int_chunk(F.col(order), chunk), "row_index")


def same_id_set(proposed: Column, known: Column) -> Column:
    """Exact id-set equality of two arrays with no duplicates in the proposed one."""
    return ((F.size(F.array_distinct(proposed)) == F.size(proposed))
            & (F.size(F.array_except(proposed, known)) == 0) & (F.size(F.array_except(known, proposed)) == 0))


def overlay_empty(original: DataFrame, replacements: DataFrame, memories: str = "retrieved_memories") -> DataFrame:
    """Replace only rows whose memory list was empty; ``changed`` says which rows differ.

    Both frames share their columns; ``replacements`` has one row per sample.
    """
    rest = [c for c in original.columns if c != "sample_id"]
    joined = original.select("sample_id", F.struct(*rest).alias("_old")).join(
        replacements.select("sample_id", F.struct(*rest).alias("_new")), "sample_id", "left")
    empty = F.size(F.col("_old")[memories]) == 0
    swap = empty & F.col("_new").isNotNull()
    row = F.when(swap, F.col("_new")).otherwise(F.col("_old"))

    def digest(c: Column) -> Column:
        return F.sha2(F.to_json(c), 256)

    out = joined.select("sample_id", row.alias("_row"), empty.alias("was_empty"), swap.alias("replaced"),
                        (digest(row) != digest(F.col("_old"))).alias("changed"))
    return out.select("sample_id", "_row.*", "was_empty", "replaced", "changed")


def id_drift(records: DataFrame, source: DataFrame) -> DataFrame:
    """Records whose source row (by ``row_index``) is absent or carries another id."""
    joined = records.select("row_index", "sample_id").join(
        source.select("row_index", F.col("sample_id").alias("source_id")), "row_index", "left")
    return joined.where(~F.col("sample_id").eqNullSafe(F.col("source_id"))).withColumn(
        "problem", F.when(F.col("source_id").isNull(), "sample absent").otherwise("id drift"))


def select_cells(cells: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Cells whose columns are in the given comma lists; an empty list keeps everything."""
    for column, names in filters.items():
        wanted = [n.strip() for n in names.split(",") if n.strip()]
        if wanted:
            cells = cells.where(F.col(column).isin(*wanted))
    return cells
