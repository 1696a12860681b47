"""Sinks: appends, ordered rewrites, reports, snapshots, persisted indexes.

Spark's commit protocol makes each write all-or-nothing, so no temporary-file dance is
needed. Tables are partitioned by the cell, which is also the pruning key of every reader.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from evalspark.sources.files import all_lines

# The columns that identify a cell's folder.
CELL = ["dataset", "subset", "system", "arm", "run_index"]


def append_records(rows: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Append records under the cell layout."""
    rows.write.mode("append").partitionBy(*(CELL if keys is None else keys)).parquet(path)


def append_failures(rows: DataFrame, path: str) -> None:
    """Append one row per failed sample; the ledger sits beside, never inside, the records."""
    rows.withColumn("recorded_at", F.current_timestamp()).write.mode("append").json(path)


def rewrite_ordered(rows: DataFrame, path: str, order: list[str]) -> None:
    """Replace a table by its rows in total order: a range shuffle, one sorted file per range."""
    rows.orderBy(*order).write.mode("overwrite").json(path)


def write_sorted(rows: DataFrame, path: str, order: list[str], part_rows: int = 200_000) -> str:
    """Replace a sorted table: ranges of ``order`` as parts whose names ascend, published whole.

    The parts go to a folder of their own; the mark that names it is written last, so a reader sees the old
    table or the new one. Returns the version's folder.
    """
    version = uuid.uuid4().hex
    parts = max(1, -(-rows.count() // part_rows))
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.json(f"{path}/versions/{version}")
    mark = rows.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
    mark.coalesce(1).write.mode("append").parquet(f"{path}/marks")
    return f"{path}/versions/{version}"


def read_sorted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the newest published version with their 1-based ``position`` in the total order.

    Positions are lines before a part plus the line's number in it; parts may be cut like any text.
    """
    version = spark.read.parquet(f"{path}/marks").agg(F.max_by("version", "published_at").alias("v")).first().v
    lines = all_lines(spark, f"{path}/versions/{version}")
    sizes = lines.groupBy("file_name").agg(F.max("line_number").alias("_n"))
    before = W.orderBy("file_name").rowsBetween(W.unboundedPreceding, -1)  # one row per part
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(sizes, "file_name").select((F.col("line_number") + F.col("_before")).alias("position"), F.from_json("value", schema).alias("_r")).select("position", "_r.*")


def write_report_csv(frames: list[DataFrame], path: str) -> None:
    """CSV with a header equal to the sorted union of all columns."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    union.select(*sorted(union.columns)).write.mode("overwrite").option("header", True).csv(path)


def table_digest(rows: DataFrame) -> tuple[int, str]:
    """Row count and an order-free digest of a table's rows, as one combinable aggregate."""
    line = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(38,0)")
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(line).alias("s"), F.bit_xor(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns))))).alias("x")).first()
    return int(one["n"]), f"{one['s']}:{one['x']}"


def snapshot_once(rows: DataFrame, path: str) -> bool:
    """Keep a copy before a rewrite. An existing copy must hold the same rows.

    Returns whether a copy was written; a different copy is refused.
    """
    try:
        rows.write.mode("errorifexists").parquet(path)
        return True
    except AnalysisException:
        if table_digest(rows.sparkSession.read.parquet(path)) != table_digest(rows):
            raise RuntimeError(f"snapshot exists but differs from the source: {path}") from None
        return False


def persist_index(documents: DataFrame, markers: DataFrame, path: str) -> None:
    """Append an index: documents with vectors by digest, then the markers that validate them.

    Markers go last, so a half-written store has no marker and is built again.
    """
    documents.write.mode("append").parquet(f"{path}/documents")
    markers.write.mode("append").parquet(f"{path}/markers")
