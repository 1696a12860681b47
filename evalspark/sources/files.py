"""File scans: JSON arrays, JSONL with line numbers, shards, record folders, digests.

Line scans are cut into byte ranges like any text scan. The physical number of a line is its place
in its range plus the lines of the ranges before it in its file; the ranges' line counts are one
row per range. Only a JSON array, which has no lines to cut at, is read as one value per file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from evalspark.functions.replies import parse_value
from evalspark.functions.text import is_blank, strip


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON-array files with a 1-based ``row_index`` in file order."""
    text = spark.read.text(path, wholetext=True)
    kind = schema if isinstance(schema, str) else schema.simpleString()
    rows = F.from_json("value", f"array<{kind}>")
    return text.select(F.posexplode(rows).alias("_p", "row")).select((F.col("_p") + 1).alias("row_index"), "row.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, line_number, value`` with physical line numbers, blank lines counted then dropped."""
    return all_lines(spark, path).where(~is_blank(F.col("value"))).select("file_name", F.col("line_number").cast("int").alias("line_number"), "value")


def all_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file and its 1-based number in it.

    A scan task numbers its rows upwards, and the rows of one byte range follow each other, so a
    range's smallest number and its count place all its lines without sorting any.
    """
    meta = F.col("_metadata")
    scan = spark.read.text(path).select(
        meta["file_path"].alias("_path"), meta["file_block_start"].alias("_block"), meta["file_name"].alias("file_name"),
        meta["file_modification_time"].alias("modified"), F.monotonically_increasing_id().alias("_id"), "value")
    ranges = scan.groupBy("_path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = scan.join(ranges, ["_path", "_block"])
    return placed.select("file_name", "modified", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_number"), "value")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSONL rows with their physical ``row_index``."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return numbered_lines(spark, path).select(
        F.col("line_number").alias("row_index"), F.from_json("value", kind).alias("row")).select("row_index", "row.*")


def lenient_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSONL without torn or invalid lines and lines that are no object, so their samples are done again."""
    good = audit_lines(spark.read.text(path)).where("problem IS NULL")
    return _typed(good, schema).where(F.col("row").isNotNull()).select("row.*")


def strict_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSONL that fails the job on the first line that is no JSON object of the schema."""
    lines = audit_lines(spark.read.text(path))
    checked = F.when(F.col("problem").isNull(), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("bad line ("), F.col("problem"), F.lit("): "), F.left("value", F.lit(200)))).cast("string"))
    rows = _typed(lines.withColumn("value", checked), schema)
    # the filter reads every row, so a count fails as well
    fits = F.col("row").isNotNull() | F.raise_error(F.lit("a line does not fit the schema")).cast("boolean")
    return rows.where(fits).select("row.*")


def _typed(lines: DataFrame, schema: StructType) -> DataFrame:
    """Lines with ``row``, NULL where a field has another type than the schema's."""
    corrupt = "_corrupt_record"
    parsed = F.from_json("value", StructType([*schema.fields]).add(corrupt, "string"), {"columnNameOfCorruptRecord": corrupt})
    rows = lines.withColumn("_row", parsed)
    fields = F.struct(*[F.col("_row")[f.name].alias(f.name) for f in schema.fields])
    return rows.withColumn("row", F.when(F.col("_row")[corrupt].isNull(), fields)).drop("_row")


def audit_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines with a parsed ``VARIANT`` object or the reason why there is none."""
    kept = lines.where(~is_blank(F.col(value)))
    object_type = F.schema_of_variant("_value").startswith("OBJECT")
    return kept.withColumn("_value", parse_value(strip(F.col(value)))).withColumns({
        "parsed": F.when(object_type, F.col("_value")),
        "problem": F.when(F.col("_value").isNull(), "not JSON").when(~object_type, "not an object")}).drop("_value")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line's own text beside its parsed row and id; ``sample_id`` NULL means refused."""
    lines = spark.read.text(path).where(~is_blank(F.col("value")))
    return lines.select("value", F.try_parse_json("value").alias("row")).withColumn(
        "sample_id", F.try_variant_get("row", "$.sample_id", "string"))


def record_folder(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One-record JSON files; ``problem`` names records without an id or with a repeated one."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    blank = is_blank(F.col("sample_id"))
    counts = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(counts, "sample_id", "left").withColumn(
        "problem", F.when(blank, "no sample_id").when(F.col("_n") > 1, "duplicate record")).drop("_n")


SAMPLE_FILE = ("struct<sample_id:string,phases:map<string,struct<sample:{sample},calls:array<{call}>>>>")


def flatten_sample_files(texts: DataFrame, column: str, sample: str, call: str) -> tuple[DataFrame, DataFrame]:
    """Per-sample JSON texts to sample rows and call rows, one pair per phase."""
    parsed = texts.select(F.from_json(column, SAMPLE_FILE.format(sample=sample, call=call)).alias("f")).where(
        F.col("f.phases").isNotNull())
    phases = parsed.select(F.col("f.sample_id").alias("sample_id"), F.explode("f.phases").alias("phase", "data"))
    samples = phases.where(F.col("data.sample").isNotNull()).select("sample_id", "phase", "data.sample.*")
    calls = phases.select("sample_id", "phase", F.explode("data.calls").alias("c")).select("sample_id", "phase", "c.*")
    return samples, calls


def shard_parts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of ``shardNN.jsonl`` parts with shard, file time and line; failure ledgers are left out."""
    parts = all_lines(spark, path).where(F.col("file_name").rlike(r"^shard\d+\.jsonl$"))
    lines = parts.select("modified", F.regexp_extract("file_name", r"^shard(\d+)", 1).cast("int").alias("shard"),
                         (F.col("line_number") - 1).cast("int").alias("line"), "value")
    return lines.where(~is_blank(F.col("value"))).select(
        F.from_json("value", schema).alias("row"), "modified", "shard", "line").select("row.*", "modified", "shard", "line")


def file_digests(spark: SparkSession, path: str, chunk_bytes: int = 4 << 20) -> DataFrame:
    """SHA-256 of each file's bytes with its length.

    Only names and lengths come from the scan; a task reads a file as a stream of chunks into one
    chained hash state, so a file of any size takes one chunk of memory. The scan lists no empty files.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    # as many tasks as files, up to the session's: one long file does not hold up others
    dealt = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for uri in batch.column(0).to_pylist():
                # the scan names files without escapes
                if uri.startswith("file:"):
                    store, place = fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
                else:
                    store, place = fs.FileSystem.from_uri(quote(uri, safe=":/"))
                state = hashlib.sha256()
                with store.open_input_stream(place) as stream:
                    while chunk := stream.read(chunk_bytes):
                        state.update(chunk)
                digests.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["path", "length", "sha256"])
    return dealt.mapInArrow(run, "path string, length long, sha256 string").select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "sha256")


def line_count(texts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Non-blank lines per key without parsing any of them."""
    kept = F.size(F.filter(F.split(column, "\n"), lambda x: ~is_blank(x)))
    return texts.groupBy(*keys).agg(F.sum(kept).alias("lines"))


def run_indices(present: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct run indices per key, always including 0."""
    return present.select(*keys, F.explode(F.array(F.lit(0), F.col("run_index"))).alias("run_index")).distinct()


def load_arms(expected: DataFrame, configs: DataFrame, outputs: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts of each expected arm; absent parts are zero, an absent config is false."""
    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count_if(F.col("problem").isNull()).alias(name),
                                       F.count_if(F.col("problem").isNotNull()).alias(f"unreadable_{name}"))
    joined = (expected.join(configs.select(*keys, F.lit(True).alias("has_config")), keys, "left")
              .join(counts(outputs, "outputs"), keys, "left").join(counts(judged, "judge"), keys, "left"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("outputs", "unreadable_outputs", "judge", "unreadable_judge")}
    return joined.withColumns({**zero, "has_config": F.coalesce("has_config", F.lit(False))})
