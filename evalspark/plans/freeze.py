"""Freezing retrieval: build or reuse memory stores, retrieve for every sample, write the frozen rows.

A store's key is the content it is built from, so equal dialogues share a store and a store that
was ever built is found again by any later run. The index is a folder of parts; a manifest row
per store, written after the part's documents, publishes them. Readers see published stores only:
a part that was left half-written has no manifest row, and its stores are built again.

Every step is a job over tables: a run first drops the samples that have rows, then anti joins
the keys with the manifest, builds what is missing, and reads documents by key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark import registry
from evalspark.functions.embedding import hashed_words
from evalspark.functions.text import dated_context, is_blank, non_blank, strip
from evalspark.operators import retrieval as R
from evalspark.operators.dialogue import dialogue_pairs, turn_timestamp
from evalspark.operators.selection import pending
from evalspark.sinks.tables import append_failures, append_records
from evalspark.session import cut_lineage

MANIFEST = "part string, digest string, method string, documents_count bigint, vectors_count bigint, messages_count bigint, published_at timestamp"
LAYOUT = ["dataset", "subset", "system"]


# --- builders ----------------------------------------------------------------------------


def _day(turn: Column) -> Column:
    return F.date_format(turn_timestamp(turn), "yyyy-MM-dd")


def pair_store(messages: DataFrame, day: Callable[[Column], Column]) -> DataFrame:
    """One document per question and reply."""
    pairs = dialogue_pairs(messages).select(F.col("sample_id").alias("store_id"), F.col("turn").alias("ordinal"), "query", "response", day(F.col("turn")).alias("date"))
    return R.pair_documents(pairs)


def turn_store(messages: DataFrame, day: Callable[[Column], Column]) -> DataFrame:
    """One document per turn that is not blank, as it was said."""
    said = messages.where(~is_blank(F.col("content")))
    return said.select(F.col("sample_id").alias("store_id"), F.col("turn").alias("ordinal"), strip("content").alias("page_content"),
                       day(F.col("turn")).alias("date"), F.lit("entry").alias("kind"))


#: ``messages(sample_id, turn, role, content)`` to ``documents(store_id, ordinal, page_content, date, kind)`` by memory system.
BUILDERS: dict[str, Callable[[DataFrame, Callable[[Column], Column]], DataFrame]] = {"memorybank": pair_store, "raw_dialogue": turn_store}


def builder(system: str) -> Callable[[DataFrame, Callable[[Column], Column]], DataFrame]:
    if system not in BUILDERS:
        raise ValueError(f"Unknown memory system: {system}; known are {', '.join(sorted(BUILDERS))}")
    return BUILDERS[system]


def store_keys(messages: DataFrame, settings: list[str]) -> DataFrame:
    """``(sample_id, digest, prior, messages_count)``: the key of each sample's store.

    The turns enter by sums over their hashes, with their numbers inside, so a dialogue of any length is
    reduced map-side and never gathered.
    """
    turn = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("turn", "role", "content")]
    summed = messages.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("messages_count"), F.sum(F.xxhash64(*turn).cast("decimal(38,0)")).alias("_sum"),
        F.bit_xor(F.xxhash64(F.lit(1), *turn)).alias("_xor"))
    prior = F.concat_ws(":", F.col("messages_count").cast("string"), F.col("_sum").cast("string"), F.col("_xor").cast("string"))
    return summed.select("sample_id", F.left(F.sha1(F.concat_ws("\x00", *[F.lit(s) for s in settings], prior)), F.lit(24)).alias("digest"),
                         F.sha2(prior, 256).alias("prior"), "messages_count")


# --- the index ---------------------------------------------------------------------------


@dataclass(frozen=True)
class IndexFolder:
    """Parts of documents with vectors, and the manifest that publishes their stores."""

    path: str

    def manifest(self, spark: SparkSession) -> DataFrame:
        return _read(spark, f"{self.path}/manifest", MANIFEST)

    def published(self, spark: SparkSession, method: str) -> DataFrame:
        """``(digest, part, marker_messages_count, published_at)``: the first usable part of each store."""
        rows = self.manifest(spark).where((F.col("method") == method) & (F.col("documents_count") == F.col("vectors_count")))
        first = F.min(F.struct("published_at", "part", "messages_count")).alias("m")
        return rows.groupBy("digest").agg(first).select("digest", "m.part", F.col("m.messages_count").alias("marker_messages_count"), "m.published_at")

    def publish(self, stores: DataFrame, documents: DataFrame, method: str) -> str:
        """Write documents (with ``digest`` and ``vector``) as a part, then its manifest rows, one per store.

        Counts are read back from the part, so a store is published with what is there.
        """
        spark, part = stores.sparkSession, uuid.uuid4().hex
        documents.write.parquet(f"{self.path}/parts/part={part}")
        counts = spark.read.schema(documents.schema).parquet(f"{self.path}/parts/part={part}").groupBy("digest").agg(
            F.count(F.lit(1)).alias("documents_count"), F.count("vector").alias("vectors_count"))
        none = F.lit(0).cast("bigint")
        rows = stores.join(counts, "digest", "left").select(
            F.lit(part).alias("part"), "digest", F.lit(method).alias("method"), F.coalesce("documents_count", none).alias("documents_count"),
            F.coalesce("vectors_count", none).alias("vectors_count"), "messages_count", F.current_timestamp().alias("published_at"))
        rows.write.mode("append").parquet(f"{self.path}/manifest")
        return part

    def documents(self, spark: SparkSession, wanted: DataFrame, schema: str) -> DataFrame:
        """Documents of published stores ``wanted(digest, part)``; other parts' files are pruned by the join."""
        return _read(spark, f"{self.path}/parts", f"{schema}, part string").join(wanted.select("digest", "part"), ["digest", "part"], "left_semi")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], schema)


# --- the job -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Cell:
    """What the rows of a run belong to."""

    dataset: str
    subset: str
    system: str = "memorybank"
    ingest_mode: str = "messages"
    top_k: int = registry.DEFAULT_TOP_K
    llm_model: str | None = None
    embedding_model: str = "hashed_words"
    settings: dict[str, str] = field(default_factory=dict)

    def identity(self) -> str:
        return self.settings.get("label") or f"ingest={self.ingest_mode}"


@dataclass
class Frozen:
    rows: DataFrame
    failures: DataFrame
    pending: int
    built: int


DOCUMENTS = "digest string, ordinal bigint, page_content string, date string, kind string, vector array<double>"


def freeze_retrieval(messages: DataFrame, requests: DataFrame, cell: Cell, folder: str, index: IndexFolder,
                     embed: Callable[[Column], Column] = hashed_words, day: Callable[[Column], Column] = _day,
                     deepest: int = registry.MAX_EXTERNAL_DEPTH) -> Frozen:
    """Frozen retrieval rows of a cell, resumed, with the stores they need built or reused.

    ``requests(sample_id, request, top_k)``, one row per sample; a null ``top_k`` takes the cell's. Samples that have
    rows in ``folder`` are left alone; a sample that cannot be retrieved for becomes a row of the failure ledger and is
    tried again by the next run.
    """
    spark, build, method = messages.sparkSession, builder(cell.system), f"{cell.system}/{cell.embedding_model}"
    place = (F.col("dataset") == cell.dataset) & (F.col("subset") == cell.subset) & (F.col("system") == cell.system)
    done = _existing(spark, f"{folder}/rows", place)
    todo = requests if done is None else pending(requests, done)
    keys = store_keys(messages.join(todo.select("sample_id"), "sample_id", "left_semi"), [method, cell.identity()])
    depth = F.coalesce(F.col("top_k"), F.lit(cell.top_k))
    problem = (F.when(is_blank(F.col("request")), "empty request").when(F.col("digest").isNull(), "no messages")
               .when(depth > deepest, F.concat(F.lit("top_k above "), F.lit(deepest))))
    keyed = cut_lineage(todo.join(keys, "sample_id", "left").select(
        "sample_id", "request", depth.cast("int").alias("top_k"), F.col("top_k").isNull().alias("fixed"), "digest", "prior", "messages_count", problem.alias("error")))
    good = keyed.where("error IS NULL")

    # one sample stands for all of equal content
    known = index.published(spark, method).select("digest")
    missing = cut_lineage(good.join(known, "digest", "left_anti").groupBy("digest").agg(F.min("sample_id").alias("sample_id"), F.first("messages_count").alias("messages_count")))
    built = missing.count()
    if built:
        own = build(messages.join(missing.select("sample_id"), "sample_id", "left_semi"), day)
        documents = own.join(missing.select(F.col("sample_id").alias("store_id"), "digest"), "store_id").select(
            "digest", F.col("ordinal").cast("bigint").alias("ordinal"), "page_content", "date", "kind", embed(F.col("page_content")).cast("array<double>").alias("vector"))
        index.publish(missing.select("digest", "messages_count"), documents, method)

    published = index.published(spark, method)
    stored = cut_lineage(good.join(published, "digest"))
    documents = index.documents(spark, stored.select("digest", "part").distinct(), DOCUMENTS).withColumnRenamed("digest", "store_id").drop("part")
    asking = stored.select(F.col("digest").alias("store_id"), "sample_id", embed(F.col("request")).cast("array<double>").alias("query_vector"), "top_k")
    merged = R.merge_by_date(R.nearest_documents(documents, asking, max_k=deepest))
    memory = F.struct(F.col("memory_rank"), F.col("date"), F.col("content"), F.col("kind"), F.col("score"), F.col("merged"))
    listed = merged.groupBy("sample_id").agg(F.array_sort(F.collect_list(memory)).alias("_found"))
    rows = (stored.join(missing.select("digest", F.lit(True).alias("_new")), "digest", "left").join(listed, "sample_id", "left")
            .withColumn("_found", F.coalesce("_found", F.array().cast("array<struct<memory_rank:int,date:string,content:string,kind:string,score:double,merged:int>>"))))
    append_records(_frozen_rows(rows, cell, method, index.path), f"{folder}/rows", LAYOUT)
    bad = keyed.where("error IS NOT NULL").select("sample_id", F.lit(cell.dataset).alias("dataset"), F.lit(cell.subset).alias("subset"),
                                                  F.lit(cell.system).alias("system"), F.lit("ValueError").alias("error_type"), "error")
    append_failures(bad, f"{folder}/failures")
    return Frozen(_existing(spark, f"{folder}/rows", place), bad, keyed.count(), built)


def _existing(spark: SparkSession, path: str, place: Column) -> DataFrame | None:
    try:
        return spark.read.parquet(path).where(place)
    except AnalysisException:
        return None


def _frozen_rows(rows: DataFrame, cell: Cell, method: str, index_path: str) -> DataFrame:
    """The frozen schema: the request, how its memories were made, and the memories with their metadata."""
    none = non_blank(F.lit(""))
    text = {name: F.lit(value).cast("string") for name, value in {
        "method": method, "save_dir": index_path, "llm_model": cell.llm_model, "embedding_model": cell.embedding_model,
        "ingest_mode": cell.ingest_mode, "ingest_identity": cell.identity()}.items()}
    config = F.struct(
        *[column.alias(name) for name, column in text.items()], F.col("top_k"), F.concat(F.lit("pm_"), F.col("digest")).alias("user_id"),
        F.col("prior").alias("prior_sha256"), F.col("messages_count"),
        F.when(F.coalesce("_new", F.lit(False)), "built").otherwise("reused").alias("store_status"),
        F.col("published_at").alias("marker_written_at"), F.col("marker_messages_count"), F.col("digest").alias("marker_digest"),
        F.when(F.col("fixed"), "fixed").otherwise("per_sample_len_memories").alias("top_k_policy"))
    memories = F.transform("_found", lambda m: F.struct(
        F.concat(F.lit(f"{cell.system}_"), F.format_string("%02d", m["memory_rank"])).alias("memory_id"), m["content"].alias("content"),
        m["content"].alias("raw_content"), m["memory_rank"].alias("retrieval_rank"),
        F.struct(m["date"].alias("date"), m["kind"].alias("kind"), m["score"].alias("score"), m["merged"].alias("merged")).alias("metadata")))
    context = dated_context(none, none, F.transform("_found", lambda m: F.struct(m["memory_rank"].alias("memory_rank"), m["date"].alias("date"), m["content"].alias("content"))))
    return rows.select(
        "sample_id", F.col("request").alias("current_request"), config.alias("memory_config"), context.alias("official_context_text"),
        memories.alias("retrieved_memories"), F.size("_found").alias("retrieved_count"),
        F.lit(cell.dataset).alias("dataset"), F.lit(cell.subset).alias("subset"), F.lit(cell.system).alias("system"))
