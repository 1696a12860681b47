"""Retrieval: document rows, nearest documents per store, date grouping, index reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evalspark.functions.binding import bind
from evalspark.functions.text import collapse_whitespace, strip
from evalspark.functions.vectors import cosine
from evalspark.session import fits_broadcast

# Document texts by language.
DOCUMENT_TEXT = {
    "en": {"turn": "Conversation content on {date}:", "user": "[|User|]:", "ai": "[|AI|]:",
           "summary": "The summary of the conversation on {date} is: "},
    "cn": {"turn": "时间{date}的对话内容：", "user": "[|用户|]：", "ai": "[|AI恋人|]：",
           "summary": "时间{date}的对话总结为："},
}


def _dated(template: str, date: Column) -> Column:
    before, after = template.split("{date}")
    return F.concat(F.lit(before), date, F.lit(after))


def pair_documents(pairs: DataFrame, language: str = "en") -> DataFrame:
    """One document per dialogue pair (``store_id, date, ordinal, query, response``)."""
    words = DOCUMENT_TEXT[language]
    text = F.concat(_dated(words["turn"], F.col("date")), F.lit(words["user"] + " "), strip("query"),
                    F.lit("; " + words["ai"] + " "), strip("response"))
    return pairs.select("store_id", "ordinal", text.alias("page_content"), "date", F.lit("dialogue").alias("kind"))


def summary_documents(summaries: DataFrame, language: str = "en") -> DataFrame:
    """One document per non-empty daily summary (``store_id, date, ordinal, summary``)."""
    text = F.concat(_dated(DOCUMENT_TEXT[language]["summary"], F.col("date")), F.col("summary"))
    return summaries.where(F.coalesce(F.col("summary") != "", F.lit(False))).select(
        "store_id", "ordinal", text.alias("page_content"), "date", F.lit("summary").alias("kind"))


def nearest_documents(documents: DataFrame, queries: DataFrame, max_k: int, salts: int = 32) -> DataFrame:
    """Top-k documents of each query's own store by cosine, ranked from 1.

    ``documents(store_id, ordinal, vector, ...)``, ``queries(store_id, sample_id,
    query_vector, top_k)``. Few queries are broadcast after a size check; otherwise both
    sides meet on ``(store_id, salt)`` so one big store is spread over many tasks. Scores
    are computed in Arrow batches and each task keeps only ``max_k`` rows per query
    before the ranking shuffle. ``top_k`` below 1 counts as 1; ties go to the lower ordinal.
    """
    if fits_broadcast(queries):
        joined = documents.join(F.broadcast(queries), "store_id")
    else:
        salted = documents.withColumn("_salt", F.pmod(F.xxhash64("ordinal"), F.lit(salts)))
        spread = queries.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        joined = salted.join(spread, ["store_id", "_salt"]).drop("_salt")
    # nine digits: far finer than real score gaps, coarser than summation order
    scored = joined.withColumn("score", F.round(cosine("vector", "query_vector"), 9)).drop("vector", "query_vector")
    order = W.partitionBy("store_id", "sample_id").orderBy(F.col("score").desc(), F.col("ordinal"))
    ranked = scored.withColumn("retrieval_rank", F.row_number().over(order))
    depth = F.greatest(F.lit(1), F.col("top_k"))
    return ranked.where((F.col("retrieval_rank") <= F.lit(max_k)) & (F.col("retrieval_rank") <= depth))


def merge_by_date(hits: DataFrame, language: str = "en") -> DataFrame:
    """Hits of one sample grouped by date: texts joined in rank order, first hit's metadata.

    A sample has at most its retrieval depth of hits, so a group is small by definition.
    """
    content = strip(F.replace(F.col("page_content"), _dated(DOCUMENT_TEXT[language]["turn"], F.col("date")), F.lit("")))
    rows = hits.withColumn("_item", F.struct(F.col("retrieval_rank").alias("r"), content.alias("c"),
                                             F.col("kind").alias("kind"), F.col("score").alias("score")))
    grouped = rows.groupBy("sample_id", "date").agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    order = W.partitionBy("sample_id").orderBy("date")
    first = F.col("_items")[0]
    return grouped.select(
        "sample_id", "date", F.row_number().over(order).alias("memory_rank"),
        F.array_join(F.transform("_items", lambda i: i["c"]), "\n").alias("content"),
        first["kind"].alias("kind"), first["score"].alias("score"), F.size("_items").alias("merged"))


def stores_to_build(stores: DataFrame, index_markers: DataFrame, method: str) -> DataFrame:
    """Stores whose digest has no usable marker: same method, equal document and vector counts."""
    usable = index_markers.where(
        (F.col("method") == method) & (F.col("documents_count") == F.col("vectors_count"))).select("digest")
    return stores.join(usable, "digest", "left_anti")


def index_markers(documents: DataFrame, vectors: DataFrame, method: str) -> DataFrame:
    """One marker row per digest with the two counts the load check compares."""
    docs = documents.groupBy("digest").agg(F.count(F.lit(1)).alias("documents_count"))
    vecs = vectors.groupBy("digest").agg(F.count(F.lit(1)).alias("vectors_count"))
    return docs.join(vecs, "digest", "left").select(
        "digest", F.lit(method).alias("method"), "documents_count",
        F.coalesce("vectors_count", F.lit(0)).alias("vectors_count"))


def load_index(documents: DataFrame, markers: DataFrame, method: str) -> DataFrame:
    """Documents of stores whose marker passes; a marker row per digest keeps the join 1:n."""
    usable = markers.where(
        (F.col("method") == method) & (F.col("documents_count") == F.col("vectors_count"))).select("digest")
    return documents.join(usable, "digest", "left_semi")


def store_status(marker_time: Column, started: Column, bundled: Column) -> Column:
    return (F.when(bundled, "managed_by_adapter")
            .when(F.coalesce(marker_time >= started, F.lit(False)), "built").otherwise("reused"))


def fidelity(given: Column, retrieved: Column, examples: int = 5) -> Column:
    """Given-versus-retrieved counts over whitespace-normalised texts of one sample."""
    wanted = F.transform(given, collapse_whitespace)
    got = F.transform(retrieved, collapse_whitespace)

    def count(unknown: Column, found: Column) -> Column:
        # set difference is hash-based; only texts outside the given set are looked up
        strange = F.filter(found, lambda t: F.array_contains(unknown, t))
        return F.struct(
            F.size(given).alias("given"), F.size(found).alias("retrieved"),
            (F.size(found) - F.size(strange)).alias("verbatim_matches"),
            F.slice(F.filter(strange, lambda t: F.length(t) > 0), 1, examples).alias("unmatched"))

    return bind(got, lambda found: bind(F.array_except(found, wanted), lambda unknown: count(unknown, found)))
