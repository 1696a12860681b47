"""Retrieval over embeddings and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalspark.functions.embedding import hashed_words
from evalspark.functions.text import dated_context, non_blank
from evalspark.functions.vectors import l2_normalize
from evalspark.operators import retrieval as R
from evalspark.operators.dialogue import dialogue_pairs
from evalspark.operators.similar import similar_entries
from evalspark.plans.freeze import Cell, IndexFolder, freeze_retrieval
from evalspark.queries import query, table
from evalspark.queries.q_dialogue import _PAIRS
from evalspark.queries.standins import messages, sql_collapse, sql_strip
from evalspark.session import ensure_checkpoint_dir


def stores(spark, sf):
    """Embeddings by label: the lowest id of a label asks, the others are its documents."""
    vectors = table(spark, sf, "embeddings").select(F.col("label").alias("store_id"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))
    first = vectors.groupBy("store_id").agg(F.min("ordinal").alias("ordinal"))
    asking = vectors.join(first, ["store_id", "ordinal"]).select(
        "store_id", F.col("ordinal").alias("sample_id"), F.col("vector").alias("query_vector"))
    documents = vectors.join(first.select("ordinal"), "ordinal", "left_anti")
    return documents, asking.withColumn("top_k", (F.col("store_id") % 4) * 3)


_HITS = """v AS (SELECT label AS store_id, vec_id AS ordinal, embedding::DOUBLE[] AS vector FROM embeddings),
q AS (SELECT store_id, min(ordinal) AS sample_id, arg_min(vector, ordinal) AS qv FROM v GROUP BY 1),
s AS (SELECT v.store_id, q.sample_id, v.ordinal, round(list_inner_product(vector, qv) / (sqrt(list_inner_product(vector, vector)) * sqrt(list_inner_product(qv, qv))), 9) AS score
  FROM v JOIN q ON q.store_id = v.store_id AND q.sample_id <> v.ordinal),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY store_id, sample_id ORDER BY score DESC, ordinal) AS INTEGER) AS retrieval_rank FROM s),
hits AS (SELECT * FROM r WHERE retrieval_rank <= greatest(1, (store_id % 4) * 3))"""


@query(f"WITH {_HITS} SELECT store_id, sample_id, ordinal, round(score, 6) AS score, retrieval_rank FROM hits")
def retrieval_nearest_documents(spark, sf):
    """Depth per store 0 (counts as 1), 3, 6 or 9"""
    documents, asking = stores(spark, sf)
    hits = R.nearest_documents(documents, asking, max_k=9)
    return hits.select("store_id", "sample_id", "ordinal", F.round("score", 6).alias("score"), "retrieval_rank")


@query(f"""WITH {_HITS}, d AS (SELECT *, '2024-02-0' || (ordinal % 3 + 1) AS date, CASE WHEN ordinal % 2 = 0 THEN 'dialogue' ELSE 'summary' END AS kind FROM hits),
g AS (SELECT sample_id, date, string_agg('memory ' || ordinal, chr(10) ORDER BY retrieval_rank) AS content, arg_min(kind, retrieval_rank) AS kind, arg_min(score, retrieval_rank) AS score, CAST(count(*) AS INTEGER) AS merged FROM d GROUP BY ALL)
SELECT sample_id, date, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY date) AS INTEGER) AS memory_rank, content, kind, round(score, 6) AS score, merged FROM g""")
def retrieval_merge_by_date(spark, sf):
    """Three dates"""
    documents, asking = stores(spark, sf)
    date = F.concat(F.lit("2024-02-0"), (F.col("ordinal") % 3 + 1).cast("string"))
    dated = documents.withColumns({
        "date": date, "kind": F.when(F.col("ordinal") % 2 == 0, "dialogue").otherwise("summary"),
        "page_content": F.concat(F.lit("Conversation content on "), date, F.lit(": memory "), F.col("ordinal").cast("string"))})
    return R.merge_by_date(R.nearest_documents(dated, asking, max_k=9)).withColumn("score", F.round("score", 6))


@query("""SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first, round(e[64] / sqrt(list_inner_product(e, e)), 6) AS last, 1.0::DOUBLE AS unit
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def retrieval_normalize_vectors(spark, sf):
    """J25"""
    def length(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", l2_normalize(F.col("embedding")).alias("n"))
    return rows.select("vec_id", F.round(length(F.col("embedding")), 6).alias("norm"), F.round(F.element_at("n", 1), 6).alias("first"),
                       F.round(F.element_at("n", -1), 6).alias("last"), F.round(length(F.col("n")), 6).alias("unit"))


def _indexed(spark, sf):
    """Stores by source and language; English texts over 5,000 characters have no vector yet."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat("source", "lang").alias("digest"), "n_chars", "lang")
    return docs, R.index_markers(docs, docs.where("n_chars <= 5000 OR lang <> 'en'"), "MemoryBank")


@query("""WITH s AS (SELECT source || lang AS digest, count(*) AS documents_count, count(*) FILTER (n_chars <= 5000 OR lang <> 'en') AS vectors_count FROM documents GROUP BY 1)
SELECT digest, documents_count FROM s WHERE documents_count <> vectors_count""")
def retrieval_stores_to_build(spark, sf):
    """Stores whose vectors are incomplete are built again"""
    docs, markers = _indexed(spark, sf)
    wanted = docs.groupBy("digest").agg(F.count(F.lit(1)).alias("documents_count"))
    return R.stores_to_build(wanted, markers, "MemoryBank")


@query("""SELECT doc_id, source || lang AS digest FROM documents WHERE source || lang NOT IN (SELECT source || lang FROM documents WHERE n_chars > 5000 AND lang = 'en')""")
def retrieval_load_index(spark, sf):
    """Only stores with equal counts are loaded"""
    docs, markers = _indexed(spark, sf)
    return R.load_index(docs, markers, "MemoryBank").select("doc_id", "digest")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'managed_by_adapter' WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 'built' ELSE 'reused' END AS status FROM orders""")
def retrieval_store_status(spark, sf):
    """M2, T7"""
    status = R.store_status(F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp_ntz"), F.col("o_orderpriority") == "5-LOW")
    return table(spark, sf, "orders").select("o_orderkey", status.alias("status"))


_EMBED = f"""emb AS (SELECT id, bucket, count(*)::DOUBLE AS tf FROM (SELECT id, CAST('0x' || left(md5(w), 7) AS INTEGER) % 64 AS bucket
  FROM (SELECT id, unnest(string_split(lower({sql_collapse('t')}), ' ')) AS w FROM texts) WHERE w <> '') GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM emb GROUP BY 1)"""


@query(f"""WITH texts AS (SELECT doc_id AS id, text AS t FROM documents), {_EMBED}
SELECT e.id AS doc_id, CAST(bucket AS BIGINT) AS bucket, round(tf / n, 6) AS weight FROM emb e JOIN norms USING (id)""")
def retrieval_hashed_embedding(spark, sf):
    """The offline embedder over whole documents"""
    vectors = table(spark, sf, "documents").select("doc_id", F.posexplode(hashed_words(F.col("text"))).alias("bucket", "weight"))
    return vectors.where("weight > 0").select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 6).alias("weight"))


def frozen_rows(spark, sf, top_k: int = 4):
    """Retrieval per conversation: pairs become documents, the last user turn asks.

    The question is excluded from no store: a store holds the whole conversation. A
    conversation without a user turn stays as a refused row without memories.
    """
    chat = messages(spark, sf)
    pairs = dialogue_pairs(chat).select(
        F.col("sample_id").alias("store_id"), F.col("turn").alias("ordinal"), "query", "response",
        F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), F.floor(F.col("turn") / 3).cast("int")), "yyyy-MM-dd").alias("date"))
    documents = R.pair_documents(pairs).withColumn("vector", hashed_words(F.col("page_content")))
    user_turn = F.when(F.col("role") == "user", F.col("turn"))
    asked = chat.groupBy(F.col("sample_id").alias("store_id")).agg(F.max_by("content", user_turn).alias("request"))
    asking = asked.where("request IS NOT NULL").select("store_id", F.col("store_id").alias("sample_id"), "request", hashed_words(F.col("request")).alias("query_vector"), F.lit(top_k).alias("top_k"))
    hits = R.nearest_documents(documents, asking.drop("request"), max_k=top_k)
    merged = R.merge_by_date(hits)
    listed = merged.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("memory_rank", "date", "content"))).alias("memories"))
    return asked.select(F.col("store_id").alias("sample_id"), "request", F.when(F.col("request").isNull(), "empty request").alias("problem")).join(listed, "sample_id", "left").withColumn(
        "memories", F.coalesce("memories", F.array().cast("array<struct<memory_rank:int,date:string,content:string>>")))


_FROZEN = f"""{_PAIRS}, docs AS (SELECT sample_id AS store, turn, strftime(DATE '2024-03-01' + CAST(turn // 3 AS INTEGER), '%Y-%m-%d') AS date, 'Conversation content on ' || strftime(DATE '2024-03-01' + CAST(turn // 3 AS INTEGER), '%Y-%m-%d') || ':' AS prefix,
  '[|User|]: ' || {sql_strip('query')} || '; [|AI|]: ' || {sql_strip('response')} AS body FROM pairs),
asked AS (SELECT conv_id AS store, arg_max(text, turn) FILTER (role = 'user') AS request FROM conversations GROUP BY 1), ask AS (SELECT * FROM asked WHERE request IS NOT NULL),
texts AS (SELECT store || ':' || turn AS id, prefix || body AS t FROM docs UNION ALL SELECT 'asks ' || store, request FROM ask), {_EMBED},
dots AS (SELECT d.store, d.turn, round(coalesce((SELECT sum(a.tf * b.tf) FROM emb a JOIN emb b ON a.bucket = b.bucket WHERE a.id = d.store || ':' || d.turn AND b.id = 'asks ' || d.store), 0) / (nd.n * nq.n), 9) AS score
  FROM docs d JOIN ask USING (store) JOIN norms nd ON nd.id = d.store || ':' || d.turn JOIN norms nq ON nq.id = 'asks ' || d.store),
rk AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY score DESC, turn) AS r FROM dots),
byday AS (SELECT rk.store, date, string_agg({sql_strip('body')}, chr(10) ORDER BY r) AS content FROM rk JOIN docs ON docs.store = rk.store AND docs.turn = rk.turn WHERE r <= 4 GROUP BY ALL),
frozen AS (SELECT store, date, content, row_number() OVER (PARTITION BY store ORDER BY date) AS memory_rank FROM byday)"""


@query(f"""WITH {_FROZEN} SELECT store AS sample_id, CAST(memory_rank AS INTEGER) AS retrieval_rank, 'memorybank_' || lpad(CAST(memory_rank AS VARCHAR), 2, '0') AS memory_id, date, content FROM frozen""")
def retrieval_frozen_memories(spark, sf):
    """End to end from messages to frozen memories"""
    rows = frozen_rows(spark, sf).select("sample_id", F.explode("memories").alias("m"))
    return rows.select("sample_id", F.col("m.memory_rank").alias("retrieval_rank"),
                       F.concat(F.lit("memorybank_"), F.format_string("%02d", "m.memory_rank")).alias("memory_id"), "m.date", "m.content")


@query(f"""WITH {_FROZEN}, c AS (SELECT store, count(*) AS n, string_agg('### Memory ' || memory_rank || ' (' || date || '):' || chr(10) || {sql_strip('content')}, chr(10) || chr(10) ORDER BY memory_rank) AS body FROM frozen GROUP BY 1)
SELECT a.store AS sample_id, CASE WHEN a.request IS NULL THEN 'empty request' END AS problem, coalesce(n, 0) AS retrieved_count, md5(CASE WHEN n IS NULL THEN '[NO RETRIEVED MEMORIES]' ELSE 'Based on the current question, the most relevant [memories] are:' || chr(10) || chr(10) || body END) AS context_digest
FROM asked a LEFT JOIN c USING (store)""")
def retrieval_frozen_context(spark, sf):
    """Context text of the frozen row"""
    rows = frozen_rows(spark, sf)
    none = non_blank(F.lit(""))
    return rows.select("sample_id", "problem", F.size("memories").cast("bigint").alias("retrieved_count"),
                       F.md5(dated_context(none, none, F.col("memories"))).alias("context_digest"))


@query(f"""WITH texts AS (SELECT doc_id AS id, text AS t FROM documents), {_EMBED},
v AS (SELECT d.doc_id, d.source, list(coalesce(e.tf, 0) / n ORDER BY b.b) AS vec FROM documents d JOIN norms ON norms.id = d.doc_id CROSS JOIN (SELECT unnest(range(64)) AS b) b LEFT JOIN emb e ON e.id = d.doc_id AND e.bucket = b.b GROUP BY ALL),
p AS (SELECT a.source AS store_id, a.doc_id AS ordinal, b.doc_id AS other, round(list_inner_product(a.vec, b.vec), 9) AS score FROM v a JOIN v b ON a.source = b.source AND a.doc_id <> b.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ordinal ORDER BY score DESC, other) AS INTEGER) AS rank FROM p WHERE score >= 0.8)
SELECT store_id, ordinal, other, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def retrieval_similar_entries(spark, sf):
    """Consolidation candidates per source; ten is the operator's own depth"""
    entries = table(spark, sf, "documents").select(
        F.col("source").alias("store_id"), F.col("doc_id").alias("ordinal"), hashed_words(F.col("text")).alias("vector"))
    return similar_entries(entries).withColumn("score", F.round("score", 6))


@query(f"""WITH {_FROZEN}, c AS (SELECT store, count(*) AS n, string_agg('### Memory ' || memory_rank || ' (' || date || '):' || chr(10) || {sql_strip('content')}, chr(10) || chr(10) ORDER BY memory_rank) AS body FROM frozen GROUP BY 1),
sizes AS (SELECT conv_id AS store, count(*) AS messages_count FROM conversations GROUP BY 1),
runs AS (SELECT * FROM (VALUES ('first', 'built'), ('second', 'reused')) r(run, status))
SELECT run, a.store AS sample_id, CASE WHEN a.request IS NULL THEN 'empty request' END AS error, CASE WHEN a.request IS NOT NULL THEN status END AS store_status,
  CASE WHEN a.request IS NOT NULL THEN messages_count END AS messages_count, CASE WHEN a.request IS NOT NULL THEN messages_count END AS marker_messages_count,
  CASE WHEN a.request IS NOT NULL THEN CAST(coalesce(n, 0) AS BIGINT) END AS retrieved_count,
  CASE WHEN a.request IS NOT NULL THEN md5(CASE WHEN n IS NULL THEN '[NO RETRIEVED MEMORIES]' ELSE 'Based on the current question, the most relevant [memories] are:' || chr(10) || chr(10) || body END) END AS context_digest
FROM asked a CROSS JOIN runs LEFT JOIN c USING (store) JOIN sizes USING (store)""")
def jobs_freeze_retrieval(spark, sf):
    """The same samples frozen for two cells; the second finds the first one's stores"""
    folder = f"{ensure_checkpoint_dir(spark)}/freeze/{uuid.uuid4().hex}"
    index, chat = IndexFolder(f"{folder}/index"), messages(spark, sf)
    user_turn = F.when(F.col("role") == "user", F.col("turn"))
    requests = chat.groupBy("sample_id").agg(F.max_by("content", user_turn).alias("request")).withColumn("top_k", F.lit(None).cast("int"))

    def day(turn):
        return F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), F.floor(turn / 3).cast("int")), "yyyy-MM-dd")
    out = None
    for run in ("first", "second"):
        done = freeze_retrieval(chat, requests, Cell("conversations", run, top_k=4), folder, index, day=day)
        rows = done.rows.select(
            F.lit(run).alias("run"), "sample_id", F.lit(None).cast("string").alias("error"), "memory_config.store_status", "memory_config.messages_count",
            "memory_config.marker_messages_count", F.col("retrieved_count").cast("bigint").alias("retrieved_count"), F.md5("official_context_text").alias("context_digest"))
        rows = rows.unionByName(done.failures.select(F.lit(run).alias("run"), "sample_id", "error"), allowMissingColumns=True)
        out = rows if out is None else out.unionByName(rows)
    return out
