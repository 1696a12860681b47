"""Selection, resume, merge, order and set operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import selection as S
from evalspark.operators.ordered import int_chunk, with_position
from evalspark.queries import query, table
from evalspark.queries.q_metrics import _PASS, native_tasks, pass_rows
from evalspark.queries.standins import SQL_LINES, lines, sql_strip


def docs(spark, sf):
    return table(spark, sf, "documents").withColumn("sample_id", F.col("doc_id"))


def label_ids(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))


@query("""SELECT doc_id AS sample_id, true AS found FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT n_nationkey + 1000000000, false FROM nation WHERE n_nationkey + 1000000000 NOT IN (SELECT doc_id FROM documents)""")
def selection_only_ids(spark, sf):
    """Labelled ids plus ids no document has"""
    strangers = table(spark, sf, "nation").select((F.col("n_nationkey").cast("bigint") + 1000000000).alias("sample_id"))
    kept, missing = S.only_ids(docs(spark, sf), label_ids(spark, sf).unionByName(strangers))
    return kept.select("sample_id", F.lit(True).alias("found")).unionByName(missing.select("sample_id", F.lit(False).alias("found")))


@query("SELECT doc_id AS sample_id, doc_id IN (SELECT doc_id FROM labels) AS dropped FROM documents")
def selection_without_ids(spark, sf):
    """D2"""
    kept, dropped = S.without_ids(docs(spark, sf), label_ids(spark, sf))
    return kept.select("sample_id", F.lit(False).alias("dropped")).unionByName(dropped.select("sample_id", F.lit(True).alias("dropped")))


_MEM = f"list_filter({SQL_LINES}, lambda x: contains(x, 'the'))"


@query(f"""SELECT doc_id AS sample_id, CASE WHEN doc_id % 2 = 0 AND len({_MEM}) = 0 THEN 'empty_retrieval' END AS reason FROM documents""")
def selection_empty_retrieval(spark, sf):
    """Even ids stand for external rows"""
    rows = docs(spark, sf).select("sample_id", F.col("lang").alias("task"),
                                  F.filter(lines(F.col("text")), lambda x: x.contains("the")).alias("retrieved_memories"))
    kept, excluded = S.split_empty_retrieval(rows, F.col("sample_id") % 2 == 0)
    return kept.select("sample_id", F.lit(None).cast("string").alias("reason")).unionByName(excluded.select("sample_id", "reason"))


@query("""SELECT doc_id AS sample_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark)""")
def selection_pending(spark, sf):
    """Finished ids come from two stores"""
    other = table(spark, sf, "benchmark").select(F.col("item_id").alias("sample_id"))
    return S.pending(docs(spark, sf).select("sample_id", "source"), label_ids(spark, sf), other)


_PARTS = "parts AS (SELECT sha256(text) AS sample_id, doc_id % 8 AS shard, doc_id // 1000 AS modified, doc_id AS line, lang FROM documents)"


def parts(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("sample_id"), (d % 8).alias("shard"), F.floor(d / 1000).cast("bigint").alias("modified"), d.alias("line"), "lang")


@query(f"""WITH {_PARTS} SELECT sample_id, shard, line, lang, copies FROM (SELECT *, count(*) OVER (PARTITION BY sample_id) AS copies,
 row_number() OVER (PARTITION BY sample_id ORDER BY modified DESC, shard DESC, line DESC) AS r FROM parts) WHERE r = 1""")
def selection_newest_part(spark, sf):
    """Copies of a text are the same sample in several shards"""
    return S.newest_part(parts(spark, sf), ["sample_id"], ["modified", "shard", "line"]).select("sample_id", "shard", "line", "lang", "copies")


@query(f"""WITH {_PARTS} SELECT sample_id, count(*) AS copies, arg_max(shard, modified * 1000000000 + shard * 100000000 + line) AS kept_shard,
 arg_min(shard, modified * 1000000000 + shard * 100000000 + line) AS oldest_shard FROM parts GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 20""")
def selection_duplicate_audit(spark, sf):
    """G1: the report shows twenty examples"""
    return S.duplicate_audit(parts(spark, sf), ["sample_id"], ["modified", "shard", "line"], "shard")


@query("""WITH e AS (SELECT doc_id AS sample_id, doc_id + 1 AS position FROM documents), x AS (SELECT doc_id AS sample_id, 'x' || quality AS answer FROM labels WHERE quality = 1),
c AS (SELECT doc_id AS sample_id, 'c' || toxic AS answer FROM labels UNION ALL SELECT n_nationkey + 1000000000, 'c' FROM nation)
SELECT coalesce(e.sample_id, x.sample_id, c.sample_id) AS sample_id, position, coalesce(x.answer, c.answer) AS answer,
 CASE WHEN position IS NULL THEN 'unexpected' WHEN x.answer IS NULL AND c.answer IS NULL THEN 'missing' ELSE 'merged' END AS status,
 CASE WHEN x.answer IS NOT NULL THEN 'existing' WHEN c.answer IS NOT NULL THEN 'cache' END AS origin
FROM e FULL JOIN x ON e.sample_id = x.sample_id FULL JOIN c ON c.sample_id = coalesce(e.sample_id, x.sample_id)""")
def selection_merge_finished(spark, sf):
    """Existing rows win, strangers are unexpected"""
    labels = table(spark, sf, "labels")
    expected = docs(spark, sf).select("sample_id", (F.col("doc_id") + 1).alias("position"))
    existing = labels.where("quality = 1").select(F.col("doc_id").alias("sample_id"), F.concat(F.lit("x"), "quality").alias("answer"))
    cached = labels.select(F.col("doc_id").alias("sample_id"), F.concat(F.lit("c"), "toxic").alias("answer"))
    strangers = table(spark, sf, "nation").select((F.col("n_nationkey").cast("bigint") + 1000000000).alias("sample_id"), F.lit("c").alias("answer"))
    return S.merge_finished(expected, existing, cached.unionByName(strangers))


@query("SELECT doc_id AS sample_id FROM labels INTERSECT SELECT item_id FROM benchmark")
def selection_overlapping_ids(spark, sf):
    """I3, I1"""
    return S.overlapping_ids(label_ids(spark, sf), table(spark, sf, "benchmark").select(F.col("item_id").alias("sample_id")))


@query("SELECT DISTINCT o_custkey AS sample_id FROM orders WHERE o_custkey NOT IN (SELECT doc_id FROM documents)")
def selection_unexpected_ids(spark, sf):
    """Customers of orders against document ids"""
    found = table(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id"))
    return S.unexpected_ids(found, docs(spark, sf).select("sample_id"))


@query("SELECT o_orderkey AS sample_id, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'")
def selection_mergeable_cache(spark, sf):
    """Merged rows leave the cache unless absent (status P) or changed (urgent ones)"""
    cached = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    merged = cached.where("o_orderstatus <> 'P'").withColumn(
        "o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return S.mergeable_cache(cached, merged, ["o_orderstatus", "o_totalprice"]).drop("o_orderpriority")


@query("SELECT sample_id, task, pick FROM (SELECT doc_id AS sample_id, lang AS task, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS pick FROM documents) WHERE pick <= 25")
def selection_stratified_first(spark, sf):
    """The first N per task is the operator"""
    rows = docs(spark, sf).select("sample_id", F.col("lang").alias("task"))
    return S.stratified(rows, 25, "sample_id")


@query("SELECT sample_id, task, pick FROM (SELECT doc_id AS sample_id, lang AS task, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id)) AS INTEGER) AS pick FROM documents) WHERE pick <= 25")
def selection_stratified_seeded(spark, sf):
    """G11, T19"""
    rows = docs(spark, sf).select("sample_id", F.col("lang").alias("task"))
    return S.stratified(rows, 25, "sample_id", seed=42)


@query("SELECT t.task, count(d.doc_id) AS available FROM (SELECT unnest(['de','en','es','fr','it']) AS task) t LEFT JOIN documents d ON d.lang = t.task GROUP BY 1 HAVING count(d.doc_id) < 25")
def selection_short_strata(spark, sf):
    """Strata too small for the request"""
    return S.short_strata(native_tasks(spark), docs(spark, sf).select("sample_id", F.col("lang").alias("task")), 25)


@query(f"""WITH {_PASS} SELECT DISTINCT sample_id FROM rows WHERE b IS NOT NULL AND s IS NOT NULL AND sample_id IN (SELECT doc_id FROM documents WHERE n_chars > 200)""")
def selection_eligible_ids(spark, sf):
    """E8, I1"""
    rows = pass_rows(spark, sf)
    long_docs = docs(spark, sf).where("n_chars > 200").select("sample_id")
    everything = docs(spark, sf).select("sample_id")
    return S.eligible_ids([(long_docs, rows.where("method = 'baseline'")), (everything, rows.where("method = 'staged'"))])


@query(f"""WITH {_PARTS}, f AS (SELECT sample_id, count(*) AS copies, min(line) AS first FROM parts GROUP BY 1 HAVING count(*) > 1)
SELECT f.sample_id, f.copies, min(p.line) AS second_position FROM f JOIN parts p ON p.sample_id = f.sample_id AND p.line > f.first GROUP BY ALL""")
def selection_duplicate_ids(spark, sf):
    """F14"""
    return S.duplicate_ids(parts(spark, sf), "line")


_LISTS = """l AS (SELECT o_orderstatus AS cell, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS position FROM orders),
r AS (SELECT cell, CASE WHEN cell = 'P' AND position >= 40 THEN id + 1 ELSE id END AS id, position FROM l)"""


@query(f"""WITH {_LISTS} SELECT l.cell, count(*) AS rows, min(l.position) FILTER (r.id IS DISTINCT FROM l.id) AS first_divergence
 FROM l LEFT JOIN r ON r.cell = l.cell AND r.position = l.position GROUP BY 1""")
def selection_first_divergence(spark, sf):
    """Positions are dense row numbers per order status"""
    base = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("cell"), F.col("o_orderkey").alias("sample_id"))
    left = with_position(base, ["cell"], ["sample_id"], int_chunk(F.col("sample_id")))
    right = left.withColumn("sample_id", F.when((F.col("cell") == "P") & (F.col("position") >= 40), F.col("sample_id") + 1).otherwise(F.col("sample_id")))
    return S.first_divergence(left, right, ["cell"])


@query("""WITH p AS (SELECT o_orderstatus AS cell, o_orderkey, o_custkey, lag(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS before FROM orders)
SELECT cell, count(*) AS rows, min(o_orderkey) FILTER (before > o_custkey) AS first_out_of_order FROM p GROUP BY 1""")
def selection_first_out_of_order(spark, sf):
    """G12, T13"""
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("cell"), "o_orderkey", "o_custkey")
    return S.first_out_of_order(rows, ["cell"], "o_orderkey", "o_custkey")


@query("""WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS k, row_number() OVER (ORDER BY l_orderkey * 8 + l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_index, count(*) OVER () AS n FROM lineitem)
SELECT CAST((row_index - 1) // CAST(ceil(n / 12.0) AS BIGINT) AS INTEGER) AS shard, count(*) AS rows, min(row_index) AS first_row, max(row_index) AS last_row, sum(k)::BIGINT AS key_sum FROM r GROUP BY 1""")
def selection_shard_assignment(spark, sf):
    """G8 over dense row numbers of a global order"""
    items = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), "l_partkey", "l_suppkey", "l_extendedprice")
    numbered = with_position(items, [], ["k", "l_partkey", "l_suppkey", "l_extendedprice"], int_chunk(F.col("k")), "row_index")
    total = items.agg(F.count(F.lit(1)).alias("total"))
    placed = numbered.withColumn("shard", S.shard_of(F.col("row_index"), total.scalar(), 12))
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.min("row_index").alias("first_row"),
                                       F.max("row_index").alias("last_row"), F.sum("k").alias("key_sum"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_index FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def selection_dense_row_index(spark, sf):
    """A2, H1: row numbers of a filtered list"""
    return S.dense_row_index(docs(spark, sf).join(label_ids(spark, sf), "sample_id", "left_semi").select("doc_id"), "doc_id")


@query("""SELECT doc_id, row_index FROM (SELECT doc_id, doc_id + 1 AS row_index FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) ORDER BY row_index LIMIT 100""")
def selection_rows_by_index(spark, sf):
    """Explicit row numbers, then the first N"""
    rows = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") + 1).alias("row_index"))
    wanted = table(spark, sf, "labels").select((F.col("doc_id") + 1).alias("row_index"))
    return rows.join(wanted, "row_index", "left_semi").orderBy("row_index").limit(100).select("doc_id", "row_index")


@query(f"""WITH o AS (SELECT doc_id, source, list_filter({SQL_LINES}, lambda x: contains(x, 'the')) AS m, list_filter({SQL_LINES}, lambda x: length({sql_strip('x')}) > 0) AS n FROM documents)
SELECT doc_id AS sample_id, md5(array_to_string(CASE WHEN len(m) = 0 AND source <> 'src5' THEN n ELSE m END, chr(10))) AS digest, len(m) = 0 AS was_empty,
 len(m) = 0 AND source <> 'src5' AS replaced, len(m) = 0 AND source <> 'src5' AND len(n) > 0 AS changed FROM o""")
def selection_overlay_empty(spark, sf):
    """Only rows that were empty change"""
    d = docs(spark, sf)
    original = d.select("sample_id", F.filter(lines(F.col("text")), lambda x: x.contains("the")).alias("retrieved_memories"))
    from evalspark.functions.text import is_blank
    repaired = d.where("source <> 'src5'").select("sample_id", F.filter(lines(F.col("text")), lambda x: ~is_blank(x)).alias("retrieved_memories"))
    out = S.overlay_empty(original, repaired)
    return out.select("sample_id", F.md5(F.array_join("retrieved_memories", "\n")).alias("digest"), "was_empty", "replaced", "changed")


@query("""SELECT l.doc_id + 1 AS row_index, CASE WHEN l.doc_id % 9 = 0 THEN -1 ELSE l.doc_id END AS sample_id, d.doc_id AS source_id, CASE WHEN d.doc_id IS NULL THEN 'sample absent' ELSE 'id drift' END AS problem
FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang <> 'fr') d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id % 9 = 0""")
def selection_id_drift(spark, sf):
    """E10"""
    records = table(spark, sf, "labels").select((F.col("doc_id") + 1).alias("row_index"), F.when(F.col("doc_id") % 9 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("doc_id")).alias("sample_id"))
    source = table(spark, sf, "documents").where("lang <> 'fr'").select((F.col("doc_id") + 1).alias("row_index"), F.col("doc_id").alias("sample_id"))
    return S.id_drift(records, source)


@query("""SELECT lang AS task, count(*) AS rows, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1 ORDER BY 1""")
def selection_manifest(spark, sf):
    """Rows by task in report order"""
    chosen = docs(spark, sf).join(label_ids(spark, sf), "sample_id", "left_semi")
    return chosen.groupBy(F.col("lang").alias("task")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).orderBy("task")


@query("""SELECT cell, unnest(list_sort(list_distinct(list_append(list(DISTINCT run_index), 0)))) AS run_index FROM (SELECT event_type AS cell, CAST(user_id % 40 + 1 AS INTEGER) AS run_index FROM events) GROUP BY cell""")
def selection_run_indices(spark, sf):
    """Run indices present per cell, always with 0"""
    present = table(spark, sf, "events").select(F.col("event_type").alias("cell"), (F.col("user_id") % 40 + 1).cast("int").alias("run_index"))
    from evalspark.sources.files import run_indices
    return run_indices(present, ["cell"])


@query("""SELECT r_name AS dataset, n_name AS subset, arm FROM region JOIN nation ON n_regionkey = r_regionkey, (SELECT unnest(['baseline','staged','memgate']) AS arm)
WHERE r_name IN ('ASIA','EUROPE') AND arm IN ('baseline','staged') AND n_nationkey IN (SELECT c_nationkey FROM customer)""")
def selection_cells(spark, sf):
    """Comma lists pick cells, and only cells with rows stay"""
    from evalspark.operators.budget import matrix

    names = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    tasks = names.select(F.col("r_name").alias("dataset"), F.col("n_name").alias("subset"), "n_nationkey")
    present = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    cells = S.select_cells(matrix(tasks, ["all"], ["baseline", "staged", "memgate"]), {"dataset": "ASIA,EUROPE", "arm": "baseline,staged"})
    return cells.join(present, "n_nationkey", "left_semi").select("dataset", "subset", "arm")
