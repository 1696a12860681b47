"""Source operators over texts that the given tables hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalspark.queries import query, table
from evalspark.queries.standins import SQL_K, SQL_LINES, k_of, lines, sql_strip
from evalspark.session import ensure_checkpoint_dir
from evalspark.sinks.tables import read_sorted, write_sorted
from evalspark.sources import files as S


@query(f"""SELECT 'call' AS kind, CAST(event_id AS VARCHAR) AS sample_id, 'generation' AS phase, event_type AS stage, value AS latency_ms, {SQL_K} AS tokens FROM events
UNION ALL SELECT 'call', CAST(event_id AS VARCHAR), 'judge', 'judge', value * 2, {SQL_K} + 1 FROM events WHERE {SQL_K} > 50
UNION ALL SELECT 'sample', CAST(event_id AS VARCHAR), 'generation', NULL, value, NULL FROM events
UNION ALL SELECT 'sample', CAST(event_id AS VARCHAR), 'judge', NULL, value + 1, NULL FROM events WHERE {SQL_K} > 50""")
def source_sample_files(spark, sf):
    """Per-sample JSON texts with one or two phases"""
    k = k_of(F.col("props"))

    def phase(stage, latency, tokens, wall):
        return F.struct(F.struct(wall.alias("latency_ms")).alias("sample"),
                        F.array(F.struct(stage.alias("stage"), latency.alias("latency_ms"), tokens.alias("tokens"))).alias("calls"))

    generation = phase(F.col("event_type"), F.col("value"), k, F.col("value"))
    judge = phase(F.lit("judge"), F.col("value") * 2, k + 1, F.col("value") + 1)
    phases = F.when(k > 50, F.create_map(F.lit("generation"), generation, F.lit("judge"), judge)).otherwise(F.create_map(F.lit("generation"), generation))
    texts = table(spark, sf, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("sample_id"), phases.alias("phases"))).alias("text"))
    samples, calls = S.flatten_sample_files(texts, "text", "struct<latency_ms:double>", "struct<stage:string,latency_ms:double,tokens:int>")
    calls = calls.select(F.lit("call").alias("kind"), "sample_id", "phase", "stage", "latency_ms", "tokens")
    return calls.unionByName(samples.withColumn("kind", F.lit("sample")), allowMissingColumns=True)


@query(f"SELECT source, CAST(sum(len(list_filter({SQL_LINES}, lambda x: length({sql_strip('x')}) > 0))) AS BIGINT) AS lines FROM documents GROUP BY 1")
def source_line_count(spark, sf):
    """A11"""
    return S.line_count(table(spark, sf, "documents"), ["source"], "text")


@query(f"""WITH l AS (SELECT doc_id, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) - 1 AS i FROM documents),
v AS (SELECT doc_id, i, line, {sql_strip('''CASE i % 5 WHEN 0 THEN CAST(json_object('sample_id', line) AS VARCHAR) WHEN 1 THEN line WHEN 2 THEN '[' || i || ']' WHEN 3 THEN '{"a": ' || i || '} tail' ELSE '   ' END''')} AS t FROM l)
SELECT doc_id, i AS line_number, CASE WHEN NOT json_valid(t) THEN 'not JSON' WHEN json_type(t) <> 'OBJECT' THEN 'not an object' END AS problem,
 md5(CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN json_extract_string(t, '$.sample_id') END) AS digest FROM v WHERE length(t) > 0""")
def source_audit_lines(spark, sf):
    """Objects, prose, arrays, trailing text and blank lines"""
    def written(t, i):
        return (F.when(i % 5 == 0, F.to_json(F.struct(t.alias("sample_id")))).when(i % 5 == 1, t)
                .when(i % 5 == 2, F.concat(F.lit("["), i.cast("string"), F.lit("]")))
                .when(i % 5 == 3, F.concat(F.lit('{"a": '), i.cast("string"), F.lit("} tail"))).otherwise("   "))
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.transform(lines(F.col("text")), written)).alias("p", "value"))
    out = S.audit_lines(rows)
    return out.select("doc_id", F.col("p").cast("bigint").alias("line_number"), "problem",
                      F.md5(F.try_variant_get("parsed", "$.sample_id", "string")).alias("digest"))


@query("""WITH c AS (SELECT source, count(*) FILTER (lang <> 'es') AS outputs, count(*) FILTER (lang = 'es') AS unreadable_outputs FROM documents GROUP BY 1),
j AS (SELECT source, count(*) FILTER (toxic = 0) AS judge, count(*) FILTER (toxic = 1) AS unreadable_judge FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT s.source, s.source <> 'src7' AS has_config, coalesce(outputs, 0) AS outputs, coalesce(unreadable_outputs, 0) AS unreadable_outputs, coalesce(judge, 0) AS judge, coalesce(unreadable_judge, 0) AS unreadable_judge
FROM (SELECT DISTINCT source FROM documents UNION ALL SELECT 'absent') s LEFT JOIN c USING (source) LEFT JOIN j USING (source)""".replace("s.source <> 'src7' AS has_config", "s.source NOT IN ('src7', 'absent') AS has_config"))
def source_load_arms(spark, sf):
    """One expected arm has no parts, one no config"""
    docs = table(spark, sf, "documents")
    names = docs.select("source").distinct()
    expected = names.unionByName(spark.createDataFrame([("absent",)], "source string"))
    outputs = docs.select("source", F.when(F.col("lang") == "es", "not JSON").alias("problem"))
    judged = table(spark, sf, "labels").join(docs.select("doc_id", "source"), "doc_id").select("source", F.when(F.col("toxic") == 1, "not JSON").alias("problem"))
    return S.load_arms(expected, names.where("source <> 'src7'"), outputs, judged, ["source"])


@query("""SELECT row_number() OVER (ORDER BY ts, event_id) AS position, event_id, user_id FROM events""")
def sink_sorted_calls(spark, sf):
    """H1, H2, B2: calls written in total order by start time, published whole, and read back with their positions"""
    path = f"{ensure_checkpoint_dir(spark)}/sorted/{uuid.uuid4().hex}"
    calls = table(spark, sf, "events").select("ts", "event_id", "user_id")
    write_sorted(calls, path, ["user_id", "event_id"])  # an older version, replaced whole
    write_sorted(calls, path, ["ts", "event_id"], part_rows=2_000)
    return read_sorted(spark, path, "event_id bigint, user_id bigint")
