"""Reply recovery, scoring and stage validation over replies written from documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evalspark.functions import replies as R
from evalspark.queries import ORACLES, query, table
from evalspark.queries.standins import RE2_WS, SQL_LINES, lines, sql_strip


def _cases(number: Column, texts: list[Column]) -> Column:
    """The text whose position equals ``number``."""
    out = F.lit(None).cast("string")
    for i, text in enumerate(texts):
        out = F.when(number == i, text).otherwise(out)
    return out


def _judge_replies(spark, sf):
    q = (F.col("n_chars") % 7).cast("string")
    s = F.col("source")
    texts = [
        F.concat(F.lit('```json\n{"reasoning": "'), s, F.lit('", "score": '), q, F.lit("}\n```")),
        F.concat(F.lit('Here is my judgement: {"reasoning": "'), s, F.lit('", "score": '), q, F.lit("}\nHope that helps.")),
        F.concat(F.lit('<think>hmm {x}</think>\n<think> two </think>{"reasoning": "'), s, F.lit('", "score": '), q, F.lit("}")),
        F.concat(F.lit('{"reasoning": "'), s, F.lit('", "score": " '), q, F.lit('"}')),
        F.concat(F.lit('{"reasoning": "'), s, F.lit('", "score": true}')),
        F.concat(F.lit('{"reasoning": "'), s, F.lit('", "score": null, "rating": '), q, F.lit(".9}")),
        F.concat(F.lit('{"score": '), q, F.lit("} tail")),
        F.concat(F.lit("["), q, F.lit("]")),
        F.concat(F.lit('x {"a":{"b":{"c": '), q, F.lit("}}} y")),
        F.concat(F.lit('{"reasoning": "  ", "score": '), q, F.lit("}")),
        F.to_json(F.struct(F.col("text").alias("reasoning"), (F.col("n_chars") % 7).alias("score"))),
    ]
    return table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % 11).alias("kind"), _cases(F.col("doc_id") % 11, texts).alias("reply"))


_REPLIES = """replies AS (SELECT doc_id, doc_id % 11 AS kind, CASE doc_id % 11
 WHEN 0 THEN '```json' || chr(10) || '{"reasoning": "' || source || '", "score": ' || n_chars % 7 || '}' || chr(10) || '```'
 WHEN 1 THEN 'Here is my judgement: {"reasoning": "' || source || '", "score": ' || n_chars % 7 || '}' || chr(10) || 'Hope that helps.'
 WHEN 2 THEN '<think>hmm {x}</think>' || chr(10) || '<think> two </think>{"reasoning": "' || source || '", "score": ' || n_chars % 7 || '}'
 WHEN 3 THEN '{"reasoning": "' || source || '", "score": " ' || n_chars % 7 || '"}'
 WHEN 4 THEN '{"reasoning": "' || source || '", "score": true}'
 WHEN 5 THEN '{"reasoning": "' || source || '", "score": null, "rating": ' || n_chars % 7 || '.9}'
 WHEN 6 THEN '{"score": ' || n_chars % 7 || '} tail'
 WHEN 7 THEN '[' || n_chars % 7 || ']'
 WHEN 8 THEN 'x {"a":{"b":{"c": ' || n_chars % 7 || '}}} y'
 WHEN 9 THEN '{"reasoning": "  ", "score": ' || n_chars % 7 || '}'
 ELSE CAST(json_object('reasoning', text, 'score', n_chars % 7) AS VARCHAR) END AS reply FROM documents)"""


def _sql_object(expr: str) -> str:
    return f"CASE WHEN json_valid({expr}) AND json_type({expr}) = 'OBJECT' THEN {expr} END"


@query(f"""WITH {_REPLIES} SELECT doc_id, md5({sql_strip("regexp_replace(reply, '<think>(.|\\n)*?</think>', '', 'g')")}) AS answer,
 array_to_string(list_transform(regexp_extract_all(reply, '<think>((?:.|\\n)*?)</think>', 1), lambda x: {sql_strip('x')}), chr(10)) AS trace FROM replies""")
def reply_split_reasoning(spark, sf):
    """J8"""
    parts = R.split_reasoning(F.col("reply"))
    return _judge_replies(spark, sf).select("doc_id", F.md5(parts["answer"]).alias("answer"), parts["trace"].alias("trace"))


_STRICT = f"""s AS (SELECT doc_id, regexp_replace({sql_strip('reply')}, '(?m)^```json[{RE2_WS}]*|[{RE2_WS}]*```$', '', 'g') AS t FROM replies)"""
_LADDER = rf"""a AS (SELECT doc_id, kind, {sql_strip("regexp_replace(reply, '<think>(.|\n)*?</think>', '', 'g')")} AS t FROM replies),
l AS (SELECT doc_id, kind, coalesce({_sql_object('t')}, {_sql_object("regexp_extract(t, '\\{[^{}]*(?:\\{[^{}]*\\}[^{}]*)*\\}', 0)")},
  {_sql_object("regexp_extract(t, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1)")}) AS obj FROM a)"""


@query(f"""WITH {_REPLIES}, {_STRICT}, {_LADDER},
o AS (SELECT doc_id, regexp_replace(regexp_replace({sql_strip('reply')}, '^```(?:json)?', ''), '[{RE2_WS}]*```$', '') AS t FROM replies),
p AS (SELECT doc_id, coalesce({_sql_object('t')}, {_sql_object("regexp_extract(t, '(?s)\\{.*\\}', 0)")}) AS obj FROM o)
SELECT s.doc_id, {_sql_object('s.t')} IS NOT NULL AS strict_ok, l.obj IS NOT NULL AS ladder_ok, p.obj IS NOT NULL AS outermost_ok,
 CAST(json_extract(l.obj, '$.b.c') AS BIGINT) AS inner_value, CAST(length(json_extract_string(p.obj, '$.reasoning')) AS BIGINT) AS reasoning_chars
FROM s JOIN l USING (doc_id) JOIN p ON p.doc_id = s.doc_id""")
def reply_recover_json(spark, sf):
    """J9, J10, J11, T1, T3, T23"""
    parsed = _judge_replies(spark, sf).select(
        "doc_id", R.recover_strict(F.col("reply")).alias("strict"),
        R.recover_ladder(R.split_reasoning(F.col("reply"))["answer"]).alias("ladder"),
        R.recover_outermost(F.col("reply")).alias("outermost"))
    return parsed.select(
        "doc_id", F.col("strict").isNotNull().alias("strict_ok"), F.col("ladder").isNotNull().alias("ladder_ok"),
        F.col("outermost").isNotNull().alias("outermost_ok"),
        F.try_variant_get("ladder", "$.b.c", "bigint").alias("inner_value"),
        F.length(F.try_variant_get("outermost", "$.reasoning", "string")).cast("bigint").alias("reasoning_chars"))


@query(f"""WITH {_REPLIES}, {_LADDER},
v AS (SELECT doc_id, kind, obj, CASE WHEN coalesce(json_type(obj, '$.score'), 'NULL') <> 'NULL' THEN '$.score' ELSE '$.rating' END AS path FROM l),
w AS (SELECT *, CASE WHEN json_type(obj, '$.score') IS NULL OR json_type(obj, '$.score') = 'NULL' THEN json_type(obj, '$.rating') ELSE json_type(obj, '$.score') END AS kind_of,
  CASE WHEN path = '$.score' THEN json_extract_string(obj, '$.score') ELSE json_extract_string(obj, '$.rating') END AS raw FROM v),
x AS (SELECT *, CASE WHEN kind_of IN ('BIGINT','UBIGINT') THEN CAST(raw AS BIGINT) WHEN kind_of = 'DOUBLE' THEN CAST(trunc(CAST(raw AS DOUBLE)) AS BIGINT)
  WHEN kind_of = 'VARCHAR' AND regexp_matches(trim(raw), '^[+-]?[0-9]+$') THEN CAST(trim(raw) AS BIGINT) END AS value FROM w),
y AS (SELECT *, CASE WHEN kind_of IS NULL OR kind_of = 'NULL' THEN 'no score' WHEN kind_of = 'BOOLEAN' THEN 'boolean score' WHEN value IS NULL THEN 'score is not an integer'
  WHEN NOT (value BETWEEN 1 AND CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 3 END) THEN 'score out of range' END AS problem,
  CASE WHEN NOT coalesce(json_type(obj, '$.reasoning') = 'VARCHAR' AND length({sql_strip("json_extract_string(obj, '$.reasoning')")}) > 0, false) THEN 'missing reasoning' END AS why FROM x)
SELECT doc_id, CASE WHEN obj IS NOT NULL AND problem IS NULL THEN CAST(value AS INTEGER) END AS score,
 CASE WHEN obj IS NULL THEN '' ELSE replace(path, '$.', '') END AS score_key,
 CASE WHEN obj IS NULL THEN 'no JSON object' ELSE concat_ws(';', why, problem) END AS problems FROM y""")
def reply_score_single(spark, sf):
    """Scale 1-5 on even ids, 1-3 on odd ones."""
    high = F.when(F.col("doc_id") % 2 == 0, F.lit(5)).otherwise(F.lit(3))
    parsed = _judge_replies(spark, sf).select(
        "doc_id", R.recover_ladder(R.split_reasoning(F.col("reply"))["answer"]).alias("parsed"))
    scored = parsed.select("doc_id", R.score_single(F.col("parsed"), F.lit(1), high).alias("s"))
    return scored.select("doc_id", "s.score", F.col("s.key").alias("score_key"), F.array_join("s.problems", ";").alias("problems"))


RUBRIC = 'Score each part. Reply {"dimension_1_safety": {"score": 0}, "dimension_2_focus" : {"score": 0}} only.'


def _dimension_replies(spark, sf):
    a, b = (F.col("n_chars") % 8).cast("string"), (F.col("doc_id") % 6).cast("string")

    def obj(first: str, second: str, extra: str = "") -> Column:
        return F.concat(F.lit('{"dimension_1_safety": '), F.lit(first.split("@")[0]), a, F.lit(first.split("@")[1]),
                        F.lit(', "dimension_2_focus": '), F.lit(second.split("@")[0]), b, F.lit(second.split("@")[1]), F.lit(extra + "}"))
    whole = '{"score": @}'
    texts = [
        obj(whole, whole), F.concat(F.lit("```json\n"), obj(whole, whole), F.lit("\n```")),
        obj(whole, whole, ', "dimension_3_more": {"score": 1}, "note": "x"'), obj('{"score": "@"}', whole),
        obj(whole, '{"score": @.0}'), obj("[@]", whole), F.concat(F.lit("So: "), obj(whole, whole)),
        F.concat(F.lit('{"dimension_2_focus": {"score": '), b, F.lit("}}")), obj('{"score": true, "n": @}', whole),
    ]
    return table(spark, sf, "documents").select("doc_id", _cases(F.col("doc_id") % 9, texts).alias("reply"))




@query("""WITH d AS (SELECT doc_id, doc_id % 9 AS k, n_chars % 8 AS a, doc_id % 6 AS b FROM documents),
e AS (SELECT doc_id, k, b,
  CASE WHEN k IN (3) THEN 'score is not an integer' WHEN k = 5 THEN 'not an object' WHEN k = 7 THEN 'not an object' WHEN k = 8 THEN 'score is not an integer'
       WHEN a > 5 THEN 'score out of range' END AS p1, a,
  CASE WHEN k = 4 THEN 'score is not an integer' WHEN b > 5 THEN 'score out of range' END AS p2 FROM d)
SELECT doc_id, CASE WHEN k = 6 THEN '' ELSE concat_ws(',', CASE WHEN p1 IS NULL THEN 'dimension_1_safety=' || a END, CASE WHEN p2 IS NULL THEN 'dimension_2_focus=' || b END) END AS scores,
 CASE WHEN k = 6 THEN 'no JSON object' ELSE concat_ws(';', CASE WHEN k = 7 THEN 'missing: dimension_1_safety' END, CASE WHEN k = 2 THEN 'unexpected: dimension_3_more' END,
   CASE WHEN p1 IS NOT NULL THEN 'dimension_1_safety: ' || p1 END, CASE WHEN p2 IS NOT NULL THEN 'dimension_2_focus: ' || p2 END) END AS problems FROM e""")
def reply_score_dimensions(spark, sf):
    """J12, J13, J15"""
    expected = R.declared_dimensions(F.lit(RUBRIC))
    parsed = _dimension_replies(spark, sf).select("doc_id", R.recover_strict(F.col("reply")).alias("parsed"))
    scored = parsed.select("doc_id", R.score_dimensions(F.col("parsed"), expected).alias("s"))
    pairs = F.transform(F.map_entries("s.scores"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return scored.select("doc_id", F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("scores"),
                         F.array_join("s.problems", ";").alias("problems"))


_JUDGED_VALUES = "list_transform(regexp_extract_all(m.scores, '=([0-9]+)', 1), lambda x: CAST(x AS INTEGER))"


@query(f"""WITH single AS ({ORACLES["reply_score_single"]}), dims AS ({ORACLES["reply_score_dimensions"]})
SELECT d.doc_id, s.score, s.score_key, CASE WHEN d.doc_id % 3 <> 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN 5 ELSE 3 END END AS scale_high,
 CASE WHEN d.doc_id % 3 <> 0 THEN CASE WHEN d.doc_id % 11 = 2 THEN 'hmm {{x}}' || chr(10) || 'two' ELSE '' END END AS judge_reasoning,
 CASE WHEN m.doc_id IS NULL THEN 0 ELSE CAST(len({_JUDGED_VALUES}) AS INTEGER) END AS dimension_count,
 round(list_sum({_JUDGED_VALUES}) / nullif(len({_JUDGED_VALUES}), 0), 6) AS dimension_mean,
 coalesce(s.problems, m.problems) = 'no JSON object' AS kept_raw, coalesce(s.problems, m.problems) AS problems
FROM documents d LEFT JOIN single s ON s.doc_id = d.doc_id AND d.doc_id % 3 <> 0 LEFT JOIN dims m ON m.doc_id = d.doc_id AND d.doc_id % 3 = 0""")
def reply_interpret(spark, sf):
    """Every third document is judged by dimensions, the others by one score."""
    third = F.col("doc_id") % 3 == 0
    replies = _judge_replies(spark, sf).where(~third).select("doc_id", "reply").unionByName(_dimension_replies(spark, sf).where(third))
    metric = F.when(F.col("doc_id") % 2 == 0, "failure").otherwise("rating3")
    judged = replies.select("doc_id", R.interpret(F.col("reply"), F.lit(RUBRIC), third, metric).alias("j")).select("doc_id", "j.*")
    return judged.select("doc_id", "score", "score_key", "scale_high", "judge_reasoning", "dimension_count",
                         F.round("dimension_mean", 6).alias("dimension_mean"), F.col("raw_judge").isNotNull().alias("kept_raw"),
                         F.array_join("problems", ";").alias("problems"))


def _memory_ids():
    return F.transform(lines(F.col("text")), lambda _l, i: F.concat(F.lit("m"), (i + 1).cast("string")))


@query(f"""WITH d AS (SELECT doc_id, doc_id % 8 AS k, len({SQL_LINES}) AS n FROM documents)
SELECT doc_id, CASE k WHEN 1 THEN CASE WHEN n > 1 THEN 'memory ids differ' END WHEN 2 THEN 'key_factors' WHEN 3 THEN 'conditional_use_rules'
 WHEN 4 THEN 'boundary_summary' WHEN 5 THEN NULL WHEN 6 THEN 'setting_use_assessments' WHEN 7 THEN 'no card list' END AS problem FROM d""")
def reply_validate_stage1(spark, sf):
    """Faults by doc_id % 8 written into cards for every line."""
    k = F.col("doc_id") % 8
    ids = F.when(k == 1, F.reverse(_memory_ids())).otherwise(_memory_ids())

    def card(m: Column) -> Column:
        return F.struct(
            m.alias("memory_id"),
            F.when(~k.isin(5, 6), F.array(F.lit("factor"), F.when(k == 2, " ").otherwise("other"))).alias("key_factors"),
            F.when(k.isin(5, 6), F.array(F.lit("t"))).alias("task_types"),
            F.when(k.isin(5, 6), F.array(F.struct(F.lit(1).alias("x")))).alias("counterfactual_settings"),
            F.when(k == 5, F.array(F.lit("a"))).alias("setting_use_assessments"),
            F.when(k != 3, F.array(F.lit("rule"))).otherwise(F.array().cast("array<string>")).alias("conditional_use_rules"),
            F.when(k == 4, "\n").otherwise("summary").alias("boundary_summary"))

    reply = F.when(k == 7, '{"memory_boundary_cards": "none"}').otherwise(
        F.to_json(F.struct(F.transform(ids, card).alias("memory_boundary_cards"))))
    docs = table(spark, sf, "documents").select("doc_id", _memory_ids().alias("ids"), R.recover_outermost(reply).alias("parsed"))
    return docs.select("doc_id", R.stage1_problem(F.col("parsed"), F.col("ids")).alias("problem"))


@query(f"""WITH d AS (SELECT doc_id, doc_id % 7 AS k, len({SQL_LINES}) AS n FROM documents),
p AS (SELECT doc_id, k, n, CASE k WHEN 2 THEN CASE WHEN n > 1 THEN 'memory ids differ' END WHEN 3 THEN 'memory ids differ' WHEN 4 THEN 'use_instruction' WHEN 5 THEN 'rationale' WHEN 6 THEN 'no instruction list' END AS problem FROM d)
SELECT doc_id, problem, CASE WHEN problem IS NULL THEN md5(array_to_string(list_transform(range(1, n + 1), lambda i: 'm' || i || ':use' || CASE WHEN k = 1 THEN n + 1 - i ELSE i END), ',')) END AS digest FROM p""")
def reply_validate_stage2(spark, sf):
    """Order changed, ids absent, duplicated, invented, or texts missing."""
    k = F.col("doc_id") % 7

    def item(m: Column, i: Column) -> Column:
        named = (F.when(k == 0, F.lit(None)).when(k == 2, "m1").when((k == 3) & (i == 0), "mx").otherwise(m))
        return F.struct(named.alias("memory_id"),
                        F.when((k == 4) & (i == 0), " ").otherwise(F.concat(F.lit("use"), (i + 1).cast("string"))).alias("use_instruction"),
                        F.when((k == 5) & (i == 0), F.lit(None)).otherwise("why").alias("rationale"))

    ids = F.when(k == 1, F.reverse(_memory_ids())).otherwise(_memory_ids())
    reply = F.when(k == 6, '{"other": []}').otherwise(
        F.to_json(F.struct(F.transform(ids, item).alias("memory_use_instructions"))))
    docs = table(spark, sf, "documents").select("doc_id", _memory_ids().alias("ids"), R.recover_outermost(reply).alias("parsed"))
    checked = docs.select("doc_id", R.stage2_instructions(F.col("parsed"), F.col("ids")).alias("r"))
    listed = F.array_join(F.transform("r.instructions", lambda i: F.concat(i["memory_id"], F.lit(":"), i["use_instruction"])), ",")
    return checked.select("doc_id", F.col("r.problem"), F.md5(listed).alias("digest"))


@query(f"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, CAST(len({SQL_LINES}) AS BIGINT) AS n FROM documents)
SELECT doc_id, CASE k WHEN 2 THEN 'unknown memory id' WHEN 3 THEN 'no JSON object' END AS keep_problem,
 CASE WHEN k NOT IN (2, 3) THEN array_to_string(list_transform(list_filter(range(1, n + 1), lambda i: i % 2 = 1), lambda i: 'm' || i), ',') END AS kept,
 CASE WHEN k IN (0, 1) THEN NULL WHEN k = 2 THEN 'duplicate memory ids' WHEN k = 3 THEN 'no JSON object' WHEN k = 4 THEN 'ids do not cover the memories' ELSE 'ids do not cover the memories' END AS partition_problem,
 CASE WHEN k IN (0, 1) THEN n END AS partitioned FROM d""")
def reply_selected_ids(spark, sf):
    """Keep lists and partitions with unknown, duplicate, missing and invented ids."""
    k = F.col("doc_id") % 6
    ids = _memory_ids()
    odd = F.filter(ids, lambda _m, i: i % 2 == 0)
    keep = F.when(k == 2, F.concat(odd, F.array(F.lit("mx")))).when(k == 1, F.reverse(odd)).otherwise(odd)
    keep_reply = F.when(k == 3, "I would keep all").otherwise(F.to_json(F.struct(keep.alias("keep_memory_ids"))))
    even = F.filter(ids, lambda _m, i: i % 2 == 1)
    second = (F.when(k == 2, F.concat(even, F.array(F.lit("m1")))).when(k == 4, F.concat(even, F.array(F.lit("mx")))).otherwise(even))
    first = F.when(k == 5, F.slice(odd, 2, F.size(odd))).otherwise(odd)
    groups = F.array(F.struct(F.lit("a").alias("domain"), first.alias("memory_ids")), F.struct(F.lit("b").alias("domain"), second.alias("memory_ids")))
    part_reply = F.when(k == 3, "{").otherwise(F.to_json(F.struct(groups.alias("groups"))))
    docs = table(spark, sf, "documents").select("doc_id", ids.alias("ids"), keep_reply.alias("kr"), part_reply.alias("pr"))
    done = docs.select("doc_id", R.selected_ids(F.col("kr"), F.col("ids"), False).alias("k"), R.selected_ids(F.col("pr"), F.col("ids"), True).alias("p"))
    return done.select("doc_id", F.col("k.problem").alias("keep_problem"), F.array_join("k.ids", ",").alias("kept"),
                       F.col("p.problem").alias("partition_problem"),
                       F.when(F.col("p.problem").isNull(), F.size("p.ids").cast("bigint")).alias("partitioned"))


@query("""WITH d AS (SELECT doc_id, n_chars AS n, doc_id % 6 AS k FROM documents)
SELECT doc_id, CASE k WHEN 5 THEN NULL WHEN 3 THEN NULL ELSE n END AS input_tokens, CASE k WHEN 2 THEN NULL WHEN 5 THEN NULL ELSE doc_id END AS output_tokens,
 CASE k WHEN 0 THEN 2 * n WHEN 1 THEN n + doc_id WHEN 4 THEN n + doc_id ELSE NULL END AS total_tokens,
 CASE k WHEN 0 THEN CAST(7 AS BIGINT) WHEN 1 THEN CAST(9 AS BIGINT) END AS cached_input_tokens, CASE k WHEN 1 THEN CAST(3 AS BIGINT) END AS reasoning_tokens,
 k <> 5 AS usage_available FROM d""")
def reply_token_usage(spark, sf):
    """Both field spellings, absent parts, booleans and texts."""
    n, d = F.col("n_chars").cast("string"), F.col("doc_id").cast("string")
    texts = [
        F.concat(F.lit('{"usage": {"prompt_tokens": '), n, F.lit(', "completion_tokens": '), d, F.lit(', "total_tokens": '),
                 (F.col("n_chars") * 2).cast("string"), F.lit(', "prompt_tokens_details": {"cached_tokens": 7}}}')),
        F.concat(F.lit('{"usage": {"input_tokens": '), n, F.lit(', "output_tokens": '), d,
                 F.lit(', "input_tokens_details": {"cache_read_input_tokens": 9}, "output_tokens_details": {"thinking_tokens": 3}}}')),
        F.concat(F.lit('{"usage": {"prompt_tokens": '), n, F.lit('}}')),
        F.concat(F.lit('{"usage": {"prompt_tokens": true, "completion_tokens": '), d, F.lit('}}')),
        F.concat(F.lit('{"usage": {"prompt_tokens": "'), n, F.lit('", "completion_tokens": '), d, F.lit('}}')),
        F.lit('{"id": 1}'),
    ]
    docs = table(spark, sf, "documents").select("doc_id", F.try_parse_json(_cases(F.col("doc_id") % 6, texts)).alias("v"))
    return docs.select("doc_id", R.token_usage(F.col("v")).alias("u")).select("doc_id", "u.*")


@query("""WITH d AS (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 END AS status,
 CASE doc_id % 4 WHEN 0 THEN text || ' Read TIMEOUT ' WHEN 1 THEN 'bad request' || text ELSE text END AS message FROM documents)
SELECT doc_id, coalesce(status = 429 OR status BETWEEN 500 AND 599, false) OR
 list_bool_or(list_transform(['connection error','connection reset','connection refused','connection aborted','remote protocol error','remoteprotocolerror','read timeout','readtimeout','connect timeout','connecttimeout','timed out','timeout','rate limit','rate_limit','too many requests','temporarily unavailable','service unavailable','bad gateway','gateway timeout','internal server error','server disconnected','http 429','status code 429','status_code=429','http 500','http 502','http 503','http 504'], lambda m: contains(lower(message), m))) AS transient FROM d""")
def reply_transient_errors(spark, sf):
    """D6"""
    k5, k4 = F.col("doc_id") % 5, F.col("doc_id") % 4
    status = F.when(k5 == 0, 429).when(k5 == 1, 503).when(k5 == 2, 404)
    message = (F.when(k4 == 0, F.concat("text", F.lit(" Read TIMEOUT ")))
               .when(k4 == 1, F.concat(F.lit("bad request"), "text")).otherwise(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", R.is_transient(status, message).alias("transient"))


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN quality = 1 WHEN 1 THEN true WHEN 2 THEN toxic = 1 END AS passed FROM labels""")
def reply_binary_value(spark, sf):
    """Booleans and 0/1 pass, 1.0, "1", 2, null and lists do not."""
    texts = [F.col("quality").cast("string"), F.lit("true"), F.col("toxic").cast("string"), F.lit("1.0"), F.lit('"1"'), F.lit("2"), F.lit("[1]")]
    value = F.try_parse_json(_cases(F.col("doc_id") % 7, texts))
    return table(spark, sf, "labels").select("doc_id", R.binary_value(value).alias("passed"))
