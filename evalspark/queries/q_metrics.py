"""Metric tables over judge scores from events and pass columns from labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.stats import rounded_mean, wilson_interval
from evalspark.operators import metrics as M
from evalspark.operators.ordered import exact_quantiles
from evalspark.queries import query, table
from evalspark.queries.standins import EXPECTED_SQL, SCORES_SQL, SQL_K, expected_samples, k_of, scores

_BOUND = """CASE WHEN n > 0 THEN {f}({edge}, (p + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) {sign} 1.96 * sqrt((p*(1-p) + 1.96*1.96/(4*n)) / n) / (1 + 1.96*1.96/n)) * 100 END"""
_LOW, _HIGH = _BOUND.format(f="greatest", edge="0.0", sign="-"), _BOUND.format(f="least", edge="1.0", sign="+")

_LATEST = "latest AS (SELECT task, sample_id, run_index, arg_max(score, event_id) AS score FROM scores GROUP BY ALL)"


def _latest(spark, sf):
    return M.latest_scores(scores(spark, sf), ["task"], F.col("event_id"), 3)


_RATES = f"""{SCORES_SQL}, {EXPECTED_SQL}, {_LATEST},
ks AS (SELECT e.task, e.sample_id, k FROM expected e, (SELECT unnest([1,2,3]) AS k) WHERE k <= CASE WHEN task = 'signup' THEN 1 ELSE 3 END),
worst AS (SELECT ks.task, ks.sample_id, ks.k, max(score) AS worst FROM ks LEFT JOIN latest l ON l.task = ks.task AND l.sample_id = ks.sample_id AND l.run_index < ks.k GROUP BY ALL),
agg AS (SELECT task, k, count(*) AS expected, count(worst) AS n, count(*) FILTER (worst >= 3) AS hits FROM worst GROUP BY ALL),
b AS (SELECT *, CASE WHEN n > 0 THEN hits::DOUBLE / n END AS p FROM agg),
c AS (SELECT *, {_LOW} AS lo, {_HIGH} AS hi FROM b)"""


def _rates(spark, sf):
    k = F.when(F.col("task") == "signup", 1).otherwise(3)
    return M.failure_rate_at_k(expected_samples(spark, sf), _latest(spark, sf), ["task"], k, F.col("task") == "signup", 3)


@query(f"""WITH {_RATES}
SELECT task, 'FR@' || k AS k_label, CAST(k AS INTEGER) AS k, round(CASE WHEN task = 'signup' THEN 100 - p * 100 ELSE p * 100 END, 6) AS rate_percent,
 round(CASE WHEN task = 'signup' THEN 100 - hi ELSE lo END, 6) AS ci95_low, round(CASE WHEN task = 'signup' THEN 100 - lo ELSE hi END, 6) AS ci95_high,
 hits, n AS n_scored, round(n::DOUBLE / expected, 6) AS coverage FROM c""")
def metrics_failure_rate_at_k(spark, sf):
    """F2, F3, G14 (flagship): signup stands for the inverted single-generation class"""
    return _rates(spark, sf).withColumns({c: F.round(c, 6) for c in ("rate_percent", "ci95_low", "ci95_high", "coverage")})


@query(f"""WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS hits FROM events GROUP BY 1),
b AS (SELECT *, hits::DOUBLE / n AS p FROM g)
SELECT user_id, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high, round(100 - ({_HIGH}), 6) AS inverted_low, round(100 - ({_LOW}), 6) AS inverted_high FROM b""")
def metrics_wilson_interval(spark, sf):
    """F3"""
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("hits"))
    plain, turned = wilson_interval(F.col("hits"), F.col("n")), wilson_interval(F.col("hits"), F.col("n"), True)
    return g.select("user_id", F.round(plain["low"], 6).alias("low"), F.round(plain["high"], 6).alias("high"),
                    F.round(turned["low"], 6).alias("inverted_low"), F.round(turned["high"], 6).alias("inverted_high"))


def judgements(spark, sf):
    """Two to four dimension scores per event, some outside 0..5."""
    n = (F.col("event_id") % 3 + 2).cast("int")
    steps = F.sequence(F.lit(1), n)
    names = F.transform(steps, lambda j: F.concat(F.lit("dimension_"), j.cast("string"), F.lit("_axis")))
    values = F.transform(steps, lambda j: ((F.col("k") + j * F.col("event_id")) % 8 - 1).cast("int"))
    return table(spark, sf, "events").withColumn("k", k_of(F.col("props"))).select(
        "event_id", F.col("event_type").alias("task"), F.concat(F.lit("system"), (F.col("user_id") % 3).cast("string")).alias("system"),
        F.map_from_arrays(names, values).alias("dimension_scores"))


_DIMS = f"""dims AS (SELECT event_id, event_type AS task, 'system' || user_id % 3 AS system, 'dimension_' || j || '_axis' AS dimension, ({SQL_K} + j * event_id) % 8 - 1 AS value
  FROM events, (SELECT unnest([1,2,3,4]) AS j) WHERE j <= event_id % 3 + 2),
means AS (SELECT task, system, dimension, count(*) AS n, avg(value) AS mean FROM dims WHERE value BETWEEN 0 AND 5 GROUP BY ALL)"""


@query(f"WITH {_DIMS} SELECT task, system, dimension, n, round(mean, 6) AS mean, round(mean / 5 * 100, 6) AS percent FROM means")
def metrics_dimension_means(spark, sf):
    """F1"""
    return M.dimension_means(judgements(spark, sf), ["task", "system"]).withColumns({c: F.round(c, 6) for c in ("mean", "percent")})


@query(f"WITH {_DIMS} SELECT task, system, round(avg(mean), 6) AS macro_mean, round(avg(mean) / 5 * 100, 6) AS macro_percent FROM means GROUP BY ALL")
def metrics_dimension_macro(spark, sf):
    """unweighted mean of dimension means"""
    means = M.dimension_means(judgements(spark, sf), ["task", "system"])
    return M.dimension_macro(means, ["task", "system"]).withColumns({c: F.round(c, 6) for c in ("macro_mean", "macro_percent")})


@query(f"WITH {_DIMS} SELECT event_id, count(*) AS dimension_count, round(avg(value), 6) AS dimension_mean FROM dims GROUP BY 1")
def metrics_judgement_summary(spark, sf):
    """F19"""
    s = M.dimension_summary(F.col("dimension_scores"))
    return judgements(spark, sf).select("event_id", s["dimension_count"].cast("bigint").alias("dimension_count"), F.round(s["dimension_mean"], 6).alias("dimension_mean"))


@query(f"""WITH {_RATES}, {_DIMS}
SELECT task, system, dimension, n, round(mean, 6) AS mean, CAST(NULL AS VARCHAR) AS k_label, CAST(NULL AS DOUBLE) AS rate_percent FROM means
UNION ALL SELECT task, NULL, NULL, NULL, NULL, 'FR@' || k, round(CASE WHEN task = 'signup' THEN 100 - p * 100 ELSE p * 100 END, 6) FROM c""")
def metrics_flatten(spark, sf):
    """C17, I5, B3"""
    dims = M.dimension_means(judgements(spark, sf), ["task", "system"]).select("task", "system", "dimension", "n", F.round("mean", 6).alias("mean"))
    rates = _rates(spark, sf).select("task", "k_label", F.round("rate_percent", 6).alias("rate_percent"))
    return M.flatten_metrics(dims, rates)


@query(f"""WITH {SCORES_SQL}, {EXPECTED_SQL}, s AS (SELECT task, count(*) AS source_n FROM expected GROUP BY 1),
r AS (SELECT task, count(DISTINCT sample_id) AS retrieved_n, count(DISTINCT sample_id) FILTER (run_index = 0) AS judged_n FROM scores GROUP BY 1),
c AS (SELECT task, source_n, retrieved_n, judged_n, retrieved_n = source_n AS retrieval_complete, judged_n::DOUBLE / retrieved_n AS coverage FROM s JOIN r USING (task))
SELECT task, source_n, retrieved_n, judged_n, retrieval_complete, round(coverage, 6) AS judge_coverage, retrieval_complete AND coverage >= 0.98 AS reportable,
 CASE WHEN retrieval_complete AND coverage >= 0.98 THEN 'complete' ELSE 'pilot_or_incomplete' END AS status FROM c""")
def metrics_reportability(spark, sf):
    """Samples with any score are retrieved, those with a run-0 score are judged"""
    source = expected_samples(spark, sf).groupBy("task").agg(F.count(F.lit(1)).alias("source_n"))
    seen = scores(spark, sf).groupBy("task", "sample_id").agg(F.bool_or(F.col("run_index") == 0).alias("judged"))
    found = seen.groupBy("task").agg(F.count(F.lit(1)).alias("retrieved_n"), F.count_if("judged").alias("judged_n"))
    cells = source.join(found, "task")
    out = cells.select("*", M.reportability(F.col("source_n"), F.col("retrieved_n"), F.col("judged_n")).alias("r"))
    return out.select("task", "source_n", "retrieved_n", "judged_n", "r.retrieval_complete",
                      F.round("r.judge_coverage", 6).alias("judge_coverage"), "r.reportable", "r.status")


def native_tasks(spark):
    return spark.createDataFrame([(t,) for t in ("de", "en", "es", "fr", "it")], "task string")


def pass_rows(spark, sf):
    """Labels as judge rows of two methods; some values are invalid (NULL)."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    methods = F.array(
        F.struct(F.lit("baseline").alias("method"), F.when(F.col("doc_id") % 10 != 0, F.col("quality") == 1).alias("passed")),
        F.struct(F.lit("staged").alias("method"), F.when(F.col("doc_id") % 15 != 0, F.col("toxic") == 0).alias("passed")))
    return rows.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("task"), F.inline(methods))


_PASS = """rows AS (SELECT l.doc_id AS sample_id, lang AS task, CASE WHEN l.doc_id % 10 <> 0 THEN quality = 1 END AS b, CASE WHEN l.doc_id % 15 <> 0 THEN toxic = 0 END AS s FROM labels l JOIN documents d USING (doc_id)),
pass_rows AS (SELECT sample_id, task, 'baseline' AS method, b AS passed FROM rows UNION ALL SELECT sample_id, task, 'staged', s FROM rows)"""


@query(f"""WITH {_PASS} SELECT t.task, count(p.sample_id) AS n, count(passed) AS pass_valid_n, round(avg(CASE WHEN passed THEN 1.0 WHEN NOT passed THEN 0.0 END), 6) AS pass_value
FROM (SELECT unnest(['de','en','es','fr','it']) AS task) t LEFT JOIN (SELECT * FROM pass_rows WHERE method = 'staged') p USING (task) GROUP BY 1""")
def metrics_pass_summary(spark, sf):
    """one registered task has no rows"""
    judged = pass_rows(spark, sf).where("method = 'staged'")
    return M.pass_summary(native_tasks(spark), judged).withColumn("pass_value", F.round("pass_value", 6))


@query(f"""WITH {_PASS} SELECT method, task, count(*) AS expected_n, count(passed) AS valid_n, round(avg(CASE WHEN passed THEN 1.0 WHEN NOT passed THEN 0.0 END), 6) AS pass_rate, count(*) = count(passed) AS complete FROM pass_rows GROUP BY ALL""")
def metrics_method_table(spark, sf):
    """F6"""
    rows = pass_rows(spark, sf)
    selected = rows.where("method = 'baseline'").select("sample_id", "task")
    return M.method_table(selected, rows.select("method", "sample_id", "passed"), ["baseline", "staged"]).withColumn("pass_rate", F.round("pass_rate", 6))


@query(f"""WITH {_PASS}, t AS (SELECT method, task, count(*) = count(passed) AS complete, avg(CASE WHEN passed THEN 1.0 WHEN NOT passed THEN 0.0 END) AS rate FROM pass_rows GROUP BY ALL)
SELECT method, bool_and(rate IS NOT NULL AND complete) AS macro_complete, CASE WHEN bool_and(rate IS NOT NULL AND complete) THEN round(avg(rate), 6) END AS macro_task_pass FROM t GROUP BY 1""")
def metrics_method_macro(spark, sf):
    """macro only over complete methods"""
    rows = pass_rows(spark, sf)
    selected = rows.where("method = 'baseline'").select("sample_id", "task")
    grid = M.method_table(selected, rows.select("method", "sample_id", "passed"), ["baseline", "staged"])
    return M.pass_macro(grid, "pass_rate", F.col("complete"), ["method"]).withColumn("macro_task_pass", F.round("macro_task_pass", 6))


@query(f"""WITH {_PASS} SELECT count(*) AS paired_n, count(*) FILTER (s AND NOT b) AS wins, count(*) FILTER (NOT s AND b) AS losses,
 count(*) FILTER (s = b) AS ties, count(*) FILTER (s AND NOT b) - count(*) FILTER (NOT s AND b) AS net_wins FROM rows WHERE s IS NOT NULL AND b IS NOT NULL""")
def metrics_paired_outcomes(spark, sf):
    """E7"""
    rows = pass_rows(spark, sf)
    return M.paired_outcomes(rows.where("method = 'staged'"), rows.where("method = 'baseline'"))


@query("""SELECT user_id AS sample_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1""")
def metrics_last_record(spark, sf):
    """G14"""
    rows = table(spark, sf, "events").withColumn("sample_id", F.col("user_id"))
    return M.last_record(rows, ["sample_id"], F.col("event_id"), ["event_type", "value", "event_id"])


_DONE = f"{SCORES_SQL}, {EXPECTED_SQL}, done AS (SELECT DISTINCT task, sample_id FROM scores WHERE run_index = 1)"


def _done(spark, sf):
    return scores(spark, sf).where("run_index = 1").select("task", "sample_id").distinct()


@query(f"""WITH {_DONE} SELECT e.task, count(*) AS expected, count(d.sample_id) AS done, count(*) - count(d.sample_id) AS missing FROM expected e LEFT JOIN done d USING (task, sample_id) GROUP BY 1""")
def metrics_coverage(spark, sf):
    """F13, B8"""
    return M.coverage(expected_samples(spark, sf), _done(spark, sf), ["task"])


@query(f"""WITH {SCORES_SQL}, {EXPECTED_SQL}, done AS (SELECT DISTINCT task, sample_id FROM scores WHERE score = 5) SELECT e.task, e.sample_id FROM expected e ANTI JOIN done d USING (task, sample_id)""")
def metrics_missing_ids(spark, sf):
    """Samples without any top score"""
    done = scores(spark, sf).where("score = 5").select("task", "sample_id").distinct()
    return M.missing_ids(expected_samples(spark, sf), done, ["task"]).select("task", "sample_id")


@query("""SELECT event_type, round(avg(value)::DECIMAL(38,6), 3)::DOUBLE AS mean, round(median(value), 3) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def metrics_quantiles(spark, sf):
    """F9"""
    events = table(spark, sf, "events")
    exact = exact_quantiles(events, ["event_type"], "value", {"median": ("cont", 0.5), "p95": ("disc", 0.95)})
    means = events.groupBy("event_type").agg(rounded_mean(F.col("value")).alias("mean"))
    return exact.join(means, "event_type").select("event_type", "mean", F.round("median", 3).alias("median"), "p95")


@query(f"""SELECT user_id, CAST(sum(CASE WHEN {SQL_K} > 97 THEN {SQL_K} END) AS BIGINT) AS known_tokens FROM events GROUP BY 1""")
def metrics_known_sum(spark, sf):
    """NULL while no value is known"""
    k = k_of(F.col("props"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.when(k > 97, k)).alias("known_tokens"))
