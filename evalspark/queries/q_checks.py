"""Record-quality checks over tables seeded with faults by plain column conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalspark.functions import replies
from evalspark.functions.hashing import fingerprint
from evalspark.operators import checks as C
from evalspark.operators.provenance import SHARED_FIELDS
from evalspark.queries import query, table
from evalspark.queries.standins import SQL_LINES, lines, sql_strip


def _short(found: DataFrame) -> DataFrame:
    return found.select("group", "level", "check", "cell", "sample_id", "detail")


def _sql(group: str, source: str, rules: list[tuple[str, str, str, str]], cell: str = "cell", sample: str = "sample_id") -> str:
    """UNION of one SELECT per rule over a CTE."""
    return " UNION ALL ".join(
        f"SELECT '{group}' AS \"group\", '{level}' AS level, '{check}' AS \"check\", {cell} AS cell, CAST({sample} AS VARCHAR) AS sample_id, coalesce(CAST({detail} AS VARCHAR), '') AS detail FROM {source} WHERE {bad}"
        for check, level, bad, detail in rules)


_CELLS = "cells AS (SELECT source AS cell, count(*) AS n, count(*) FILTER (lang = 'en') AS e, count(*) FILTER (lang = 'es') AS es, min(doc_id) AS lo FROM documents GROUP BY 1)"


@query(f"""WITH {_CELLS}, c AS (SELECT cell, cell <> 'src0' AS present, CASE WHEN cell = 'src1' THEN 0 ELSE n END AS n, CASE WHEN cell = 'src2' THEN n - 1 WHEN cell = 'src3' THEN n + 1 ELSE n END AS expected,
  CASE WHEN cell = 'src4' THEN es + 1 ELSE 0 END AS unreadable, CASE WHEN cell = 'src5' THEN 2 ELSE 0 END AS dup, CASE WHEN cell = 'src6' THEN lo END AS ooo, NULL AS sample_id FROM cells)
""" + _sql("retrieval", "c", [
    ("retrieval_file_missing", "fail", "NOT present", "'no retrieval rows stored'"), ("retrieval_row_unreadable", "fail", "present AND unreadable > 0", "unreadable"),
    ("retrieval_file_empty", "fail", "present AND n = 0", "'no readable rows'"), ("retrieval_rows_exceed_dataset", "fail", "present AND n > 0 AND n > expected", "n || '/' || expected"),
    ("retrieval_file_partial", "warn", "present AND n > 0 AND n < expected", "n || '/' || expected"), ("retrieval_coverage", "ok", "present AND n > 0 AND n = expected", "n"),
    ("retrieval_duplicate_ids", "fail", "present AND n > 0 AND dup > 0", "dup"), ("retrieval_not_in_source_order", "warn", "present AND n > 0 AND ooo IS NOT NULL", "ooo"),
    ("retrieval_rows_checked", "ok", "present AND n > 0", "n")]))
def checks_retrieval_cells(spark, sf):
    """2.14 retrieval, cell level"""
    cell = F.col("cell")
    facts = table(spark, sf, "documents").groupBy(F.col("source").alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "es").alias("es"), F.min("doc_id").alias("lo"))
    seeded = facts.select(
        "cell", (cell != "src0").alias("file_present"), F.when(cell == "src1", 0).otherwise(F.col("n")).alias("row_count"),
        F.when(cell == "src2", F.col("n") - 1).when(cell == "src3", F.col("n") + 1).otherwise(F.col("n")).alias("expected_count"),
        F.when(cell == "src4", F.col("es") + 1).otherwise(0).alias("unreadable"), F.when(cell == "src5", 2).otherwise(0).alias("duplicates"),
        F.when(cell == "src6", F.col("lo")).alias("out_of_order"))
    return _short(C.retrieval_cell_checks(seeded))


def retrieval_rows(spark, sf):
    """Documents as retrieval rows; faults follow ``doc_id % 14``."""
    d, k = F.col("doc_id"), F.col("doc_id") % 14
    listed = F.transform(lines(F.col("text")), lambda t, i: F.struct(
        F.concat(F.lit("m"), i.cast("string")).alias("memory_id"), t.alias("content"),
        F.when((k == 6) & (i == 0), F.lit(None)).otherwise(t).alias("raw_content"), (i + 1).alias("retrieval_rank")))
    memories = F.col("memories")
    n = F.size(memories)
    persist = d % 2 == 0
    keys = F.array(*[F.lit(x) for x in C.ROW_KEYS])
    return table(spark, sf, "documents").withColumn("memories", listed).select(
        F.col("source").alias("cell"), d.alias("sample_id"), F.when(persist, "persistbench").otherwise("memtrapbench").alias("dataset"),
        F.lit("t").alias("task"), F.lit("A-MEM").alias("method"), F.when(k == 1, F.array_remove(keys, "task")).otherwise(keys).alias("keys"),
        F.when(k == 2, "other").otherwise("t").alias("row_task"), F.when(k == 3, "MemZero").otherwise("A-MEM").alias("memory_system"),
        F.when(k == 4, F.slice(memories, 1, 0)).otherwise(memories).alias("retrieved_memories"),
        F.when(k == 5, n + 1).otherwise(n).alias("retrieved_count"), F.when(k == 7, " \n").otherwise(F.col("text")).alias("context_text"),
        F.when(k == 8, n - 1).when(k == 9, F.lit(None)).otherwise(n).alias("top_k"),
        F.when(k == 10, "unset").when(persist, "per_sample_len_memories").otherwise("fixed").alias("top_k_policy"), n.alias("given_count"))


_ROWS = f"""rows AS (SELECT source AS cell, doc_id AS sample_id, doc_id % 14 AS k, doc_id % 2 = 0 AS persist, len({SQL_LINES}) AS n, text FROM documents)"""
_ROW_RULES = _sql("retrieval", "rows", [
    ("retrieval_row_keys", "fail", "k = 1", "'task'"), ("retrieval_row_task", "fail", "k = 2", "'other'"), ("retrieval_row_system", "fail", "k = 3", "'MemZero'"),
    ("retrieval_row_no_memories", "fail", "k = 4", "''"), ("retrieval_count_mismatch", "fail", "k = 5", "n + 1"), ("retrieval_memory_schema", "fail", "k = 6", "1"),
    ("retrieval_context_text_empty", "fail", f"k = 7 OR (k NOT IN (1, 4) AND length({sql_strip('text')}) = 0)", "''"), ("retrieval_depth_exceeded", "fail", "k = 8", "n || '>' || (n - 1)"),
    ("retrieval_top_k_not_given_set", "fail", "persist AND k = 8", "n - 1"), ("retrieval_top_k_not_given_set", "fail", "persist AND k = 9", "NULL"),
    ("retrieval_top_k_policy", "fail", "k = 10", "'unset'")])


@query(f"WITH {_ROWS} {_ROW_RULES}")
def checks_retrieval_rows(spark, sf):
    """2.14 retrieval, row level"""
    return _short(C.retrieval_row_checks(retrieval_rows(spark, sf)))


@query(f"""WITH {_ROWS}, f AS ({_ROW_RULES}) SELECT "group", count(*) FILTER (level = 'ok') AS ok_count, count(*) FILTER (level = 'warn') AS warn_count, count(*) FILTER (level = 'fail') AS fail_count FROM f GROUP BY ROLLUP ("group")""")
def checks_finding_counts(spark, sf):
    """F15"""
    return C.finding_counts(C.retrieval_row_checks(retrieval_rows(spark, sf)))


@query(f"""WITH {_ROWS}, f AS ({_ROW_RULES}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "group", level, "check" ORDER BY cell, sample_id, detail) AS INTEGER) AS shown, count(*) OVER (PARTITION BY "group", level, "check") AS occurrences FROM f)
SELECT "group", level, "check", cell, sample_id, detail, shown, occurrences FROM r WHERE shown <= 5""")
def checks_capped_findings(spark, sf):
    """The report shows five details per check beside the full count"""
    return C.capped_findings(C.retrieval_row_checks(retrieval_rows(spark, sf))).drop("run_index")


_STORE = """rows AS (SELECT 'c' || doc_id % 3 AS cell, doc_id AS sample_id, CAST(substr(source, 4) AS INTEGER) AS k, doc_id % 2 = 0 AS persist, n_chars FROM documents)"""


@query(f"WITH {_STORE} " + _sql("store", "rows", [
    ("store_row_index_missing", "fail", "k = 0", "''"), ("store_sample_absent", "fail", "k = 1", "''"),
    ("store_digest_mismatch", "fail", "k = 2", "'stale'"), ("store_digest", "ok", "k NOT IN (0, 1, 2)", "''"),
    ("store_messages_count", "fail", "k = 3", "n_chars + 1"), ("store_marker_messages_count", "fail", "k = 4", "n_chars + 2"), ("store_prior_sha256", "fail", "k = 5", "''"),
    ("store_ingest_mode", "fail", "k = 6", "'other'"), ("store_ingest_mode_adapter", "fail", "k = 6", "'other'"),
    ("store_top_k_policy", "fail", "k = 7", "CASE WHEN persist THEN 'fixed' ELSE 'per_sample_len_memories' END"), ("store_top_k", "fail", "k = 8 AND persist", "'99'"),
    ("store_top_k_schema", "fail", "k = 9", "'0'"), ("store_top_k", "fail", "k = 9 AND persist", "'0'"), ("store_status", "fail", "k = 10", "'lost'"),
    ("store_marker_missing", "fail", "k = 11", "''"), ("store_marker_file_count", "fail", "k = 12", "n_chars + 3"), ("store_documents_missing", "fail", "k = 13", "''"), ("store_marker_digest", "fail", "k = 14", "'foreign'")]))
def checks_stores(spark, sf):
    """2.14 store: faults follow the number of the source"""
    return _short(C.store_checks(*store_frames(spark, sf)))


def store_frames(spark, sf):
    """Retrieval rows, samples and markers of the stores, one store per document."""
    d, k, n = F.col("doc_id"), F.substring("source", 4, 3).cast("int"), F.col("n_chars")
    persist = d % 2 == 0
    digest = F.concat(F.left(F.sha1("text"), F.lit(24)), d.cast("string"))
    docs = table(spark, sf, "documents")
    mode = F.when(persist, "raw").otherwise("messages")
    rows = docs.select(
        F.concat(F.lit("c"), (d % 3).cast("string")).alias("cell"), F.when(persist, "persistbench").otherwise("memtrapbench").alias("dataset"), d.alias("sample_id"),
        digest.alias("save_dir"), F.when(k != 0, d + 1).alias("row_index"), F.when(k == 2, "stale").otherwise(digest).alias("marker_digest"),
        F.when(k == 3, n + 1).otherwise(n).alias("messages_count"), F.when(k == 4, n + 2).otherwise(n).alias("marker_messages_count"),
        F.when(k == 5, "x").otherwise(F.md5("text")).alias("prior_sha256"), F.when(k == 6, "other").otherwise(mode).alias("ingest_mode"),
        F.when((k == 7) == persist, "fixed").otherwise("per_sample_len_memories").alias("top_k_policy"),
        F.when(k == 8, 99).when(k == 9, 0).otherwise(7).alias("top_k"), F.when(k == 10, "lost").otherwise("built").alias("store_status"))
    samples = docs.where(k != 1).select(
        d.alias("sample_id"), digest.alias("expected_digest"), n.alias("expected_messages"), F.md5("text").alias("expected_prior_sha256"),
        mode.alias("sample_ingest_mode"), F.when(persist, 7).alias("sample_top_k"))
    markers = docs.where(k != 11).select(digest.alias("save_dir"), F.when(k == 14, "foreign").otherwise(digest).alias("digest"), F.when(k == 12, n + 3).otherwise(n).alias("marker_file_count"), (k != 13).alias("has_documents"))
    return rows, samples, markers


_ARMS = """arms AS (SELECT o_orderstatus || '/' || o_orderpriority AS cell, count(*) AS n, NULL AS sample_id, left(o_orderpriority, 1) AS p, o_orderstatus AS st FROM orders GROUP BY ALL)"""


@query(f"WITH {_ARMS} " + _sql("alignment", "arms", [
    ("run_config_missing", "fail", "p = '1' AND st <> 'P'", "''"), ("run_config_unreadable", "fail", "p = '1' AND st = 'P'", "''"), ("config_retrieval_path", "fail", "p = '2' AND st = 'O'", "'moved'"), ("outputs_unreadable", "fail", "p = '2'", "3"), ("judge_unreadable", "fail", "p = '3'", "4"), ("outputs_duplicate_ids", "fail", "p = '4'", "2"),
    ("outputs_not_retrieval_prefix", "fail", "p = '5'", "n"), ("outputs_are_retrieval_prefix", "ok", "p <> '5'", "n"), ("config_retrieval_sha256", "fail", "p <> '1' AND st = 'F'", "''"),
    ("config_sample_count", "fail", "p <> '1' AND st = 'O'", "n + 1"), ("config_top_k", "fail", "p <> '1' AND st = 'P'", "9")]))
def checks_alignment_cells(spark, sf):
    """2.14 alignment, cell level"""
    p, st, n = F.left("o_orderpriority", F.lit(1)), F.col("o_orderstatus"), F.col("n")
    facts = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    arms = facts.select(
        F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("cell"), F.lit(0).alias("run_index"), F.lit("memtrapbench").alias("dataset"), (p != "1").alias("has_config"), ((p == "1") & (st == "P")).alias("config_unreadable"),
        F.when((p == "2") & (st == "O"), "moved").otherwise("here").alias("config_retrieval_path"), F.lit("here").alias("retrieval_path"),
        n.alias("outputs"), F.when(p == "4", 2).otherwise(0).alias("duplicates"), F.when(p == "5", n).alias("first_divergence"),
        F.when(st == "F", "old").otherwise("h").alias("config_retrieval_sha256"), F.lit("h").alias("retrieval_sha256"),
        F.when(st == "O", n + 1).otherwise(n).alias("config_sample_count"), n.alias("retrieval_rows"), F.lit(10).alias("config_top_k"),
        F.when(st == "P", 9).otherwise(10).alias("row_top_k"), F.when(p == "2", 3).otherwise(0).alias("unreadable_outputs"), F.when(p == "3", 4).otherwise(0).alias("unreadable_judge"))
    return _short(C.alignment_cell_checks(arms))


@query("WITH r AS (SELECT o_orderpriority AS cell, o_orderkey AS sample_id, o_orderstatus AS st, o_custkey FROM orders) " + _sql("alignment", "r", [
    ("record_retrieval_sha256", "fail", "st = 'F'", "''"), ("record_no_memories", "fail", "o_custkey % 10 = 0", "''"),
    ("record_retrieved_count", "fail", "o_custkey % 10 <> 0 AND st = 'P'", "11"), ("record_config", "fail", "st = 'P'", "''")]))
def checks_alignment_rows(spark, sf):
    """2.14 alignment, row level"""
    st, n = F.col("o_orderstatus"), F.col("o_custkey") % 10
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("cell"), F.lit(0).alias("run_index"), F.col("o_orderkey").alias("sample_id"),
        F.when(st == "F", "old").when(st == "O", "h").alias("record_retrieval_sha256"), F.lit("h").alias("retrieval_sha256"), n.alias("memory_count"),
        F.when(st == "P", F.lit(11).cast("bigint")).otherwise(n).alias("retrieved_count"), F.when(st == "P", "g").when(st == "O", "f").alias("embedded_fingerprint"), F.lit("f").alias("shared_fingerprint"))
    return _short(C.alignment_row_checks(rows))


def _arm_configs(spark, sf):
    """One config per source and arm; every fault hits the sources of one digit."""
    cell = F.col("cell")
    cells = table(spark, sf, "documents").groupBy(F.col("source").alias("cell")).agg(F.count(F.lit(1)).alias("sample_count"))

    def arm(name: str) -> DataFrame:
        staged = name == "staged"
        base = cells.withColumns({f: F.lit("v") for f in SHARED_FIELDS if f != "sample_count"})
        if staged:
            base = base.withColumns({"temperature": F.when(cell == "src1", "w").otherwise("v"), "sample_count": F.when(cell == "src1", F.col("sample_count") + 1).otherwise(F.col("sample_count"))})
        stored = F.when((cell == "src2") & F.lit(staged), "edited").otherwise(fingerprint(SHARED_FIELDS))
        prompt = F.when(cell == "src4", "same").when((cell == "src5") & F.lit(not staged), F.lit(None)).otherwise(name)
        return base.withColumn("shared_fingerprint", stored).withColumns({
            "run_fingerprint": F.when((cell == "src3") & F.lit(staged), "r2").otherwise("r"), "prompt_sha256": prompt,
            "answer_prompt_sha256": F.when((cell == "src6") & F.lit(staged), "old").otherwise(prompt),
            "final_answer_prompt": F.when((cell == "src7") & F.lit(not staged), "odd.txt").otherwise(f"{name}.txt"), "expected_prompt": F.lit(f"{name}.txt")})
    return arm("baseline").where("cell <> 'src8'"), arm("staged")


@query("WITH c AS (SELECT DISTINCT source AS cell, NULL AS sample_id FROM documents) " + _sql("arms", "c", [
    ("arm_pair_incomplete", "warn", "cell = 'src8'", "''"), ("arm_shared_config", "fail", "cell = 'src1'", "'temperature,sample_count'"), ("arm_shared_config", "ok", "cell NOT IN ('src1', 'src8')", "''"),
    ("arm_shared_fingerprint", "fail", "cell IN ('src1', 'src2')", "''"), ("arm_run_fingerprint", "fail", "cell = 'src3'", "''"), ("arm_intervention_absent", "fail", "cell = 'src4'", "''"),
    ("arm_intervention", "ok", "cell NOT IN ('src4', 'src5', 'src8')", "''"), ("arm_shared_fingerprint_stale", "fail", "cell = 'src2'", "'staged'"), ("arm_answer_prompt_missing", "fail", "cell = 'src5'", "'baseline'"),
    ("arm_answer_prompt_sha256", "fail", "cell = 'src6'", "'staged'"), ("arm_answer_prompt_identity", "fail", "cell = 'src7'", "'baseline'")]))
def checks_arm_configs(spark, sf):
    """2.14 arms, configs"""
    return _short(C.arm_config_checks(*_arm_configs(spark, sf), ["cell"]))


@query("WITH r AS (SELECT source AS cell, doc_id AS sample_id, lang, n_chars FROM documents) " + _sql("arms", "r", [
    ("arm_record_settings", "fail", "lang = 'de'", "'generation_temperature'"), ("arm_record_settings", "fail", "lang = 'es'", "'generation_max_tokens'"),
    ("arm_record_fingerprint", "fail", "cell = 'src9'", "''"), ("arm_record_memories", "fail", "n_chars > 3000", "'2 vs 3'")]))
def checks_arm_records(spark, sf):
    """2.14 arms, records: the baseline keeps canonical objects, the staged arm only texts"""
    def arm(staged: bool) -> DataFrame:
        lang = F.col("lang")
        full = F.struct(F.lit(None if staged else " ").cast("string").alias("memory_text"), F.concat(F.lit(" "), "text").alias("content"), F.lit(None).cast("string").alias("text"), F.col("text").alias("raw_content"))
        slim = F.struct(F.concat("text", F.lit("\n")).alias("memory_text"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("raw_content"))
        one = slim if staged else full
        memories = F.when(F.lit(staged) & (F.col("n_chars") > 3000), F.array(one, one, one)).otherwise(F.array(one, one))
        return table(spark, sf, "documents").select(
            F.col("source").alias("cell"), F.col("doc_id").alias("sample_id"), F.lit("m").alias("generation_model"), F.lit("u").alias("generation_base_url"),
            F.when(F.lit(staged) & (lang == "de"), 0.5).otherwise(0.2).alias("generation_temperature"),
            F.when((lang != "es") | F.lit(not staged), 4096).alias("generation_max_tokens"),
            F.when(F.lit(staged) & (F.col("source") == "src9"), "r2").otherwise("r").alias("run_fingerprint"), memories.alias("retrieved_memories"))
    return _short(C.arm_record_checks(arm(False), arm(True), ["cell"]))


@query("WITH r AS (SELECT d.source AS cell, doc_id AS sample_id, quality, toxic FROM labels JOIN documents d USING (doc_id)) " + _sql("arms", "r", [
    ("arm_judge_field", "fail", "toxic = 1", "'judge_temperature'"), ("arm_judge_field", "fail", "quality = 0", "'rubric_sha256'"), ("arm_judge_config", "fail", "toxic = 1 AND quality = 0", "''")]))
def checks_arm_judges(spark, sf):
    """2.14 arms, judge records"""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("cell")), "doc_id").withColumn("sample_id", F.col("doc_id"))
    base = rows.withColumns({f: F.lit("v") for f in [*C.JUDGE_SETTINGS, "config_fingerprint"]})
    bad_t, bad_r = F.col("toxic") == 1, F.col("quality") == 0
    staged = base.withColumns({"judge_temperature": F.when(bad_t, "w").otherwise("v"), "rubric_sha256": F.when(bad_r, F.lit(None)).otherwise("v"),
                               "config_fingerprint": F.when(bad_t & bad_r, "w").otherwise("v")})
    return _short(C.arm_judge_checks(base, staged, ["cell"]))


def _judge_common(k):
    return {"cell": F.col("source"), "sample_id": F.col("doc_id"), "run_index": F.when(k == 1, 1).otherwise(0), "expected_run_index": F.lit(0),
            "arm": F.when(k == 2, "other").otherwise("baseline"), "expected_arm": F.lit("baseline"), "final_answer": F.when(k == 3, " ").otherwise("answer"),
            "rubric_sha256": F.when(k == 4, F.lit(None)).otherwise("r"), "expected_rubric_sha256": F.lit("r"), "rubric_file": F.when(k == 5, "x.txt").otherwise("j.txt"), "expected_rubric_file": F.lit("j.txt")}


_COMMON_RULES = [("judge_run_index", "fail", "k = 1", "1"), ("judge_arm_label", "fail", "k = 2", "'other'"), ("judge_empty_answer", "fail", "k = 3", "''"),
                 ("judge_rubric_sha256", "fail", "k = 4", "''"), ("judge_rubric_file", "fail", "k = 5", "'x.txt'")]


@query("WITH r AS (SELECT source AS cell, doc_id AS sample_id, doc_id % 13 AS k, n_chars % 5 + 1 AS q FROM documents) " + _sql("judge", "r", _COMMON_RULES + [
    ("judge_score_scale", "fail", "k = 6", "'1-3'"), ("judge_score_key", "fail", "k = 7", "'points'"), ("judge_rescore", "fail", "k = 7", "''"), ("judge_score_key_deviation", "warn", "k = 8", "'rating'"), ("judge_rescore", "fail", "k = 8", "''"),
    ("judge_score_range", "fail", "k = 9", "q + 5"), ("judge_rescore", "fail", "k = 9", "''"), ("judge_rescore", "fail", "k = 10", "'missing reasoning'"), ("judge_rescore", "fail", "k = 11", "''")]))
def checks_judge_single(spark, sf):
    """2.14 judge, single scores: stored values against the re-scored reply"""
    k, q = F.col("doc_id") % 13, (F.col("n_chars") % 5 + 1).cast("int")
    reply = F.concat(F.lit('{"reasoning": "'), F.when(k == 10, "").otherwise("because"), F.lit('", "score": '), F.when(k == 11, q % 5 + 1).otherwise(q).cast("string"), F.lit("}"))
    rows = table(spark, sf, "documents").withColumns({**_judge_common(k), "score": F.when(k == 9, q + 5).otherwise(q),
        "score_key": F.when(k == 7, "points").when(k == 8, "rating").otherwise("score"), "expected_key": F.lit("score"), "scale_low": F.lit(1),
        "scale_high": F.when(k == 6, 3).otherwise(5), "low": F.lit(1), "high": F.lit(5), "parsed": replies.parse_object(reply)})
    return _short(C.judge_row_checks(rows.withColumn("rescored", replies.score_single(F.col("parsed"), F.col("low"), F.col("high"))), True))


@query("WITH r AS (SELECT source AS cell, doc_id AS sample_id, doc_id % 12 AS k FROM documents) " + _sql("judge", "r", _COMMON_RULES + [
    ("judge_dimensions_missing", "fail", "k = 6", "''"), ("judge_dimensions", "fail", "k = 7", "''"), ("judge_rescore", "fail", "k = 7", "''"), ("judge_score_range", "fail", "k = 8", "''"), ("judge_rescore", "fail", "k = 8", "''"),
    ("judge_dimension_count", "fail", "k = 9", "3"), ("judge_rescore", "fail", "k = 10", "'missing: dimension_2_b'")]))
def checks_judge_dimensions(spark, sf):
    """2.14 judge, dimension scores"""
    k, q = F.col("doc_id") % 12, (F.col("n_chars") % 6).cast("int")
    expected = F.array(F.lit("dimension_1_a"), F.lit("dimension_2_b"))
    stored = F.create_map(F.lit("dimension_1_a"), F.when(k == 8, 6).otherwise(q), F.when(k == 7, "dimension_3_c").otherwise("dimension_2_b"), F.lit(1))
    stored = F.when(k != 6, stored)
    reply = F.concat(F.lit('{"dimension_1_a": {"score": '), q.cast("string"), F.lit('}'), F.when(k == 10, "").otherwise(', "dimension_2_b": {"score": 1}'), F.lit("}"))
    rows = table(spark, sf, "documents").withColumns({**_judge_common(k), "dimension_scores": stored, "dimension_count": F.when(k == 9, 3).otherwise(2),
        "expected_dimensions": expected, "parsed": replies.parse_object(reply)})
    return _short(C.judge_row_checks(rows.withColumn("rescored", replies.score_dimensions(F.col("parsed"), F.col("expected_dimensions"))), False))


@query("WITH c AS (SELECT d.source AS cell, NULL AS sample_id, count(*) AS g, count(*) FILTER (quality = 1 OR toxic = 1) AS j FROM documents d JOIN labels USING (doc_id) GROUP BY 1) " + _sql("judge", "c", [
    ("judge_coverage", "fail", "j::DOUBLE / g < 0.98", "j || '/' || g"), ("judge_coverage", "ok", "j::DOUBLE / g >= 0.98", "j || '/' || g")]))
def checks_judge_coverage(spark, sf):
    """2.14 judge_coverage, F13, D8"""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    arms = rows.groupBy(F.col("source").alias("cell")).agg(F.count(F.lit(1)).alias("generated"), F.count_if((F.col("quality") == 1) | (F.col("toxic") == 1)).alias("judged"))
    return _short(C.judge_coverage_checks(arms.withColumn("run_index", F.lit(0))))


@query("WITH r AS (SELECT 'stage1-stage2-baseline' AS cell, doc_id AS sample_id, lang, source, n_chars FROM documents), l AS (SELECT 'stage1-stage2-baseline' AS cell, doc_id AS sample_id, quality, toxic FROM labels) " + _sql("native", "r", [
    ("prompt_version", "fail", "lang = 'de'", "'v0'"), ("prompt_hashes", "fail", "lang = 'es'", "''"), ("missing_final_answer", "fail", "source = 'src1'", "''"),
    ("missing_boundary_cards", "fail", "source = 'src2'", "''"), ("missing_role_assignments", "fail", "source = 'src3'", "''")]) + " UNION ALL " + _sql("native", "l", [
    ("invalid_judge_record", "fail", "quality = 0 AND toxic = 1", "''"), ("invalid_correctness", "fail", "quality = 0 AND toxic = 0", "''"), ("invalid_task_pass", "fail", "quality = 1 AND toxic = 1", "''")]))
def checks_native(spark, sf):
    """Native output and judge rows"""
    source = F.col("source")
    outputs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), F.when(F.col("lang") == "de", "v0").otherwise("v1").alias("prompt_version"), F.when(F.col("lang") == "es", "x").otherwise("h").alias("prompt_hash"),
        F.when(source == "src1", "").otherwise("a").alias("final_answer"), F.when(source != "src2", "cards").alias("boundary_cards"), F.when(source != "src3", "roles").alias("role_assignments"))
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    judged = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), (q | ~t).alias("known_task"), q.alias("correctness_valid"), (~(q & t)).alias("pass_valid"))
    return _short(C.native_checks(outputs, judged, "stage1-stage2-baseline", "v1", "h"))


@query("WITH r AS (SELECT source AS cell, count(*) AS n, NULL AS sample_id FROM documents GROUP BY 1), l AS (SELECT d.source AS cell, count(*) AS n, NULL AS sample_id FROM labels JOIN documents d USING (doc_id) GROUP BY 1) " + _sql("store", "r", [
    ("store_rows_checked", "ok", "n > 0", "n")]) + " UNION ALL " + _sql("judge", "l", [("judge_rows_checked", "ok", "n > 0", "n")]))
def checks_rows_checked(spark, sf):
    """2.14 rows_checked of the store and judge groups"""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("cell"))
    judged = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi")
    return _short(C.rows_checked(docs, "store", "store_rows_checked").unionByName(C.rows_checked(judged, "judge", "judge_rows_checked")))


@query("""WITH c AS (SELECT d.source AS cell, NULL AS sample_id, count(*) FILTER (quality = 1) AS n, bool_or(toxic = 1 AND d.source < 'src2') AS bad FROM labels JOIN documents d USING (doc_id) GROUP BY 1) """ + _sql("arms", "c", [
    ("arm_records_unpaired", "warn", "n = 0", "''"), ("arm_records", "ok", "n > 0 AND NOT bad", "n")]))
def checks_agreed_cells(spark, sf):
    """2.14 arm_records OK and arm_records_unpaired: toxic labels of the first sources stand for failing pairs"""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("cell")), "doc_id")
    found = C.findings(rows, "arms", [("arm_record_settings", C.FAIL, (F.col("toxic") == 1) & (F.col("cell") < "src2"), "")], sample_id=F.col("doc_id"))
    pairs = rows.groupBy("cell").agg(F.count_if(F.col("quality") == 1).alias("pairs"))
    return _short(C.agreed_cells(pairs, found, "arm_records"))


@query("""WITH c AS (SELECT lang AS cell, NULL AS sample_id, count(*) AS r, count(*) FILTER (n_chars > 100) AS o, count(*) FILTER (n_chars > 100 AND source <> 'src1') AS j, min(doc_id) FILTER (lang = 'de') AS od, min(doc_id) FILTER (lang = 'es') AS jd FROM documents GROUP BY 1) """ + _sql("native", "c", [
    ("outputs_not_retrieval_prefix", "fail", "od IS NOT NULL", "od"), ("judge_not_output_prefix", "fail", "jd IS NOT NULL", "jd"), ("output_count", "fail", "o <> r", "o || '/' || r"), ("judge_count", "fail", "j <> o", "j || '/' || o")]) + " UNION ALL " + _sql("judge", "c", [
    ("rubric_file_missing", "fail", "cell = 'fr'", "'fr.txt'")]))
def checks_native_cells(spark, sf):
    """F20, 2.14 native order and counts, rubric_file_missing"""
    lang = F.col("lang")
    cells = table(spark, sf, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("retrieval_rows"), F.count_if(F.col("n_chars") > 100).alias("output_rows"),
        F.count_if((F.col("n_chars") > 100) & (F.col("source") != "src1")).alias("judge_rows"), F.min("doc_id").alias("first"))
    cells = cells.select(lang.alias("cell"), "retrieval_rows", "output_rows", "judge_rows", F.when(lang == "de", F.col("first")).alias("output_divergence"),
                         F.when(lang == "es", F.col("first")).alias("judge_divergence"), F.concat(lang, F.lit(".txt")).alias("rubric_file"), (lang != "fr").alias("rubric_present"))
    return _short(C.native_cell_checks(cells).unionByName(C.rubric_checks(cells)))
