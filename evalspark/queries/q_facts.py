"""Cell facts derived from lists of rows, and the validation of all groups on them.

Documents stand for retrieval rows: a source is a cell and ``place`` the number of a document in it. Rows are
seeded with faults by source (dropped, doubled, swapped and broken lines); no fact is given.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import checks as C, facts as X
from evalspark.plans import jobs as J
from evalspark.queries import query, table
from evalspark.queries.q_checks import _sql, _short, store_frames

_S, _PLACE = "CAST(substr(source, 4) AS INTEGER)", "doc_id // 20"
_LISTS = f"""d AS (SELECT source AS cell, {_S} AS s, {_PLACE} AS place, doc_id, lang, 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS sample_id FROM documents),
r AS (SELECT cell, s, place, sample_id, CASE WHEN s = 6 THEN xor(place, 1) ELSE place END * 2 + c AS line, CASE WHEN s = 12 AND place % 2 = 1 THEN 6 ELSE 5 END AS top_k
  FROM d, (SELECT unnest([0, 1]) AS c) WHERE s NOT IN (0, 1) AND NOT (s = 2 AND place % 7 = 3) AND (c = 0 OR (s = 5 AND place % 9 = 2))),
rp AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY line) - 1 AS position FROM r),
rs AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY sample_id) - 1 AS position FROM r)"""
_FACTS = f"""{_LISTS}, rf AS (SELECT cell, s, s <> 0 AS present, NULL AS sample_id, count(*) FILTER (NOT (s = 3 AND place % 5 = 0)) AS expected,
  count(*) FILTER (s = 1 OR (s = 4 AND lang = 'es')) AS unreadable,
  (SELECT count(*) FROM r WHERE r.cell = d.cell) AS n,
  (SELECT count(*) FROM (SELECT sample_id FROM r WHERE r.cell = d.cell GROUP BY 1 HAVING count(*) > 1)) AS dup,
  (SELECT arg_min(rs.sample_id, rs.position) FROM rs JOIN rp USING (cell, position) WHERE rs.cell = d.cell AND rs.sample_id <> rp.sample_id) AS ooo FROM d GROUP BY 1, 2)"""
_RETRIEVAL_RULES = _sql("retrieval", "rf", [
    ("retrieval_file_missing", "fail", "NOT present", "'no retrieval rows stored'"), ("retrieval_row_unreadable", "fail", "present AND unreadable > 0", "unreadable"),
    ("retrieval_file_empty", "fail", "present AND n = 0", "'no readable rows'"), ("retrieval_rows_exceed_dataset", "fail", "present AND n > 0 AND n > expected", "n || '/' || expected"),
    ("retrieval_file_partial", "warn", "present AND n > 0 AND n < expected", "n || '/' || expected"), ("retrieval_coverage", "ok", "present AND n > 0 AND n = expected", "n"),
    ("retrieval_duplicate_ids", "fail", "present AND n > 0 AND dup > 0", "dup"), ("retrieval_not_in_source_order", "warn", "present AND n > 0 AND ooo IS NOT NULL", "ooo"),
    ("retrieval_rows_checked", "ok", "present AND n > 0", "n")])


def _documents(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("source").alias("cell"), F.substring("source", 4, 9).cast("int").alias("s"), F.floor(F.col("doc_id") / 20).alias("place"),
        "lang", "doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("sample_id"))


def _retrieval(spark, sf):
    s, place = F.col("s"), F.col("place")
    copies = F.when((s == 5) & (place % 9 == 2), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = _documents(spark, sf).where(~s.isin(0, 1) & ~((s == 2) & (place % 7 == 3)))
    return kept.withColumn("c", F.explode(copies)).select(
        "cell", "s", "place", "sample_id", (F.when(s == 6, place.bitwiseXOR(F.lit(1))).otherwise(place) * 2 + F.col("c")).alias("line"),
        F.when((s == 12) & (place % 2 == 1), 6).otherwise(5).alias("top_k"))


def _retrieval_found(spark, sf):
    docs, s = _documents(spark, sf), F.col("s")
    cells = docs.groupBy("cell").agg(F.max(s != 0).alias("file_present"), F.count_if(~((s == 3) & (F.col("place") % 5 == 0))).alias("expected_count"))
    broken = docs.where((s == 1) | ((s == 4) & (F.col("lang") == "es"))).select("cell", F.col("place").alias("line"))
    return C.retrieval_cell_checks(X.retrieval_facts(cells, _retrieval(spark, sf), broken))


@query(f"WITH {_FACTS} {_RETRIEVAL_RULES}")
def facts_retrieval_cells(spark, sf):
    """N10, 2.14 retrieval: counts, repeated ids and the first id out of order, found in the rows"""
    return _short(_retrieval_found(spark, sf))


_ARM_FACTS = f"""o AS (SELECT cell, s, run_index, sample_id, line FROM r, (SELECT unnest([0, 1]) AS run_index) WHERE NOT (run_index = 1 AND s = 7 AND place % 11 = 4)
  UNION ALL SELECT cell, s, 1, 'extra' || cell, 1000000000000 FROM (SELECT DISTINCT cell, s FROM d WHERE s = 8)),
op AS (SELECT *, row_number() OVER (PARTITION BY cell, run_index ORDER BY line) - 1 AS position FROM o),
od AS (SELECT op.cell, op.run_index, count(*) AS n, count(*) - count(DISTINCT op.sample_id) AS again, min(op.position) FILTER (op.sample_id IS DISTINCT FROM rp.sample_id) AS first FROM op LEFT JOIN rp ON op.cell = rp.cell AND op.position = rp.position GROUP BY 1, 2),
a AS (SELECT c.cell, c.s, c.run_index, NULL AS sample_id, c.n AS declared, coalesce(od.n, 0) AS n, od.again, od.first, (SELECT count(*) FROM r WHERE r.cell = c.cell) AS frozen,
  (SELECT CASE WHEN min(top_k) = max(top_k) THEN min(top_k) END FROM r WHERE r.cell = c.cell) AS k, NOT (s = 13 AND c.run_index = 1) AND NOT (s = 14 AND c.run_index = 0) AS conf, s = 14 AND c.run_index = 0 AS broken, c.de, c.fr
  FROM (SELECT cell, s, run_index, count(*) AS n, count(*) FILTER (lang = 'de' AND s = 10) AS de, count(*) FILTER (lang = 'fr' AND s = 11) AS fr FROM d, (SELECT unnest([0, 1]) AS run_index) GROUP BY ALL) c LEFT JOIN od USING (cell, run_index))"""
_ALIGNMENT_RULES = _sql("alignment", "a", [
    ("run_config_unreadable", "fail", "broken", "''"), ("run_config_missing", "fail", "NOT conf AND NOT broken", "''"), ("outputs_unreadable", "fail", "de > 0", "de"),
    ("judge_unreadable", "fail", "fr > 0", "fr"), ("outputs_duplicate_ids", "fail", "again > 0", "again"), ("outputs_not_retrieval_prefix", "fail", "first IS NOT NULL", "first"),
    ("outputs_are_retrieval_prefix", "ok", "n > 0 AND first IS NULL", "n"), ("config_retrieval_sha256", "fail", "n > 0 AND conf AND s = 15", "''"), ("config_retrieval_path", "fail", "n > 0 AND conf AND s = 16", "'moved'"),
    ("config_sample_count", "fail", "n > 0 AND conf AND declared <> frozen", "declared"), ("config_top_k", "fail", "n > 0 AND conf AND k IS DISTINCT FROM 5", "k")], cell="cell || '/' || run_index")


def _arms(spark, sf):
    """Arms with their configs, outputs, and broken lines."""
    s, run = F.col("s"), F.col("run_index")
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("run_index")
    docs = _documents(spark, sf)
    arms = docs.groupBy("cell", "s").agg(F.count(F.lit(1)).alias("config_sample_count")).select("*", both)
    torn = (s == 14) & (run == 0)
    arms = arms.select(
        "cell", "run_index", F.lit("memtrapbench").alias("dataset"), (~((s == 13) & (run == 1)) & ~torn).alias("has_config"), torn.alias("config_unreadable"),
        F.when(s == 15, "old").otherwise(F.md5("cell")).alias("config_retrieval_sha256"), F.md5("cell").alias("retrieval_sha256"),
        F.when(s == 16, "moved").otherwise(F.col("cell")).alias("config_retrieval_path"), F.col("cell").alias("retrieval_path"),
        "config_sample_count", F.lit(5).alias("config_top_k"))
    extra = docs.where(s == 8).select("cell", "s").distinct().select(
        "cell", F.lit(1).alias("run_index"), F.concat(F.lit("extra"), "cell").alias("sample_id"), F.lit(10**12).alias("line"))
    outputs = _retrieval(spark, sf).select("*", both).where(~((run == 1) & (s == 7) & (F.col("place") % 11 == 4))).select(
        "cell", "run_index", "sample_id", "line").unionByName(extra)
    lang = F.col("lang")
    broken = docs.where(((lang == "de") & (s == 10)) | ((lang == "fr") & (s == 11))).select(
        "cell", both, F.when(s == 10, "outputs").otherwise("judge").alias("kind"))
    return arms, outputs, broken


def _alignment_found(spark, sf):
    arms, outputs, broken = _arms(spark, sf)
    found = C.alignment_cell_checks(X.arm_facts(arms, _retrieval(spark, sf), outputs, broken))
    return found.withColumn("cell", F.concat_ws("/", "cell", "run_index"))


@query(f"WITH {_LISTS}, {_ARM_FACTS} {_ALIGNMENT_RULES}")
def facts_arm_alignment(spark, sf):
    """N10, 2.14 alignment: outputs against the frozen list, configs against its rows"""
    return _short(_alignment_found(spark, sf))


_NATIVE = """nr AS (SELECT lang AS cell, doc_id FROM documents), no AS (SELECT * FROM nr WHERE NOT (cell = 'fr' AND doc_id % 101 = 7)), nj AS (SELECT * FROM no WHERE NOT (cell = 'es' AND doc_id % 37 = 5)),
np AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY doc_id) - 1 AS p FROM nr), nq AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY doc_id) - 1 AS p FROM no), ns AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY doc_id) - 1 AS p FROM nj),
nf AS (SELECT cell, NULL AS sample_id, count(*) AS r, (SELECT count(*) FROM no WHERE no.cell = nr.cell) AS o, (SELECT count(*) FROM nj WHERE nj.cell = nr.cell) AS j,
  (SELECT min(nq.p) FROM nq JOIN np USING (cell, p) WHERE nq.cell = nr.cell AND nq.doc_id <> np.doc_id) AS od, (SELECT min(ns.p) FROM ns JOIN nq USING (cell, p) WHERE ns.cell = nr.cell AND ns.doc_id <> nq.doc_id) AS jd FROM nr GROUP BY 1)"""
_NATIVE_RULES = _sql("native", "nf", [
    ("outputs_not_retrieval_prefix", "fail", "od IS NOT NULL", "od"), ("judge_not_output_prefix", "fail", "jd IS NOT NULL", "jd"),
    ("output_count", "fail", "o <> r", "o || '/' || r"), ("judge_count", "fail", "j <> o", "j || '/' || o")])


def _native_found(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("lang").alias("cell"), F.col("doc_id").alias("sample_id"), F.col("doc_id").alias("line"))
    outputs = rows.where(~((F.col("cell") == "fr") & (F.col("line") % 101 == 7)))
    judged = outputs.where(~((F.col("cell") == "es") & (F.col("line") % 37 == 5)))
    return C.native_cell_checks(X.native_facts(rows.select("cell").distinct(), rows, outputs, judged))


@query(f"WITH {_NATIVE} {_NATIVE_RULES}")
def facts_native_cells(spark, sf):
    """N10, 2.14 native: where outputs and judgements leave the order of the list before them"""
    return _short(_native_found(spark, sf))


_FOLDERS = """fo AS (SELECT 'c' || doc_id % 3 AS cell, doc_id AS sample_id, CAST(substr(source, 4) AS INTEGER) AS k, left(sha1(text), 24) || doc_id AS dir FROM documents)"""
_FOLDER_RULES = _sql("store", "fo", [
    ("store_dir_missing", "fail", "k = 11", "dir"), ("store_marker_missing", "fail", "k = 15", "''"), ("store_marker_unreadable", "fail", "k = 16", "dir")]) + """
UNION ALL SELECT 'store', 'fail', 'store_dataset_unreadable', source, NULL, 'no text' FROM documents GROUP BY source HAVING count(*) FILTER (lang = 'fr') = 0"""
_FOLDER_CHECKS = ["store_dir_missing", "store_marker_missing", "store_marker_unreadable", "store_dataset_unreadable"]


def _folder_found(spark, sf):
    rows, samples, markers = store_frames(spark, sf)
    k = rows.select("save_dir", (F.col("sample_id") % 20).alias("k"))
    markers = markers.join(k, "save_dir").withColumn("marker_state", F.when(F.col("k") == 15, "missing").when(F.col("k") == 16, "unreadable").otherwise("readable"))
    unread = table(spark, sf, "documents").groupBy(F.col("source").alias("cell")).agg(
        F.when(F.count_if(F.col("lang") == "fr") == 0, "no text").alias("dataset_error"))
    return C.store_checks(rows, samples, markers).unionByName(C.store_dataset_checks(unread)).where(F.col("check").isin(_FOLDER_CHECKS))


@query(f"WITH {_FOLDERS} {_FOLDER_RULES}")
def checks_store_folders(spark, sf):
    """2.14 store: folders and markers that are absent or unreadable, datasets that cannot be read"""
    return _short(_folder_found(spark, sf))


_PRESENCE = """pr AS (SELECT source AS cell, NULL AS sample_id, CAST(substr(source, 4) AS INTEGER) AS k FROM documents GROUP BY ALL)"""
_PRESENCE_RULES = _sql("arms", "pr", [("arm_config_missing", "fail", "k % 5 = 1", "'staged'"), ("arm_config_missing", "fail", "k % 5 = 2", "'baseline,staged'")])


def _presence_found(spark, sf):
    k = F.col("k")
    cells = table(spark, sf, "documents").select(F.col("source").alias("cell"), F.substring("source", 4, 9).cast("int").alias("k")).distinct()
    arms = cells.select("cell", F.lit(0).alias("run_index"), F.inline(F.array(
        F.struct(F.lit("baseline").alias("arm"), (k % 5 != 2).alias("has_config")),
        F.struct(F.lit("staged").alias("arm"), (~(k % 5).isin(1, 2)).alias("has_config")))))
    return C.arm_presence_checks(arms)


@query(f"WITH {_PRESENCE} {_PRESENCE_RULES}")
def checks_arm_presence(spark, sf):
    """2.14 arms: pairs that ran without a config"""
    return _short(_presence_found(spark, sf))


_COVER = """jc AS (SELECT source AS cell, NULL AS sample_id, count(*) AS g, count(l.doc_id) AS j FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1) l USING (doc_id) GROUP BY 1)"""
_COVER_RULES = _sql("judge", "jc", [("judge_coverage", "fail", "j / g < 0.98", "j || '/' || g"), ("judge_coverage", "ok", "j / g >= 0.98", "j || '/' || g")])


def _coverage_found(spark, sf):
    outputs = table(spark, sf, "documents").select(F.col("source").alias("cell"), F.lit(0).alias("run_index"), F.col("doc_id").alias("sample_id"))
    done = table(spark, sf, "labels").where((F.col("quality") == 1) | (F.col("toxic") == 1)).select(F.col("doc_id").alias("sample_id"))
    return C.judge_coverage_checks(X.coverage_facts(outputs, outputs.join(done, "sample_id", "left_semi")))


@query(f"""WITH {_FACTS}, {_ARM_FACTS}, {_NATIVE}, {_FOLDERS}, {_PRESENCE}, {_COVER}, f AS ({_RETRIEVAL_RULES} UNION ALL {_ALIGNMENT_RULES} UNION ALL {_NATIVE_RULES} UNION ALL {_FOLDER_RULES} UNION ALL {_PRESENCE_RULES} UNION ALL {_COVER_RULES})
SELECT "group", count(*) FILTER (level = 'ok') AS ok_count, count(*) FILTER (level = 'warn') AS warn_count, count(*) FILTER (level = 'fail') AS fail_count FROM f GROUP BY ROLLUP ("group")""")
def jobs_validate_cells(spark, sf):
    """All six groups on derived facts, counted"""
    found = [f(spark, sf) for f in (_retrieval_found, _folder_found, _alignment_found, _presence_found, _coverage_found, _native_found)]
    return J.validation_report(found)[0]
