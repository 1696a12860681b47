"""File scans and sinks on files written here."""

import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalspark.operators.selection import newest_part
from evalspark.sinks import tables as T
from evalspark.sources import files as S

ROW = "sample_id string, n int"
SCHEMA = StructType().add("sample_id", "string").add("n", "integer")


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as handle:
        handle.write(text)
    return str(path)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_json_array_keeps_file_order(spark, tmp_path):
    path = write(f"{tmp_path}/a.json", json.dumps([{"sample_id": "x", "n": 3}, {"sample_id": "y"}]))
    assert pairs(S.json_array(spark, path, f"struct<{ROW.replace(' ', ':').replace(',:', ',')}>"), "row_index", "sample_id", "n")[0] == (1, "x", 3)


def test_json_lines_count_blank_lines(spark, tmp_path):
    path = write(f"{tmp_path}/a.jsonl", '{"sample_id": "x"}\n\n{"sample_id": "y"}\r\n   \n{"sample_id": "z"}\n')
    assert pairs(S.json_lines(spark, path, "struct<sample_id:string>"), "row_index", "sample_id") == [(1, "x"), (3, "y"), (5, "z")]


def test_lenient_and_strict_lines(spark, tmp_path):
    path = write(f"{tmp_path}/a.jsonl", '{"sample_id": "x", "n": 1}\n{"sample_id": "y", "n"')
    assert pairs(S.lenient_lines(spark, path, SCHEMA), "sample_id") == [("x",)]
    with pytest.raises(Exception):
        S.strict_lines(spark, path, SCHEMA).collect()


def test_lines_that_are_no_object(spark, tmp_path):
    path = write(f"{tmp_path}/a.jsonl", '{"sample_id": "x", "n": 1}\n[{"sample_id": "y"}]\n{"sample_id":\n{"sample_id": "z"}\n')
    lenient = S.lenient_lines(spark, path, SCHEMA)
    assert lenient.count() == 2 and sorted(pairs(lenient, "sample_id")) == [("x",), ("z",)]
    bad = S.strict_lines(spark, write(f"{tmp_path}/b.jsonl", '{"sample_id": "x"}\n[{"sample_id": "y"}]\n'), SCHEMA)
    for action in (bad.count, bad.collect):
        with pytest.raises(Exception, match="not an object"):
            action()


def test_audit_lines(spark, tmp_path):
    path = write(f"{tmp_path}/a.jsonl", '{"a": 1}\n[1]\n{"a": 1} tail\n\n"text"\nnope\n')
    rows = S.audit_lines(S.numbered_lines(spark, path)).orderBy("line_number").collect()
    assert [(r["line_number"], r["problem"]) for r in rows] == [
        (1, None), (2, "not an object"), (3, "not JSON"), (5, "not an object"), (6, "not JSON")]


def test_raw_lines_keep_their_text(spark, tmp_path):
    path = write(f"{tmp_path}/a.jsonl", '{"sample_id":  "x"}\n{"other": 1}\n')
    assert set(pairs(S.raw_lines(spark, path).na.fill("-"), "value", "sample_id")) == {('{"sample_id":  "x"}', "x"), ('{"other": 1}', "-")}


def test_record_folder_names_bad_records(spark, tmp_path):
    for name, text in {"a": '{"sample_id": "x",\n "n": 1}', "b": '{"sample_id": "y"}', "c": '{"sample_id": "y"}', "d": '{"n": 2}'}.items():
        write(f"{tmp_path}/r/{name}.json", text)
    got = S.record_folder(spark, f"{tmp_path}/r", SCHEMA).na.fill("")
    assert pairs(got, "sample_id", "problem") == [("", "no sample_id"), ("x", ""), ("y", "duplicate record"), ("y", "duplicate record")]


def test_shard_parts_and_merge_by_file_time(spark, tmp_path):
    base = time.time() - 1000
    for shard, age, rows in ((0, 50, ["x:1", "y:1", "x:2"]), (1, 90, ["x:3"]), (2, 10, ["z:9"])):
        path = write(f"{tmp_path}/p/shard{shard:02d}.jsonl", "".join(json.dumps({"sample_id": r[0], "n": int(r[2:])}) + "\n" for r in rows))
        os.utime(path, (base - age, base - age))
    write(f"{tmp_path}/p/shard00.failures.jsonl", '{"sample_id": "q", "n": 0}\n')
    parts = S.shard_parts(spark, f"{tmp_path}/p", SCHEMA)
    merged = newest_part(parts, ["sample_id"], ["modified", "shard", "line"])
    assert pairs(merged, "sample_id", "n", "copies") == [("x", 2, 3), ("y", 1, 1), ("z", 9, 1)]


def test_file_digests(spark, tmp_path):
    path = write(f"{tmp_path}/d/a.txt", "ab\r\ncd")
    assert pairs(S.file_digests(spark, f"{tmp_path}/d"), "file_name", "sha256") == [("a.txt", hashlib.sha256(open(path, "rb").read()).hexdigest())]


def test_sample_files(spark):
    text = json.dumps({"sample_id": "s", "phases": {
        "generation": {"sample": {"w": 1}, "calls": [{"c": 1}, {"c": 2}]}, "judge": {"sample": None, "calls": []}}})
    frame = spark.createDataFrame([(text,), ("broken",)], "t string")
    samples, calls = S.flatten_sample_files(frame, "t", "struct<w:int>", "struct<c:int>")
    assert pairs(samples, "sample_id", "phase", "w") == [("s", "generation", 1)]
    assert pairs(calls, "phase", "c") == [("generation", 1), ("generation", 2)]


def test_record_layout_prunes_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("d", "s", "AMEM", arm, run, f"{arm}{run}") for arm in ("a", "b") for run in (0, 1)],
                                 "dataset string, subset string, system string, arm string, run_index int, sample_id string")
    T.append_records(rows, f"{tmp_path}/out")
    T.append_records(rows.where("arm = 'a'"), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").where("arm = 'a' AND run_index = 1")
    assert back.count() == 2
    assert len(back.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(arm" in back._jdf.queryExecution().toString()
    assert pairs(S.run_indices(spark.read.parquet(f"{tmp_path}/out").where("run_index = 1"), ["arm"]), "arm", "run_index") == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_ordered_rewrite(spark, tmp_path):
    T.rewrite_ordered(spark.createDataFrame([(3,), (1,), (2,)], "row_index int"), f"{tmp_path}/o", ["row_index"])
    names = sorted(n for n in os.listdir(f"{tmp_path}/o") if n.startswith("part"))
    values = [json.loads(line)["row_index"] for n in names for line in open(f"{tmp_path}/o/{n}")]
    assert values == [1, 2, 3]


def test_report_csv_has_the_sorted_union_of_columns(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "n int, b string"), spark.createDataFrame([("y", 2)], "a string, n int")
    T.write_report_csv([a, b], f"{tmp_path}/c")
    back = spark.read.option("header", True).csv(f"{tmp_path}/c")
    assert back.columns == ["a", "b", "n"] and back.count() == 2


def test_snapshot_is_written_once_and_guarded(spark, tmp_path):
    rows = spark.range(5).withColumn("t", F.lit("x"))
    assert T.snapshot_once(rows, f"{tmp_path}/s") is True
    assert T.snapshot_once(rows.orderBy(F.desc("id")), f"{tmp_path}/s") is False
    with pytest.raises(RuntimeError):
        T.snapshot_once(rows.where("id < 4"), f"{tmp_path}/s")


def test_index_round_trip(spark, tmp_path):
    from evalspark.operators.retrieval import index_markers, load_index

    docs = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [2.0]), ("b", 1, None)], "digest string, ordinal int, vector array<double>")
    T.persist_index(docs, index_markers(docs, docs.where("vector IS NOT NULL"), "m"), f"{tmp_path}/i")
    stored, markers = spark.read.parquet(f"{tmp_path}/i/documents"), spark.read.parquet(f"{tmp_path}/i/markers")
    assert pairs(load_index(stored, markers, "m"), "digest", "ordinal") == [("a", 1), ("a", 2)]
    assert load_index(stored, markers, "other").count() == 0


def test_line_numbers_hold_when_files_are_cut(spark, tmp_path):
    os.makedirs(tmp_path / "cut")
    expected = []
    for k in range(3):
        lines = ["" if i % 7 == 0 else json.dumps({"sample_id": f"{k}-{i}", "pad": "x" * (i * 13 % 90)}) for i in range(400)]
        write(f"{tmp_path}/cut/shard{k}.jsonl", ("\r\n" if k == 1 else "\n").join(lines))
        expected += [(i + 1, f"{k}-{i}") for i in range(400) if i % 7]
    write(f"{tmp_path}/cut/shard1.failures.jsonl", '{"sample_id": "failed"}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        scan = S.json_lines(spark, f"{tmp_path}/cut/shard?.jsonl", "struct<sample_id:string>")
        assert spark.read.text(f"{tmp_path}/cut/shard?.jsonl").rdd.getNumPartitions() > 30
        assert sorted((r["row_index"], r["sample_id"]) for r in scan.collect()) == sorted(expected)
        parts = S.shard_parts(spark, f"{tmp_path}/cut", SCHEMA).collect()
        assert sorted((r["line"] + 1, f"{r['shard']}", r["sample_id"]) for r in parts) == sorted((n, s[0], s) for n, s in expected)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_digests_of_files_read_in_chunks(spark, tmp_path):
    os.makedirs(tmp_path / "big")
    contents = {"a.bin": bytes(range(256)) * 500, "b c.bin": b"1", "ü.bin": b"xyz" * 7}
    for name, data in contents.items():
        with open(tmp_path / "big" / name, "wb") as f:
            f.write(data)
    rows = S.file_digests(spark, f"{tmp_path}/big", chunk_bytes=1000)
    got = sorted((r["length"], r["sha256"]) for r in rows.collect())
    assert got == sorted((len(d), hashlib.sha256(d).hexdigest()) for d in contents.values())
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString()


def test_sorted_tables_are_replaced_whole(spark, tmp_path):
    rows = spark.range(0, 500).select((F.col("id") * 37 % 500).alias("n"), F.concat(F.lit("r"), F.col("id")).alias("name"))
    path, kind = f"{tmp_path}/sorted", "n bigint, name string"
    T.write_sorted(rows.limit(3), path, ["n"])
    place = T.write_sorted(rows, path, ["n"], part_rows=60)
    assert len([f for f in os.listdir(place) if f.startswith("part-")]) > 4
    got = T.read_sorted(spark, path, kind).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 501)) and [r["n"] for r in got] == list(range(500))
    # a version without its mark is not seen
    rows.limit(1).write.json(f"{path}/versions/lost")
    assert T.read_sorted(spark, path, kind).count() == 500


def test_calls_of_a_sample_under_two_tasks_count_once(spark):
    from evalspark.operators.efficiency import run_report

    sample = "sample_id string, phase string, run_id string, task string, success boolean, sample_wall_time_ms double, input_tokens bigint, output_tokens bigint, total_tokens bigint, sample_started_at timestamp, sample_finished_at timestamp, run_started_at timestamp"
    moment = __import__("datetime").datetime(2024, 1, 1)
    samples = spark.createDataFrame([("s", "p", None, t, True, 1.0, 1, 1, 2, moment, moment, moment) for t in ("a", "b")], sample)
    call = "sample_id string, phase string, run_id string, stage string, attempt int, success boolean, latency_ms double, retry_sleep_ms double, usage_available boolean, input_tokens bigint, output_tokens bigint, total_tokens bigint, cached_input_tokens bigint, reasoning_tokens bigint"
    calls = spark.createDataFrame([("s", "p", None, "x", 1, True, 5.0, 0.0, True, 1, 1, 2, 0, 0)] * 3, call).withColumn("task", F.lit("a"))
    rows = {r["task"]: r["api_call_count"] for r in run_report(samples, calls).collect()}
    assert rows == {None: 3, "a": 3, "b": None}
