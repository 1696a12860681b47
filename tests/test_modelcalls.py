"""Model passes: retries, schema rounds, resumption, and one call per row."""

import json
import os
import sys
import time
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evalspark.functions import replies as R
from evalspark.plans import arms as A, prompts as P
from evalspark.plans.modelcalls import backoff_seconds, call_model, failure_ledger, last_attempt, validated_pass
from evalspark.plans.summaries import daily_and_overall

cloudpickle.register_pickle_by_value(sys.modules[__name__])
FAST = {"wait_seconds": lambda attempt, error: 0.0}


def prompts(spark, texts):
    rows = [(str(i), "sys", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "call_key string, system string, user string").repartition(3)


def test_backoff_honours_the_server_hint():
    assert backoff_seconds(1, "x") == 2
    assert backoff_seconds(9, "x") == 64
    assert backoff_seconds(1, "{'retry_after': 33}") == 33
    assert backoff_seconds(1, '{"retry_after": 999}') == 120


def test_attempts_end_as_rows(spark):
    def factory():
        tries = {}

        def call(system, user, stage):
            tries[user] = tries.get(user, 0) + 1
            if user == "never" or (user == "second" and tries[user] == 1):
                raise RuntimeError("rate limit")
            return "  " if user == "empty" else {"text": " ok ", "output_tokens": 2}
        return call

    asked = prompts(spark, ["first", "second", "never", "empty"])
    log = call_model(asked, factory, "answer", attempts=3, **FAST)
    rows = {(r["call_key"], r["attempt"]): r for r in log.collect()}
    assert sorted(rows) == [("0", 1), ("1", 1), ("1", 2), ("2", 1), ("2", 2), ("2", 3), ("3", 1), ("3", 2), ("3", 3)]
    assert rows["0", 1]["text"] == "ok" and rows["0", 1]["output_tokens"] == 2 and rows["0", 1]["usage_available"]
    assert rows["1", 1]["error"] == "rate limit" and rows["1", 2]["success"]
    assert rows["3", 3]["error_type"] == "ValueError"
    frame = spark.createDataFrame(list(rows.values()), log.schema)
    assert {r["call_key"]: r["success"] for r in last_attempt(frame).collect()} == {"0": True, "1": True, "2": False, "3": False}
    assert sorted(r["call_key"] for r in failure_ledger(asked, frame).collect()) == ["2", "3"]


def test_schema_rounds_ask_only_refused_rows_again(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        def call(system, user, stage):
            before = len([n for n in os.listdir(folder) if n.startswith(user + "-")])
            open(os.path.join(folder, f"{user}-{uuid.uuid4().hex}"), "w").close()
            return "good" if user == "easy" or (user == "slow" and before == 1) else "bad"
        return call

    def check(rows):
        return rows.withColumn("problem", F.when(F.col("text") != "good", "bad reply"))

    accepted, calls = validated_pass(prompts(spark, ["easy", "slow", "never"]), factory, "stage1", check, rounds=3, attempts=1, **FAST)
    assert sorted(r["call_key"] for r in accepted.collect()) == ["0", "1"]
    accepted.count(), calls.count()
    made = [n.split("-")[0] for n in os.listdir(folder)]
    # reading the results again called nothing again
    assert {w: made.count(w) for w in ("easy", "slow", "never")} == {"easy": 1, "slow": 2, "never": 3}
    assert calls.count() == 6


def memory_rows(spark):
    rows = [(i, f"q{i}", [{"memory_id": f"m{j}", "memory_text": f"t{i}{j}"} for j in range(1, i + 2)]) for i in range(5)]
    return spark.createDataFrame(rows, "sample_id int, current_request string, memories array<struct<memory_id:string,memory_text:string>>")


def staged_factory():
    def call(system, user, stage):
        asked = json.loads(user)
        if stage == "stage1":
            if asked["memories"][0]["memory_text"].startswith("t4"):
                return "I refuse"
            return json.dumps({"memory_boundary_cards": [
                {"memory_id": m["memory_id"], "key_factors": [], "conditional_use_rules": ["r"], "boundary_summary": "s"} for m in asked["memories"]]})
        if stage == "stage2":
            return json.dumps({"memory_use_instructions": [
                {"memory_id": m["memory_id"], "use_instruction": "u", "rationale": "w"} for m in asked["memories"][::-1]]})
        return f"answer {asked['query']} {len(asked['use']['memory_use_instructions'])}"
    return call


STAGES = {
    "stage1": ("a", '{"memories": {{RETRIEVED_MEMORIES}}}'),
    "stage2": ("b", '{"memories": {{RETRIEVED_MEMORIES}}, "cards": {{MEMORY_BOUNDARY_CARDS}}}'),
    "stage3": ("c", '{"query": "{{CURRENT_QUERY}}", "use": {{MEMORY_USE_INSTRUCTIONS}}}'),
}


def test_staged_arm_resumes_caches_and_ledgers(spark):
    rows = memory_rows(spark)
    done = rows.where("sample_id = 0").select("sample_id")
    card = json.dumps({"memory_boundary_cards": [
        {"memory_id": "m1", "key_factors": [], "conditional_use_rules": ["r"], "boundary_summary": "s"},
        {"memory_id": "m2", "key_factors": [], "conditional_use_rules": ["r"], "boundary_summary": "s"}]})
    system, template = STAGES["stage1"]
    asked = P.add_prompt(rows.where("sample_id = 1"), P.stage_prompt(system, template, F.col("current_request"), F.col("memories"), None))
    cache = asked.select("sample_id", F.lit("stage1").alias("stage"), A.cache_key("full", "stage1").alias("cache_key"), F.lit(card).alias("text"))
    result = A.staged_arm(rows, done, STAGES, staged_factory, "full", cache, rounds=2, attempts=1, **FAST)
    answers = {r["sample_id"]: r["final_answer"] for r in result.outputs.collect()}
    assert answers == {1: "answer q1 2", 2: "answer q2 3", 3: "answer q3 4"}
    assert [(r["call_key"], r["stage"]) for r in result.failures.collect()] == [("4", "stage1")]
    stages = [(r["call_key"], r["stage"]) for r in result.calls.collect()]
    assert ("1", "stage1") not in stages and ("1", "stage2") in stages
    assert stages.count(("4", "stage1")) == 2


def test_selector_failures_are_ledgered(spark):
    rows = spark.createDataFrame([(i, "q", [{"memory_id": "m1", "content": "a"}, {"memory_id": "m2", "content": "b"}]) for i in range(2)],
                                 "sample_id int, current_request string, memories array<struct<memory_id:string,content:string>>")

    def factory():
        return lambda system, user, stage: '{"keep_memory_ids": ["zz"]}' if stage == "self_recheck" else system

    def prompt_of(memories, query):
        return P.memory_answer_prompt("{memories}", F.transform(memories, lambda m: m["content"]), query, "g")
    none = rows.where("false").select("sample_id")
    result = A.intervention_arm(rows, none, "self_recheck", prompt_of, factory, attempts=1, **FAST)
    assert result.outputs.count() == 0 and result.failures.count() == 2
    gate = A.intervention_arm(rows, none, "memgate", prompt_of, factory, attempts=1, **FAST)
    assert {r["final_answer"] for r in gate.outputs.collect()} == {"<memories>\n- a\n- b\n</memories>"}


def test_format_once_ignores_braces_in_values(spark):
    frame = spark.createDataFrame([("{user_query}", "q")], "m string, q string")
    got = frame.select(P.format_once("A {conversation_history} B {user_query} {{x}}", {"conversation_history": F.col("m"), "user_query": F.col("q")})).first()[0]
    assert got == "A {user_query} B q {x}"


def test_rubric_placeholders_are_checked_before_filling(spark):
    rubrics = [("shared", "{final_trigger} {assistant_response} {{not_a}} {X}"), ("shared", "{gold_standard} {other}"), ("number_game", "{gold_standard}"),
               ("unheard_of", "{poisoned_fact}")]
    found = P.rubric_findings(spark.createDataFrame(rubrics, "family string, template string")).collect()
    assert sorted((r["family"], r["field"]) for r in found) == [("shared", "gold_standard"), ("shared", "not_a"), ("shared", "other"), ("unheard_of", "poisoned_fact")]
    row = spark.range(1).select(F.lit("t").alias("final_trigger"), F.lit("a").alias("assistant_response"))
    fields = {c: F.col(c) for c in row.columns}
    assert row.select(P.dialogue_judge_prompt("{final_trigger}-{assistant_response}", "shared", fields)["user"]).first()[0] == "t-a"
    with pytest.raises(Exception, match="gold_standard"):
        row.select(P.dialogue_judge_prompt("{final_trigger} {gold_standard}", "shared", fields)).collect()


def test_a_stage_refuses_a_template_it_cannot_fill():
    with pytest.raises(ValueError, match="MEMORY_BOUNDARY_CARDS"):
        P.stage_prompt("s", "{{CURRENT_QUERY}} {{MEMORY_BOUNDARY_CARDS}}", F.lit("q"), F.lit("m"))


def test_only_transient_errors_are_tried_again_and_secrets_are_struck_out(spark):
    def factory():
        def call(system, user, stage):
            raise RuntimeError(f"{user}: key sk-123456789 refused" + "x" * 3000)
        return call
    log = call_model(prompts(spark, ["bad request", "HTTP 503"]), factory, "answer", attempts=3, secrets=["sk-123456789"], **FAST).collect()
    assert sorted((r["call_key"], r["attempt"]) for r in log) == [("0", 1), ("1", 1), ("1", 2), ("1", 3)]
    assert all("sk-123456789" not in r["error"] and "[REDACTED]" in r["error"] and len(r["error"]) == 2000 for r in log)


def test_calls_of_a_task_run_side_by_side(spark):
    def factory():
        return lambda system, user, stage: time.sleep(0.2) or "ok"
    started = time.perf_counter()
    rows = call_model(prompts(spark, ["q"] * 40), factory, "answer", partitions=1, concurrency=20, **FAST).collect()
    assert len(rows) == 40 and all(r["success"] for r in rows) and time.perf_counter() - started < 6


def test_an_incomplete_sample_gets_no_overall_summary(spark):
    def factory():
        def call(system, user, stage):
            if "broken" in user:
                raise RuntimeError("no")
            return user.count("\n") * "line " + "done"
        return call
    rows = [(1, "2024-01-01", [("a", "b")]), (1, "2024-01-02", [("broken", "b")]), (2, "2024-01-01", [("c", "d")])]
    records = spark.createDataFrame(rows, "sample_id int, date string, pairs array<struct<query:string,response:string>>")
    daily, overall, log, failures = daily_and_overall(records, "sum", factory, **FAST)
    assert sorted((r["sample_id"], r["date"]) for r in daily.collect()) == [(1, "2024-01-01"), (2, "2024-01-01")]
    assert [r["sample_id"] for r in overall.collect()] == [2]
    assert [(r["sample_id"], r["stage"], r["error"]) for r in failures.orderBy("stage").collect()] == [
        (1, "daily_summary", "no"), (1, "overall_summary", "daily summaries are missing")]


def test_recover_outermost_strips_fences(spark):
    frame = spark.createDataFrame([('```\n{"a": 1}\n```',), ('x {"a": {"b": 2}} y',), ("{",)], "t string")
    got = [r[0] for r in frame.select(F.to_json(R.recover_outermost(F.col("t")))).collect()]
    assert got == ['{"a":1}', '{"a":{"b":2}}', None]


def counting_factory(folder, broken=None):
    """A model that leaves a file per call, and ends its task the first time it is asked the broken prompt."""
    def factory():
        def call(system, user, stage):
            open(os.path.join(folder, f"{user}-{uuid.uuid4().hex}"), "w").close()
            if user == broken and not os.path.exists(os.path.join(folder, "ended")):
                open(os.path.join(folder, "ended"), "w").close()
                raise KeyboardInterrupt("the task ends here")
            return "fails" if user == "q3" else {"text": f"reply to {user}", "output_tokens": 3}
        return call
    return factory


def made_calls(folder):
    names = [n.split("-")[0] for n in os.listdir(folder) if "-" in n]
    return {n: names.count(n) for n in set(names)}


def test_a_pass_goes_on_where_its_task_ended(spark, tmp_path):
    calls, journal = str(tmp_path / "calls"), f"file://{tmp_path}/journal"
    os.makedirs(calls)
    asked = prompts(spark, [f"q{i}" for i in range(60)])
    options = {"partitions": 3, "concurrency": 1, "journal": journal, **FAST}
    with pytest.raises(Exception, match="the task ends here"):
        call_model(asked, counting_factory(calls, "q41"), "answer", **options).collect()
    first = made_calls(calls)
    assert 0 < len(first) < 60 and set(first.values()) == {1}
    # other settings do not move keys to other tasks
    rows = call_model(asked, counting_factory(calls, "q41"), "answer", **{**options, "partitions": 7}).collect()
    assert {r["call_key"]: r["text"] for r in rows} == {str(i): "fails" if i == 3 else f"reply to q{i}" for i in range(60)}
    assert all(r["output_tokens"] == 3 for r in rows if r["call_key"] != "3") and all(r["request_started_at"] for r in rows)
    again = made_calls(calls)
    # only the call that ended its task is made twice
    assert {n: c for n, c in again.items() if c != 1} == {"q41": 2}
    call_model(asked, counting_factory(calls), "answer", **options).count()
    assert made_calls(calls) == again


def test_a_torn_line_is_a_call_that_was_not_finished(spark, tmp_path):
    calls, folder = str(tmp_path / "calls"), str(tmp_path / "journal")
    os.makedirs(calls)
    asked = prompts(spark, ["a", "b"])
    call_model(asked, counting_factory(calls), "answer", partitions=1, journal=folder, **FAST).collect()
    task = os.path.join(folder, "task-000000")
    [name] = os.listdir(task)
    with open(os.path.join(task, name)) as lines:
        kept = lines.read()
    with open(os.path.join(task, name), "w") as lines:
        lines.write(kept[:-20])
    call_model(asked, counting_factory(calls), "answer", partitions=1, journal=folder, **FAST).collect()
    assert sorted(made_calls(calls).values()) == [1, 2]


def test_a_retried_task_repeats_no_call(tmp_path):
    """A session that retries tasks runs in a process of its own."""
    import subprocess

    calls = str(tmp_path / "calls")
    os.makedirs(calls)
    program = f"""
import sys
sys.path[:0] = {sys.path!r}
import test_modelcalls as T
from evalspark.plans.modelcalls import call_model
from evalspark.session import build_session
spark = build_session("retries", "local[2,3]", 2)
rows = call_model(T.prompts(spark, ["q%d" % i for i in range(40)]), T.counting_factory({calls!r}, "q17"), "answer", partitions=2, concurrency=1, **T.FAST).collect()
assert len(rows) == 40, len(rows)
"""
    done = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert {n: c for n, c in made_calls(calls).items() if c != 1} == {"q17": 2} and len(made_calls(calls)) == 40


def test_rounds_write_keys_not_rows(spark, tmp_path, monkeypatch):
    from evalspark.plans import modelcalls

    written = []
    monkeypatch.setattr(modelcalls, "cut_lineage", lambda df: written.append(df.columns) or df.cache())
    rows = prompts(spark, ["x", "y"]).withColumn("memories", F.lit("long"))
    accepted, _ = validated_pass(rows, lambda: lambda s, u, g: "good", "stage1", lambda r: r.withColumn("problem", F.lit(None).cast("string")), rounds=1, attempts=1, **FAST)
    assert written[-1] == ["call_key", "text", "problem"]
    assert {(r["call_key"], r["memories"], r["text"]) for r in accepted.collect()} == {("0", "long", "good"), ("1", "long", "good")}


def test_cached_replies_are_used_under_their_keys_only(spark):
    rows = memory_rows(spark).where("sample_id < 4")
    none = rows.where("false").select("sample_id")
    first = A.staged_arm(rows, none, STAGES, staged_factory, "full", rounds=1, attempts=1, **FAST)
    cache = spark.createDataFrame(first.replies.collect(), first.replies.schema)
    assert cache.groupBy("stage").count().orderBy("stage").collect() == [("stage1", 4), ("stage2", 4)]

    def stages_of(prompts, variant="full", data=rows):
        result = A.staged_arm(data, none, prompts, staged_factory, variant, cache, rounds=1, attempts=1, **FAST)
        made = [r["stage"] for r in result.calls.collect()]
        stale = sorted(r["detail"].split(" ")[0] for r in result.findings.where("check = 'stale_cache'").collect())
        return {s: made.count(s) for s in set(made)}, stale, result.outputs.count()
    assert stages_of(STAGES) == ({"stage3": 4}, [], 4)
    # another prompt, another variant, other memories: asked again, and the old replies are listed
    assert stages_of({**STAGES, "stage1": ("other", STAGES["stage1"][1])}) == ({"stage1": 4, "stage3": 4}, ["stage1"] * 4, 4)
    baseline = {**STAGES, "baseline": STAGES["stage3"]}
    assert stages_of(baseline, "stage1-stage2-baseline") == ({"stage1": 4, "stage2": 4, "baseline": 4}, ["stage1"] * 4 + ["stage2"] * 4, 4)
    edited = rows.withColumn("memories", F.when(F.col("sample_id") == 2, F.transform("memories", lambda m: F.struct(
        m["memory_id"].alias("memory_id"), F.concat(m["memory_text"], F.lit("!")).alias("memory_text")))).otherwise(F.col("memories")))
    assert stages_of(STAGES, data=edited) == ({"stage1": 1, "stage2": 1, "stage3": 4}, ["stage1", "stage2"], 4)


def test_a_guard_stops_every_arm_before_its_first_call(spark):
    from evalspark.plans.guards import Guard

    def never():
        raise AssertionError("no client is made")

    def prompt_of(memories, query):
        return F.struct(F.lit("s").alias("system"), query.alias("user"))
    rows = memory_rows(spark).withColumn("arm", F.when(F.col("sample_id") == 3, "other").otherwise("mine"))
    twice = rows.unionByName(rows.where("sample_id = 1"))
    done = spark.createDataFrame([(0, {"answer": "p1"}, "c1"), (4, {"answer": "p0"}, "c1"), (2, None, None)], "sample_id int, prompt_hashes map<string,string>, run_fingerprint string")
    prompt = F.struct(F.lit("s").alias("system"), F.col("current_request").alias("user"))
    guard = Guard("mine", {"answer": "p1"}, "c1")
    want = {("duplicate_ids", "1", "2 rows"), ("wrong_arm", "3", "arm other"), ("prompt_drift", "4", "answer p0"), ("prompt_drift", "2", "answer none"), ("config_drift", "2", "none")}
    arms = [lambda g: A.baseline_arm(twice, done, prompt, never, guard=g), lambda g: A.staged_arm(twice, done, STAGES, never, guard=g),
            lambda g: A.intervention_arm(twice, done, "memgate", prompt_of, never, guard=g),
            lambda g: A.judge_arm(twice, done, prompt, lambda t: F.struct(F.array().alias("problems")), never, guard=g)]
    for arm in arms:
        result = arm(guard)
        assert {tuple(r) for r in result.findings.collect()} == want
        assert result.calls.count() == 0 and result.outputs.count() == 0 and result.failures.count() == len(want)
        # repeated ids are checked without any declaration
        assert [tuple(r) for r in arm(None).findings.collect()] == [("duplicate_ids", "1", "2 rows")]
    passed = A.baseline_arm(rows, done.limit(0), prompt, lambda: lambda s, u, g: "ok", guard=Guard(), attempts=1, **FAST)
    assert passed.findings.count() == 0 and passed.outputs.count() == 5


def test_a_staged_arm_reads_its_input_once(spark, tmp_path):
    """What comes out is made of the arm's own tables; the rows are not filtered and moved again for every reader."""
    memory_rows(spark).where("sample_id < 4").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    none = rows.where("false").select("sample_id")
    first = A.staged_arm(rows, none, STAGES, staged_factory, "full", rounds=1, attempts=1, **FAST)
    second = A.staged_arm(rows, none, STAGES, staged_factory, "full", first.replies, rounds=1, attempts=1, **FAST)
    for frame in (first.outputs, first.replies, first.failures, second.outputs, second.replies, second.findings):
        assert frame.inputFiles() and not [f for f in frame.inputFiles() if str(tmp_path) in f]
    assert set(second.outputs.columns) == {*rows.columns, "stage1_raw", "stage1_json", "stage2_raw", "stage2_json", "final_answer"}


def test_no_prompts_make_no_pass(spark):
    none = prompts(spark, ["x"]).where("call_key = 'none'")
    calls = call_model(none, staged_factory, "stage1", attempts=1, **FAST)
    assert calls.count() == 0 and calls.schema.simpleString() == call_model(prompts(spark, ["x"]), staged_factory, "stage1", attempts=1, **FAST).schema.simpleString()
    assert "MapInPandas" not in calls._jdf.queryExecution().optimizedPlan().toString()
