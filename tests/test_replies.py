"""Hand-written goldens for reply recovery and scoring."""

import json

import pytest
from pyspark.sql import functions as F

from evalspark.functions import replies as R


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def as_json(column):
    return lambda c: F.to_json(column(c))


@pytest.mark.parametrize("text, strict, ladder", [
    ('```json\n{"dimension_1_x": {"score": 4}}\n```', {"dimension_1_x": {"score": 4}}, {"dimension_1_x": {"score": 4}}),
    ('Here is my judgement: {"a": 1}\nHope that helps.', None, {"a": 1}),
    ('{"a":1} tail', None, {"a": 1}),
    ("[1]", None, None),
    ('x {"a":{"b":{"c":1}}} y', None, {"b": {"c": 1}}),
    ('{"a":1},"b":{"c":2}', None, {"a": 1}),
    ('{"a":1},0]', None, {"a": 1}),
    ("", None, None),
])
def test_recovery_families(spark, text, strict, ladder):
    got = one(spark, text, as_json(R.recover_strict))
    assert (json.loads(got) if got else None) == strict
    got = one(spark, text, as_json(R.recover_ladder))
    assert (json.loads(got) if got else None) == ladder


def test_long_text_does_not_exhaust_the_regex_stack(spark):
    text = "{" + "x" * 300_000 + '} {"a": 1}'
    assert json.loads(one(spark, text * 1, as_json(R.recover_outermost)) or "null") is None
    assert one(spark, "y" * 300_000 + ' {"a": 1} ' + "z" * 300_000, as_json(R.recover_ladder)) == '{"a":1}'


def test_reasoning_is_split_off(spark):
    row = one(spark, "<think>hmm {x}</think>\n{\"score\": 2}", R.split_reasoning)
    assert (row["trace"], row["answer"]) == ("hmm {x}", '{"score": 2}')


@pytest.mark.parametrize("reply, score, problems", [
    ({"reasoning": "r", "score": 3}, 3, []),
    ({"reasoning": "r", "score": "3"}, 3, []),
    ({"reasoning": "r", "score": 3.9}, 3, []),
    ({"reasoning": "r", "score": "3.0"}, None, ["score is not an integer"]),
    ({"reasoning": "r", "score": True}, None, ["boolean score"]),
    ({"reasoning": "r", "rating": 2}, 2, []),
    ({"reasoning": "r", "rating": 4}, None, ["score out of range"]),
    ({"reasoning": "r", "score": None, "rating": 1}, 1, []),
    ({"score": 1}, 1, ["missing reasoning"]),
    ({"reasoning": " "}, None, ["missing reasoning", "no score"]),
    ({"reasoning": "r", "score": [1]}, None, ["score is not an integer"]),
])
def test_single_score(spark, reply, score, problems):
    row = one(spark, json.dumps(reply), lambda c: R.score_single(R.parse_object(c), F.lit(1), F.lit(3)))
    assert (row["score"], row["problems"]) == (score, problems)


@pytest.mark.parametrize("value, ok", [(0, True), (5, True), (6, False), ("4", False), (True, False), (4.0, False), (None, False)])
def test_dimension_scores_are_not_coerced(spark, value, ok):
    reply = json.dumps({"dimension_1_x": {"score": value}})
    expected = F.array(F.lit("dimension_1_x"))
    row = one(spark, reply, lambda c: R.score_dimensions(R.parse_object(c), expected))
    assert (row["scores"] == {"dimension_1_x": value}) == ok
    assert (row["problems"] == []) == ok


@pytest.mark.parametrize("text, value", [("true", True), ("1", True), ("0", False), ("1.0", None), ('"1"', None), ("2", None), ("null", None)])
def test_binary_values(spark, text, value):
    assert one(spark, text, lambda c: R.binary_value(F.try_parse_json(c))) is value


def test_stage_two_reattaches_ids_only_when_all_are_absent(spark):
    ids = F.array(F.lit("a"), F.lit("b"))

    def check(items):
        return one(spark, json.dumps({"memory_use_instructions": items}), lambda c: R.stage2_instructions(R.parse_object(c), ids))
    text = {"use_instruction": "u", "rationale": "r"}
    assert [i["memory_id"] for i in check([text, text])["instructions"]] == ["a", "b"]
    assert [i["memory_id"] for i in check([{**text, "memory_id": "b"}, {**text, "memory_id": "a"}])["instructions"]] == ["a", "b"]
    assert check([text, {**text, "memory_id": "b"}])["problem"] == "memory ids differ"
    assert check([{**text, "memory_id": "a"}, {**text, "memory_id": "a"}])["problem"] == "memory ids differ"
    assert check([{"memory_id": "a", "use_instruction": "u"}, {**text, "memory_id": "b"}])["problem"] == "rationale"


def test_outermost_refuses_a_list_around_an_object(spark):
    rows = ['[{"memory_use_instructions": []}]', 'so: {"a": 1} done', '```json\n{"a": 2}\n```', '"text"']
    frame = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in frame.select(F.to_json(R.recover_outermost(F.col("t")))).collect()] == [None, '{"a":1}', '{"a":2}', None]


def test_selections_of_the_wrong_type(spark):
    ids = F.array(F.lit("m1"), F.lit("m2"))

    def problems(rows, partition):
        frame = spark.createDataFrame([(r,) for r in rows], "t string")
        return [tuple(r[0]) for r in frame.select(R.selected_ids(F.col("t"), ids, partition)).collect()]

    wrong = "keep_memory_ids is not a list"
    assert problems(['{"keep_memory_ids": null}', '{"keep_memory_ids": "m1"}', '{"keep_memory_ids": 5}', "{}", '{"keep_memory_ids": ["m2"]}'], False) == [
        (None, wrong), (None, wrong), (None, wrong), ([], None), (["m2"], None)]
    wrong = "groups are malformed"
    assert problems(['{"groups": [{"memory_ids": ["m1"]}, 5, {"memory_ids": ["m2"]}]}', '{"groups": {"a": 1}}', '{"groups": [{"memory_ids": "m1"}]}',
                     '{"groups": [{"memory_ids": ["m1", "m2"]}]}'], True) == [(None, wrong), (None, wrong), (None, wrong), (["m1", "m2"], None)]


def test_mean_is_rounded_once(spark):
    from evalspark.functions.stats import rounded_mean

    frame = spark.createDataFrame([(0.0004,), (0.0004,), (0.0008,), (None,)], "v double")
    assert frame.select(rounded_mean(F.col("v"))).first()[0] == 0.001
