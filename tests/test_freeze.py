"""The retrieval freeze: built, reused and half-written stores, resumption, failures."""

import pytest
from pyspark.sql import functions as F

from evalspark.plans import freeze as Z

CHAT = "sample_id string, turn int, role string, content string"
ASK = "sample_id string, request string, top_k int"


def chat(spark, *samples):
    rows = [(s, t, "user" if t % 2 == 0 else "assistant", text) for s, texts in samples for t, text in enumerate(texts)]
    return spark.createDataFrame(rows, CHAT)


def asks(spark, *rows):
    return spark.createDataFrame(rows, ASK)


def status(frozen):
    return {r["sample_id"]: r["memory_config"]["store_status"] for r in frozen.rows.collect()}


TEA, SEA = ["I like tea", "Noted", "and red cups", "Fine"], ["the sea is cold", "Yes"]


def test_stores_are_built_once_and_found_again(spark, tmp_path):
    index, folder = Z.IndexFolder(f"{tmp_path}/index"), f"{tmp_path}/runs"
    talk = chat(spark, ("a", TEA), ("b", SEA), ("c", TEA))
    first = Z.freeze_retrieval(talk, asks(spark, ("a", "tea?", None), ("b", "sea?", 1)), Z.Cell("d", "s", top_k=2), folder, index)
    assert status(first) == {"a": "built", "b": "built"} and first.built == 2
    rows = {r["sample_id"]: r for r in first.rows.collect()}
    assert rows["a"]["memory_config"]["top_k"] == 2 and rows["a"]["memory_config"]["top_k_policy"] == "fixed"
    assert rows["b"]["memory_config"]["top_k_policy"] == "per_sample_len_memories" and rows["b"]["retrieved_count"] == 1
    assert rows["a"]["memory_config"]["messages_count"] == rows["a"]["memory_config"]["marker_messages_count"] == 4
    memory = rows["a"]["retrieved_memories"][0]
    assert memory["memory_id"] == "memorybank_01" and memory["metadata"]["kind"] == "dialogue" and "tea" in memory["content"]
    # the other cell shares the stores; equal content under another id needs none of its own
    second = Z.freeze_retrieval(talk, asks(spark, ("a", "cups?", None), ("c", "tea?", None)), Z.Cell("d", "other", top_k=2), folder, index)
    assert status(second) == {"a": "reused", "c": "reused"} and second.built == 0
    # an appended store beside the old ones; samples with rows are left alone
    more = talk.unionByName(chat(spark, ("e", ["new words", "ok"])))
    third = Z.freeze_retrieval(more, asks(spark, ("a", "tea?", None), ("b", "sea?", 1), ("e", "words?", None)), Z.Cell("d", "s", top_k=2), folder, index)
    assert third.pending == 1 and third.built == 1 and status(third) == {"a": "built", "b": "built", "e": "built"}
    assert index.manifest(spark).count() == 3
    # another turn is another store, and so is another system
    changed = chat(spark, ("a", [*TEA, "no, coffee"]))
    assert status(Z.freeze_retrieval(changed, asks(spark, ("a", "tea?", None)), Z.Cell("d", "t"), folder, index)) == {"a": "built"}
    other = Z.freeze_retrieval(talk, asks(spark, ("a", "tea?", None)), Z.Cell("d", "t", system="raw_dialogue"), folder, index)
    assert status(other) == {"a": "built"} and {m["metadata"]["kind"] for m in other.rows.first()["retrieved_memories"]} == {"entry"}


def test_a_half_written_part_is_not_seen(spark, tmp_path, monkeypatch):
    index, folder = Z.IndexFolder(f"{tmp_path}/index"), f"{tmp_path}/runs"
    talk, asked = chat(spark, ("a", TEA)), asks(spark, ("a", "tea?", None))
    real = Z.F.current_timestamp

    def lost():
        raise RuntimeError("the driver is lost before the manifest")
    monkeypatch.setattr(Z.F, "current_timestamp", lost)
    with pytest.raises(RuntimeError, match="before the manifest"):
        Z.freeze_retrieval(talk, asked, Z.Cell("d", "s"), folder, index)
    monkeypatch.setattr(Z.F, "current_timestamp", real)
    assert spark.read.parquet(f"{tmp_path}/index/parts").count() == 2 and index.manifest(spark).count() == 0
    again = Z.freeze_retrieval(talk, asked, Z.Cell("d", "s"), folder, index)
    assert status(again) == {"a": "built"}
    assert spark.read.parquet(f"{tmp_path}/index/parts").count() == 4
    # both documents come from the published part only: each once, merged into their one day
    assert [m["metadata"]["merged"] for m in again.rows.first()["retrieved_memories"]] == [2]


def test_failures_are_rows_and_are_tried_again(spark, tmp_path):
    index, folder = Z.IndexFolder(f"{tmp_path}/index"), f"{tmp_path}/runs"
    talk = chat(spark, ("a", TEA), ("b", SEA), ("empty", ["  ", ""]))
    asked = asks(spark, ("a", "tea?", None), ("b", " ", None), ("none", "who?", None), ("deep", "x", 99), ("empty", "said?", None))
    done = Z.freeze_retrieval(talk.unionByName(chat(spark, ("deep", SEA))), asked, Z.Cell("d", "s"), folder, index)
    assert {r["sample_id"]: r["error"] for r in done.failures.collect()} == {"b": "empty request", "none": "no messages", "deep": "top_k above 16"}
    rows = {r["sample_id"]: r for r in done.rows.collect()}
    assert set(rows) == {"a", "empty"} and rows["empty"]["retrieved_count"] == 0 and rows["empty"]["official_context_text"] == "[NO RETRIEVED MEMORIES]"
    ledger = spark.read.json(f"{folder}/failures")
    assert ledger.count() == 3 and ledger.where(F.col("recorded_at").isNull()).count() == 0
    again = Z.freeze_retrieval(talk, asks(spark, ("a", "tea?", None), ("b", "sea?", None)), Z.Cell("d", "s"), folder, index)
    assert again.pending == 1 and set(status(again)) == {"a", "empty", "b"}


def test_keys_follow_content_and_order(spark):
    talk = chat(spark, ("a", TEA), ("b", TEA), ("c", TEA[::-1]), ("d", TEA[:3]))
    keys = {r["sample_id"]: r["digest"] for r in Z.store_keys(talk, ["m"]).collect()}
    assert keys["a"] == keys["b"] and len({keys[k] for k in "acd"}) == 3
    assert keys["a"] != Z.store_keys(talk, ["n"]).where("sample_id = 'a'").first()["digest"]


def test_unknown_systems_are_refused():
    with pytest.raises(ValueError, match="memorybank"):
        Z.builder("nothing")
