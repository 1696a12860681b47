"""Cell facts against plain list code on random lists, and the rules that have no artefact in the tables."""

import random

from pyspark.sql import functions as F

from evalspark.operators import checks as C, facts as X

ROWS = "cell string, run_index int, line bigint, sample_id string"


def _lists(rng, cells, ids, twist):
    """Lists of ids per cell: sorted, or with some swaps, repeats and cuts."""
    out = {}
    for c in range(cells):
        row = [f"s{i:03d}" for i in range(rng.randint(0, ids))]
        for _ in range(rng.randint(0, twist)):
            if len(row) > 1:
                i, j = rng.randrange(len(row)), rng.randrange(len(row))
                row[i], row[j] = (row[j], row[i]) if rng.random() < 0.7 else (row[i], row[i])
        if row and rng.random() < 0.3:
            row.append(rng.choice(row))
        out[f"c{c}"] = row
    return out


def _frame(spark, lists, rng=None, run=0):
    rows = []
    for cell, ids in lists.items():
        line = 0
        for i in ids:
            line += rng.randint(1, 9) if rng else 1
            rows.append((cell, run, line, i))
    return spark.createDataFrame(rows, ROWS)


def test_first_unsorted_and_repeats_follow_lists(spark):
    rng = random.Random(3)
    lists = _lists(rng, 120, 25, 2)
    rows = _frame(spark, lists, rng)
    order = {r["cell"]: r["out_of_order"] for r in X.first_unsorted(rows, ["cell"], chunk=7).collect()}
    again = {r["cell"]: r["duplicates"] for r in X.repeated_ids(rows, ["cell"]).collect()}
    for cell, ids in lists.items():
        if ids:
            assert order[cell] == next((b for a, b in zip(ids, sorted(ids)) if a != b), None)
            assert again[cell] == sum(ids.count(i) > 1 for i in set(ids))


def test_divergence_follows_lists(spark):
    rng = random.Random(8)
    lists = _lists(rng, 120, 20, 1)
    others = {}
    for cell, ids in lists.items():
        part = ids[:rng.randint(0, len(ids))]
        if rng.random() < 0.4 and part:
            part[rng.randrange(len(part))] = "other"
        others[cell] = part if rng.random() < 0.8 else ids + ["more"]
    outputs, frozen = _frame(spark, others, rng), _frame(spark, lists, rng).drop("run_index")
    found = X.first_divergence(X.placed(outputs, X.ARM, 5), X.placed(frozen, ["cell"], 5), X.ARM, ["cell"], "d")
    found = {r["cell"]: r["d"] for r in found.collect()}
    for cell, ids in others.items():
        want = None
        if ids != lists[cell][:len(ids)]:
            want = next((i for i, (a, b) in enumerate(zip(ids, lists[cell])) if a != b), min(len(ids), len(lists[cell])))
        assert found.get(cell) == want


def test_facts_of_cells_without_rows_and_null_ids(spark):
    rows = spark.createDataFrame([("a", 0, 1, None), ("a", 0, 2, None), ("a", 0, 3, "x")], ROWS)
    cells = spark.createDataFrame([("a", True, 3), ("b", True, 2), ("c", False, 1)], "cell string, file_present boolean, expected_count int")
    broken = spark.createDataFrame([("b", 1)], "cell string, line bigint")
    facts = {r["cell"]: r for r in X.retrieval_facts(cells, rows, broken).collect()}
    assert [facts["a"][c] for c in ("row_count", "duplicates", "out_of_order", "unreadable")] == [3, 0, None, 0]
    assert [facts["b"][c] for c in ("row_count", "duplicates", "out_of_order", "unreadable")] == [0, 0, None, 1]
    checks = {(r["cell"], r["check"]) for r in C.retrieval_cell_checks(X.retrieval_facts(cells, rows, broken)).collect()}
    assert checks == {("a", "retrieval_coverage"), ("a", "retrieval_rows_checked"), ("b", "retrieval_row_unreadable"),
                      ("b", "retrieval_file_empty"), ("c", "retrieval_file_missing")}
    same = X.first_divergence(X.placed(rows, X.ARM), X.placed(rows.drop("run_index"), ["cell"]), X.ARM, ["cell"], "d").first()
    assert same["d"] == 0  # a row without an id equals no row


def test_coverage_counts_ids_once_and_only_generated_ones(spark):
    outputs = spark.createDataFrame([("a", 0, 1, "x"), ("a", 0, 2, "x"), ("a", 0, 3, "y"), ("a", 1, 1, "x")], ROWS)
    judged = spark.createDataFrame([("a", 0, 1, "x"), ("a", 0, 2, "z"), ("a", 0, 3, "x")], ROWS)
    found = {r["run_index"]: (r["generated"], r["judged"]) for r in X.coverage_facts(outputs, judged).collect()}
    assert found == {0: (2, 1), 1: (1, 0)}


def test_uniform(spark):
    table = spark.createDataFrame([("a", 5), ("a", 5), ("b", 5), ("b", 6), ("c", None), ("c", 5)], "k string, v int")
    found = {r["k"]: r["u"] for r in table.groupBy("k").agg(X.uniform(F.col("v")).alias("u")).collect()}
    assert found == {"a": 5, "b": None, "c": None}


def test_presence_needs_both_arms(spark):
    arms = spark.createDataFrame(
        [("a", 0, "baseline", True), ("a", 0, "staged", None), ("a", 1, "staged", False), ("b", 0, "baseline", True), ("b", 0, "staged", True)],
        "cell string, run_index int, arm string, has_config boolean")
    assert [(r["cell"], r["run_index"], r["detail"]) for r in C.arm_presence_checks(arms).collect()] == [("a", 0, "staged")]
