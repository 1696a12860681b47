"""Facts of cells and arms, reduced from the tables of an experiment.

The checks of ``checks.py`` judge facts; here they are derived. Every reduction combines map-side or runs
per (cell, chunk) of lines, so a cell with most of the rows is spread over many tasks.

Lists of rows carry ``cell``, ``line`` (bigint, ascending in the file, gaps allowed) and ``sample_id``; outputs and
judgements also ``run_index``. A row without an id counts as a row, equals no id and is no duplicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.operators.ordered import CHUNK, int_chunk, with_neighbours, with_position

ARM = ["cell", "run_index"]


def placed(rows: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """Rows with their 0-based ``position`` in the list of ``keys``; lines must be unique in it."""
    return with_position(rows, keys, ["line"], int_chunk(F.col("line"), chunk)).withColumn("position", F.col("position") - 1)


def first_unsorted(rows: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """``out_of_order`` per list: the id that sorting would put where the order first breaks; NULL if sorted.

    Up to the break both orders agree, so that id is the least one behind it. Ascending runs begin with
    their least id, and all runs but the first begin behind a descent: it is the least id after a descent.
    """
    walked = with_neighbours(rows.where(F.col("sample_id").isNotNull()), keys, ["line"],
                             int_chunk(F.col("line"), chunk), ["sample_id"])
    after = F.col("next.sample_id")
    return walked.groupBy(*keys).agg(F.min(F.when(after < F.col("sample_id"), after)).alias("out_of_order"))


def repeated_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``duplicates`` per list: ids that stand in it more than once."""
    ids = rows.where(F.col("sample_id").isNotNull()).groupBy(*keys, "sample_id").agg(F.count(F.lit(1)).alias("_n"))
    return ids.groupBy(*keys).agg(F.count_if(F.col("_n") > 1).alias("duplicates"))


def first_divergence(rows: DataFrame, of: DataFrame, keys: list[str], shared: list[str], name: str) -> DataFrame:
    """Per list of ``rows``, the first position where it stops being a prefix of ``of``'s list; NULL if it is one.

    Both frames are ``placed``; ``shared`` are the keys of ``of``. Rows behind its end differ.
    """
    other = of.select(*[F.col(c).alias(f"_o_{c}") for c in [*shared, "position"]], F.col("sample_id").alias("_id"))
    same = F.lit(True)
    for c in [*shared, "position"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    equal = F.coalesce(F.col("sample_id") == F.col("_id"), F.lit(False))
    return rows.join(other, same, "left").groupBy(*keys).agg(F.min(F.when(~equal, F.col("position"))).alias(name))


def _beside(cells: DataFrame, facts: DataFrame, keys: list[str], counts: list[str] = []) -> DataFrame:
    """Facts beside their cells; ``counts`` of a cell without rows are 0."""
    return cells.join(facts, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def retrieval_facts(cells: DataFrame, rows: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Facts for ``retrieval_cell_checks``.

    ``cells(cell, file_present, expected_count)`` lists what was planned, ``rows`` the readable lines, and
    ``unreadable(cell, line)`` the others. Cells that nobody planned are left out.
    """
    n = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("row_count"))
    broken = unreadable.groupBy("cell").agg(F.count(F.lit(1)).alias("unreadable"))
    facts = _beside(_beside(cells, n, ["cell"], ["row_count"]), broken, ["cell"], ["unreadable"])
    facts = _beside(facts, repeated_ids(rows, ["cell"]), ["cell"], ["duplicates"])
    return _beside(facts, first_unsorted(rows, ["cell"]), ["cell"])


def uniform(value: Column) -> Column:
    """The value that all rows of a group have, NULL if they differ or one lacks it."""
    whole = F.count(value) == F.count(F.lit(1))
    return F.when(whole & (F.min(value) == F.max(value)), F.min(value))


def arm_facts(arms: DataFrame, retrieval: DataFrame, outputs: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Facts for ``alignment_cell_checks``.

    ``arms`` holds one row per started arm: ``cell, run_index, dataset, has_config, config_unreadable`` and
    the config's and the retrieval file's digest and path under that check's names. ``retrieval`` rows carry ``top_k``;
    ``unreadable(cell, run_index, kind)`` lists broken lines, ``kind`` 'outputs' or 'judge'.
    """
    frozen = retrieval.groupBy("cell").agg(F.count(F.lit(1)).alias("retrieval_rows"), uniform(F.col("top_k")).alias("row_top_k"))
    made = outputs.groupBy(*ARM).agg(F.count(F.lit(1)).alias("outputs"))
    broken = unreadable.groupBy(*ARM).agg(
        F.count_if(F.col("kind") == "outputs").alias("unreadable_outputs"), F.count_if(F.col("kind") == "judge").alias("unreadable_judge"))
    facts = _beside(_beside(arms, frozen, ["cell"], ["retrieval_rows"]), made, ARM, ["outputs"])
    facts = _beside(facts, broken, ARM, ["unreadable_outputs", "unreadable_judge"])
    facts = _beside(facts, repeated_ids(outputs, ARM), ARM, ["duplicates"])
    lists = first_divergence(placed(outputs, ARM), placed(retrieval, ["cell"]), ARM, ["cell"], "first_divergence")
    return _beside(facts, lists, ARM)


def native_facts(cells: DataFrame, retrieval: DataFrame, outputs: DataFrame, judged: DataFrame) -> DataFrame:
    """Facts for ``native_cell_checks``: rows of the three lists of each ``cell`` and where their orders part."""
    facts, key = cells, ["cell"]
    for rows, name in ((retrieval, "retrieval_rows"), (outputs, "output_rows"), (judged, "judge_rows")):
        facts = _beside(facts, rows.groupBy(*key).agg(F.count(F.lit(1)).alias(name)), key, [name])
    lists = placed(outputs, key)
    facts = _beside(facts, first_divergence(lists, placed(retrieval, key), key, key, "output_divergence"), key)
    return _beside(facts, first_divergence(placed(judged, key), lists, key, key, "judge_divergence"), key)


def coverage_facts(outputs: DataFrame, judged: DataFrame) -> DataFrame:
    """Facts for ``judge_coverage_checks``: distinct generated ids per arm, and those among them that were judged."""
    keys = [*ARM, "sample_id"]
    done = judged.select(*keys).distinct().withColumn("_judged", F.lit(True))
    return outputs.select(*keys).distinct().join(done, keys, "left").groupBy(*ARM).agg(
        F.count(F.lit(1)).alias("generated"), F.count("_judged").alias("judged"))
