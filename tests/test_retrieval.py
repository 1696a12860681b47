"""Retrieval against a numpy brute force, on both join strategies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions.embedding import hashed_words, model_embedder
from evalspark.functions.vectors import cosine
from evalspark.operators import retrieval as R


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    docs = [(s, i, rng.normal(size=8).tolist()) for s in range(4) for i in range(1 if s == 3 else 60)]
    docs += [(0, 100 + i, docs[0][2]) for i in range(5)] + [(1, 200, [0.0] * 8)]
    queries = [(s, 10 * s + j, rng.normal(size=8).tolist(), k) for s in range(4) for j, k in enumerate((0, 3, 7))]
    return docs, queries


def brute(docs, queries):
    out = set()
    for store, sample, q, k in queries:
        scored = []
        for s, i, v in docs:
            if s == store:
                a, b = np.array(v), np.array(q)
                n = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((-round(float(a @ b / n) if n else 0.0, 9), i))
        for rank, (_, i) in enumerate(sorted(scored)[: max(1, min(k, len(scored)))], start=1):
            out.add((sample, i, rank))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_nearest_documents(spark, vectors, broadcast, monkeypatch):
    docs, queries = vectors
    monkeypatch.setattr(R, "fits_broadcast", lambda df: broadcast)
    d = spark.createDataFrame(docs, "store_id int, ordinal int, vector array<double>")
    q = spark.createDataFrame(queries, "store_id int, sample_id int, query_vector array<double>, top_k int")
    got = R.nearest_documents(d, q, max_k=7, salts=4)
    assert {(r["sample_id"], r["ordinal"], r["retrieval_rank"]) for r in got.collect()} == brute(docs, queries)


def test_merge_by_date_keeps_rank_order_and_first_metadata(spark):
    rows = [("s", 1, "d2", "Conversation content on d2: a ", "dialogue", 0.9), ("s", 2, "d1", "b", "summary", 0.8), ("s", 3, "d2", "c", "summary", 0.7)]
    hits = spark.createDataFrame(rows, "sample_id string, retrieval_rank int, date string, page_content string, kind string, score double")
    got = [(r["memory_rank"], r["date"], r["content"], r["kind"], r["score"]) for r in R.merge_by_date(hits).orderBy("memory_rank").collect()]
    assert got == [(1, "d1", "b", "summary", 0.8), (2, "d2", "a\nc", "dialogue", 0.9)]


def test_hashed_words_are_unit_vectors(spark):
    frame = spark.createDataFrame([("The the\tcat",), ("",), ("the THE cat",)], "t string")
    a, empty, b = [np.array(r[0]) for r in frame.select(hashed_words(F.col("t"))).collect()]
    assert np.allclose(a, b) and np.isclose(np.linalg.norm(a), 1) and not empty.any()


def test_model_embedder_batches_and_normalises(spark):
    def factory():
        def model(texts):
            assert len(texts) <= 3
            return np.array([[len(t), 0.0] for t in texts])
        return model
    embed = model_embedder(factory, batch=3)
    frame = spark.createDataFrame([("a" * n,) for n in range(10)], "t string").coalesce(1)
    got = sorted(r[0][0] for r in frame.select(embed("t")).collect())
    assert got == [0.0] + [1.0] * 9


def test_cosine_of_ragged_rows(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 2.0, 2.0], [2.0, 4.0, 4.0]), ([0.0], [1.0])], "a array<double>, b array<double>").coalesce(1)
    assert [round(r[0], 9) for r in frame.select(cosine("a", "b")).collect()] == [1.0, 1.0, 0.0]


@pytest.mark.parametrize("pivots, block", [(1, 4096), (5, 7), (16, 50)])
def test_similar_entries(spark, pivots, block):
    from evalspark.operators.similar import similar_entries

    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(6, 5))
    rows = []
    for i in range(150):
        store = "hot" if i % 3 else "cold"
        v = centres[rng.integers(6)] + rng.normal(scale=0.3, size=5)
        rows.append((store, i, v.tolist()))
    rows += [("hot", 1000 + i, rows[1][2]) for i in range(60)]  # a crowd of copies
    rows += [("hot", 2000, [0.0] * 5), ("lone", 3000, [1.0] * 5)]
    frame = spark.createDataFrame(rows, "store_id string, ordinal int, vector array<double>")
    got = {(r["ordinal"], r["rank"], r["other"]) for r in similar_entries(frame, 0.8, 10, pivots, block).collect()}
    want = set()
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for _, i, v in rows}
    for s, i, _ in rows:
        near = [(-round(float(unit[i] @ unit[j]), 9), j) for t, j, _ in rows if t == s and j != i]
        near = sorted(x for x in near if -x[0] >= 0.8)[:10]
        want |= {(i, n, j) for n, (_, j) in enumerate(near, start=1)}
    assert got == want


@pytest.mark.parametrize("levels", [16, 1])
def test_metric_tree(spark, monkeypatch, levels):
    from evalspark.operators import metric_tree

    monkeypatch.setattr(metric_tree, "LEVELS", levels)
    rng = np.random.default_rng(3)
    vectors = np.repeat(rng.normal(size=(12, 8)), 40, axis=0) + rng.normal(scale=0.02, size=(480, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    frame = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(vectors)], "store_id string, uid int, vector array<double>")
    tree = metric_tree.grow(frame, 20, 4)
    home = {r["uid"]: (r["leaf"], r["part"]) for r in tree.rows.collect()}
    assert sorted(home) == list(range(480))
    listed = [frozenset({(p["a"], p["a_part"]), (p["b"], p["b_part"])}) for p in metric_tree.close_blocks(tree, 0.1).collect()]
    pairs = set(listed)
    assert len(pairs) == len(listed)  # each pair once
    close = np.argwhere(np.arccos(np.clip(vectors @ vectors.T, -1, 1)) <= 0.1)
    assert all(frozenset({home[i], home[j]}) in pairs for i, j in close.tolist())
    blocks = list(home.values())
    if levels > 1:  # deep enough: blocks fit, and most pairs of blocks are never formed
        assert max(map(blocks.count, set(blocks))) <= 20
        assert len(pairs) < len(set(blocks)) ** 2 / 4


def test_similar_entries_across_groups(spark, monkeypatch):
    """Groups of one block: most neighbours are found by tiles, with equal scores in many dimensions of few values."""
    from evalspark.operators import similar

    monkeypatch.setattr(similar, "GROUP", 1)
    rng = np.random.default_rng(9)
    rows = [("s", i, (rng.integers(0, 3, size=6) + 0.0).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "store_id string, ordinal int, vector array<double>")
    got = {(r["ordinal"], r["rank"], r["other"]) for r in similar.similar_entries(frame, 0.8, 4, 4, 20).collect()}
    unit = [np.array(v) / (np.linalg.norm(v) or 1) for _, _, v in rows]
    want = set()
    for i in range(300):
        near = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in range(300) if j != i)
        want |= {(i, n, j) for n, (score, j) in enumerate([x for x in near if -x[0] >= 0.8][:4], start=1)}
    assert got == want


@pytest.mark.parametrize("room", [0, 32])
def test_floors_keep_pairs_few(monkeypatch, room):
    """Where all vectors are close, a block hands on keep + 1 rows a vector, and the next block only what reaches the floor."""
    from evalspark.operators import similar

    monkeypatch.setattr(similar, "ROOM", room)
    monkeypatch.setattr(similar, "SLICE", 100)
    rng = np.random.default_rng(5)
    vectors = np.round(1 + rng.normal(scale=0.05, size=(1200, 16)), 1)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(vectors @ vectors.T, 9)
    assert scores.min() >= 0.8
    first, second = (similar._Block(np.arange(600) + at, vectors[at:at + 600], np.full(600, 0.8)) for at in (0, 600))
    first.meet(first, 3)
    assert np.bincount(first.rows).max() == 4
    rows, _, _ = similar._reaching(first.vectors, second.vectors, first.floor, 3)
    assert len(rows) < 600 * 600 / 10
    first.meet(second, 3)
    want = [(row, member) for row in range(600) for member in np.lexsort((np.arange(1200), -scores[row]))[:4].tolist()]
    assert list(zip(first.rows.tolist(), first.members.tolist())) == want
