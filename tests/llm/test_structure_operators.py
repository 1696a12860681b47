"""Periodic runs, the prefix trie and the cuckoo-filter index, against plain versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from brute import WORD, sha
from conftest import SF, odd_texts, sentence
from evalspark.llm import cuckoo_dedup, periodic_runs, prefix_trie
from evalspark.llm.queries import ORACLES, QUERIES, table


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_prefix_trie", "op13_exact_dedup"])
def test_queries_equal_their_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), name, QUERIES[name], ORACLES[name], SF) is None


# periodic runs

def plain_runs(w, least):
    """Runs by trying every period at every place."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q - s), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic_words(rng):
    n, kinds = rng.randrange(60), rng.choice([1, 2, 3, 6])
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if n > 6 and rng.random() < 0.5:
        p, a = rng.randrange(1, n // 3 + 1), rng.randrange(n)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_words(least):
    rng = random.Random(least)
    for _ in range(700):
        w = periodic_words(rng)
        assert [tuple(r) for r in periodic_runs.runs_of(w, least).tolist()] == plain_runs(w, least)


def test_common_extensions_of_all_places():
    rng = random.Random(7)
    for _ in range(40):
        w = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))]
        extend = periodic_runs.Extensions(periodic_runs.SuffixTree(w, 3))
        x, y = (np.array(v) for v in zip(*[(i, j) for j in range(len(w) + 1) for i in range(j)]))
        for i, j, n in zip(x.tolist(), y.tolist(), extend(x, y).tolist()):
            want = 0
            while j + want < len(w) and w[i + want] == w[j + want]:
                want += 1
            assert n == want


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_documents(spark, odd_docs, no_docs):
    rng = random.Random(3)
    texts = [" ".join(periodic_words(rng)) for _ in range(120)]
    texts += [(sentence(4, 40) + " \n") * 3 + sentence(5, 30) + " " + sentence(4, 40), sentence(6, 900) + " é" * 30, " ".join(["a"] * 3000)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", F.lit(1).alias("runs"), F.lit(2).alias("start")).unionByName(more, allowMissingColumns=True)
    want = []
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        runs = plain_runs(w, 12)
        want.append((r.doc_id, len(w), runs, plain_collapse(w, runs)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(runs for _, _, runs, _ in want)
    assert periodic_runs.find_runs(no_docs).count() == 0


def test_longest_run_and_digests(spark):
    text = "x y " * 8 + "z " + "p q r " * 6 + "- " + "k " * 16
    w = text.split()
    runs = plain_runs(w, 12)
    row = periodic_runs.run_digests(periodic_runs.find_runs(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))).orderBy("doc_id").collect()
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    assert (row[0].n_runs, row[0].start, row[0].length, row[0].period, row[0].exponent_milli) == (len(runs), s, n, q, 1000 * n // q)
    assert row[0].runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
    assert row[0].collapsed_sha256 == sha(plain_collapse(w, runs))
    assert tuple(row[1]) == (2, 0, None, None, None, None, sha(""), sha(""))


def test_periodic_tails(spark):
    docs = spark.createDataFrame([(i, sentence(i, i % 23)) for i in range(300)] + [(None, "a b")], "doc_id long, text string")
    for r in periodic_runs.with_periodic_tails(docs).collect():
        w = WORD.findall(sentence(r.doc_id, r.doc_id % 23) if r.doc_id is not None else "a b")
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert WORD.findall(r.text) == w


def test_words_in_runs_are_never_cut_away():
    rng = random.Random(9)
    for _ in range(300):
        w = periodic_words(rng) + [f"u{i}" for i in range(5)] + periodic_words(rng)
        hashes = np.array([zlib.crc32(x.encode()) for x in w], np.uint64)
        found = periodic_runs.candidate_stretches(hashes, np.zeros(len(w), np.int64))
        for s, n, _ in plain_runs(w, 12):
            assert any(a <= s and s + n <= b for a, b in found)


# prefix trie

def plain_trie(sequences):
    """Nodes by walking every prefix of every conversation."""
    members = collections.defaultdict(list)
    for conv_id, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv_id)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    sha(",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(p)))) for p, m in members.items()), key=repr)


def random_conversations(rng, n):
    rows = []
    for c in rng.sample(range(0, 400), n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(["hi", "hi", "hi", "a longer text", "", None, "é"])))
    return rows


@pytest.mark.parametrize("part_rows", [1, 3, 7, 1000])
def test_trie_of_random_conversations(spark, part_rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SMALL_PART_ROWS", part_rows)
    rng = random.Random(part_rows)
    rows = random_conversations(rng, 60) + [(1000 + i, t, "user", "same") for i in range(25) for t in range(3)]
    rows += [(None, 1, "user", "of no conversation"), (2000, None, "user", "first"), (2000, 0, "user", "next"), (2000, 0, "user", "next"), (-7, 0, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")).withColumn("part", F.lit(1))
    sequences = collections.defaultdict(list)
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        sequences[c].append((role or "", text or ""))
    # random turns of one conversation have numbers of their own, except the equal rows of 2000
    got = prefix_trie.prefix_trie(prefix_trie.sequences(frame), part_rows=part_rows).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_trie(sequences)
    own = {c: list(t) for c, t in sequences.items()}
    rebuilt = {}
    for c, turns in own.items():
        base, h = int(c - np.fmod(c, 100)), zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    got = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.sequences(frame)), part_rows=part_rows).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_trie(rebuilt)


def test_trie_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.sequences(empty)).count() == 0
    nothing = spark.createDataFrame([(3, []), (5, [])], "conv_id long, turns array<struct<key:binary,chars:bigint>>")
    assert [tuple(r) for r in prefix_trie.prefix_trie(nothing).collect()] == [(3, 0, None, 2, 0, 1, 0, sha("3,5"))]
    long = spark.createDataFrame([(c, t, "user", f"turn {t}") for c in (1, 2) for t in range(3000)], "conv_id long, turn long, role string, text string")
    rows = prefix_trie.prefix_trie(prefix_trie.sequences(long), part_rows=1).collect()
    assert len(rows) == 3001 and max(r.depth for r in rows) == 3000
    root = next(r for r in rows if r.depth == 0)
    assert root.saved_tokens == sum(len(f"turn {t}") for t in range(3000)) and root.n_leaves == 1 and root.n_convs == 2


def test_extents_by_range_minima():
    rng = np.random.default_rng(1)
    for _ in range(50):
        values = rng.integers(0, 4, rng.integers(1, 40))
        tables = prefix_trie.RangeMinimum(values)
        place, least = np.arange(len(values)), rng.integers(0, 4, len(values))
        for p, k, r, l in zip(place, least, tables.right_extent(place, least), tables.left_extent(place, least)):
            want_r = p
            while want_r + 1 < len(values) and values[want_r + 1] >= k:
                want_r += 1
            want_l = p
            while want_l > 0 and values[want_l] >= k:
                want_l -= 1
            assert (r, l) == (want_r, want_l)


# exact duplicates

def plain_groups(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate({c: None for c in [0x20, *range(9, 14)]})].append(r)
    out = []
    for body, members in groups.items():
        members.sort(key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], members[0][0], len(members), i == 0, sha(body)) for i, r in enumerate(members)]
    return sorted(out, key=repr)


def spaced_copies():
    base = sentence(3, 50)
    return [(900 + i, base.replace(" ", " " * (1 + i % 3), i) + "\n" * (i % 5)) for i in range(30)]


def test_exact_groups(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", F.lit("x").alias("key"), F.lit(0).alias("n")).unionByName(
        spark.createDataFrame(spaced_copies(), "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in cuckoo_dedup.exact_groups(docs).collect()), key=repr) == plain_groups(rows)
    assert cuckoo_dedup.exact_groups(no_docs).count() == 0


def test_exact_groups_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(cuckoo_dedup, "HEAVY", 10)
    monkeypatch.setattr(cuckoo_dedup, "FOLDED", 7)
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i % 40}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in cuckoo_dedup.exact_groups(docs).collect()), key=repr) == plain_groups(rows)


def test_cuckoo_index_follows_a_dictionary():
    rng = random.Random(5)
    index, model = cuckoo_dedup.CuckooIndex(1), {}
    for step in range(20000):
        key = hashlib.sha256(str(rng.randrange(3000)).encode()).digest()
        if key in model and rng.random() < 0.4:
            assert index.delete(key)
            del model[key]
        elif key in model:
            index.replace(key, step)
            model[key] = step
        else:
            assert index.get(key) is None and not index.delete(key)
            index.insert(key, step)
            model[key] = step
        assert index.size == len(model)
    assert dict(index.items()) == model and all(index.may_hold(k) for k in model)
    assert index.buckets * cuckoo_dedup.SLOTS < 8 * 3000
    strange = [hashlib.sha256(f"other {i}".encode()).digest() for i in range(5000)]
    assert sum(index.may_hold(k) for k in strange) < 50 and all(index.get(k) is None for k in strange)


def test_equal_fingerprints_are_told_apart_by_content():
    index = cuckoo_dedup.CuckooIndex(64)
    keys = [bytes([i]) + b"\0" * 7 + b"\x01\x02" + b"\0" * 30 for i in range(6)]
    for i, key in enumerate(keys):
        assert index.may_hold(key) == (i > 0) and index.get(key) is None
        index.insert(key, i)
    assert [index.get(k) for k in keys] == list(range(6))
    index.delete(keys[2])
    assert index.get(keys[2]) is None and index.get(keys[3]) == 3


def test_live_index(spark, tmp_path):
    schema = "doc_id long, text string"
    start = [(i, f"text {i % 12}" + " " * (i % 4)) for i in range(60)] + [(None, "text 3"), (7, None)]
    later = [(100 + i, f"text {i % 20}  \t") for i in range(40)]
    index = cuckoo_dedup.LiveIndex.create(spark.createDataFrame(start, schema), str(tmp_path / "index"))
    live = list(start)
    assert sorted((tuple(r) for r in index.groups().collect()), key=repr) == plain_groups(live)
    index = index.insert(spark.createDataFrame(later, schema))
    live += later
    assert sorted((tuple(r) for r in index.groups().collect()), key=repr) == plain_groups(live)
    # the best ones of several groups, and all of one group
    gone = {r[1] for r in plain_groups(live) if r[2] > 1 and r[0] is not None and r[0] % 2} | {r[0] for r in live if (r[1] or "").strip() == "text 5"}
    index = index.delete(spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    live = [r for r in live if r[0] not in gone]
    assert sorted((tuple(r) for r in cuckoo_dedup.LiveIndex.open(spark, str(tmp_path / "index")).groups().collect()), key=repr) == plain_groups(live)
    assert {hashlib.sha256((t or "").replace(" ", "").replace("\t", "").encode()).digest() for _, t in live} == {bytes(r.key)[:32] for r in index.entries().collect()}
    assert index.version == 3
