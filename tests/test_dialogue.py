"""Window and array forms against independent formulations on random dialogues."""

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from evalspark.functions.text import WHITE_SPACE, collapse_whitespace, first_difference, strip, truncate
from evalspark.operators import dialogue as D, ordered as O

ROLES = ["user", "assistant", "system"]


def pair_tokens(messages):
    """Kept turns and the pattern matches over their role letters: ``ua``, a lone ``a``, a lone ``u``."""
    kept = [(i, role, text.strip()) for i, (role, text) in enumerate(messages) if text.strip()]
    letters = "".join("a" if role == "assistant" else "u" for _, role, _ in kept)
    return kept, list(re.finditer("ua|a|u", letters))


def expected_pairs(messages):
    kept, tokens = pair_tokens(messages)
    return [("" if t.group() == "a" else kept[t.start()][2], kept[t.end() - 1][2] if "a" in t.group() else "") for t in tokens]


def expected_indices(messages):
    kept, tokens = pair_tokens(messages)
    after = [k[0] for k in kept] + [len(messages)]
    return [after[t.end() - 1] if "a" in t.group() else after[t.end()] for t in tokens]


def expected_parse(text):
    groups = [("user", [])]
    for piece in (x.strip() for x in text.strip().split("\n") if x):
        head, colon, rest = piece.partition(":")
        if colon and head.strip().lower() in ROLES:
            groups.append((head.strip().lower(), [rest.strip()]))
        elif piece:
            groups[-1][1].append(piece)
        else:
            groups.append(("user", []))
    found = [(role, "\n".join(lines).strip()) for role, lines in groups]
    found = [m for m in found if m[1]]
    return found or [("user", t) for t in [text.strip()] if t]


@pytest.fixture(scope="module")
def dialogues():
    rng = random.Random(7)
    return [[(rng.choice(ROLES), rng.choice(["", " \n", "a", " b ", "c\nd"])) for _ in range(rng.randint(0, 30))] for _ in range(150)]


@pytest.mark.parametrize("chunk", [1, 3, 65536])
def test_pairs_and_batches(spark, dialogues, chunk):
    rows = [(i, t, role, text) for i, d in enumerate(dialogues) for t, (role, text) in enumerate(d)]
    table = spark.createDataFrame(rows, "sample_id int, turn int, role string, content string")
    got = {}
    for r in D.turn_batches(table, chunk).orderBy("sample_id", "turn").collect():
        got.setdefault(r["sample_id"], []).append((r["query"], r["response"], r["batch_index"]))
    for i, dialogue in enumerate(dialogues):
        assert [x[:2] for x in got.get(i, [])] == expected_pairs(dialogue)
        assert [x[2] for x in got.get(i, [])] == expected_indices(dialogue)


def test_nested_pairs_equal_exploded_pairs(spark, dialogues):
    rows = [(i, [{"role": r, "content": t} for r, t in d]) for i, d in enumerate(dialogues)]
    table = spark.createDataFrame(rows, "i int, m array<struct<role:string,content:string>>")
    for r in table.select("i", D.pair_messages(F.col("m")).alias("p")).collect():
        assert [tuple(x) for x in r["p"]] == expected_pairs(dialogues[r["i"]])


def test_parser_equals_line_groups(spark):
    rng = random.Random(3)
    pieces = ["User:", "assistant :", "SYSTEM:  ", "hello", "\n", "\n\n", "\n  \n", " ", "user: x", "\r\n", "mid user: y", "　"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in table.select("i", D.parse_dialogue(F.col("t")).alias("m")).collect():
        assert [(m["role"], m["content"]) for m in r["m"]] == expected_parse(texts[r["i"]]), repr(texts[r["i"]])


def test_round_trip_loss_equals_whole_sample_parse(spark, dialogues):
    clean = [[(r, t.strip()) for r, t in d if t.strip()] for d in dialogues]
    lossy = 0
    for messages in clean:
        text = "\n\n".join(("User" if r == "user" else "Assistant") + ": " + t for r, t in messages)
        lossy += bool(messages) and expected_parse(text) != messages
    rows = [("t", i, r, t) for i, d in enumerate(clean) for r, t in d]
    table = spark.createDataFrame(rows, "task string, sample_id int, role string, content string")
    row = D.round_trip_loss(table, ["task"]).first()
    assert (row["samples"], row["mangled"]) == (sum(bool(d) for d in clean), lossy)


def test_running_sum_and_position_over_chunks(spark):
    rng = random.Random(5)
    rows = [(k, o, rng.randint(-5, 5)) for k in range(3) for o in rng.sample(range(500), 200)]
    table = spark.createDataFrame(rows, "k int, o int, v int")
    out = O.with_running_sum(table, ["k"], ["o"], O.int_chunk(F.col("o"), 7), F.col("v"), "s")
    out = O.with_position(out, ["k"], ["o"], O.int_chunk(F.col("o"), 11), "p")
    seen = {(r["k"], r["o"]): (r["s"], r["p"]) for r in out.collect()}
    for k in range(3):
        total = 0
        for p, (_, o, v) in enumerate(sorted(r for r in rows if r[0] == k), start=1):
            total += v
            assert seen[(k, o)] == (total, p)


def _nearest(ordered, p):
    return ordered[max(0, math.ceil(len(ordered) * p) - 1)]


WANTED = {"m": ("cont", 0.5), "p95": ("disc", 0.95), "p99": ("disc", 0.99), "lo": ("disc", 0.001)}


def test_exact_quantiles(spark):
    rng = random.Random(9)
    groups = {str(size): [round(rng.choice([rng.gauss(0, 1), 0.0, 5.0, rng.expovariate(0.1)]), 2) for _ in range(size)]
              for size in (1, 2, 7, 400, 5000)}
    groups[None] = [float(v) for v in range(-50, 51)]
    table = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None)], "k string, v double")
    found = {r["k"]: r for r in O.exact_quantiles(table, ["k"], "v", WANTED).collect()}
    assert set(found) == set(groups)
    for k, vs in groups.items():
        ordered = sorted(vs)
        assert found[k]["m"] == pytest.approx(statistics.median(ordered))
        for name, p in (("p95", 0.95), ("p99", 0.99), ("lo", 0.001)):
            assert found[k][name] == _nearest(ordered, p)


def test_exact_quantiles_resolve_every_double(spark):
    """Neighbouring doubles, all magnitudes, both signs, infinities, NaN, and one value in most rows."""
    rng = random.Random(4)
    near = [1.9999]
    for _ in range(2000):
        near.append(math.nextafter(near[-1], 3.0))
    wide = [rng.choice([-1, 1]) * math.ldexp(rng.random(), rng.randint(-1070, 1020)) for _ in range(2000)]
    ends = [float("-inf"), -1.0, -0.0, 0.0, 5e-324, 1.7e308, float("inf")]
    hot = [3.25] * 3000 + [2.0, 4.0]
    groups = {"near": near, "wide": wide, "ends": ends, "hot": hot}
    table = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    wanted = {f"p{i}": ("disc", i / 40) for i in range(0, 41, 5)}
    found = {r["k"]: r for r in O.exact_quantiles(table, ["k"], "v", wanted).collect()}
    for k, vs in groups.items():
        for i in range(0, 41, 5):
            assert found[k][f"p{i}"] == _nearest(sorted(vs), i / 40), (k, i)
    whole = O.exact_quantiles(spark.createDataFrame([(v,) for v in near + [float("nan")]], "v double"), [], "v",
                              {"top": ("disc", 1.0), "mid": ("disc", 0.5)}).first()
    assert math.isnan(whole["top"]) and whole["mid"] == _nearest(near + [9.0], 0.5)
    empty = table.where("false")
    assert O.exact_quantiles(empty, ["k"], "v", wanted).count() == 0


def test_text_functions_follow_python(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(WHITE_SPACE + "abX.") for _ in range(rng.randint(0, 20))) for _ in range(1000)]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in table.select("i", strip(F.col("t")).alias("s"), collapse_whitespace(F.col("t")).alias("c"), truncate(F.col("t"), 8).alias("u")).collect():
        text = texts[r["i"]]
        flat = re.sub(r"\s+", " ", text).strip()
        assert r["s"] == text.strip()
        assert r["c"] == flat
        assert r["u"] == (flat if len(flat) <= 8 else flat[:5].rstrip() + "...")


def test_first_difference(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))) for _ in range(500)]
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for r in table.select("i", first_difference(F.col("a"), F.col("b")).alias("d")).collect():
        a, b = pairs[r["i"]]
        want = None if a == b else next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert r["d"] == want
