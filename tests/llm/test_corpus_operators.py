"""Substring removal, similarity join, decontamination, personal data, pipeline: against brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest import SF, sentence
from evalspark.llm import components, decontaminate, jaccard_join, pii, substring_dedup
from evalspark.llm.queries import table


def by_row(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("split", [2, substring_dedup.SPLIT])
def test_repeated_substrings(spark, odd_docs, no_docs, split):
    docs = odd_docs.select("doc_id", "text", "spans").unionByName(table(spark, SF, "documents").select(F.col("doc_id") + 1000, "text", F.lit("x")).toDF("doc_id", "text", "spans"))
    rows = docs.collect()
    want = by_row((r.doc_id, *w) for r, w in zip(rows, brute.repeats([r.text for r in rows])))
    assert by_row(tuple(r) for r in substring_dedup.remove_repeats(docs, split=split).collect()) == want
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(30):
        strings = [bytes(rng.integers(0, 2, rng.integers(1, 60)).astype(np.uint8)) for _ in range(6)]
        strings.append(strings[0])
        data = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(s) for s in strings])
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
        order = substring_dedup.suffix_array(data, left, 64)
        suffix = [bytes(data[i:i + left[i]]) for i in range(len(data))]
        assert [suffix[i] for i in order] == sorted(suffix)
        common = substring_dedup.common_prefixes(data, left, order)
        for k in range(1, len(order)):
            a, b = suffix[order[k - 1]], suffix[order[k]]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("size", [3, 40, 500])
def test_prefixes_after_a_differing_byte(size):
    rng = np.random.default_rng(6)
    head, tail = (bytes(rng.choice(list(b"abcdefgh"), size).astype(np.uint8)) for _ in range(2))
    strings = [head + b"0" + tail, head + b"1" + tail]
    data, left = np.frombuffer(b"".join(strings), np.uint8), np.tile(np.arange(2 * size + 1, 0, -1), 2)
    order = substring_dedup.suffix_array(data, left, len(data))
    common = substring_dedup.common_prefixes(data, left, order)
    suffix = [bytes(data[i:i + left[i]]) for i in range(len(data))]
    for k in range(1, len(order)):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    repeat = substring_dedup.repeated_windows(strings, size)[0]
    assert repeat[size + 1] and repeat[3 * size + 2]


def near_copies(n=40):
    base = sentence(2, 200).split()
    rng = np.random.default_rng(5)
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.integers(0, 200, rng.integers(0, 7)):
            words[at] = f"w{rng.integers(1000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_similar_groups(spark, odd_docs, no_docs, size, percent):
    copies = [(500 + i, t) for i, t in enumerate(near_copies())]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string")).withColumn("n", F.lit("clash"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = by_row((k, *g) for (k, _), g in zip(rows, brute.groups(rows, size, percent)))
    assert by_row(tuple(r) for r in jaccard_join.similar_groups(docs, size, percent).collect()) == want
    assert jaccard_join.similar_groups(no_docs, size, percent).count() == 0
    kept = [(r.doc_id, r.text) for r in jaccard_join.one_per_group(docs, size, percent).collect()]
    # a null id has no smaller id: its row stays
    assert by_row(kept) == by_row({(k, t) for (k, t), (_, _, g) in zip(rows, [(0, *x) for x in brute.groups(rows, size, percent)]) if k is None or k == g})


def test_components_of_a_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a != 30")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(61)}
    assert components.components(edges.limit(0)).count() == 0


def test_decontamination(spark, odd_docs, no_docs):
    items = [(1, sentence(5, 40)), (1, sentence(5, 40)), (2, "Lorem"), (3, None), (4, "  "), (None, sentence(9, 12)), (10, sentence(3, 300)[300:700]), (7, "It's 12")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("clash"))
    rows = odd_docs.collect()
    want = by_row((r.doc_id, *c) for r, c in zip(rows, brute.contamination([r.text for r in rows], items)))
    assert by_row((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(odd_docs, bench).collect()) == want
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert decontaminate.decontaminate(odd_docs, bench.limit(0)).where("n_hit > 0").count() == 0


PRIVATE = ["", None, "a@b.c%d@e.f", "x@y..z a@b.c.", "1.2.3.4.5.6.7.8", "001.2.3.004 256.1.1.1", "+1 (743) 555-3824+44 20 7946 0958", "4111 1111 1111 1111",
           "4111-1111-1111-1111 5", "4111  1111 1111 1111 12", "é😀 a.b@c.de 1.1.1.1", "+12345678901234567", "12 " * 500, "a@b" + ".c" * 5000, "a" * 20000 + "@",
           "9" * 20000, "+1" * 2000 + "2345678901", "@@a@b.c@d.e", "4539578763621486 4539578763621486", "1-2.3.4.5-6 4", "card 4111111111111111"]


def test_personal_data(spark, no_docs):
    rows = [(i, t) for i, t in enumerate(PRIVATE)] + [(0, PRIVATE[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("proposals", F.lit("clash"))
    got = by_row((r.doc_id, [(s.at, s.rank, s.until) for s in r.spans if s.base]) for r in pii.find_personal_data(docs).collect())
    assert got == by_row((k, brute.personal(t)) for k, t in rows)
    assert pii.find_personal_data(no_docs).count() == 0


def test_personal_data_of_documents_and_masks(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert {k: [(s.at, s.rank, s.until) for s in v if s.base] for k, v in found.items()} == {k: brute.personal(t) for k, t in texts.items()}
    masked = {r.doc_id: r for r in pii.mask_personal_data(docs).collect()}
    for k, text in texts.items():
        want, end = "", 0
        for s in found[k]:
            if s.at >= end:
                want += text[end:s.at] + f"[{s.kind.upper()}]"
                end = s.until
        assert masked[k].text == want + text[end:] and masked[k].n_chars == len(masked[k].text)


def test_proposals_have_no_cap(spark):
    key, letters, long_name = "aB3-" * 100, "x" * 100 + "123", "A" + "b" * 40
    texts = [f"token: {key}.", f"key {letters} end", f"Dr. {long_name} {long_name} left", "met John Smith and Mary J. Jones, Dr. Paul Simon", "x" * 50000 + " " + "-" * 50000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(pii.KINDS[p["rank"]], texts[r.doc_id][p["at"]:p["until"]]) for p in r.proposals] for r in pii.proposals(docs).collect()}
    assert got == {0: [("secret", key)], 1: [("secret", letters)], 2: [("name", f"Dr. {long_name} {long_name}")],
                   3: [("name", "John Smith"), ("name", "Mary J. Jones"), ("name", "Dr. Paul Simon")], 4: []}


OVERLAPS = [("+1 555 123 4567john@x.com", [(0, 15, "phone"), (11, 25, "email")], "[PHONE]"),
            ("Hi Dr. Jane.Doe@x.com!", [(3, 11, "name"), (7, 21, "email")], "Hi [EMAIL]!"),
            ("1.2.3.41111111111111111 x a@b.c", [(0, 7, "ip"), (6, 23, "card"), (26, 31, "email")], "[CARD] x [EMAIL]"),
            ("ab", [(0, 1, "ip"), (1, 2, "ssn")], "[IP][SSN]"), ("abcdef", [(0, 2, "ip"), (1, 5, "card"), (4, 6, "ssn")], "[CARD]"), ("abc", [], "abc")]


def test_overlapping_spans_are_masked_whole(spark):
    df = spark.createDataFrame([(t, s) for t, s, _ in OVERLAPS], "text string, spans array<struct<at:int,until:int,kind:string>>")
    assert [r[0] for r in df.select(pii.masked(F.col("text"), F.col("spans"))).collect()] == [w for _, _, w in OVERLAPS]
    docs = spark.createDataFrame([(1, OVERLAPS[0][0])], "doc_id long, text string")
    assert pii.mask_personal_data(docs).collect()[0].text == "[PHONE]"


def test_personal_data_query(spark):
    from evalspark.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op4_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute.personal(texts[r.doc_id])
        kinds = list(brute.PATTERNS)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == i for s in spans) for i in range(4))
        names = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
        assert r.base_sha256 == brute.sha(",".join(names)) and set(names) <= set(r.spans.split(","))  | ({""} if not names else set())


def test_label_model_finds_the_reliable_labeler():
    counts = [("ip", (1, 1, 1, 1), 300), ("ip", (1, -1, 0, 1), 40), ("ip", (-1, -1, -1, 1), 200), ("ip", (-1, 1, -1, 1), 90)]
    posterior, likelihood = pii.label_model(counts)
    assert posterior["ip", (1, 1, 1, 1)] > 0.95 and posterior["ip", (-1, 1, -1, 1)] < 0.1
    assert likelihood[0, 1][0] / likelihood[0, 1][1] > likelihood[1, 1][0] / likelihood[1, 1][1]


def test_few_proposals_are_enough_to_train(spark):
    kind = "proposals array<struct<shape:string,v_format:int,v_gazetteer:int,v_context:int,v_border:int,size:int>>"
    sure = ("secret", 1, 1, 1, 1, 4)
    few = pii.train(spark.createDataFrame([([sure],)], kind))
    many = pii.train(spark.createDataFrame([([sure] * 40,)], kind))
    margins = [m.weights["", ""] + sum(m.weights[f, v] for f, v in zip(pii.FEATURES, sure)) for m in (few, many)]
    assert margins[1] >= margins[0] >= np.log(pii.SURE / (1 - pii.SURE))
    assert pii.train(spark.createDataFrame([], kind)).weights == {("", ""): 0.0}


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from evalspark.session import cut_lineage

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    quality, near, clean, private, encode = (f for _, f in cp.STAGES)
    sf = "/root/testdata/sf0.01"
    kept = cut_lineage(quality(spark, docs, sf))
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = [k for k, q in labels.items() if q == 1]
    assert sum(k in ids for k in good) >= 0.98 * len(good) and sum(k in ids for k, q in labels.items() if q == 0) <= 0.1 * (len(labels) - len(good))
    some = cut_lineage(kept.limit(250))
    rows = [(r.doc_id, r.text) for r in some.collect()]
    single = cut_lineage(near(spark, some, sf))
    assert {r.doc_id for r in single.collect()} == {g for _, g in brute.groups(rows, 5, 80)}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    rows = [(r.doc_id, r.text) for r in single.collect()]
    cleaned = cut_lineage(clean(spark, single, sf))
    assert {r.doc_id for r in cleaned.collect()} == {k for (k, _), c in zip(rows, brute.contamination([t for _, t in rows], items)) if not c[1]}
    masked = cut_lineage(private(spark, cleaned, sf))
    assert masked.columns == docs.columns and not any(brute.personal(r.text) for r in masked.collect())
    coded = {r.doc_id: r.decoded_sha256 for r in encode(spark, masked, sf).collect()}
    assert coded == {r.doc_id: brute.sha(r.text) for r in masked.collect()}


@pytest.mark.parametrize("size", [0, 1, pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, 3 * pii.BLOCK, 1000])
def test_running_folds(spark, size):
    values = [(i * 7919) % 1009 for i in range(size)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    sums, tops = df.select(pii.running(F.col("v"), lambda a, x: a + x), pii.running(F.col("v"), lambda a, x: F.greatest(a, x))).first()
    assert sums == [sum(values[:i + 1]) for i in range(size)]
    assert tops == [max(values[:i + 1]) for i in range(size)]


def test_masks_of_many_overlapping_spans(spark):
    rng = np.random.default_rng(6)
    kind = "text string, spans array<struct<at:int,rank:int,until:int,kind:string,base:boolean>>"
    rows, want = [], []
    for n in (1, 40, 700, 1500):
        text = "".join(rng.choice(list("ab é"), 4000))
        spans = sorted({(int(a), int(r), int(a + w)) for a, r, w in zip(rng.integers(0, 3900, n), rng.integers(0, 7, n), rng.integers(1, 9, n))})
        rows.append((text, [(a, r, u, pii.KINDS[r], False) for a, r, u in spans]))
        unions = []
        for a, r, u in spans:
            if unions and a < unions[-1][1]:
                unions[-1][1] = max(unions[-1][1], u)
                unions[-1][2].append((a, r, u))
            else:
                unions.append([a, u, [(a, r, u)]])
        out, end = "", 0
        for a, u, parts in unions:
            longest = max(parts, key=lambda p: p[2] - p[0])
            out, end = out + text[end:a] + f"[{pii.KINDS[longest[1]].upper()}]", u
        want.append(out + text[end:])
    df = spark.createDataFrame(rows, kind)
    assert [r[0] for r in df.select(pii.masked(F.col("text"), F.col("spans"))).collect()] == want


def test_a_text_full_of_addresses_is_masked_in_linear_time(spark):
    n = 60_000
    docs = spark.createDataFrame([(1, " ".join(f"u{i}@mail.org" for i in range(n)))], "doc_id bigint, text string")
    start = time.time()
    masked = pii.mask_personal_data(docs).first().text
    assert masked == " ".join(["[EMAIL]"] * n)
    assert time.time() - start < 60
