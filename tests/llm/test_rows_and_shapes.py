"""Cases that once went wrong: long texts under filters, clashing names, repeated and null ids, page tags, Unicode tables."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline as cp
from conftest import SF, sentence
from evalspark.llm import bpe, decontaminate, jaccard_join, main_text, pii, quality_model, quality_rules, substring_dedup
from evalspark.llm.queries import QUERIES, table, vocabulary

BYTE = vocabulary("byte_bpe_50k.json")


def test_a_filtered_ledger_stays_linear(spark):
    text = " ".join(f"w{i % 5000} x{i * i % 977}" for i in range(80_000))
    assert len(text) > 1_000_000 * 0.7
    docs = spark.createDataFrame([(1, text + " tail " * 60_000), (2, "short")], "doc_id long, text string")
    start = time.time()
    ledger = quality_rules.rule_ledger(docs)
    assert quality_rules.apply_policy(ledger, 1).where("kept").count() == 0
    assert ledger.where("n_dup_lines = 0 AND n_repeat_words > 100").count() == 1
    assert time.time() - start < 60


@pytest.mark.parametrize("tag", sorted(main_text.ENDS))
def test_names_stay_off_behind_any_tag(tag):
    page = f"<html><body><{tag}>a</{tag}><div class='comments'><p>{'A sentence, of some length. ' * 12}</p></div></body></html>"
    found = main_text.parse(page, names=False)
    stack, cut = [found], []
    while stack:
        node = stack.pop()
        cut += [node] if node.named or node.cut else []
        stack += [c for c in node.children if isinstance(c, main_text.Node)]
    assert not cut


def test_a_page_whose_article_has_a_cut_name():
    article = "A sentence, of some length, that goes on. " * 12
    found = main_text.main_text(f"<ul><li>x</ul><div class='comments'><p>{article}</p></div>")
    assert article.strip() in found.split("\n")


def test_quoted_attributes_of_any_length():
    article = "A sentence, of some length, that goes on. " * 12
    for size in (100, 70_000, 300_000):
        page = f"<div data-props='{'a > b, ' * (size // 7)}'><p>{article}</p></div>"
        assert main_text.main_text(page) == article.strip()
    broken = f"<div title=\"never closed><p>{article}</p></div>"
    assert main_text.main_text(broken) == article.strip()
    many = "<p a='>' b='>' c=\">\">" * 5000 + article + "</p>"
    start = time.time()
    assert article.strip() in main_text.main_text(many)
    assert time.time() - start < 20


def test_scores_beside_clashing_names(spark):
    machine = quality_model.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    docs = spark.createDataFrame([(1, sentence(2, 50), "mine", 7), (None, None, "too", 8)], "doc_id long, text string, _text string, _declared int")
    got = quality_model.score(docs.withColumn("score", F.lit("kept")), machine, ["doc_id", "_text", "_declared", "score"], "quality")
    assert got.columns == ["doc_id", "_text", "_declared", "score", "quality"]
    assert {(r.doc_id, r._text, r._declared, r.score) for r in got.collect()} == {(1, "mine", 7, "kept"), (None, "too", 8, "kept")}
    assert [r[0] for r in docs.orderBy(F.col("doc_id").desc_nulls_last()).select(quality_model.held_out(F.col("doc_id"))).collect()][1] is False


CLASHES = "doc_id long, text string, score string, proposals int, _text int, _text_digest int, _id string, ids int"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, 3, "i", 4) for r in rows], CLASHES)


def test_stages_decide_by_row_and_keep_other_columns(spark):
    base, other = sentence(2, 200), sentence(5, 120)
    near = base.replace(base.split()[100], "changed", 1)
    item = table(spark, SF, "benchmark").where("text IS NOT NULL").first().text
    rows = [(1, base), (7, base), (7, other), (None, near), (None, sentence(8, 90)), (2, ""), (2, ""), (2, None), (9, other), (9, other),
            (5, f"{sentence(1, 30)} {item} {sentence(4, 30)}"), (5, sentence(6, 70)), (None, f"x {item}")]
    docs = clashing(spark, rows)
    single = cp.near_duplicate_stage(spark, docs, SF)
    assert single.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in single.collect()), key=repr)
    assert got == sorted([r for i, r in enumerate(rows) if i not in (1, 3, 8, 9)], key=repr)
    # without the repeated rows the others are treated alike
    fewer = [r for r in rows if r != (9, other)]
    got = [(r.doc_id, r.text) for r in cp.near_duplicate_stage(spark, clashing(spark, fewer), SF).collect()]
    assert got.count((2, "")) == 2 and len(got) == len(fewer) - 2
    clean = cp.decontamination_stage(spark, docs, SF)
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted([r for r in rows if not (r[1] and item in r[1])], key=repr)
    for stage in (cp.quality_stage, cp.personal_data_stage):
        assert stage(spark, docs, SF).columns == docs.columns
    assert cp.personal_data_stage(spark, docs, SF).where("proposals = 1 AND ids = 4").count() == len(rows)
    assert cp.near_duplicate_stage(spark, docs.limit(0), SF).count() == 0


def test_equal_rows_of_a_kept_id_leave_one(spark):
    text = sentence(3, 60)
    docs = clashing(spark, [(4, text), (4, text), (6, text), (None, text)])
    assert [(r.doc_id, r.text) for r in jaccard_join.one_per_group(docs).collect()] == [(4, text)]
    docs = clashing(spark, [(None, text), (None, text)])
    assert [(r.doc_id, r.text) for r in jaccard_join.one_per_group(docs).collect()] == [(None, text)]


def test_the_pipeline_returns_texts_and_ids(spark):
    rows = cp.run(spark, SF).collect()
    own = bpe.load(BYTE)
    for r in rows[:50]:
        ids = [int(i) for i in r.ids.split(",") if i]
        assert own.decode(ids) == r.decoded and own.encode(r.decoded) == ids and len(ids) == r.n_tokens
        assert brute.sha(r.ids) == r.ids_sha256 and brute.sha(r.decoded) == r.decoded_sha256 and not brute.personal(r.decoded)
    assert rows


def test_letters_and_digits_are_the_librarys():
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(BYTE).pre_tokenizer.pre_tokenize_str
    pattern = bpe.full_pattern(BYTE)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 4000):
        text = "".join(f"{c}'s1{c}a" for c in chars[i:i + 4000])
        assert pattern.findall(text) == [text[a:b] for _, (a, b) in split(text)]
    own, library = bpe.load(BYTE), Tokenizer.from_file(BYTE)
    for c in bpe.disputed_characters()[::7]:
        assert own.encode(f"x{c}'s") == library.encode(f"x{c}'s", add_special_tokens=False).ids


def test_masks_keep_a_column_of_any_name(spark):
    docs = spark.createDataFrame([(1, "mail a@b.de now", "mine")], "doc_id long, text string, proposals string")
    assert tuple(pii.mask_personal_data(docs).first()) == (1, "mail [EMAIL] now", "mine")


def peak_mb(work):
    """Megabytes that the driver's Python holds at most during ``work``, and its result; numpy tells, Arrow's own memory does not count."""
    import tracemalloc

    tracemalloc.start()
    try:
        made = work()
        return tracemalloc.get_traced_memory()[1] / 1e6, made
    finally:
        tracemalloc.stop()


def test_the_driver_keeps_bitmaps_packed(spark):
    hashes = [0, 1, -1, 1 << 62, -(1 << 40), 12345678901234567]
    rows = spark.createDataFrame([(h,) for h in hashes], "hash long")
    peak, packed = peak_mb(lambda: decontaminate.hash_bitmap(rows))
    want = np.zeros(1 << decontaminate.BITMAP_BITS, bool)
    want[[(h % (1 << 64)) >> (64 - decontaminate.BITMAP_BITS) for h in hashes]] = True
    assert (packed == np.packbits(want)).all() and peak < 8


def test_the_training_sample_is_held_in_four_bytes_a_number(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_model, "fit", lambda row, feature, value, label: seen.extend([row, feature, value]) or quality_model.Machine.empty())
    quality_model.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert len(seen[0]) == len(seen[1]) == len(seen[2]) > 0 and {a.itemsize for a in seen} == {4}


def test_only_rows_in_groups_are_marked(spark, monkeypatch):
    group = sentence(3, 60)
    texts = [group, group, group + " more", *[sentence(k, 60) for k in range(20, 40)]]
    written, runs = [], []
    cut, find = jaccard_join.cut_lineage, jaccard_join.components

    def noted(df):
        made = cut(df)
        if "stays" in made.columns:
            written.append(made.count())
        return made
    monkeypatch.setattr(jaccard_join, "cut_lineage", noted)
    monkeypatch.setattr(jaccard_join, "components", lambda links: runs.append(1) or find(links))
    kept = jaccard_join.one_per_group(clashing(spark, list(enumerate(texts)))).collect()
    assert sorted(r.doc_id for r in kept) == [0, *range(3, 23)]
    # no link is left between the components, so they are not looked for again
    assert written == [3] and len(runs) == 1


def test_repeats_are_removed_from_the_texts_themselves(spark):
    part, tail = sentence(3, 90), "é" * 300
    texts = [part + " one", "two " + part, "three", None, "", "x" + tail, "yy" + tail]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, with_text=True).collect()}
    assert [found[k].text for k in range(7)] == [" one", "two ", "three", "", "", "x", "yy"]
    assert all(brute.sha(r.text) == r.kept_sha256 and len(r.text.encode()) == r.n_bytes - r.n_removed for r in found.values())
    # the registered query returns them too
    rows = QUERIES["op2_substring_dedup"](spark, SF).collect()
    assert sum(r.n_removed > 0 for r in rows) > 0
    assert all("\ufffd" in r.text or brute.sha(r.text) == r.kept_sha256 for r in rows)


def test_lists_and_decoded_texts_leave_in_pieces():
    texts = [sentence(k, 3000) for k in range(200)] + [None, ""]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    made = list(bpe._digester(BYTE, True, True)(iter([whole])))
    assert max(m.nbytes for m in made) < 6_000_000 < sum(m.nbytes for m in made)
    assert [x for m in made for x in m.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert [x for m in made for x in m.column("decoded").to_pylist()] == [t or "" for t in texts]
