"""Chat formatting, BPE, token files, page text, quality rules, quality model."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalspark.llm import arrays, bpe, chat, main_text, quality_model, quality_rules, token_files
from evalspark.llm.queries import ORACLES, QUERIES, table, vocabulary
from brute import WORD, sha
from conftest import SF, odd_texts

BYTE, WORD_BPE = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def library(path):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def strange_texts():
    rng = np.random.default_rng(1)
    parts = ["a", "É", " ", "\n", "'s", "'LL", "1", "½", "²", "!", "<|endoftext|>", "　", "\x85", "\x1c", "\xa0", "😀", "\t", "\r\n", "  ", "İ",
             "ǅ", "中", "́", "_", "ª", "\x00", "​", "Σ"]
    return ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000)]


def test_bpe_equals_the_library():
    own, lib = bpe.Bpe(BYTE), library(BYTE)
    for text in [t or "" for t in odd_texts()] + strange_texts() + ["ab" * 20000]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_recent_memory_is_bounded_and_right():
    made = []
    memory = bpe.Recent(10, lambda k: made.append(k) or (len(k),))
    for i in range(1000):
        assert memory["x" * (i % 37)] == (i % 37,)
        assert len(memory) <= 10


def test_recent_memory_keeps_what_is_met_again():
    made = []
    memory = bpe.Recent(10, lambda k: made.append(k) or (k,))
    for i in range(500):
        assert memory["often"] == ("often",) and memory[f"once {i}"] == (f"once {i}",)
        assert len(memory) + len(memory._older) <= 10
    assert made.count("often") == 1


def test_bpe_rows(spark, odd_docs, no_docs):
    lib = library(BYTE)
    got = sorted(tuple(r) for r in bpe.round_trip_digests(odd_docs, BYTE).select("n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = []
    for r in odd_docs.select("text").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((len(ids), sha(",".join(map(str, ids))), sha(r.text or "")))
    assert got == sorted(want)
    assert bpe.round_trip_digests(no_docs, BYTE).count() == 0
    back = bpe.with_text(bpe.with_ids(odd_docs.select("text"), BYTE), BYTE).where(F.coalesce("text", F.lit("")) != F.col("decoded"))
    assert back.count() == 0


def test_word_encoder_equals_the_library():
    encoder, lib = token_files.WordEncoder(WORD_BPE), library(WORD_BPE)
    for texts in ([t or "" for t in odd_texts()], strange_texts()):
        ids, counts = encoder.encode(pa.array(texts))
        want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("ids", [[], [5], [7] * 1000, [1, 2] * 700, list(range(300)) * 40, [3, 3, 3, 4] * 333])
def test_grammar_round_trip_and_random_access(ids):
    ids = np.array(ids, np.uint32)
    lengths = np.array([len(ids) // 3, 0, len(ids) - len(ids) // 3])
    shard = token_files.Shard(token_files.pack(ids, lengths, 400, min_count=4))
    assert shard.ids().tolist() == ids.tolist()
    assert shard.document(0).tolist() == ids[:len(ids) // 3].tolist() and shard.document(1).tolist() == []
    for start in range(0, len(ids), 97):
        assert shard.read(start, 13).tolist() == ids[start:start + 13].tolist()
    if len(ids) > 1000:
        assert len(shard.symbols) <= len(ids) / 3


@pytest.mark.parametrize("kind,size", [("one", 500_000), ("copies", 100_000), ("skewed", 60_000), ("skewed", 5000), ("skewed", 1200)])
def test_no_pair_of_the_packed_symbols_is_frequent(kind, size):
    rng = np.random.default_rng(4)
    ids = {"one": lambda: np.full(size, 7), "copies": lambda: np.tile(rng.integers(0, 300, 100), size // 100),
           "skewed": lambda: rng.geometric(0.05, size)}[kind]().astype(np.uint32)
    shard = token_files.Shard(token_files.pack(ids, np.array([size]), 400))
    assert shard.ids().tolist() == ids.tolist() and shard.read(size // 3, 50).tolist() == ids[size // 3:size // 3 + 50].tolist()
    seen, last = {}, {}
    for i, pair in enumerate(zip(shard.symbols.tolist(), shard.symbols[1:].tolist())):
        if last.get(pair, -2) < i - 1:
            seen[pair], last[pair] = seen.get(pair, 0) + 1, i
    assert max(seen.values(), default=0) < token_files.MIN_COUNT
    if kind != "skewed":
        assert len(shard.symbols) < size / 16


def test_token_files(spark, odd_docs, no_docs, tmp_path):
    token_files.write_token_files(odd_docs, WORD_BPE, f"{tmp_path}/a", shard_tokens=500)
    got = [tuple(r) for r in token_files.read_documents(spark, f"{tmp_path}/a").orderBy("start").collect()]
    lib, at, rest = library(WORD_BPE), 0, {}
    for r in odd_docs.collect():
        ids = np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        rest.setdefault((r.doc_id, len(ids), zlib.crc32(ids.tobytes())), []).append(1)
    assert [g[0] for g in got if g[0] is not None] == sorted(g[0] for g in got if g[0] is not None) and got[0][0] is None
    for doc_id, start, n, crc in got:
        assert start == at
        at += n
        rest[doc_id, n, crc].pop()
    assert not any(rest.values()) and len(got) == odd_docs.count()
    token_files.write_token_files(no_docs, WORD_BPE, f"{tmp_path}/b")
    assert token_files.read_documents(spark, f"{tmp_path}/b").count() == 0


def test_chat_escapes_are_undone():
    for text in ["<|im_end|>", "<\\|", "<\\\\||", "<", "|", "<<||", "a<|b<\\|c", ""]:
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


@pytest.mark.parametrize("block_chars", [1, 60, 1 << 20])
def test_chat_masks(spark, block_chars):
    rows = [(1, 2, "assistant", " two\n"), (1, 1, "user", "\n\n hi <|im_end|>"), (1, 2, "assistant", "é\U0001F600 <|im_start|>assistant no"), (1, None, None, None),
            (2, 1, "assistant", ""), (2, 2, "assis<|tant", "x"), (None, 1, "user", "lost"), (3, 1, "assistant", "a" * 300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    blocks = chat.format_conversations(df, BYTE, block_chars=block_chars)
    lib = chat.tokenizer(BYTE)
    for r in blocks.collect():
        assert r.ids == lib.encode(r.formatted, add_special_tokens=False).ids
        under = lib.decode([i for i, m in zip(r.ids, r.loss_mask) if m], skip_special_tokens=False)
        assert under == "".join(r.formatted[a:b] for a, b in zip(r.loss_starts, r.loss_ends))
    got = {r.conv_id: r for r in chat.conversation_digests(blocks).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted([((r[1] is not None, r[1] or 0), r[2] is not None, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        loss = "".join(t for _, _, role, t in mine if role == "assistant")
        assert got[conv].turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, _, role, t in mine)) and got[conv].n_turns == len(mine)
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    assert chat.conversation_digests(chat.format_conversations(df.limit(0), BYTE)).count() == 0


PAGES = [
    (None, ""), ("", ""), ("plain text, only", "plain text, only"),
    ("<body><nav>Home</nav><article><h1>T &amp; U</h1><p>One,\n two <b>three</b>&nbsp;x.<p>Four<br>five</article><footer>end</footer>", "T & U\nOne, two three x.\nFour five"),
    ("<div class='main'><p>Long paragraph, with commas, and more words to be found here.</p></div><div class='comments'><p>I think, that, this, is, long, too</p></div>",
     "Long paragraph, with commas, and more words to be found here."),
    ("<article><p>a, b</p><script>var x='</p>'</script><!-- no --><ul><li>c<li>d</ul></article><!-- open", "a, b\nc\nd"),
    ("<article><p>x</p><form><p>no</p></form><aside>no</aside><div style='display: none'>no</div><table><tr><td>1<td>2</table></article>", "x\n1\n2"),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_main_text(html, want):
    assert main_text.main_text(html) == want


ARTICLE = "<article><p>A long paragraph, with commas, and more words to be found here.</p><p>And a second one, with more.</p></article>"
SIDE = "<div class='sidebar'><p>Other, things, to read, here.</p></div>"


@pytest.mark.parametrize("html", [f"<div {frame}>{ARTICLE}{SIDE}</div>" for frame in (
    "class='container with-sidebar'", "class='no-sidebar'", "class='elementor-widget-container'", "class='page menu-open'", "id='social-layout'")] + [
    f"<div class='menu-open'><div id='widget'><div>{ARTICLE.replace('article', 'div')}</div>{SIDE}</div></div><div class='comments'>{'<p>I, too, think so.</p>' * 50}</div>",
    f"<div class='promo'>{ARTICLE}</div><div class='ad'><p>Buy, buy, buy.</p></div>", f"<div class='comments'>{ARTICLE}</div>"])
def test_names_do_not_empty_a_page(html):
    assert main_text.main_text(html) == "A long paragraph, with commas, and more words to be found here.\nAnd a second one, with more."


LONG = "<p>" + "A long sentence, with commas, that goes on, and on, and on. " * 8 + "</p>"


@pytest.mark.parametrize("frame", ["article", "main", "div"])
def test_short_sections_beside_a_long_one_stay(frame):
    links = "<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>"
    html = f"<body><{frame}><section><p>Short opening.</p></section><section>{LONG * 3}</section><section><p>Short end.</p></section>{links}</{frame}>"
    lines = main_text.main_text(html).split("\n")
    assert len(lines) == 5 and (lines[0], lines[-1]) == ("Short opening.", "Short end.")
    html = f"<article><div><p>Summary.</p></div><div><section>{LONG}</section><section>{LONG * 3}</section></div>{links}</article>"
    assert main_text.main_text(html).startswith("Summary.\n") and "One" not in main_text.main_text(html)


def test_main_text_is_linear_on_broken_pages():
    for html in ("<div>" * 20000 + "hi, there", "<p>a" * 20000, "<a b=\"c" * 20000, "<b>" * 20000 + "<p>hi" * 2000, "</x>" * 20000, "<" * 50000, "<!--" * 20000):
        main_text.main_text(html)


def test_pages_rows(spark):
    df = spark.createDataFrame([(1, None, None, 3), (2, "u", PAGES[3][0], 4), (2, "u", PAGES[3][0], 4)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in main_text.extract_pages(df).collect()) == [(1, "", 0)] + [(2, PAGES[3][1], len(PAGES[3][1]))] * 2
    assert main_text.extract_pages(df.limit(0)).count() == 0


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd_docs, no_docs):
    ledger = quality_rules.rule_ledger(odd_docs.withColumn("n_words", F.lit("clash")))
    got = sorted(tuple(r) for r in ledger.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted(measures(r.text) for r in odd_docs.collect())
    assert quality_rules.rule_ledger(no_docs).count() == 0
    rows = ledger.collect()
    for version, mask in quality_rules.POLICIES.items():
        kept = quality_rules.apply_policy(ledger, version).where("kept").count()
        assert kept == sum(not r.failed_bits & mask for r in rows)
        for a in quality_rules.ablations(ledger, version).collect():
            bit = quality_rules.BIT[a.rule]
            assert a.failed == sum(bool(r.failed_bits & bit) for r in rows)
            assert a.rescued == sum(r.failed_bits & mask == bit for r in rows)
    assert [r.failed for r in quality_rules.ablations(quality_rules.rule_ledger(no_docs)).collect()] == [0] * 6


def test_linear_scoring_equals_all_pairs():
    rng = np.random.default_rng(2)
    machine = quality_model.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, quality_model.RANK)))
    row, feature, value = np.array([0, 0, 0, 2, 2]), np.array([3, 7, 9, 3, 40]), rng.normal(size=5)
    got, _ = machine.margins(row, feature, value, 3)
    for r in range(3):
        mine = [(f, v) for k, f, v in zip(row, feature, value) if k == r]
        want = 0.3 + sum(machine.weights[f] * v for f, v in mine) + sum(
            machine.factors[f] @ machine.factors[g] * v * w for i, (f, v) in enumerate(mine) for g, w in mine[:i])
        assert abs(got[r] - want) < 1e-9


def test_quality_model(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    machine = quality_model.train(documents, labels)
    scored = quality_model.score(documents, machine, ["doc_id"]).join(labels.select("doc_id", "quality"), "doc_id")
    rows = scored.withColumn("held", quality_model.held_out(F.col("doc_id"))).where("held").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(a > b for a in good for b in bad) > 0.97 * len(good) * len(bad)
    assert sum(s >= 0.3 for s in good) >= 0.98 * len(good)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    odd = quality_model.score(odd_docs, machine, odd_docs.columns)
    assert odd.count() == odd_docs.count() and odd.where("score between 0 and 1").count() == odd_docs.count()
    assert quality_model.score(no_docs, machine, ["doc_id"]).count() == 0
    empty = quality_model.train(documents, labels.limit(0))
    assert {r.score for r in quality_model.score(odd_docs, empty, ["doc_id"]).collect()} == {0.5}


def test_pieces_cover_all_rows():
    column = pa.array(["a" * 10, None, "", "b" * 50, "c"] * 3).slice(2)
    seen = [bytes(data[a:b]).decode() for _, data, offsets in arrays.pieces(column, 20) for a, b in zip(offsets, offsets[1:])]
    assert seen == [x or "" for x in column.to_pylist()]
    assert [x for a, b in arrays.stretches(column, 20) for x in range(a, b)] == list(range(len(column)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    import oracle

    assert oracle.compare(spark, oracle.connect(SF), name, QUERIES[name], ORACLES[name], SF) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
