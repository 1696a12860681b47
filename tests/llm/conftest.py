import pytest

SF = "/root/testdata/sf0.001"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()


def sentence(seed, n):
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


def odd_texts():
    """Null, empty, blank, short, equal, nearly equal, self-repeating and long texts."""
    base = sentence(3, 300)
    near = base.replace(base.split()[150], "changed", 1)
    return [None, "", " \n\t ", "one", "one two", base, base, near, sentence(5, 300), base[:1500] + sentence(8, 200), "ab " * 600,
            ("x" * 30 + " ") * 40, sentence(9, 12000), "é😀 " + sentence(4, 120), "Á\x00\x1c\x85　b " * 80, "<|endoftext|> it's 12½ <|im_end|>"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(None if i == 3 else i, t, "en", None, None if t is None else len(t), "x") for i, t in enumerate(odd_texts())]
    rows += [rows[5], rows[8]]
    # extra columns carry names that the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").withColumnsRenamed(
        {"lang": "tokens", "source": "spans"})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
