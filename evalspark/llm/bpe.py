"""Byte-level BPE: encoding by a queue of merge ranks, decoding by concatenation.

A piece of text is a doubly linked list of symbols. A heap holds the rank of every
adjacent pair; the lowest rank, leftmost first, is merged, and entries whose symbols have
changed since they were pushed are skipped as stale. A piece of m symbols costs
O(m log m), whatever its length. Decoding concatenates the byte strings of the vocabulary.

Texts repeat their pieces heavily. A piece is encoded and decoded once and kept as its ids, their
decimal text and its bytes, within a fixed number of pieces; a text is then joined from pieces,
not from tokens. Pieces that are met again outlive the others.

Which characters are letters or digits is the tokenizer library's to say: its Unicode tables
differ from this interpreter's in characters that only one of them knows. Those are asked of
the library's own pre-tokenizer when the first unusual text comes.

Cases: a null text is empty (no ids); an added token's text in a document is that token; every
row is handled by itself, so rows may repeat; an empty table gives no rows. ``with_ids`` and
``with_text`` add their column to all others (one of that name gives way); ``round_trip_digests``
returns ``doc_id`` and its own columns only, whatever the names of the others.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from evalspark.llm import arrays as A

#: Fixed value: the split pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers; this bounds its memory, not the input.
RECENT_PIECES = 500_000
#: A longer text is encoded but not remembered.
RECENT_CHARS = 64
#: Bits of a token id inside a pair's key.
_SHIFT = 21

#: The same pieces in texts without unusual characters, where letters and digits need no Unicode tables. Letters
#: are tried first: no contraction begins with one.
_PLAIN_PATTERN = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Outside ASCII and the Latin letters; such a text is split by the full pattern.
_UNUSUAL = re.compile("[\x1c-\x1f\x80-\xbf" + chr(0x250) + "-" + chr(0x10FFFF) + "]")


def disputed_characters() -> list[str]:
    """Characters that this interpreter's two Unicode tables class differently, so that a third one may, too."""
    chars = "".join(chr(code) for code in range(0x80, 0x110000) if not 0xD800 <= code < 0xE000)
    letters, digits = set(regex.findall(r"\p{L}", chars)), set(regex.findall(r"\p{N}", chars))
    majors = ((char, unicodedata.category(char)[0]) for char in chars)
    return [char for char, major in majors if (major == "L") != (char in letters) or (major == "N") != (char in digits)]


def library_classes(path: str, chars: list[str]) -> tuple[list[str], list[str]]:
    """Those of some characters that the tokenizer library takes for letters, and for digits."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    letters = [c for c in chars if len(split(f"a{c}")) == 1]
    digits = [c for c in chars if len(split(f"1{c}")) == 1]
    return letters, digits


def full_pattern(path: str) -> regex.Pattern:
    """The split pattern with the library's letters and digits."""
    chars = disputed_characters()
    letters, digits = library_classes(path, chars)

    def listed(codes: list[int]) -> str:
        """Code points as ranges of a character class."""
        runs: list[list[int]] = []
        for code in codes:
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)

    def group(name: str, mine: list[str]) -> str:
        own, mine = regex.compile(rf"\p{{{name}}}"), set(mine)
        more = listed([ord(c) for c in chars if c in mine and not own.match(c)])
        gone = listed([ord(c) for c in chars if c not in mine and own.match(c)])
        return f"[[\\p{{{name}}}{more}]--[{gone}]]" if gone else f"[\\p{{{name}}}{more}]"
    letter, digit = group("L", letters), group("N", digits)
    return regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:(?!{letter}|{digit})\S)").replace(r"\p{L}", letter).replace(r"\p{N}", digit),
                         regex.V1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return [names[b] for b in range(256)]


class Recent(dict):
    """What was made of texts met lately, in two generations: a missing one is taken from the older one, else made.

    When the younger one holds half of the size it becomes the older one; what was not met since then goes.
    """

    def __init__(self, size: int, make: Callable[[str], tuple]) -> None:
        super().__init__()
        self._size, self._make, self._older = size, make, {}

    def __missing__(self, key: str) -> tuple:
        made = self._older.pop(key, None) or self._make(key)
        if len(key) <= RECENT_CHARS:
            if len(self) >= self._size // 2:
                self._older = dict(self)
                self.clear()
            self[key] = made
        return made


class Bpe:
    """A vocabulary file as merge ranks and byte strings; built once per worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        value = {c: b for b, c in enumerate(symbols)}
        vocab = spec["model"]["vocab"]
        self.byte_ids = [vocab[c] for c in symbols]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
        # ranks stand above the 32 bits of a place, as in the heap's entries
        self.ranks = {vocab[left] << _SHIFT | vocab[right]: rank << 32 for rank, (left, right) in enumerate(pairs)}
        self.products = [vocab[left + right] for left, right in pairs]
        self.strings = {i: bytes(value[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: token.encode() for token, i in self.added.items()})
        self.names = {i: f"{i}," for i in self.strings}
        self._added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces = Recent(RECENT_PIECES, lambda piece: self.described(self.merge(piece.encode("utf-8", "surrogatepass"))))
        self._path = path

    @cached_property
    def _split(self) -> regex.Pattern:
        """Made when the first unusual text comes."""
        return full_pattern(self._path)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece, merged by rank with a heap over a linked list."""
        ids = list(map(self.byte_ids.__getitem__, data))
        n = len(ids)
        if n < 2:
            return tuple(ids)
        rank_of, products = self.ranks.get, self.products
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [rank_of(x << _SHIFT | y, -1) for x, y in zip(ids, ids[1:])]
        ranks.append(-1)
        heap = [rank | i for i, rank in enumerate(ranks) if rank >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            if ranks[i] != entry ^ i:
                continue  # stale: the pair at this place has changed since
            made = ids[i] = products[entry >> 32]
            j = after[i]
            ids[j] = ranks[j] = ranks[i] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks[i] = rank_of(made << _SHIFT | ids[k], -1)
                if rank >= 0:
                    heappush(heap, rank | i)
            h = before[i]
            if h >= 0:
                rank = ranks[h] = rank_of(ids[h] << _SHIFT | made, -1)
                if rank >= 0:
                    heappush(heap, rank | h)
        return tuple([x for x in ids if x >= 0])

    def described(self, ids: tuple[int, ...]) -> tuple[tuple[int, ...], str, bytes]:
        """Ids, their decimal text with a comma behind each, and the bytes they stand for."""
        return ids, "".join(map(self.names.__getitem__, ids)), b"".join(map(self.strings.__getitem__, ids))

    def pieces_of(self, text: str) -> list[tuple[tuple[int, ...], str, bytes]]:
        """A text as encoded and decoded pieces, in order."""
        out: list[tuple[tuple[int, ...], str, bytes]] = []
        for k, part in enumerate(self._added.split(text) if self._added else [text]):
            if k % 2:
                out.append(self.described((self.added[part],)))
            else:
                split = self._split if _UNUSUAL.search(part) else _PLAIN_PATTERN
                out.extend(map(self.pieces.__getitem__, split.findall(part)))
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([p[0] for p in self.pieces_of(text)]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def with_ids(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of a text column as ``array<int>``."""
    @F.udf(T.ArrayType(T.IntegerType()), useArrow=True)
    def encode(value):
        return load(path).encode(value or "")
    return df.withColumn(ids, encode(F.col(text)))


def with_text(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that a column of token ids stands for; null ids give an empty text."""
    @F.udf(T.StringType(), useArrow=True)
    def decode(value):
        return load(path).decode(list(value if value is not None else []))
    return df.withColumn(text, decode(F.col(ids)))


def _digester(path: str, with_lists: bool, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        # handed on piece by piece: lists and decoded texts take several times the room of their texts
        for batch in (b.slice(first, last - first) for b in batches for first, last in A.stretches(b.column(1), A.PIECE)):
            counts, id_digests, text_digests, lists, texts = [], [], [], [], []
            for text in batch.column(1):
                pieces = bpe.pieces_of(text.as_py() or "")
                ids, names, strings = zip(*pieces) if pieces else ((), (), ())
                names = "".join(names)
                counts.append(names.count(","))
                id_digests.append(hashlib.sha256(names[:-1].encode()).hexdigest())
                data = b"".join(strings)
                decoded = data.decode("utf-8", "replace")
                # bytes that decode as they are, which is the rule, need not be encoded again
                text_digests.append(hashlib.sha256(decoded.encode() if "\ufffd" in decoded else data).hexdigest())
                if with_lists:
                    lists.append(np.fromiter(chain.from_iterable(ids), np.int32, counts[-1]))
                if with_text:
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_lists:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def round_trip_digests(df: DataFrame, path: str, with_lists: bool = False, with_text: bool = False) -> DataFrame:
    """Encode and decode every text and keep digests, in one pass; ``with_lists`` and ``with_text`` also keep ids and decoded texts."""
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(
        _digester(path, with_lists, with_text), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
        + ", ids array<int>" * with_lists + ", decoded string" * with_text)
