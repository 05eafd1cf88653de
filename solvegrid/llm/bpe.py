"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols lie at the leaves. The leaf of a symbol holds the rank of the pair that
it makes with its right neighbour; inner nodes hold the minimum, so the root yields the
lowest rank and the descent that prefers the left child yields the leftmost of it. A
merge changes three leaves, each in logarithmic time, until the root says that no pair is
mergeable. Words are memoised, since texts repeat them; the memo is emptied at a bound.

The vocabulary file decides the rest: NFC, white space to one blank, lower case, the
splitting pattern, byte letters and the end-of-word mark. Added tokens are cut out of the
raw text first. Characters that Unicode 3.2 has and that behave alike in Python's tables and
in the tokenizers library are normalised and split here (a character's normal form never
changes once it is assigned); a text with any other character is normalised and split by the
library's own normaliser and splitter, whose Unicode version is what counts.

Cases: a null text counts as empty and gives no ids, as does one of white space only; a text
or word of any length is encoded whole; rows are encoded each by itself, so repeated rows get
the same ids and an empty table gives no rows; a column of the result's name is replaced,
other columns and their names play no part.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

MEMO = 1 << 19
_NONE = 1 << 60


def byte_letters() -> list[str]:
    """For each byte the printable letter that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def merge_word(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges ids by (rank, id of the result) of their pairs: lowest rank first, leftmost among equals."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    ids, right, left = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    get = pairs.get
    for i in range(n - 1):
        found = get((ids[i], ids[i + 1]))
        if found:
            tree[size + i] = found[0]
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        i += size
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    while (rank := tree[1]) != _NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != rank:
                i += 1
        i -= size
        j = right[i]
        ids[i] = get((ids[i], ids[j]))[1]
        right[i] = after = right[j]
        ids[j] = -1
        put(j, _NONE)
        if after < n:
            left[after] = i
            found = get((ids[i], ids[after]))
            put(i, found[0] if found else _NONE)
        else:
            put(i, _NONE)
        before = left[i]
        if before >= 0:
            found = get((ids[before], ids[i]))
            put(before, found[0] if found else _NONE)
    return [x for x in ids if x >= 0]


class Codec:
    """Encodes and decodes with a vocabulary file in the JSON form of public tokenizers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            joined = a + b
            if a in vocab and b in vocab and joined in vocab:
                self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[joined]))
        added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.tokens = {i: t for t, i in (vocab | added).items()}
        self.added = added
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        steps = (spec.get("normalizer") or {}).get("normalizers") or [spec["normalizer"]] if spec.get("normalizer") else []
        self.normalizers = [s["type"] for s in steps]
        patterns = [s["pattern"]["Regex"] for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if s["type"] == "Split"]
        if len(patterns) != 1 or not set(self.normalizers) <= {"NFC", "Replace", "Lowercase"} or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path} isn't of the supported form")
        self.split = regex.compile(patterns[0]).findall
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters]
        self.byte = {c: b for b, c in enumerate(letters)}
        self.memo = _Memo(self)
        library = Tokenizer.from_file(path)
        self.library = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.plain: set[str] = set(map(chr, range(128)))
        self.foreign: set[str] = set()

    def normalise(self, text: str) -> str:
        """NFC and lower case. White space stays as it is: whatever its kind, the split drops it."""
        if not text.isascii() and "NFC" in self.normalizers:
            text = unicodedata.normalize("NFC", text)
        if "Lowercase" in self.normalizers:
            # letter by letter: a capital sigma has one lower form, wherever it stands
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return text

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without added tokens."""
        if text.isascii() or not self._foreign(set(text) - self.plain):
            return self.split(self.normalise(text))
        return self._library_words(text)

    def _library_words(self, text: str) -> list[str]:
        normalise, split = self.library
        byte = self.byte
        return [bytes(map(byte.__getitem__, w)).decode("utf-8", "surrogatepass") for w, _ in split(normalise(text))]

    def _foreign(self, unknown: set[str]) -> bool:
        """Whether any of the characters behaves otherwise in the library; keeps what it learns."""
        if unknown & self.foreign:
            return True
        for c in unknown:
            probe = f"a{c}b {c} 1{c}2 '{c}"
            if unicodedata.ucd_3_2_0.category(c) != "Cn" and self.split(self.normalise(probe)) == self._library_words(probe):
                self.plain.add(c)
            else:
                self.foreign.add(c)
        return bool(unknown & self.foreign)

    def encode_word(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8")
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        return tuple(merge_word(symbols, self.pairs))

    def encode(self, text: str) -> list[int]:
        if self.cut is None or "<" not in text:
            return list(chain.from_iterable(map(self.memo.__getitem__, self.words(text))))
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out.extend(chain.from_iterable(map(self.memo.__getitem__, self.words(part))))
        return out

    def decode(self, ids) -> str:
        """Without a decoder in the file, tokens are joined by blanks."""
        return " ".join(map(self.tokens.__getitem__, ids))


class _Memo(dict):
    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        ids = self.codec.encode_word(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoder(path: str):
    """A vectorised function: text to array of ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array([np.asarray(own.encode(x.as_py() or ""), dtype=np.int32) for x in texts], pa.list_(pa.int32()))

    return encode


def decoder(path: str):
    """A vectorised function: array of ids to text; null gives an empty text."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array([own.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in ids], pa.string())

    return decode


def encode_column(docs: DataFrame, path: str, *, text_col: str = "text", into: str = "ids") -> DataFrame:
    return docs.withColumn(into, encoder(path)(F.col(text_col)))


def digests(path: str):
    """A vectorised function: text to (n_tokens, ids_sha256, decoded_sha256), encoding and then decoding the ids."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pa.Array) -> pa.Array:
        own, counts, a, b = codec(path), [], [], []
        for x in texts:
            ids = own.encode(x.as_py() or "")
            counts.append(len(ids))
            a.append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
            b.append(hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest
