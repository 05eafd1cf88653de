"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

A window is ``SPAN`` consecutive words of one document. A word is removed if a window that
covers it also starts earlier: in a document of smaller id, or earlier in the same one.

Each window selects one block: the ``GRAM``-word piece of smallest hash in it, the last one
among equals. Equal windows select equal blocks at equal offsets, so blocks index every window
with about one entry for eight words. The windows that select one occurrence of a block are
consecutive; the words that they cover are its reach. The reference is every block with its
reach at its first occurrence, so it has all text of all documents, each reach once.

1. Occurrences are keyed by (block hash, hash of the reach), 128 bits. Blocks that occur once
   are dropped. The first occurrence of each key, the reference's entry, is found by a partial
   aggregation.
2. Any later occurrence of a key matches the reference with its whole reach.
3. Where a block has several keys, copies begin or end within a reach. There the entries of
   the reference, which step 2 doesn't match, are checked at these boundaries: their windows
   are keyed one by one by two independent hashes and match the first start of each.
   Occurrences that aren't first are settled by step 2, so this is exact, and no pair of
   occurrences is made.
4. Each document is parsed from left to right: a factor starts at the first window that
   matches and is greedily extended word by word as long as the matches go on at the same
   distance in the same document. It is (place, source, source's place, words), at least
   ``SPAN`` words long; what matches nothing is literal. The next factor may start within the
   last ``SPAN - 1`` words of the one before it, so that no window at a boundary is lost.

Words are hashed to 64 bits, and a window is told apart by 128 bits of its words' hashes.

Cases: null text has no words; fewer than ``SPAN`` words have no window; an empty table gives
no rows; texts of any length are parsed whole; rows that share an id and a text are one place,
so none is earlier than the other; rows that share an id only, told apart by a 64-bit hash of
their text, are judged by id and start as well, and keep their own words; a null id counts as
the smallest; other columns and their names play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SPAN = 20
GRAM = 5
_A, _B = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_U = np.uint64


class _Ranges:
    """Hashes of ranges of a sequence of word hashes, from prefix sums modulo 2 ** 64."""

    def __init__(self, h: np.ndarray, base: int):
        self.back = C.powers(pow(base, -1, 1 << 64), len(h) + 1)
        self.total = np.zeros(len(h) + 1, dtype=_U)
        np.cumsum(h * C.powers(base, len(h)), out=self.total[1:])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return C.mix64((self.total[b] - self.total[a]) * self.back[a] + (b - a).astype(_U))


def _blocks(words: C.Tokens, h: np.ndarray, span: int, gram: int):
    """Position of each selected block, and its first and last window, within the chunk."""
    starts = np.flatnonzero(C.inside_doc(words.first, words.n, span))
    if not len(starts):
        return None
    g = C.gram_hashes(h, gram)
    width = span - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(g, width)[:, ::-1]
    at = starts + (width - 1 - np.argmin(view[starts], axis=1))
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return g, at[begin], starts[begin], starts[end]


def _index(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """block, reach, id, tag, place: an entry for each occurrence of a selected block.

    place is the block's first word in its document, and how far before it the first and the
    last window start.
    """
    for batch in batches:
        ids, tags = np.asarray(batch.column("id")), np.asarray(batch.column("tag"))
        for lo, _, chunk in C.chunks(batch.column("text")):
            words = chunk.tokens()
            h = words.hashes()
            found = _blocks(words, h, span, gram)
            if found is None:
                continue
            g, p, a, b = found
            reach = _Ranges(h, _A).hash(a, b + span) ^ C.mix64((p - a).astype(_U) + _U(1))
            doc = np.searchsorted(words.first, p, side="right") - 1
            place = ((p - words.first[doc]) << 16) | ((p - a) << 8) | (p - b)
            yield pa.RecordBatch.from_arrays([pa.array(g[p].view(np.int64)), pa.array(reach.view(np.int64)), pa.array(ids[lo + doc]), pa.array(tags[lo + doc]), pa.array(place)], ["block", "reach", "id", "tag", "place"])


def _edges(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """w1, w2, id, tag, at: an entry for each window of the listed places, as far as the text has it."""
    for batch in batches:
        ids, tags, places = np.asarray(batch.column("id")), np.asarray(batch.column("tag")), batch.column("places")
        for lo, _, chunk in C.chunks(batch.column("text")):
            words = chunk.tokens()
            h = words.hashes()
            own = places.slice(lo, chunk.n)
            n = np.asarray(own.value_lengths())
            place = np.asarray(own.flatten())
            doc = np.repeat(np.arange(chunk.n), n)
            p = place >> 16
            a, b = p - ((place >> 8) & 255), p - (place & 255)
            size = b - a + 1
            row = np.repeat(np.arange(len(p)), size)
            at = a[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            # places are of one of the id's texts, others may be shorter
            has = at + span <= np.diff(words.first)[doc[row]]
            row, at = row[has], at[has]
            begin = words.first[doc[row]] + at
            w1, w2 = (_Ranges(h, base).hash(begin, begin + span) for base in (_A, _B))
            yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(ids[lo + doc[row]]), pa.array(tags[lo + doc[row]]), pa.array(at)], ["w1", "w2", "id", "tag", "at"])


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The id, and a hash of the text that tells rows of one id apart."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), F.coalesce(F.xxhash64(text_col), F.lit(0))


def parse(a: np.ndarray, b: np.ndarray, source: np.ndarray, shift: np.ndarray, span: int) -> list[tuple[int, int, int, int]]:
    """Factors (place, source, source's place, words), greedily from left to right.

    a..b are starts of windows that match the windows at a + shift..b + shift of the source;
    no window has two matches.
    """
    order = np.lexsort((b, a))
    a, b, source, shift = a[order], b[order], source[order], shift[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] > b[:-1] + 1) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    return list(zip(a[first].tolist(), source[first].tolist(), (a + shift)[first].tolist(), (b[last] - a[first] + span).tolist(), strict=True))


_FACTORS = "array<struct<at: long, source: long, source_at: long, n_words: long>>"


def factors(docs: DataFrame, *, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tag, factors: the parse of each document that has any factor; literals lie between them."""
    if not gram <= span < 256:
        raise ValueError("gram <= span < 256 is needed")
    place, tag = _key(id_col, text_col)
    own = docs.select(place.alias("id"), tag.alias("tag"), F.col(text_col).alias("text"))
    entries = own.mapInArrow(lambda it: _index(it, span, gram), "block long, reach long, id long, tag long, place long")
    # written, so that the join deals both sides itself and can split a very common block
    again = C.settle(entries.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block"))
    entries = C.settle(entries.join(again, "block", "left_semi"))
    at, before, upto = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    keys = C.settle(entries.groupBy("block", "reach").agg(F.min(F.struct("id", at.alias("at"), "place")).alias("lead"), F.count(F.lit(1)).alias("n")))
    several = keys.where("n > 1").select("block", "reach", F.col("lead.id").alias("lead_id"), F.col("lead.at").alias("lead_at"))
    later = F.struct("id", "at") > F.struct("lead_id", "lead_at")
    match = [F.col("lead_id").alias("source"), (F.col("lead_at") - F.col("at")).alias("shift")]
    whole = entries.withColumn("at", at).join(several, ["block", "reach"]).where(later)
    whole = C.settle(whole.select("id", "tag", (F.col("at") - before).alias("a"), (F.col("at") - upto).alias("b"), *match))
    open_blocks = C.settle(keys.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block"))
    leads = keys.join(open_blocks, "block", "left_semi").select("lead.id", "lead.place")
    listed = leads.groupBy("id").agg(F.collect_list("place").alias("places"))
    windows = C.settle(own.join(listed, "id").select("id", "tag", "text", "places").mapInArrow(lambda it: _edges(it, span), "w1 long, w2 long, id long, tag long, at long"))
    firsts = windows.groupBy("w1", "w2").agg(F.min(F.struct("id", "at")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = C.settle(firsts.select("w1", "w2", F.col("lead.id").alias("lead_id"), F.col("lead.at").alias("lead_at")))
    edge = windows.join(firsts, ["w1", "w2"]).where(later).select("id", "tag", F.col("at").alias("a"), F.col("at").alias("b"), *match)
    matches = whole.unionByName(edge).groupBy("id", "tag").agg(F.collect_list(F.struct("a", "b", "source", "shift")).alias("matches"))

    @F.arrow_udf(_FACTORS)
    def parsed(lists: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("at", "source", "source_at", "n_words")]))
        return pa.array([parse(*[np.asarray(x.values.field(c)) for c in ("a", "b", "source", "shift")], span) for x in lists], kind)

    return C.settle(matches.select("id", "tag", parsed("matches").alias("factors")))


def covered(n: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of n words the factors cover."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step[:-1]) > 0


def _kept(texts: pa.Array, found: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    for text, own in zip(texts, found, strict=True):
        words = (text.as_py() or "").encode("utf-8").split()
        n, gone = len(words), 0
        if own.is_valid:
            mask = covered(n, np.asarray(own.values.field("at")), np.asarray(own.values.field("n_words")))
            gone = int(mask.sum())
            words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
        yield n, gone, b" ".join(words)


def _with_factors(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    place, tag = _key(id_col, text_col)
    keyed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], place.alias("__id"), tag.alias("__tag"))
    return keyed.join(found.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), F.col("factors").alias("__factors")), ["__id", "__tag"], "left")


def dedup(docs: DataFrame, *, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept words, joined by one blank, as text; rows and columns stay."""
    found = factors(docs, span=span, gram=gram, id_col=id_col, text_col=text_col)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([x[2].decode() for x in _kept(texts, found)], pa.string())

    joined = _with_factors(docs, found, id_col, text_col)
    at = docs.columns.index(text_col)
    return joined.select(*[(cut(f"c{i}", "__factors") if i == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def digests(docs: DataFrame, *, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    slim = docs.select(id_col, text_col)
    found = factors(slim, span=span, gram=gram, id_col=id_col, text_col=text_col)

    @F.arrow_udf("n_words long, n_removed long, kept_sha256 string")
    def digest(texts: pa.Array, found: pa.Array) -> pa.Array:
        done = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in _kept(texts, found)]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["n_words", "n_removed", "kept_sha256"])

    joined = _with_factors(slim, found, id_col, text_col)
    return joined.select(F.col("c0").alias("doc_id"), digest("c1", "__factors").alias("d")).select("doc_id", "d.*")


#: DuckDB SQL over the table documents; windows are told apart by their words themselves.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS pos, words FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 19), ' ') AS key FROM g),
f AS (SELECT doc_id, pos, min((doc_id, pos)) OVER (PARTITION BY key) AS lead FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM f WHERE (doc_id, pos) > lead),
flat AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT flat.doc_id, string_agg(word, ' ' ORDER BY flat.i) AS kept, count(*) AS n FROM flat ANTI JOIN gone ON flat.doc_id = gone.doc_id AND flat.i = gone.i GROUP BY flat.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
