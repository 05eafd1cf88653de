"""Quality rules: exact rules plus a hashed n-gram logistic regression.

Features are the words, word pairs and character 3- and 4-grams (over UTF-8 bytes) of a
text, hashed into ``2 ** BITS`` buckets for words and as many for characters; each of the
two groups counts as frequencies. The model is fitted on a sample of labelled rows with a
documented bound for each class: ``sample_per_class`` rows, those of smallest
``xxhash64(doc_id)``, as far as ``SAMPLE_BYTES`` of text reach, and none of more than
``SAMPLE_TEXT`` bytes; a row has at most three features a byte, so what the driver gets is
bounded too. A quarter of the sample is kept back to calibrate the probability. Every text
is scored whole.

Cases: null or empty text has no words, hence fails the rules; a missing or one-sided
label table gives no model, and then the rules alone decide; repeated rows are judged
each by itself; other columns are passed through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BITS = 16
SAMPLE_PER_CLASS = 1500
#: Bytes of text that a class is learned from, and of the longest text of these.
SAMPLE_BYTES, SAMPLE_TEXT = 1 << 24, 1 << 20
KEEP_AT = 0.35
MIN_WORDS = 20
REPEAT_WORDS = 8
SYMBOLS = b"#*$%&|<>"

#: Bytes of text whose n-grams are worked on at once; there are several for each byte.
CHUNK_BYTES = C.CHUNK_BYTES // 4

_SYMBOL_BYTES = C.byte_set(SYMBOLS)
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_stats(chunk: C.Chunk, words: C.Tokens, h: np.ndarray) -> dict[str, np.ndarray]:
    n_words = np.diff(words.first)
    inside = ~C.SPACES[chunk.buf]
    out = {"n_words": n_words, "word_chars": chunk.count(inside & ((chunk.buf & 0xC0) != 0x80)), "n_symbols": chunk.count(_SYMBOL_BYTES[chunk.buf])}
    lines = chunk.tokens(C.NEWLINE)
    has_word = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
    doc, lh = lines.doc()[has_word], lines.hashes(5)[has_word]
    order = np.lexsort((lh, doc))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (lh[order][1:] == lh[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][same], minlength=chunk.n).astype(np.int64)
    g = C.gram_hashes(h, REPEAT_WORDS)
    at = np.flatnonzero(C.inside_doc(words.first, words.n, REPEAT_WORDS))
    doc_of = words.doc()
    key = C.mix64(g[at] + doc_of[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    twice = np.zeros(len(order), dtype=bool)
    equal = sorted_key[1:] == sorted_key[:-1]
    twice[1:] |= equal
    twice[:-1] |= equal
    covered = np.zeros(words.n + 1, dtype=np.int32)
    starts = at[order[twice]]
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + REPEAT_WORDS, -1)
    repeated = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = np.bincount(doc_of[repeated], minlength=chunk.n).astype(np.int64)
    return out


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


def _bucket(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def features(chunk: C.Chunk, words: C.Tokens, h: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two groups (words, characters) of (bucket ids, first index of each document)."""
    pair_at = np.flatnonzero(C.inside_doc(words.first, words.n, 2))
    pairs = C.gram_hashes(h, 2)[pair_at]
    doc = np.concatenate([words.doc(), words.doc()[pair_at]])
    ids = np.concatenate([_bucket(h, bits), _bucket(pairs, bits)])
    order = np.argsort(doc, kind="stable")
    first = np.searchsorted(doc[order], np.arange(chunk.n + 1))
    groups = [(ids[order], first)]
    b = chunk.buf.astype(np.uint64)
    length = np.diff(chunk.off)
    left = np.repeat(chunk.off[1:], length) - np.arange(len(b))
    parts, docs = [], []
    doc_of = np.repeat(np.arange(chunk.n), length)
    for k in (3, 4):
        if len(b) < k:
            continue
        v = np.zeros(len(b) - k + 1, dtype=np.uint64)
        for j in range(k):
            v = (v << np.uint64(8)) | b[j : j + len(v)]
        ok = np.flatnonzero(left[: len(v)] >= k)
        v = C.mix64(v[ok] + np.uint64(k << 40))
        parts.append(_bucket(v, bits) + (1 << bits))
        docs.append(doc_of[ok])
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    order = np.argsort(doc, kind="stable")
    groups.append((ids[order], np.searchsorted(doc[order], np.arange(chunk.n + 1))))
    return groups


class Model:
    """weights over the buckets, a bias, and Platt's slope and offset."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float, bits: int):
        self.weights, self.bias, self.slope, self.offset, self.bits = weights, bias, slope, offset, bits

    def probability(self, groups) -> np.ndarray:
        z = self.bias
        for ids, first in groups:
            total = C.segment_sum(self.weights[ids], first)
            z = z + total / np.maximum(np.diff(first), 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def _sparse(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, chunk in C.chunks(batch.column("text"), CHUNK_BYTES):
            words = chunk.tokens()
            h = words.hashes()
            rows = [[] for _ in range(chunk.n)]
            for ids, first in features(chunk, words, h, bits):
                for d in range(chunk.n):
                    own = ids[first[d] : first[d + 1]]
                    at, n = np.unique(own, return_counts=True)
                    rows[d].append((at.astype("<i4"), (n / max(1, len(own))).astype("<f4")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").slice(lo, hi - lo),
                    batch.column("part").slice(lo, hi - lo),
                    pa.array([np.concatenate([x[0] for x in r]).tobytes() for r in rows], pa.binary()),
                    pa.array([np.concatenate([x[1] for x in r]).tobytes() for r in rows], pa.binary()),
                ],
                ["label", "part", "ids", "values"],
            )


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], id_col: str = "doc_id", text_col: str = "text", most_bytes: int = SAMPLE_BYTES, longest: int = SAMPLE_TEXT) -> DataFrame:
    """text, label, part (0 to 3) of a bounded sample of labelled rows.

    Only rows whose crc32 of the id is not 2 modulo 4 are taken, so that the others can
    be held out. The chosen ids are at most sum(per_class) rows: small enough to broadcast.
    Their texts are dealt by a hash of the id into 256 parts; as many parts are taken, in order,
    as have at most most_bytes of their class together. Null texts count as empty; an id of several rows gives them all.
    """
    own = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & (F.crc32(F.col("__id").cast("string")) % 4 != 2))
    own = own.groupBy("__id").agg(F.max("label").alias("label"))
    chosen = None
    for value, most in per_class.items():
        part = own.where(F.col("label") == value).orderBy(F.xxhash64("__id"), "__id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("__size", F.octet_length("text").cast("long")).where(F.col("__size") <= longest)
    got = C.settle(texts.join(F.broadcast(chosen), "__id").withColumn("__part", F.pmod(F.xxhash64(F.col("__id"), F.lit(9)), F.lit(256))))
    # at most 256 sums a class
    sums = got.groupBy("label", "__part").agg(F.sum("__size").alias("__size"))
    upto = sums.withColumn("__upto", F.sum("__size").over(Window.partitionBy("label").orderBy("__part"))).where(F.col("__upto") <= most_bytes)
    got = got.join(F.broadcast(upto.select("label", "__part")), ["label", "__part"], "left_semi")
    return got.select("text", "label", (F.pmod(F.xxhash64(F.col("__id"), F.lit(7)), F.lit(4))).cast("int").alias("part"))


def _digest(ids: np.ndarray, values: np.ndarray) -> bytes:
    h = hashlib.blake2b(ids, digest_size=16)
    h.update(values)
    return h.digest()


def _logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, steps: int, penalty: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the weighted log loss, both classes with equal weight.

    Rows are gone through in blocks, so that the driver needs little more than the rows.
    """
    blocks = []
    for lo in range(0, len(rows), 128):
        part = rows[lo : lo + 128]
        first = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum([len(r[0]) for r in part], out=first[1:])
        blocks.append((lo, part, first))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b, m, v = np.zeros(dims), 0.0, np.zeros(dims + 1), np.zeros(dims + 1)
    for t in range(1, steps + 1):
        grad = np.append(penalty * w, 0.0)
        for lo, part, first in blocks:
            cols = np.concatenate([r[0] for r in part])
            vals = np.concatenate([r[1] for r in part])
            z = C.segment_sum(vals * w[cols], first) + b
            own = slice(lo, lo + len(part))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) * weight[own]
            grad[:-1] += np.bincount(cols, weights=vals * np.repeat(g, np.diff(first)), minlength=dims)
            grad[-1] += g.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return w.astype(np.float32), float(b)


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, most: float = 12.0) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (z, y); z counts as at most ``most`` from 0.

    Newton steps on the weighted log loss, halved until they lower it; a small pull keeps the
    curve finite where the classes don't overlap.
    """
    z = np.clip(z, -most, most)
    x = np.array([1.0, 0.0])

    def loss(v: np.ndarray) -> float:
        t = v[0] * z + v[1]
        return float((weight * (np.logaddexp(0, t) - y * t)).sum() + 0.05 * (v @ v))

    now = loss(x)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x[0] * z + x[1], -30, 30)))
        r, s = weight * (p - y), weight * p * (1 - p)
        grad = np.array([(r * z).sum(), r.sum()]) + 0.1 * x
        hess = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 0.1 * np.eye(2)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and (new := loss(x - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - new < 1e-9:
            break
        x, now = x - size * step, new
    return (float(x[0]), float(x[1])) if x[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, *, sample_per_class: int = SAMPLE_PER_CLASS, bits: int = BITS, steps: int = 150, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """None if one of the classes has no labelled row."""
    rows = sample(docs, labels, "quality", {0: sample_per_class, 1: sample_per_class}, id_col, text_col)
    got = rows.mapInArrow(lambda it: _sparse(it, bits), "label int, part int, ids binary, values binary").toArrow()
    y, part = np.asarray(got["label"]), np.asarray(got["part"])
    if len(set(y.tolist())) < 2:
        return None
    # views of the Arrow buffers, no copies
    sparse = [(np.frombuffer(a.as_buffer(), "<i4"), np.frombuffer(b.as_buffer(), "<f4")) for a, b in zip(got["ids"], got["values"], strict=True)]
    # rows arrive in no set order; sums of floats shall not depend on it
    order = sorted(range(len(y)), key=lambda i: (y[i], len(sparse[i][0]), _digest(*sparse[i])))
    y, part, sparse = y[order], part[order], [sparse[i] for i in order]
    held = part == 0
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held = np.zeros(len(y), dtype=bool)
    weights, bias = _logistic([x for x, k in zip(sparse, held, strict=True) if not k], y[~held], 2 << bits, steps, 1e-7)
    z = np.array([float((weights[i] * v).sum()) + bias for i, v in sparse])
    use = held if held.any() else np.ones(len(y), dtype=bool)
    slope, offset = platt(z[use], y[use], np.where(y[use] == 1, 1 / max(1, (y[use] == 1).sum()), 1 / max(1, (y[use] == 0).sum())) * use.sum() / 2)
    del got, sparse
    C.release(docs.sparkSession)
    return Model(weights, bias, slope, offset, bits)


_RESULT = f"{_STATS}, base_failed boolean, probability double, kept boolean"


def verdict(model: Model | None, spark, keep_at: float = KEEP_AT):
    """A vectorised function of a text column that gives a struct of _RESULT.

    The model has 2 ** (BITS + 1) floats whatever the input, so it may be broadcast.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        own, parts = shared.value, []
        for _, _, chunk in C.chunks(texts, CHUNK_BYTES):
            words = chunk.tokens()
            h = words.hashes()
            stats = base_stats(chunk, words, h)
            failed = base_failed(stats)
            p = own.probability(features(chunk, words, h, own.bits)) if own is not None else np.ones(chunk.n)
            parts.append([*stats.values(), failed, np.broadcast_to(np.asarray(p, dtype=np.float64), (chunk.n,)), ~failed & (p >= keep_at)])
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        columns = [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], kinds[i]) for i in range(8)]
        return pa.StructArray.from_arrays(columns, names=names)

    return judge


def annotate(docs: DataFrame, model: Model | None, *, text_col: str = "text", into: str = "__quality", keep_at: float = KEEP_AT) -> DataFrame:
    """docs with a struct column of the rule counts, the probability and the verdict."""
    return docs.withColumn(into, verdict(model, docs.sparkSession, keep_at)(F.col(text_col)))


def keep_good(docs: DataFrame, model: Model | None, **options) -> DataFrame:
    """The rows of docs that pass; their columns are as they were."""
    return annotate(docs, model, **options).where("__quality.kept").drop("__quality")
