"""Toxicity by maximum-scoring segments over token log-odds.

Training: on a bounded sample of labelled rows (``per_class``: the ids of smallest hash, and
the bytes of ``quality.sample``) each token gets its log-odds between toxic and clean documents
under a Dirichlet prior in proportion to its overall share. Evidence for a toxic text counts by
the lower end of its interval, evidence against it as it is; every token costs ``COST``
besides, as does one that the sample doesn't have, so that chance alone drifts downwards. All
tokens of the sample are kept. The n-th time that a text has a token its score counts an n-th
if it is above 0.

Scoring: a linear scan finds all maximal segments of positive total in the whole text. The
scores that clean rows get in this scan give Karlin-Altschul's lambda, their best segments K;
these turn a segment's total S among n tokens into the evidence lambda * S - ln(K * n). A
segment is significant where this is above ``SIGNIFICANT``. A text's evidence is that of its
best segment plus the positive evidence of its others. A logistic curve through the sample,
weighted to the classes' true shares, gives the score.

Cases: null or empty texts have no segment and get the evidence of an empty scan; without
labels of both classes every score is 0; an empty table gives no rows; a token of any length
and a text of any length are taken whole; equal totals keep the order of their places; repeated
rows are scored each; other columns and their names play no part. Labels, lang, source and ids
are never inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .quality import platt, sample

PER_CLASS = {0: 12000, 1: 4000}
PRIOR = 20.0
COST = 0.25
INTERVAL = 2.6
SIGNIFICANT = 3.0
PREDICT_AT = 0.3
#: Steps of a score's histogram, and the scores that it covers; those beyond count at its ends.
_STEP, _LOW, _HIGH = 0.05, -10.0, 20.0
_BINS = int((_HIGH - _LOW) / _STEP)

#: Tokens are runs of ASCII letters and digits and of all bytes beyond ASCII.
_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BITMAP = 20


def _tokens(chunk: C.Chunk) -> tuple[C.Tokens, np.ndarray]:
    t = chunk.tokens(_APART)
    return t, t.hashes(11, _LOWER)


class Table:
    """Scores by token hash."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], scores[order].astype(np.float32)
        self.bitmap = np.zeros(1 << _BITMAP, dtype=bool)
        self.bitmap[(self.keys >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of h that are in the table, and their scores."""
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITMAP)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], np.zeros(0, np.float32)
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        return at[hit], self.scores[k[hit]]


class Model:
    def __init__(self, words: Table, decay: float = 1.0, log_k: float = 0.0, slope: float = 1.0, offset: float = 0.0):
        self.words, self.decay, self.log_k, self.slope, self.offset = words, decay, log_k, slope, offset

    def scores(self, t: C.Tokens, h: np.ndarray) -> np.ndarray:
        """The score of each token as it stands in its text."""
        out = np.full(len(h), -COST, dtype=np.float64)
        at, s = self.words.find(h)
        out[at] = s
        hits = np.flatnonzero(out > 0)
        doc = np.searchsorted(t.first, hits, side="right") - 1
        order = np.lexsort((h[hits], doc))
        new = np.ones(len(hits), dtype=bool)
        new[1:] = (h[hits[order[1:]]] != h[hits[order[:-1]]]) | (doc[order[1:]] != doc[order[:-1]])
        begin = np.flatnonzero(new)
        out[hits[order]] /= 1 + np.arange(len(hits)) - np.repeat(begin, np.diff(np.append(begin, len(hits))))
        return out

    def scan(self, chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, int, int]]]]:
        """All tokens' scores, each document's first token, and its maximal segments (total, from, to) by token."""
        t, h = _tokens(chunk)
        scores = self.scores(t, h)
        hits = np.flatnonzero(scores > 0)
        bounds = np.searchsorted(hits, t.first)
        found = []
        for d in range(chunk.n):
            lo, own = int(t.first[d]), hits[bounds[d] : bounds[d + 1]]
            found.append([] if not len(own) else segments(own - lo, scores[own], scores[lo : int(t.first[d + 1])]))
        return scores, t.first, found

    def evidence(self, n: int, totals) -> tuple[float, list[float]]:
        """Of a text of n tokens, and of each of its segments."""
        base = self.log_k + math.log(max(n, 1))
        each = [self.decay * s - base for s in totals]
        if not each:
            return -base, each
        best = max(range(len(each)), key=each.__getitem__)
        return each[best] + sum(x for i, x in enumerate(each) if i != best and x > 0), each

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.offset))))


def segments(at: np.ndarray, gain: np.ndarray, scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments of a sequence of which only the positions at score above 0.

    One pass with a stack of candidates, each with the running sums before and after it;
    a candidate joins the last one that starts lower and ends lower than it does.
    """
    total = np.cumsum(scores)
    # (sum before, sum after, from, to, the nearest candidate below that starts lower)
    stack: list[tuple[float, float, int, int, int]] = []
    for p, g in zip(at.tolist(), gain.tolist(), strict=True):
        high = float(total[p])
        low, start = high - g, p
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= high:
                stack.append((low, high, start, p + 1, j))
                break
            low, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(high - low, a, b) for low, high, a, b, _ in stack]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, number of toxic and of clean documents that have the token, by batch."""
    for batch in batches:
        label = np.asarray(batch.column("label"))
        keys = []
        for lo, _, chunk in C.chunks(batch.column("text")):
            t, h = _tokens(chunk)
            doc = t.doc()
            toxic = label[lo : lo + chunk.n] == 1
            order = np.lexsort((h, doc))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            keys.append((h[order][new], toxic[doc[order][new]]))
        h = np.concatenate([x for x, _ in keys] or [np.zeros(0, np.uint64)])
        toxic = np.concatenate([x for _, x in keys] or [np.zeros(0, bool)])
        at, where = np.unique(h, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.view(np.int64)), pa.array(np.bincount(where, weights=toxic, minlength=len(at)).astype(np.int64)), pa.array(np.bincount(where, weights=~toxic, minlength=len(at)).astype(np.int64))],
            ["h", "toxic", "clean"],
        )


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens in so many of n_toxic and n_clean documents: log-odds under the prior, and their deviation."""
    share = (toxic + clean) / (n_toxic + n_clean)
    pull = prior * (share + 0.01)
    a, b, more = toxic + pull, clean + pull, 1.01 * prior
    return np.log(a / (n_toxic + more - a)) - np.log(b / (n_clean + more - b)), np.sqrt(1 / a + 1 / b)


def token_scores(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, prior: float = PRIOR) -> np.ndarray:
    odds, deviation = log_odds(toxic, clean, n_toxic, n_clean, prior)
    return np.where(odds > INTERVAL * deviation, odds - INTERVAL * deviation, np.minimum(odds, 0)) - COST


def _scan_sample(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """label, number of tokens, segment totals; in a chunk's first row the histogram of the scores of its clean rows."""
    model = shared.value
    for batch in batches:
        label = np.asarray(batch.column("label"))
        for lo, _, chunk in C.chunks(batch.column("text")):
            scores, first, found = model.scan(chunk)
            n = np.diff(first)
            clean = scores[np.repeat(label[lo : lo + chunk.n] == 0, n)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").slice(lo, chunk.n),
                    pa.array(n, pa.int64()),
                    pa.array([[s for s, _, _ in x] for x in found], pa.list_(pa.float64())),
                    pa.array([histogram(clean).tolist()] + [None] * (chunk.n - 1), pa.list_(pa.int64())),
                ],
                ["label", "n", "totals", "steps"],
            )


def histogram(scores: np.ndarray) -> np.ndarray:
    """Counts of scores by the step that they end in, rounded upwards."""
    return np.bincount(np.clip(np.ceil((scores - _LOW) / _STEP).astype(np.int64), 0, _BINS), minlength=_BINS + 1)


def decay(counts: np.ndarray) -> float:
    """Karlin-Altschul's lambda: the positive root of E[exp(lambda * score)] = 1 over a histogram."""
    values = _LOW + _STEP * np.arange(_BINS + 1)
    p = counts / max(1, counts.sum())
    lo, hi = 0.0, 3.0
    if not (values * p).sum() < 0 or not p[values > 0].any():
        return 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if float((p * np.exp(mid * values)).sum()) > 1 else (mid, hi)
    return lo


def fit(docs: DataFrame, labels: DataFrame, *, per_class: dict[int, int] | None = None, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """None if one of the classes has no labelled row that may be learned from."""
    spark = docs.sparkSession
    own = labels.where((F.crc32(F.col(id_col).cast("string")) % 4 != 2) & F.col("toxic").isNotNull())
    share = {r["toxic"]: r["n"] for r in own.groupBy(F.col("toxic").cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not share.get(0) or not share.get(1):
        return None
    # copies of one text would make its chance words look like evidence
    rows = C.settle(sample(docs, labels, "toxic", per_class or PER_CLASS, id_col, text_col).dropDuplicates(["text", "label"]))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    got = rows.mapInArrow(_counts, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    words = Table(np.asarray(got["h"]).view(np.uint64), token_scores(np.asarray(got["toxic"]), np.asarray(got["clean"]), sizes[1], sizes[0], prior))
    model = Model(words)
    shared = spark.sparkContext.broadcast(model)
    got = rows.mapInArrow(lambda it: _scan_sample(it, shared), "label int, n long, totals array<double>, steps array<long>").toArrow()
    y, n = np.asarray(got["label"]), np.asarray(got["n"])
    totals = [np.asarray(x.values) if len(x.values) else np.zeros(0) for x in got["totals"]]
    model.decay = decay(np.sum([np.asarray(x.values) for x in got["steps"] if x.is_valid], axis=0))
    # the mean of a Gumbel variable is Euler's constant above its mode
    top = sorted(model.decay * x.max(initial=0.0) - math.log(max(k, 1)) for x, k, c in zip(totals, n.tolist(), y, strict=True) if c == 0)
    model.log_k = float(np.mean(top)) - 0.5772156649
    x = np.array([model.evidence(k, t)[0] for t, k in zip(totals, n.tolist(), strict=True)])
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    weight = np.where(y == 1, share[1] / sizes[1], share[0] / sizes[0])
    model.slope, model.offset = platt(x, y, weight * len(y) / weight.sum())
    return model


_SEGMENT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())])
_RESULT = "score double, evidence double, n_tokens long, segments array<struct<start: long, end: long, evidence: double>>"


def scorer(model: Model | None, spark):
    """A vectorised function of a text column that gives a struct of _RESULT.

    segments has all significant passages in order, as ranges of tokens. The model grows with
    the sample only, whose bytes are bounded, so it may be broadcast.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def score(texts: pa.Array) -> pa.Array:
        own, rows = shared.value, []
        for _, _, chunk in C.chunks(texts):
            if own is None:
                rows += [(0.0, 0.0, int(n), []) for n in np.diff(chunk.tokens(_APART).first)]
                continue
            _, first, found = own.scan(chunk)
            for n, spans in zip(np.diff(first).tolist(), found, strict=True):
                x, each = own.evidence(n, [s for s, _, _ in spans])
                rows.append((own.probability(x), x, n, [(a, b, e) for (_, a, b), e in zip(spans, each, strict=True) if e > SIGNIFICANT]))
        kinds = [pa.float64(), pa.float64(), pa.int64(), pa.list_(_SEGMENT)]
        names = ["score", "evidence", "n_tokens", "segments"]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return score


def annotate(docs: DataFrame, model: Model | None, *, text_col: str = "text", into: str = "__toxicity") -> DataFrame:
    return docs.withColumn(into, scorer(model, docs.sparkSession)(F.col(text_col)))
