"""MinHash near-dedup with DartMinHash signatures.

A text is the weighted set of its shingles of five consecutive words, each weighted by its
count; a text of one to four words is one shingle. Similarity is the weighted Jaccard
similarity, and texts of 0.8 or more are near copies.

Signatures: every unit of weight, (shingle, occurrence), has its own sequence of darts, whose
ranks are the arrivals of a Poisson process and whose coordinates are uniform, both hashed
from the unit alone. A text of m units throws all darts up to a rank at which about
``k * (ln k + 4)`` fall on it, hence few for each unit if m is large, doubles the rank while a
coordinate is empty, and keeps the earliest dart of each coordinate. Two texts agree in a
coordinate with the probability of their similarity.

Classes:
1. Texts of equal shingles collapse to one node, a hash of their shingles, before anything is
   joined; so texts that share an id stay apart.
2. Signatures are cut into bands. In each bucket of a band every member is linked to the
   smallest node in it; these links, as many as members, are checked exactly on the shingles.
3. Where members of a bucket are still in different classes, they are compared within the
   bucket, block against block, by longer signatures, so that no chain is lost; what agrees in
   ``AGREE`` of the coordinates is checked exactly. Members of one class aren't compared. This is
   done twice: at first for the best pairs that would join the classes of a block (a spanning
   forest, so no more pairs than members), then for all pairs that are still between classes.
4. The classes of texts are the connected components of all checked links; those of ids have
   the nodes of each id as links besides.

A pair at similarity 0.8 meets in no bucket with probability 3e-6, at 0.9 below 1e-11.

Cases: texts without words (null, empty) are copies of each other; rows that share an id fall
in one class, since classes are of ids; ``keep_one`` goes by the classes of texts, so no text
goes unless a near copy, or a chain of them, stays; a null id counts as the smallest long; an empty table
gives an empty result; other columns and their names play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
BANDS, ROWS = 24, 4
#: In fifths: similarity is at least 4 of 5.
NUM, DEN = 4, 5
#: Coordinates of the longer signatures, a byte each, and the share of them that a pair of
#: similarity 0.8 falls below with probability 3e-5; the same for the first of them.
LONG, AGREE, FEW, AGREE_FEW = 512, 0.73, 64, 0.55
TILE = 2048
_U = np.uint64
_G1, _G2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def units(chunk: C.Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all (shingle, occurrence), by document, and the first index of each document."""
    words = chunk.tokens()
    h = words.hashes()
    at = np.flatnonzero(C.inside_doc(words.first, words.n, k))
    doc = words.doc()
    shingles, of = C.gram_hashes(h, k)[at], doc[at]
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        rel = np.arange(words.n) - np.repeat(words.first[:-1], n)
        whole = C.segment_sum(h * C.powers(0x9FB21C651E98DF25, k)[np.minimum(rel, k - 1)], words.first)
        shingles = np.concatenate([shingles, C.mix64(whole[short] + n[short].astype(_U))])
        of = np.concatenate([of, short])
    order = np.lexsort((shingles, of))
    shingles, of = shingles[order], of[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (of[1:] != of[:-1])
    begin = np.flatnonzero(new)
    nth = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
    return C.mix64(shingles + nth.astype(_U) * _G1), np.searchsorted(of, np.arange(chunk.n + 1))


def signatures(unit: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each coordinate, one row of k for each document with units; else zeros."""
    n = len(first) - 1
    m = np.diff(first)
    best = np.full(n * k, np.inf)
    dart = np.zeros(n * k, dtype=_U)
    limit = k * (math.log(k) + 4) / np.maximum(m, 1)
    doc = np.repeat(np.arange(n), m)
    rank = np.zeros(len(unit))
    thrown = np.zeros(len(unit), dtype=_U)

    def arrival(e: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = C.mix64(e + (j + _U(1)) * _G2)
        u = ((C.mix64(x ^ _G1) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        return x, -np.log(u)

    x, gap = arrival(unit, thrown)
    rank += gap
    open_docs = m > 0
    while open_docs.any():
        live = np.flatnonzero(open_docs[doc] & (rank <= limit[doc]))
        while len(live):
            at = doc[live] * k + (x[live] % _U(k)).astype(np.int64)
            r = rank[live]
            np.minimum.at(best, at, r)
            won = best[at] == r
            dart[at[won]] = x[live[won]]
            thrown[live] += _U(1)
            nx, gap = arrival(unit[live], thrown[live])
            x[live] = nx
            rank[live] = r + gap
            live = live[rank[live] <= limit[doc[live]]]
        open_docs = (m > 0) & np.isinf(best.reshape(n, k)).any(axis=1)
        limit = np.where(open_docs, limit * 2, limit)
    return dart.reshape(n, k)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), dtype=_U)
    for b in range(bands):
        key = np.full(len(sig), (b + 1) * int(_G1) % 2**64, dtype=_U)
        for r in range(rows):
            key = C.mix64(key ^ sig[:, b * rows + r])
        out[:, b] = key
    return out


def _sketch(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, chunk in C.chunks(batch.column("text"), 2 * C.CHUNK_BYTES):
            unit, first = units(chunk)
            sig = signatures(unit, first, bands * rows)
            keys = band_keys(sig, bands, rows).view(np.int64)
            offsets = pa.array(np.arange(0, (chunk.n + 1) * bands, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").slice(lo, chunk.n),
                    batch.column("tag").slice(lo, chunk.n),
                    pa.array(C.segment_sum(C.mix64(unit ^ _G1), first).view(np.int64)),
                    pa.array(C.segment_sum(C.mix64(unit ^ _G2), first).view(np.int64)),
                    pa.array(np.diff(first)),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                ],
                ["doc", "tag", "a", "b", "m", "bands"],
            )


def _unit_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, chunk in C.chunks(batch.column("text")):
            unit, first = units(chunk)
            sig = (signatures(C.mix64(unit + _G2), first, LONG) >> _U(50)).astype(np.uint8)
            a, b = (pa.array(C.segment_sum(C.mix64(unit ^ g), first).view(np.int64)) for g in (_G1, _G2))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(unit.view(np.int64))), pa.array([x.tobytes() for x in sig], pa.binary())], ["a", "b", "m", "units", "sig"])


def _checked(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (x, y, mx, my) whose similarity is NUM / DEN or more."""
    near = pairs.where(F.least("mx", "my") * DEN >= F.greatest("mx", "my") * NUM)
    both = near.join(lists.select(F.col("id").alias("x"), F.col("units").alias("ux")), "x").join(lists.select(F.col("id").alias("y"), F.col("units").alias("uy")), "y")
    both = both.select("x", "y", "mx", "my", F.size(F.array_intersect("ux", "uy")).cast("long").alias("same"))
    return both.where(F.col("same") * DEN >= (F.col("mx") + F.col("my") - F.col("same")) * NUM).select("x", "y")


def components(links: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """id, least: the smallest id of the connected component of each id in links.

    Large-star and small-star steps in turn: each hangs the neighbours of a node on the
    smallest of them, until all edges are (id, least id). Each is an aggregation and a join.
    """
    edges = C.settle(links.select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("low").alias("u")).where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(least, "v").where("u <> low").select(F.col("u").alias("v"), F.col("low").alias("u"))
        edges = C.settle(small.unionByName(least.select("v", F.col("low").alias("u"))).where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40))).alias("s")).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("least"))


def _forest(x: np.ndarray, y: np.ndarray, label: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of pairs of members, those that join labels when taken by falling share."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.get(v, v) != v:
            parent[v] = parent.get(parent[v], parent[v])
            v = parent[v]
        return v

    taken = []
    for i in np.lexsort((y, x, -share)).tolist():
        a, b = root(int(label[x[i]])), root(int(label[y[i]]))
        if a != b:
            parent[a] = b
            taken.append(i)
    return np.array(taken, dtype=np.int64)


def _compare(batches: Iterator[pa.RecordBatch], forest: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j), of the members of blocks i and j of a bucket, to pairs that agree and differ in class."""
    held: list[tuple] = []
    now = None

    def pairs() -> pa.RecordBatch | None:
        _, i, j = now
        ids, label, m, own = (np.array([r[c] for r in held], dtype=np.int64) for c in range(4))
        sig = np.frombuffer(b"".join(r[4] for r in held), np.uint8).reshape(len(held), LONG)
        bands = np.array([r[5] for r in held], dtype=np.int64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        few = np.ascontiguousarray(sig[:, :FEW])
        out, shares = [], []
        for lo in range(0, len(left), 64):
            a = left[lo : lo + 64]
            near = (few[a][:, None, :] == few[right][None, :, :]).sum(axis=2) >= AGREE_FEW * FEW
            near &= label[a][:, None] != label[right][None, :]
            near &= ids[a][:, None] < ids[right][None, :] if i == j else True
            p, q = np.nonzero(near)
            p, q = a[p], right[q]
            for at in range(0, len(p), 4096):
                x, y = p[at : at + 4096], q[at : at + 4096]
                share = (sig[x] == sig[y]).sum(axis=1)
                hit = share >= AGREE * LONG
                out.append((x[hit], y[hit]))
                shares.append(share[hit])
        if not out:
            return None
        p, q, share = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), np.concatenate(shares)
        p, q = np.where(ids[p] < ids[q], p, q), np.where(ids[p] < ids[q], q, p)
        if forest:
            take = _forest(p, q, label, share)
            p, q = p[take], q[take]
        else:
            # a pair that shares several buckets is given in the first of them only
            same = bands[p] == bands[q]
            here = bands[p, same.argmax(axis=1)] == now[0] if len(p) else np.zeros(0, dtype=bool)
            p, q = p[here], q[here]
        return pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(ids[q]), pa.array(m[p]), pa.array(m[q])], ["x", "y", "mx", "my"]) if len(p) else None

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j", "id", "label", "m", "own", "sig", "bands")], strict=True):
            if held and row[:3] != now:
                if found := pairs():
                    yield found
                held.clear()
            now = row[:3]
            held.append(row[3:])
    if held and (found := pairs()):
        yield found


def _across(met: DataFrame, label: DataFrame, lists: DataFrame, first: DataFrame, forest: bool) -> DataFrame | None:
    """Pairs (x, y, mx, my) of members of one bucket in different classes whose long signatures agree; None where no bucket has any."""
    rest = C.settle(met.where("n > 2 and id <> hub").join(label, "id", "left").select("key", "id", "m", F.coalesce("least", "id").alias("label")))
    mixed = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    mixed = C.settle(mixed.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
    if mixed.isEmpty():
        return None
    tiled = rest.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # lists has a row for each id of met
    both = lists.select("id", "sig").join(first.select("id", "bands"), "id")
    tiled = tiled.join(both, "id").select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "label", "m", "own", "sig", "bands")
    tiled = tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return tiled.mapInArrow(lambda it: _compare(it, forest), "x long, y long, mx long, my long").distinct()


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))


def _nodes(docs: DataFrame, bands: int, rows: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc, tag (a hash of the text), id (the node) of each row; id, least of each linked node."""
    node = F.xxhash64("a", "b", "m").alias("id")
    own = docs.select(_key(id_col).alias("doc"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    sketch = own.mapInArrow(lambda it: _sketch(it, bands, rows), "doc long, tag long, a long, b long, m long, bands array<long>")
    # written, as hubs are, so that the join deals both sides itself and can split a hot key
    sketch = C.settle(sketch.select("doc", "tag", node, "m", "bands"))
    # rows of one node have the same bands, whichever is taken
    first = C.settle(sketch.where("m > 0").groupBy("id").agg(F.min("doc").alias("doc"), F.first("m").alias("m"), F.first("bands").alias("bands")))
    buckets = first.select("id", "m", F.explode("bands").alias("key"))
    hubs = C.settle(buckets.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = C.settle(buckets.join(hubs, "key").select("key", "id", "m", "hub", "n"))
    involved = first.select("id", "doc").join(met.select("id").distinct(), "id", "left_semi").select("doc").distinct()
    # the same join at every size: the ids grow as the texts do
    lists = own.select("doc", "text").join(involved.hint("merge"), "doc", "left_semi").mapInArrow(_unit_lists, "a long, b long, m long, units array<long>, sig binary")
    lists = C.settle(lists.select(node, "units", "sig").dropDuplicates(["id"]))
    weights = met.where("id = hub").select(F.col("id").alias("x"), F.col("m").alias("mx")).distinct()
    star = met.where("id <> hub").select(F.col("hub").alias("x"), F.col("id").alias("y"), F.col("m").alias("my")).distinct().join(weights, "x")
    links = C.settle(_checked(star, lists))
    label = components(links)
    for forest in (True, False):
        pairs = _across(met, label, lists, first, forest)
        if pairs is None:
            break
        more = C.settle(_checked(pairs, lists))
        if not more.isEmpty():
            # the classes so far count as links
            label = components(more.unionByName(_as_links(label)))
    return sketch.select("doc", "tag", "id"), label


def _as_links(label: DataFrame) -> DataFrame:
    return label.select(F.col("least").alias("x"), F.col("id").alias("y"))


def _least_docs(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """id, class: the smallest document id of the class of each node."""
    own = C.settle(nodes.groupBy("id").agg(F.min("doc").alias("doc")).join(label, "id", "left").select("id", "doc", F.coalesce("least", "id").alias("least")))
    return C.settle(own.join(C.settle(own.groupBy("least").agg(F.min("doc").alias("class"))), "least").select("id", "class"))


def classes(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id: the smallest id of the class of near copies of each row's id."""
    nodes, label = _nodes(docs, bands, rows, id_col, text_col)
    ids = C.settle(nodes.groupBy("doc").agg(F.min("id").alias("id"), F.max("id").alias("hi")))
    several = ids.where("id <> hi").select("doc", F.col("id").alias("x"))
    if not several.isEmpty():
        # the texts of one id are in one class
        label = components(nodes.select("doc", F.col("id").alias("y")).join(several, "doc").select("x", "y").unionByName(_as_links(label)))
    out = ids.select("doc", "id").join(_least_docs(nodes, label), "id").select(F.col("doc").alias("__id"), F.col("class").alias("class_id"))
    return docs.select(F.col(id_col).alias("doc_id"), _key(id_col).alias("__own")).join(out, F.col("__own") == F.col("__id")).select("doc_id", "class_id")


def keep_one(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their text's class of near copies; columns stay as they are."""
    nodes, label = _nodes(docs, bands, rows, id_col, text_col)
    kept = nodes.join(_least_docs(nodes, label), "id").where(F.col("doc") == F.col("class")).select(F.col("doc").alias("__class"), F.col("tag").alias("__tag")).distinct()
    # the same join at every size: the ids grow as the texts do
    return docs.join(kept.hint("merge"), (_key(id_col) == F.col("__class")) & (F.xxhash64(F.col(text_col)) == F.col("__tag")), "left_semi")
