"""Exact top-k by inner product, exhaustive and term at a time.

Components become whole numbers, floor(scale * x) in double. Vectors are dealt by a hash of
their id into blocks of about ``BLOCK`` candidates and ``QUERIES`` queries. Each block of
queries meets each block of candidates once, by an equi-join on the pair of their numbers.
There a candidate block is turned into postings by term: a query's non-zero terms add their
weighted postings into a dense array of scores, and a partition selection keeps the k best.
The selections of a query are then merged. All arithmetic is on integers and exact.

Cases: vectors that are null, empty or hold a null or non-finite component, and rows with a
null id, take no part; shorter vectors count as padded by zeros; equal rows asked twice are
one query; candidates that repeat stay repeated; ties go to the smaller id; a component whose
product with scale is beyond the range of a double counts as the nearest double, a score beyond
that of a long is given as the nearest long; an empty table, or one without queries, gives no
rows; other columns and their names play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK = 4096
QUERIES = 1024
SCALE = 64


def _pack(batches: Iterator[pa.RecordBatch], scale: float, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, vector), sorted by block and id, to packed blocks; at most so many rows in each."""
    names = ["block", "n", "dims", "ids", "weights"]
    held: list[tuple[int, np.ndarray]] = []
    now = None

    def flush() -> pa.RecordBatch:
        dims = max(len(v) for _, v in held)
        m = np.zeros((len(held), dims))
        for i, (_, v) in enumerate(held):
            m[i, : len(v)] = v
        ids = np.array([i for i, _ in held], dtype="<i8")
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([m.astype("<f8").tobytes()], pa.binary())], names)

    for batch in batches:
        for block, i, v in zip(batch.column("block").to_pylist(), batch.column("id").to_pylist(), batch.column("v"), strict=True):
            if not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = np.asarray(v.values, dtype=np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                x = np.nan_to_num(np.floor(x * scale))
            if held and (block != now or len(held) >= most):
                yield flush()
            now = block
            held.append((i, x))
    if held:
        yield flush()


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["weights"], "<f8").reshape(row["n"], row["dims"])


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> Iterator[np.ndarray]:
    """For each query row the exact scores of all candidate rows."""
    dims = min(queries.shape[1], candidates.shape[1])
    queries, candidates = queries[:, :dims], candidates[:, :dims]
    bound = dims * max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(candidates).max(initial=0))
    if bound >= 2**62:
        queries, candidates = (np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (queries, candidates))
        for q in queries:
            yield candidates @ q if dims else np.zeros(len(candidates), dtype=object)
        return
    kind = np.int32 if bound < 2**31 else np.int64
    queries = queries.astype(kind)
    postings = []
    for t in range(dims):
        w = candidates[:, t].astype(kind)
        at = np.flatnonzero(w)
        postings.append((at, w[at]) if 4 * len(at) < len(w) else (None, w))
    score, term = np.empty(len(candidates), dtype=kind), np.empty(len(candidates), dtype=kind)
    for q in queries:
        score[:] = 0
        for t in np.flatnonzero(q):
            at, w = postings[t]
            if at is None:
                np.multiply(w, q[t], out=term)
                np.add(score, term, out=score)
            else:
                score[at] += w * q[t]
        yield score


def select(score: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best but own, by score and then the smaller id, in no set order."""
    ok = np.flatnonzero(ids != own)
    score, ids = score[ok], ids[ok]
    if len(score) > k:
        if score.dtype == object:
            least = sorted(score, reverse=True)[k - 1]
        else:
            least = np.partition(score, len(score) - k)[len(score) - k]
        above, even = np.flatnonzero(score > least), np.flatnonzero(score == least)
        even = even[np.argsort(ids[even], kind="stable")][: k - len(above)]
        take = np.concatenate([above, even])
        score, ids = score[take], ids[take]
    return score, ids


def search(vectors: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row that is_query holds for."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    n = own.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, groups = max(1, -(-n["n"] // block)), max(1, -(-n["q"] // queries))

    def packed(rows: DataFrame, number: int, most: int) -> DataFrame:
        placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(number)).cast("int")).select("block", "id", "v")
        placed = placed.repartition(number, "block").sortWithinPartitions("block", "id")
        return placed.mapInArrow(lambda it: _pack(it, scale, most), "block int, n int, dims int, ids binary, weights binary")

    asked = packed(own.where("asks").select("id", "v").distinct(), groups, queries).withColumnRenamed("block", "g").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    given = packed(own, blocks, block).withColumnRenamed("block", "c").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        top = np.iinfo(np.int64)
        for a in left.to_pylist():
            q_ids, q = _unpack(a)
            for b in right.to_pylist():
                ids, m = _unpack(b)
                for i, score in zip(q_ids, accumulate(q, m), strict=True):
                    s, v = select(score, ids, i, k)
                    out_q.append(np.full(len(s), i, dtype=np.int64))
                    out_v.append(v)
                    out_s.append(np.array([min(max(int(x), top.min), top.max) for x in s], dtype=np.int64) if s.dtype == object else s.astype(np.int64))
        empty = [np.zeros(0, np.int64)]
        return pa.table({"query_id": np.concatenate(out_q or empty), "vec_id": np.concatenate(out_v or empty), "score": np.concatenate(out_s or empty)})

    # copies under other schemas, so that the two sides' columns don't meet
    found = asked.groupBy("g", "c").cogroup(given.groupBy("g", "c")).applyInArrow(meet, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the query over the table embeddings.
SQL = """
WITH v AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score FROM (SELECT DISTINCT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
