"""pass@k, judged scores, retrieval weights and label packages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import router_tokens


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The unbiased estimate 1 - prod(1 - k / i) for i from n - c + 1 to n; 1 if n - c < k; null if n < k."""
    terms = F.sequence((n - c + 1).cast("int"), n.cast("int"))
    return F.when(n < k, F.lit(None)).when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1 - F.aggregate(terms, F.lit(1.0), lambda s, i: s * (1 - k / i)))


def pass_table(attempts: DataFrame, task: str, ok: str, ks: list[int], by: str | None = None) -> DataFrame:
    """pass@k over tasks, overall and by group; null unless every task has k attempts."""
    each = attempts.groupBy(task, *([by] if by else [])).agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("c"))
    score = [F.when(F.min("n") >= k, F.round(F.avg(pass_at_k(F.col("n"), F.col("c"), k)), 9)).alias(f"pass_at_{k}") for k in ks]
    if by is None:
        return each.agg(*score, F.count(F.lit(1)).alias("tasks"))
    whole = each.agg(*score, F.count(F.lit(1)).alias("tasks")).withColumn(by, F.lit("overall"))
    return whole.unionByName(each.groupBy(by).agg(*score, F.count(F.lit(1)).alias("tasks")))


def merge_metrics(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Averages merged by their sizes."""
    both = old.select(key, "mean", "n").unionByName(new.select(key, "mean", "n"))
    return both.groupBy(key).agg(F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 9).alias("mean"), F.sum("n").alias("n"))


def category_means(rows: DataFrame, categories: str, score: str) -> DataFrame:
    """Each row counts in each of its categories."""
    return rows.select(F.explode(categories).alias("category"), score).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 9).alias("mean"))


def judged(rows: DataFrame, file: str) -> DataFrame:
    """Passes before, by the judge, and by either; for each file and for all."""
    either = F.greatest("before", "judge")
    return rows.rollup(file).agg(F.count(F.lit(1)).alias("n"), F.sum("before").alias("before"), F.sum("judge").alias("judge"), F.sum(either).alias("either")).withColumn(file, F.coalesce(file, F.lit("all")))


def confusion(rows: DataFrame, gold: str, pred: str, labels: list) -> DataFrame:
    """Counts for every pair of labels, zeros too, and the accuracy of each gold label."""
    grid = rows.sparkSession.createDataFrame([(g, p) for g in labels for p in labels], "gold string, pred string")
    counts = rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    full = grid.join(counts, ["gold", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    hit = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).over(Window.partitionBy("gold"))
    return full.withColumn("accuracy", F.round(F.try_divide(hit, F.sum("n").over(Window.partitionBy("gold"))), 9))


def terms(docs: DataFrame, id_col: str, text_col: str, hashed: bool = False) -> DataFrame:
    """id, term, tf; hashed: terms as 64-bit hashes, which are cheaper to group by where the words themselves aren't needed."""
    each = docs.select(F.col(id_col).alias("id"), F.explode(router_tokens(F.col(text_col))).alias("term"))
    if hashed:
        each = each.select("id", F.xxhash64("term").alias("term"))
    return each.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(pool: DataFrame) -> DataFrame:
    """ln((n + 1) / (df + 1)) + 1 over the pool's terms."""
    n = pool.agg(F.countDistinct("id").alias("n"))
    df = pool.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


#: Queries and pool rows that meet in one task.
QUERIES, POOL = 2048, 8192


def vectors(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """id, terms: a vector of length 1 over the pool's vocabulary, as an array of (h, a hash of the term; w)."""
    hashed = rows.schema["term"].dataType == T.LongType()
    own = rows if hashed else rows.withColumn("term", F.xxhash64("term"))
    own = own.join(weights.select(F.xxhash64("term").alias("term"), "idf"), "term").select("id", F.col("term").alias("h"), (F.col("tf") * F.col("idf")).alias("w"))
    whole = own.groupBy("id").agg(F.collect_list(F.struct("h", "w")).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return whole.select("id", F.transform("t", lambda x: F.struct(x["h"].alias("h"), F.when(F.col("norm") > 0, x["w"] / F.col("norm")).otherwise(x["w"]).alias("w"))).alias("terms"))


def _meet(left: pa.Table, right: pa.Table, k: int, grouped: bool) -> pa.Table:
    """The k best of a block of the pool for each query: postings by term are scattered into dense scores."""
    pool, of = right["id"].combine_chunks(), right["terms"].combine_chunks()
    row = np.repeat(np.arange(len(pool)), np.asarray(of.value_lengths()))
    h, w = (np.asarray(of.flatten().field(c)) for c in ("h", "w"))
    order = np.lexsort((row, h))
    h, w, row = h[order], w[order], row[order]
    group = np.asarray(right["grp"].combine_chunks()) if grouped else np.arange(len(pool))
    ids = np.asarray(pool)
    out = []
    for query, terms in zip(left["query"].to_pylist(), left["terms"].combine_chunks(), strict=True):
        q = np.asarray(terms.values.field("h"))
        by = np.argsort(q)
        q, qw = q[by], np.asarray(terms.values.field("w"))[by]
        lo, hi = np.searchsorted(h, q, "left"), np.searchsorted(h, q, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        whole = np.bincount(row[at], weights=w[at] * np.repeat(qw, n), minlength=len(ids))
        score = np.round(whole, 9)
        hit = np.flatnonzero(np.bincount(row[at], minlength=len(ids)))
        best = hit[np.lexsort((ids[hit], -score[hit]))]
        if grouped:
            best = best[np.sort(np.unique(group[best], return_index=True)[1])]
        best = best[:k]
        out.append((np.full(len(best), query), ids[best], score[best], np.round(whole[best], 6), group[best]))
    parts = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(5)]
    return pa.table({"query": parts[0].astype(np.int64), "id": parts[1].astype(np.int64), "by": parts[2].astype(np.float64), "score": parts[3].astype(np.float64), "grp": parts[4].astype(np.int64)})


def retrieve(queries: DataFrame, pool: DataFrame, k: int, group: DataFrame | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """query, id, score, rank: the k best of the pool by cosine, exactly; at most one of each group, if given.

    Blocks of queries meet blocks of the pool once each, dealt by hash, whatever terms they share.
    Their numbers follow from sizes, how many queries and pool rows there are at most; without, both
    are counted. Scores have six decimals; those that agree in nine are equal, and the smaller id comes
    first. Ids and groups are whole numbers; only rows that share a term with the query are found.
    The queries' terms may be hashed, the pool's are words.
    """
    weights, grouped = idf(pool), group is not None
    p, q = vectors(pool, weights), vectors(queries, weights).withColumnRenamed("id", "query")
    if group is not None:
        p = p.join(group.select("id", F.col("grp").cast("long").alias("grp")), "id")
    n_queries, n_pool = sizes or [d.agg(F.countDistinct("id")).first()[0] for d in (queries, pool)]
    blocks, groups = max(1, -(-n_pool // POOL)), max(1, -(-n_queries // QUERIES))
    q = q.withColumn("g", F.pmod(F.xxhash64("query"), F.lit(groups))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    p = p.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    found = q.groupBy("g", "c").cogroup(p.groupBy("g", "c")).applyInArrow(lambda a, b: _meet(a, b, k, grouped), "query long, id long, by double, score double, grp long")
    order = [F.desc("by"), "id"]
    if group is not None:
        found = found.withColumn("__g", F.row_number().over(Window.partitionBy("query", "grp").orderBy(*order))).where("__g = 1").drop("__g")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query", "id", "score", "rank")


def census(rows: DataFrame, by: list[str], broken: Column) -> DataFrame:
    """n and the share of broken rows of each group, the largest first."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(broken.cast("int")), 9).alias("broken_rate")).orderBy(F.desc("n"), *by)


def support_report(rows: DataFrame, by: str, mode: Column, modes: list[str]) -> DataFrame:
    """A row for each group with a count of each mode, zeros too."""
    return rows.select(by, mode.alias("__mode")).groupBy(by).pivot("__mode", modes).agg(F.count(F.lit(1))).na.fill(0)


def tag_counts(rows: DataFrame, tag: Column) -> DataFrame:
    """How often each tag occurs; null is a tag."""
    return rows.select(tag.alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def category_means_of_all(rows: DataFrame, categories: str) -> DataFrame:
    """category, score, n, mean of every column whose name ends in _score; each row counts in each of its categories, nulls don't count."""
    names = [c for c in rows.columns if c.endswith("_score")]
    each = rows.select(F.explode(categories).alias("category"), F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).cast("double").alias("value")) for c in names])).alias("s"))
    return each.groupBy("category", "s.score").agg(F.count("s.value").alias("n"), F.round(F.avg("s.value"), 9).alias("mean"))


def select_for_expert(solve: DataFrame, totals: DataFrame, expert: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Problems that the expert solved, of at most `low` or at least `high` solvers."""
    own = solve.where((F.col("expert_id") == expert) & (F.col("solved") == 1)).join(totals, "problem_id")
    if low is not None:
        own = own.where(F.col("n_solved") <= low)
    if high is not None:
        own = own.where(F.col("n_solved") >= high)
    return own.select("problem_id", "n_solved")
