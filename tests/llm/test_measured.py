"""What README says of the models and of near copies, measured on the synthetic tables."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute import jaccard, shingles

from solvegrid.llm import queries

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").distinct()
    got = queries.op2_toxicity(spark, SF).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    y = got.toxic.to_numpy()
    assert auc(got.score.to_numpy(), y) > 0.94
    assert got.predicted[y == 1].mean() > 0.8 and got.predicted[y == 0].mean() < 0.01


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").distinct()
    got = queries.op10_quality(spark, SF).where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).join(labels, "doc_id").select("kept", "base_failed", "quality").toPandas()
    good = got[got.quality == 1]
    assert good.kept.mean() > 0.93 and good[~good.base_failed].kept.mean() > 0.97
    assert got[got.quality == 0].kept.mean() < 0.03


def test_near_copies_by_similarity(spark):
    """All links at 0.8 or more are within classes, whose links are all of that kind; how many pairs lie below is README's table."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    own = {d: shingles(t) for d, t in rows}
    places = defaultdict(list)
    for d, s in own.items():
        for x in s:
            places[x].append(d)
    pairs = {p for ds in places.values() if len(ds) <= 200 for p in combinations(sorted(ds), 2)}
    similar, bands = [], Counter()
    for a, b in pairs:
        same, whole = jaccard(own[a], own[b])
        bands[int(10 * same / whole)] += 1
        if 5 * same >= 4 * whole:
            similar.append((a, b))
    got = {r.doc_id: r.class_id for r in queries.op1_minhash(spark, sf).collect()}
    assert len(similar) > 90 and all(got[a] == got[b] for a, b in similar)
    least = {d: d for d in own}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for a, b in similar:
        x, y = sorted((root(a), root(b)))
        least[y] = x
    empty = min((d for d, s in own.items() if not s), default=None)
    assert got == {d: root(d) if s else empty for d, s in own.items()}
    # nothing lies between the near copies that are too far apart for the threshold and chance
    assert bands[3] == 0
    print(sorted(bands.items()))


@pytest.mark.parametrize("table", ["documents", "conversations", "embeddings", "labels"])
def test_queries_on_empty_tables(spark, tmp_path, table):
    """An empty table gives no rows, or those of the added conversation; models do without it."""
    for t in ("documents", "conversations", "embeddings", "labels"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        (rows.limit(0) if t == table else rows).write.parquet(f"{tmp_path}/{t}.parquet")
    reads = {"documents": [n for n in queries.QUERIES if n not in ("op7_topk", "op9_chat")], "conversations": ["op9_chat"], "embeddings": ["op7_topk"], "labels": ["op2_toxicity", "op10_quality"]}[table]
    for name in reads:
        n = queries.QUERIES[name](spark, str(tmp_path)).count()
        assert n == {"documents": 0, "conversations": 1, "embeddings": 0}.get(table, spark.read.parquet(f"{tmp_path}/documents.parquet").count()), name
