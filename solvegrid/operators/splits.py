"""Seeded samples and splits. The order is an explicit key, so every engine gives the same rows.

Rows are numbered by buckets of the key: the counts of the buckets before, and the place
within one's own. So the largest task has a bucket of a group, never all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys are whole numbers from 0 below this.
SPACE = 1000003
BUCKETS = 64


def arithmetic_key(id_col: str, seed: int) -> Column:
    """A portable pseudo-random key."""
    return F.pmod(F.col(id_col) * 7919 + F.lit(seed * 104729 + 12345), F.lit(SPACE))


def hash_key(id_col: str, seed: int) -> Column:
    """A pseudo-random key of ids of any type."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(SPACE))


def ranked(df: DataFrame, key: Column, id_col: str, by: list[str] | None = None) -> DataFrame:
    """df with rn from 1 and n, by the key and then the id, within each group; null groups are groups."""
    by = by or []
    placed = df.withColumn("__key", key).withColumn("__bucket", F.floor(F.col("__key") * BUCKETS / SPACE))
    counts = placed.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # at most BUCKETS rows for each group
    group, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(group).alias("n"))
    same = F.col("__bucket") == F.col("__b")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    own = Window.partitionBy(*by, "__bucket").orderBy("__key", id_col)
    out = placed.withColumn("__within", F.row_number().over(own)).join(totals, same)
    return out.select(*df.columns, (F.col("__before") + F.col("__within")).alias("rn"), "n")


def numbered(df: DataFrame, id_col: str, seed: int, by: list[str] | None = None, key: Column | None = None) -> DataFrame:
    return ranked(df, arithmetic_key(id_col, seed) if key is None else key, id_col, by)


def ratio_head(df: DataFrame, id_col: str, ratio: float, seed: int, key: Column | None = None) -> DataFrame:
    """That share of the rows, in seeded order; at least one."""
    rows = numbered(df, id_col, seed, key=key)
    return rows.where(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * ratio))).drop("rn", "n")


def train_holdout(df: DataFrame, id_col: str, size: int, seed: int, key: Column | None = None) -> DataFrame:
    """The first rows in seeded order are for training, the others are held out."""
    rows = numbered(df, id_col, seed, key=key)
    return rows.withColumn("split", F.when(F.col("rn") <= size, "train").otherwise("holdout")).drop("rn", "n")


def sample(df: DataFrame, id_col: str, most: int, seed: int, by: list[str] | None = None, key: Column | None = None) -> DataFrame:
    """At most so many rows, or of each group; without replacement."""
    return numbered(df, id_col, seed, by, key).where(F.col("rn") <= most).drop("rn", "n")


def balanced(df: DataFrame, id_col: str, category: str, seed: int) -> DataFrame:
    """Every category is cut to the smallest one's size N; validation and test take N // 12 each."""
    rows = numbered(df, id_col, seed, [category])
    least = df.groupBy(category).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("cap"))
    rows = rows.join(F.broadcast(least)).where(F.col("rn") <= F.col("cap"))
    part = F.floor(F.col("cap") / 12)
    split = F.when(F.col("rn") <= part, "val").when(F.col("rn") <= 2 * part, "test").otherwise("train")
    return rows.select(id_col, category, split.alias("split"))


def quota(df: DataFrame, id_col: str, sizes: dict[str, int], by: list[str], seed: int) -> DataFrame:
    """The first sizes[a] rows of each group go to a, the next to b, and so on; the rest to leftover.

    A group with fewer rows than all sizes together fills them in order, so that the last have none.
    """
    rows, start, split = numbered(df, id_col, seed, by), 0, None
    for name, size in sizes.items():
        cond = F.col("rn") <= start + size
        split = F.when(cond, name) if split is None else split.when(cond, name)
        start += size
    return rows.select(id_col, *by, split.otherwise("leftover").alias("split"))


def stratified(df: DataFrame, id_col: str, stratum: str, seed: int, share: float = 0.2) -> DataFrame:
    """At least one row of each stratum is held out; halves round to even. A stratum without rows isn't there."""
    rows = numbered(df, id_col, seed, [stratum])
    held = F.greatest(F.lit(1), F.bround(F.col("n") * share))
    return rows.select(id_col, stratum, F.when(F.col("rn") <= held, "heldout").otherwise("train").alias("split"))


def folds(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """k folds in seeded order; the first n % k are one larger."""
    size, larger = F.floor(F.col("n") / k), F.col("n") % k
    edge = larger * (size + 1)
    fold = F.when(F.col("rn") <= edge, F.ceil(F.col("rn") / (size + 1))).otherwise(larger + F.ceil((F.col("rn") - edge) / F.greatest(size, F.lit(1))))
    return numbered(df, id_col, seed).select(id_col, fold.cast("int").alias("fold"))


def batches(df: DataFrame, id_col: str, epochs: int, size: int, seed: int) -> DataFrame:
    """epoch, batch, id: each epoch in an order of its own, cut into batches."""
    each = df.select(id_col).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    key = F.pmod(F.col(id_col) * (7919 + 2 * F.col("epoch")) + F.lit(seed), F.lit(SPACE))
    return ranked(each, key, id_col, ["epoch"]).select("epoch", F.floor((F.col("rn") - 1) / size).alias("batch"), id_col)


def few_shot(members: DataFrame, seed: int) -> DataFrame:
    """expert_id, instruction, place: one of each expert's past solves, then others up to the number of experts.

    members has expert_id and history, an array of instructions; all choices go by a seeded hash.
    """
    each = members.select("expert_id", F.explode("history").alias("instruction"))
    key = F.xxhash64("expert_id", "instruction", F.lit(seed))
    first = each.withColumn("__key", key).withColumn("__nth", F.row_number().over(Window.partitionBy("expert_id").orderBy("__key", "instruction")))
    # a roster and its short histories: a handful of rows
    order = F.struct((F.col("__nth") > 1).alias("extra"), "__key", "expert_id", "instruction")
    chosen = first.withColumn("__rank", F.row_number().over(Window.partitionBy().orderBy(order))).join(F.broadcast(members.agg(F.count(F.lit(1)).alias("__most"))))
    kept = chosen.where((F.col("__rank") <= F.col("__most")) | (F.col("__nth") == 1))
    place = F.row_number().over(Window.partitionBy().orderBy(F.xxhash64("expert_id", "instruction", F.lit(seed + 1)), "expert_id", "instruction"))
    return kept.select("expert_id", "instruction", place.alias("place"))
