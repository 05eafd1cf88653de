"""The solve relation: one row for each (problem, expert), dense, with solved 0 or 1.

A roster is a DataFrame (ordinal, expert_id); its ordinal settles every tie. A missing pair
means not solved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def densify(pairs: DataFrame, problems: DataFrame, roster: DataFrame) -> DataFrame:
    """All problems by all experts; pairs that aren't there count as 0. The roster is the small side by nature."""
    grid = problems.select("problem_id").distinct().withColumn("__e", F.lit(1)).join(roster.withColumn("__e", F.lit(1)), "__e").drop("__e")
    best = pairs.groupBy("problem_id", "expert_id").agg(F.max("solved").alias("solved"))
    return grid.join(best, ["problem_id", "expert_id"], "left").withColumn("solved", F.coalesce("solved", F.lit(0)))


def n_solved(solve: DataFrame) -> DataFrame:
    return solve.groupBy("problem_id").agg(F.sum("solved").alias("n_solved"), F.count(F.lit(1)).alias("n_experts"))


#: Experts that a mask has room for.
MASK = 63


def bit(ordinal: Column) -> Column:
    """The bit of an expert; an ordinal beyond the mask is an error."""
    fits = F.when((ordinal >= 0) & (ordinal < MASK), ordinal).otherwise(F.raise_error(F.lit(f"more than {MASK} experts don't fit a mask")).cast("long"))
    return F.call_function("shiftleft", F.lit(1).cast("long"), fits.cast("int"))


def bitmask(solve: DataFrame) -> DataFrame:
    """problem_id, mask: bit `ordinal` is set if that expert solved it."""
    return solve.groupBy("problem_id").agg(F.bit_or(F.when(F.col("solved") == 1, bit(F.col("ordinal"))).otherwise(F.lit(0).cast("long"))).alias("mask"))


def to_binned(solve: DataFrame) -> DataFrame:
    """problem_id, solved_by (by ordinal), n_solved, per_expert."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "expert_id", "solved")))
    own = solve.groupBy("problem_id").agg(rows.alias("r"))
    by = F.transform(F.filter("r", lambda x: x["solved"] == 1), lambda x: x["expert_id"])
    return own.select("problem_id", by.alias("solved_by"), F.size(by).alias("n_solved"), F.map_from_entries(F.transform("r", lambda x: F.struct(x["expert_id"], x["solved"]))).alias("per_expert"))


def from_binned(binned: DataFrame, roster: DataFrame) -> DataFrame:
    """The dense relation again; an expert that per_expert lacks hasn't solved the problem."""
    pairs = binned.select("problem_id", F.explode("per_expert").alias("expert_id", "solved"))
    return densify(pairs, binned, roster)


def solve_index(solve: DataFrame) -> DataFrame:
    """expert_id, problem_id, solved: the index of each expert in long form, so no row grows with the problems."""
    return solve.select("expert_id", "problem_id", (F.col("solved") == 1).alias("solved"))


def key_union(rows: DataFrame, keys: str, order: str) -> DataFrame:
    """expert_id, place: the keys of all rows' arrays, once each, by first appearance."""
    each = rows.select(order, F.posexplode(keys).alias("__i", "expert_id"))
    first = each.groupBy("expert_id").agg(F.min(F.struct(order, "__i")).alias("__first"))
    # a roster's keys: a handful of rows
    return first.select("expert_id", (F.row_number().over(Window.partitionBy().orderBy("__first", "expert_id")) - 1).alias("place"))
