"""Coverage of problems by experts: pass rates, unions, leave-one-out, histograms."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relation import bit, bitmask, n_solved

#: Combinations of experts that are compared at most.
SETS = 10_000


def pct(x):
    return F.round(F.avg(x) * 100, 6)


def pass_at_1(solve: DataFrame) -> DataFrame:
    return solve.groupBy("ordinal", "expert_id").agg(F.sum("solved").alias("n_solved"), F.count(F.lit(1)).alias("total"), pct("solved").alias("pass_pct"))


def union_ub(solve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of problems that anyone solves; 0 of no problems is 0."""
    any_ = solve.groupBy("problem_id", *(by or [])).agg(F.max("solved").alias("any"))
    return any_.groupBy(*(by or [])).agg(F.coalesce(F.sum("any"), F.lit(0)).alias("union_ub"), F.count(F.lit(1)).alias("total"), F.coalesce(pct("any"), F.lit(0.0)).alias("union_pct"))


def war(solve: DataFrame, roster: DataFrame) -> DataFrame:
    """Problems that only this expert solves, for each of the roster: what the union loses without it."""
    alone = n_solved(solve).where("n_solved = 1").select("problem_id")
    counts = solve.where("solved = 1").join(alone, "problem_id", "left_semi").groupBy("expert_id").agg(F.count(F.lit(1)).alias("war"))
    return roster.select("ordinal", "expert_id").join(counts, "expert_id", "left").select("ordinal", "expert_id", F.coalesce("war", F.lit(0)).alias("war"))


def exclusive(solve: DataFrame) -> DataFrame:
    """expert_id, problem_id: the problems that only this expert solves."""
    alone = n_solved(solve).where("n_solved = 1").select("problem_id")
    return solve.where("solved = 1").join(alone, "problem_id", "left_semi").select("expert_id", "problem_id")


def niche(solve: DataFrame, expert: str) -> DataFrame:
    """The problems that this expert solves and none of the others does."""
    done = solve.where("solved = 1")
    others = done.where(F.col("expert_id") != expert).select("problem_id")
    return done.where(F.col("expert_id") == expert).select("problem_id").join(others, "problem_id", "left_anti").distinct()


def recovered(niche_: DataFrame, passed: DataFrame) -> DataFrame:
    """niche_n, recovered_n, whole: how much of a niche a newcomer passes; an empty niche is recovered."""
    hit = niche_.join(passed.select("problem_id").distinct().withColumn("__in", F.lit(1)), "problem_id", "left")
    both = hit.agg(F.count(F.lit(1)).alias("niche_n"), F.count("__in").alias("recovered_n"))
    return both.withColumn("whole", F.col("niche_n") == F.col("recovered_n"))


def sparse_summary(pairs: DataFrame) -> DataFrame:
    """pass_at_1, war and the union for pairs (problem_id, ordinal, solved) of which not all are there; missing ones count as not solved and are never made."""
    own = bit(F.col("ordinal"))
    by = pairs.groupBy("problem_id").agg(F.bit_or(F.when(F.col("solved") == 1, own).otherwise(F.lit(0).cast("long"))).alias("mask"), F.bit_or(own).alias("seen"))
    masks = by.groupBy("mask", "seen").agg(F.count(F.lit(1)).alias("n"))
    total = masks.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("mask") != 0, F.col("n")).otherwise(0)).alias("union_ub"), F.max("seen").alias("__most"))
    # as many ordinals as the largest mask has bits
    each = masks.join(F.broadcast(total.select("__most"))).withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.log2(F.col("__most")) + 1e-9))))
    each = each.withColumn("bit", bit(F.col("ordinal")))
    solved, alone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask") == F.col("bit")
    out = each.where(F.col("seen").bitwiseAND(F.col("bit")) != 0).groupBy("ordinal").agg(F.sum(F.when(solved, F.col("n")).otherwise(0)).alias("n_solved"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("war"))
    return out.join(F.broadcast(total.drop("__most")))


def histogram(solve: DataFrame) -> DataFrame:
    return n_solved(solve).groupBy("n_solved").agg(F.count(F.lit(1)).alias("n_problems"))


def dense_histogram(solve: DataFrame, experts: int) -> DataFrame:
    buckets = solve.sparkSession.range(experts + 1).select(F.col("id").alias("n_solved"))
    return buckets.join(histogram(solve), "n_solved", "left").select("n_solved", F.coalesce("n_problems", F.lit(0)).alias("n_problems"))


def all_or_none(solve: DataFrame) -> DataFrame:
    return n_solved(solve).agg(F.count_if(F.col("n_solved") == F.col("n_experts")).alias("solved_by_all"), F.count_if(F.col("n_solved") == 0).alias("solved_by_none"))


def anchor(solve: DataFrame) -> DataFrame:
    """The expert of the highest rate; of equals, the one of the smallest ordinal."""
    rates = solve.groupBy("ordinal", "expert_id").agg(F.round(F.avg("solved"), 9).alias("rate"))
    return rates.orderBy(F.desc("rate"), "ordinal").limit(1)


def best_and_oracle(solve: DataFrame) -> DataFrame:
    best = solve.groupBy("expert_id").agg(F.avg("solved").alias("r")).agg(F.max("r").alias("best_single"), F.avg("r").alias("random_route"))
    top = solve.groupBy("problem_id").agg(F.max("solved").alias("any")).agg(F.avg("any").alias("oracle"))
    both = best.join(top)
    return both.select(*[F.round(c, 9).alias(c) for c in ("best_single", "random_route", "oracle")], F.round((F.col("random_route") - F.col("best_single")) / (F.col("oracle") - F.col("best_single") + 1e-9), 6).alias("headroom_recovery"))


def best_fixed_set(solve: DataFrame, experts: int, k: int) -> DataFrame:
    """The k experts of the largest union; of equals the first in order of combination.

    Problems are first counted by mask, of which there are at most 2 ** experts. More than SETS
    combinations are an error.
    """
    if comb(experts, k) > SETS:
        raise ValueError(f"{comb(experts, k)} sets of {k} experts, at most {SETS}")
    masks = bitmask(solve).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    sets = [(i, sum(1 << e for e in c), ",".join(f"e{e}" for e in c)) for i, c in enumerate(combinations(range(experts), k))]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("m"), F.lit(s).alias("members")) for i, m, s in sets]))
    return masks.select("mask", "n", rows.alias("s")).groupBy("s.i", "s.members").agg(F.sum(F.when(F.col("mask").bitwiseAND(F.col("s.m")) != 0, F.col("n")).otherwise(0)).alias("covered")).orderBy(F.desc("covered"), "i").limit(1).select("members", "covered")


def class_labels(solve: DataFrame, experts: int) -> DataFrame:
    """(all fail), (all solved) from experts - 1 on, or the solver that solves least, then of smallest ordinal."""
    load = solve.groupBy("ordinal", "expert_id").agg(F.sum("solved").alias("load"))
    solvers = solve.where("solved = 1").join(load.select("expert_id", "load"), "expert_id")
    rare = solvers.groupBy("problem_id").agg(F.min(F.struct("load", "ordinal", "expert_id")).alias("r"))
    label = F.when(F.col("n_solved") == 0, "(all fail)").when(F.col("n_solved") >= experts - 1, "(all solved)").otherwise(F.col("r.expert_id"))
    return n_solved(solve).join(rare, "problem_id", "left").select("problem_id", label.alias("label"))


def agreement(pairs: DataFrame, a: str, b: str, drop_a: tuple[str, ...] = (), drop_b: tuple[str, ...] = (), least: int = 50) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labelings, from their contingency table.

    Rows with a label to be dropped don't count; fewer rows than `least` give null.
    """
    for c, drop in ((a, drop_a), (b, drop_b)):
        pairs = pairs.where(~F.col(c).isin(*drop)) if drop else pairs
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    choose = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    entropy = lambda c: F.sum(-(F.col(c) / F.col("t")) * F.log(F.col(c) / F.col("t")))
    total = cells.agg(F.sum("n").alias("t"))
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias("m")) for c in (a, b))
    parts = [
        cells.join(total).agg(choose("n").alias("sc"), entropy("n").alias("hab"), F.max("t").alias("t")),
        rows.join(total).agg(choose("m").alias("sa"), entropy("m").alias("ha")),
        cols.join(total).agg(choose("m").alias("sb"), entropy("m").alias("hb")),
    ]
    one = reduce(lambda x, y: x.join(y), parts)
    expected = F.col("sa") * F.col("sb") / (F.col("t") * (F.col("t") - 1) / 2)
    ari = (F.col("sc") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)
    nmi = (F.col("ha") + F.col("hb") - F.col("hab")) / ((F.col("ha") + F.col("hb")) / 2)
    enough = lambda x: F.when(F.col("t") >= least, F.round(x, 4))
    return one.select(enough(ari).alias("ari"), enough(nmi).alias("nmi"))


def method_subset_accuracy(predictions: DataFrame, subsets: DataFrame) -> DataFrame:
    """method, subset, correct, n, accuracy; a problem may be in many subsets; an empty subset gives null."""
    hits = subsets.join(predictions, "problem_id", "left").groupBy("method", "subset").agg(F.sum("correct").alias("correct"), F.count("correct").alias("n"))
    return hits.where("method is not null").select("method", "subset", "correct", "n", F.round(F.try_divide("correct", "n"), 6).alias("accuracy"))


def id_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many ids only one side has, and how many both have."""
    a, b = left.select(key).distinct().withColumn("a", F.lit(1)), right.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full").agg(F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def plurality(solve: DataFrame) -> DataFrame:
    """Per problem the prediction of the largest confidence; each expert's agreement score with it."""
    votes = solve.groupBy("problem_id", "pred").agg(F.round(F.sum("conf"), 6).alias("w"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("problem_id").orderBy(F.desc("w"), "pred"))).where("r = 1").select("problem_id", F.col("pred").alias("plurality"))
    own = solve.join(best, "problem_id")
    return own.select("problem_id", "expert_id", "plurality", F.round((F.col("pred") == F.col("plurality")).cast("int") + 0.01 * F.col("conf"), 6).alias("score"))


def random_route(solve: DataFrame) -> DataFrame:
    """What a random pick of an expert is expected to solve: the mean of the experts' means."""
    return solve.groupBy("expert_id").agg(F.avg("solved").alias("mean")).agg(F.round(F.avg("mean"), 9).alias("expected"))


def score_file(results: DataFrame, id_col: str, score: str, show: int = 20) -> DataFrame:
    """n_passed, total, pass_pct, and the first failures by id. A score passes at 100, less a rounding error; fails on no results."""
    passed = F.col(score) >= 100 - 1e-6
    failures = results.where(F.coalesce(~passed, F.lit(True))).select(F.col(id_col).alias("id")).orderBy("id").limit(show).agg(F.array_sort(F.collect_list("id")).alias("failures"))
    whole = results.agg(F.count_if(passed).alias("n_passed"), F.count(F.lit(1)).alias("total"), F.round(F.count_if(passed) * 100 / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("pass_pct"))
    return whole.where(F.when(F.col("total") > 0, True).otherwise(F.raise_error(F.lit("no results")).cast("boolean"))).join(failures)


def report(solve: DataFrame, methods: list[str], subset: str) -> DataFrame:
    """A row a subset, a column a method: accuracy in percent with two decimals, null where the subset has no rows."""
    return solve.groupBy(subset).pivot("expert_id", methods).agg(F.round(F.avg("solved") * 100, 2))
