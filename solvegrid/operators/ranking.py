"""Normalised scores, routing picks and what routing yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import softmax

EPS = 1e-6


def znorm(df: DataFrame, column: str, by: str, into: str) -> DataFrame:
    """(x - mean) / (population deviation + 1e-6) within each group; groups are aggregated, rows aren't moved for it if they are few."""
    stats = df.groupBy(by).agg(F.avg(column).alias("__mean"), F.stddev_pop(column).alias("__dev"))
    return df.join(stats, by).withColumn(into, (F.col(column) - F.col("__mean")) / (F.col("__dev") + EPS)).drop("__mean", "__dev")


#: Parts of a group whose values are summed up apart.
PARTS = 64


def below(counts: DataFrame, by: str, value: str) -> DataFrame:
    """counts (by, value, c: rows of each distinct value) with below and all: rows of smaller values, and of the group.

    A group's values are cut into parts by its percentiles; sums go over the parts, then within them.
    """
    cuts = counts.groupBy(by).agg(F.percentile_approx(value, [i / PARTS for i in range(1, PARTS)], 1000).alias("__cuts"), F.sum("c").alias("all"))
    placed = counts.join(cuts, by).withColumn("__part", F.size(F.filter("__cuts", lambda x: x < F.col(value)))).drop("__cuts")
    sums = placed.groupBy(by, "__part").agg(F.sum("c").alias("__sum"))
    # at most PARTS rows a group
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(by, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("__within", F.coalesce(F.sum("c").over(within), F.lit(0))).join(sums, [by, "__part"])
    return out.select(by, value, "c", (F.col("__before") + F.col("__within")).alias("below"), "all")


def average_rank(df: DataFrame, column: str, by: str, into: str) -> DataFrame:
    """Ranks from 1, ties averaged, divided by the group's size."""
    ranks = below(df.groupBy(by, column).agg(F.count(F.lit(1)).alias("c")), by, column)
    share = ((F.col("below") + (F.col("c") + 1) / 2) / F.col("all")).alias(into)
    return df.join(ranks.select(by, column, share), [by, column]).select(*df.columns, into)


def ordinal_rank(df: DataFrame, column: str, by: str, tie: str, into: str) -> DataFrame:
    """Ranks from 0, ties by another column."""
    ranks = below(df.groupBy(by, column).agg(F.count(F.lit(1)).alias("c")), by, column)
    nth = F.row_number().over(Window.partitionBy(by, column).orderBy(tie))
    return df.withColumn("__nth", nth).join(ranks.select(by, column, "below"), [by, column]).select(*df.columns, (F.col("below") + F.col("__nth") - 1).alias(into))


def top_k(df: DataFrame, score: str | Column, k: int) -> DataFrame:
    """The k experts of the highest score for each problem; of equals the smaller ordinal."""
    s = F.col(score) if isinstance(score, str) else score
    return df.withColumn("pick", F.row_number().over(Window.partitionBy("problem_id").orderBy(s.desc(), "ordinal"))).where(F.col("pick") <= k)


def routed(picks: DataFrame, solve: DataFrame) -> DataFrame:
    """routed: share of problems that a pick solves; beside the best single expert and the oracle."""
    hit = picks.groupBy("problem_id").agg(F.max("solved").alias("hit")).agg(F.avg("hit").alias("routed"))
    best = solve.groupBy("expert_id").agg(F.avg("solved").alias("r")).agg(F.max("r").alias("best"))
    top = solve.groupBy("problem_id").agg(F.max("solved").alias("any")).agg(F.avg("any").alias("oracle"))
    one = hit.join(best).join(top)
    return one.select(*[F.round(c, 9).alias(c) for c in ("routed", "best", "oracle")], F.round((F.col("routed") - F.col("best")) / (F.col("oracle") - F.col("best") + 1e-9), 6).alias("headroom_recovery"))


def anchor_and_residual(solve: DataFrame, score: str, anchor: DataFrame) -> DataFrame:
    """The anchor for every problem, and the best of the others by score."""
    a = anchor.select(F.col("expert_id").alias("__anchor"))
    marked = solve.join(F.broadcast(a), F.col("expert_id") == F.col("__anchor"), "left")
    first = marked.where("__anchor is not null").drop("__anchor").withColumn("pick", F.lit(1))
    second = top_k(marked.where("__anchor is null").drop("__anchor"), score, 1).withColumn("pick", F.lit(2))
    return first.unionByName(second)


def pick_summary(picks: DataFrame) -> DataFrame:
    """top1, topk, recovered: problems that the first pick solves, that any does, and that only a later one does."""
    p = picks.groupBy("problem_id").agg(F.max("solved").alias("any"), F.max(F.when(F.col("pick") == 1, F.col("solved")).otherwise(0)).alias("first"))
    return p.agg(F.sum("first").alias("top1"), F.sum("any").alias("topk"), F.sum(((F.col("any") == 1) & (F.col("first") == 0)).cast("long")).alias("recovered"))


def hybrid(solve: DataFrame, first: str | Column, second: str | Column) -> DataFrame:
    """The best expert by each of two scores; both may pick the same one."""
    return top_k(solve, first, 1).unionByName(top_k(solve, second, 1))


def union_of(picks: DataFrame) -> DataFrame:
    """covered, total: problems that any pick solves, and all of them."""
    return picks.groupBy("problem_id").agg(F.max("solved").alias("hit")).agg(F.sum("hit").alias("covered"), F.count(F.lit(1)).alias("total"))


def routed_summary(picks: DataFrame, task: str) -> DataFrame:
    """n and accuracy overall, by task and by expert; a problem that is routed twice is an error."""
    once = picks.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("problem_id")))
    once = once.where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("routed twice: "), F.col("problem_id").cast("string"))).cast("boolean")))
    g = once.groupingSets([[], [task], ["expert_id"]], task, "expert_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("solved"), 9).alias("accuracy"))
    return g.select(F.coalesce(task, F.lit("all")).alias(task), F.coalesce("expert_id", F.lit("all")).alias("expert_id"), "n", "accuracy")


def chosen_id(reply: Column, roster: Column, keys: tuple[str, ...] = ("selected_expert_id", "selected_critic_id")) -> Column:
    """The known id that a router's JSON reply names under the first key that it has, else the first of the roster."""
    said = F.coalesce(*[F.get_json_object(reply, f"$.{k}") for k in keys])
    return F.when(F.array_contains(roster, said), said).otherwise(F.try_element_at(roster, F.lit(1)))


def median_split(solve: DataFrame) -> DataFrame:
    """Accuracy at and above each expert's median confidence and below it, averaged over experts."""
    mid = solve.groupBy("expert_id").agg(F.percentile("conf", 0.5).alias("mid"))
    by = solve.join(mid, "expert_id").groupBy("expert_id").agg(F.avg(F.when(F.col("conf") >= F.col("mid"), F.col("solved"))).alias("hi"), F.avg(F.when(F.col("conf") < F.col("mid"), F.col("solved"))).alias("lo"))
    return by.agg(F.round(F.avg("hi"), 6).alias("acc_high"), F.round(F.avg("lo"), 6).alias("acc_low"))


def margin(solve: DataFrame, score: str) -> DataFrame:
    """Best score less the second best."""
    top = F.sort_array(F.collect_list(score), asc=False)
    return solve.groupBy("problem_id").agg(top.alias("s")).select("problem_id", F.round(F.col("s")[0] - F.try_element_at("s", F.lit(2)), 6).alias("margin"))


def missed_headroom(picks: DataFrame, solve: DataFrame) -> DataFrame:
    got = picks.groupBy("problem_id").agg(F.max("solved").alias("hit"))
    any_ = solve.groupBy("problem_id").agg(F.max("solved").alias("any"))
    return any_.join(got, "problem_id", "left").agg(F.count_if((F.col("any") == 1) & (F.coalesce("hit", F.lit(0)) == 0)).alias("missed"), F.count(F.lit(1)).alias("total"))


def worst_agent(roster: DataFrame) -> DataFrame:
    """Of those without lives that have been active: lowest average, then longest tenure, then id."""
    return roster.where((F.coalesce("lives", F.lit(3)) <= 0) & (F.col("active_steps") > 0)).orderBy("average_war", F.desc("active_steps"), "expert_id").limit(1)


def pad_ranked_ids(parsed: Column, roster: Column, k: int) -> Column:
    """The first k of the known ids in the order given, then of the roster."""
    known = F.filter(parsed, lambda x: F.array_contains(roster, x))
    return F.slice(F.array_distinct(F.concat(known, roster)), 1, k)


def best_checkpoint(log: DataFrame, by: str, recorded: str, step: str, accuracy: str) -> DataFrame:
    """The recorded best step, else the saved step of the best accuracy (the later of equals), else the last one saved; by says why."""
    g = log.groupBy(by).agg(F.max(recorded).alias("__r"), F.max(F.when(F.col(accuracy).isNotNull(), F.struct(accuracy, step))).getField(step).alias("__a"), F.max(step).alias("__l"))
    reason = F.when(F.col("__r").isNotNull(), "recorded").when(F.col("__a").isNotNull(), "accuracy").otherwise("latest")
    return g.select(by, F.coalesce("__r", "__a", "__l").alias("step"), reason.alias("reason"))


def letter_confidence(logits: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The likeliest option, the first of equals, and its share under a softmax."""
    a = logits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x.getField(value)).alias("v"))
    return a.select(key, (F.array_position("v", F.array_max("v")) - 1).alias("choice"), F.round(F.array_max(softmax(F.col("v"))), 9).alias("share"))
