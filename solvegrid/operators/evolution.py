"""The roster over the steps of a run: what a batch does to its members, who goes, who comes, and the log's replay.

A roster is a DataFrame with a row for each member (see sources.runs.ROSTER); it is small by nature.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import may_stop
from ..sources.runs import ROSTER, persona


def after_batch(roster: DataFrame, scores: DataFrame, batch_n: int, *, lives: int = 3, window: int = 0, floor: float = 0.0, exempt_shared: bool = False) -> DataFrame:
    """The roster after a batch; scores has id, war (what only this member solved) and solved (all that it solved).

    With a window: sums over the last batches; a rate above the floor gives a life back, one below it
    takes one, none changes before the window is full. Without: a unique solve restores all lives, a
    batch in which nobody had one changes nothing, and with exempt_shared neither does a shared solve.
    Members that the scores lack stay as they are.
    """
    any_ = scores.agg(F.coalesce(F.max("war"), F.lit(0)).alias("__top"))
    own = roster.join(scores.select("id", F.col("war").alias("__war"), F.col("solved").alias("__solved")), "id", "left").join(F.broadcast(any_))
    there, war, now = F.col("__war").isNotNull(), F.col("__war"), F.coalesce(F.col("lives"), F.lit(lives))
    less, more = F.greatest(now - 1, F.lit(0)), F.least(now + 1, F.lit(lives))
    recent = F.col("recent_unique")
    if window > 0:
        full = F.concat(F.coalesce(recent, F.array().cast("array<long>")), F.array(war.cast("long")))
        recent = F.slice(full, F.greatest(F.size(full) - window, F.lit(0)) + 1, F.lit(window))
        rate = F.aggregate(recent, F.lit(0).cast("long"), lambda s, x: s + x) / (F.size(recent) * F.lit(batch_n))
        next_ = F.when(F.size(recent) < window, now).when(rate > floor, more).otherwise(less)
    else:
        shared = F.lit(exempt_shared) & (F.col("__solved") > 0)
        next_ = F.when(war > 0, F.lit(lives)).when((F.col("__top") == 0) | shared, now).otherwise(less)
    total, steps = F.col("total_war") + war, F.col("active_steps") + 1
    changed = {"total_war": total, "active_steps": steps, "average_war": total / steps, "lives": next_.cast("int"), "recent_unique": recent}
    return own.select(*[F.when(there, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in roster.columns])


def worst(roster: DataFrame, scored: DataFrame, *, tie: str = "id", rate: DataFrame | None = None, seed: int = 0, lives: int = 3) -> DataFrame:
    """Of the scored members without lives the one of the lowest average, or rate if given; then of the longest tenure.

    Then by tie: id; random, a seeded hash of the id; size, the shorter strengths and then that hash.
    """
    own = roster.join(scored.select("id"), "id", "left_semi").where(F.coalesce("lives", F.lit(lives)) <= 0)
    value = F.coalesce("average_war", F.lit(0.0))
    if rate is not None:
        own = own.join(rate.select("id", F.col("rate").alias("__rate")), "id", "left")
        value = F.coalesce("__rate", F.lit(0.0))
    chance = F.xxhash64("id", F.lit(seed))
    order = {"id": ["id"], "random": [chance, "id"], "size": [F.length(F.coalesce("strengths", F.lit(""))), chance, "id"]}[tie]
    return own.orderBy(value, F.desc(F.coalesce("active_steps", F.lit(0))), *order).limit(1).select(*roster.columns)


def mutate(roster: DataFrame, decision: str, worst_id: str | None = None, candidate: Mapping[str, object] | None = None, new_id: str | None = None, *, lives: int = 3, history: list[str] | None = None) -> DataFrame:
    """The roster after a decision: delete and swap drop the worst member, add and swap bring the candidate with all lives."""
    out = roster
    if decision in ("delete", "swap"):
        out = out.where(F.col("id") != F.lit(worst_id))
    if decision in ("add", "swap"):
        fresh = persona(candidate or {}, new_id or "", 0, lives, history) | {"lives": lives}
        row = roster.sparkSession.createDataFrame([tuple(fresh.values())], ROSTER)
        last = roster.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("__last"))
        row = row.join(F.broadcast(last)).withColumn("ordinal", F.col("__last") + 1).drop("__last")
        out = out.unionByName(row.select(*roster.columns))
    return out


def decided(steps: DataFrame) -> DataFrame:
    """Steps with early exits as noop: no hard errors, or no candidate. Every step has a row."""
    out_early = (F.col("hard_error_n") == 0) | ~F.coalesce("has_candidate", F.lit(False))
    return steps.withColumn("decision", F.when(out_early, "noop").otherwise(F.col("decision")))


def replay(log: DataFrame) -> DataFrame:
    """step, ordinal, expert_id of the rosters that a log tells of in roster_after."""
    return log.select("step", F.posexplode("roster_after").alias("ordinal", "expert_id"))


def latest(log: DataFrame) -> DataFrame:
    """ordinal, expert_id after the last step."""
    last = log.agg(F.max(F.struct("step", "roster_after")).alias("l"))
    return last.select(F.posexplode("l.roster_after").alias("ordinal", "expert_id"))


def history(solves: DataFrame, by: str, text: str, order: str, most: int = 500, keep: int = 10) -> DataFrame:
    """by, history: the last distinct texts of what each solved alone, clipped, by first appearance."""
    first = solves.groupBy(by, F.substring(text, 1, most).alias("__text")).agg(F.min(order).alias("__first"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("__first"), "__text"))
    last = first.withColumn("__nth", nth).where(F.col("__nth") <= keep)
    said = F.array_sort(F.collect_list(F.struct((-F.col("__nth")).alias("o"), F.col("__text").alias("t"))))
    return last.groupBy(by).agg(F.transform(said, lambda x: x["t"]).alias("history"))


def log_summary(log: DataFrame) -> DataFrame:
    """Mean, least and largest size of the roster, and how many came and went."""
    size, took = F.size("roster_after"), F.col("decision")
    return log.agg(F.round(F.avg(size), 6).alias("mean_size"), F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.count_if(took.isin("add", "swap")).alias("adds"), F.count_if(took.isin("delete", "swap")).alias("deletes"))


def refine(answers: DataFrame, critic: Callable[[DataFrame], DataFrame], reviser: Callable[[DataFrame], DataFrame], rounds: int, stops: Callable[[Column], Column] = may_stop) -> DataFrame:
    """answers (id, answer) after up to so many rounds of critic and revision, with rounds.

    critic adds feedback; the rows whose feedback lets them stop are done, reviser gives the others
    a new answer. Both are DataFrame to DataFrame, so that generation stays a plug-in.
    """
    active, done = answers.withColumn("rounds", F.lit(0)), None
    for _ in range(rounds):
        seen = critic(active).withColumn("__stop", F.coalesce(stops(F.col("feedback")), F.lit(False)))
        over = seen.where("__stop").select("id", "answer", "rounds")
        done = over if done is None else done.unionByName(over)
        active = reviser(seen.where("not __stop").drop("__stop")).withColumn("rounds", F.col("rounds") + 1).select("id", "answer", "rounds")
    return active if done is None else done.unionByName(active)
