"""Ordered analytics over a log of batches: windows, lives, churn, the action gate."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type


def unique_rate(log: DataFrame, width: int) -> DataFrame:
    """Unique solves in an expert's last batches, by their number times the current batch's size."""
    w = Window.partitionBy("expert_id").orderBy("step").rowsBetween(-(width - 1), 0)
    return log.withColumn("seen", F.count(F.lit(1)).over(w)).withColumn("rate", F.round(F.sum("war").over(w) / (F.col("seen") * F.col("batch_n")), 9))


def cumulative_war(log: DataFrame, by_stay: bool = False) -> DataFrame:
    """Running total, steps and mean of unique solves; by_stay begins anew where an expert was away for a step."""
    by = ["expert_id"]
    if by_stay:
        log = log.withColumn("__stay", F.col("step") - F.row_number().over(Window.partitionBy("expert_id").orderBy("step")))
        by.append("__stay")
    w = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("expert_id", "step", F.sum("war").over(w).alias("total_war"), F.count(F.lit(1)).over(w).alias("active_steps"), F.round(F.avg("war").over(w), 9).alias("average_war"))


def folded(rows: DataFrame, by: list[str], order: str, values: list[str], start: Callable[[], object], step: Callable, result: str, kind: pa.DataType) -> DataFrame:
    """by, order, result: step(state, order, *values) gives the next state and the row's result, within each group in order.

    Rows are streamed through their task, sorted, so a group of any length takes the memory of a batch.
    """
    own = rows.select(*by, order, *values)
    ddl = T.StructType([*[own.schema[c] for c in (*by, order)], T.StructField(result, from_arrow_type(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in (*by, order, *values)), strict=True):
                if row[: len(by)] != key:
                    key, state = row[: len(by)], start()
                state, got = step(state, *row[len(by) :])
                out.append(got)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*by, order)], pa.array(out, kind)], [*by, order, result])

    placed = own.repartition(*by) if by else own.repartition(1)
    return placed.sortWithinPartitions(*by, order).mapInArrow(run, ddl)


def lives(log: DataFrame, most: int, floor: float | None = None, width: int = 1, shared: str | None = None) -> DataFrame:
    """expert_id, step, lives. With a floor: below it on a full window one life goes, above it one returns.

    Without: a unique solve restores all lives; in a batch in which someone had one, an expert
    without loses one; a batch without any changes nothing, nor does one in which the column
    `shared`, if given, says that the expert solved something.
    """
    if floor is None:
        own = log.withColumn("__any", F.max("war").over(Window.partitionBy("step")) > 0).withColumn("__spared", F.lit(False) if shared is None else F.col(shared) > 0)

        def step(now: int, _, war: int, any_: bool, spared: bool) -> tuple[int, int]:
            now = most if war > 0 else now if spared or not any_ else max(now - 1, 0)
            return now, now

        return folded(own, ["expert_id"], "step", ["war", "__any", "__spared"], lambda: most, step, "lives", pa.int32())
    own = unique_rate(log, width).withColumn("__full", F.col("seen") >= width)

    def by_rate(now: int, _, rate: float, full: bool) -> tuple[int, int]:
        now = now if not full else min(now + 1, most) if rate > floor else max(now - 1, 0)
        return now, now

    return folded(own, ["expert_id"], "step", ["rate", "__full"], lambda: most, by_rate, "lives", pa.int32())


#: Steps that make a part of a log; sums and places go over the parts, then within them.
PART = 1024


def _parts(df: DataFrame, order: str) -> DataFrame:
    """df with __part and __r, its place from 0 by a column of whole numbers."""
    placed = df.withColumn("__part", F.floor(F.col(order) / PART))
    before = Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for PART steps
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return placed.withColumn("__within", within).join(offsets, "__part").withColumn("__r", F.col("__before") + F.col("__within")).drop("__before", "__within")


def centered_average(df: DataFrame, value: str, order: str, width: int) -> DataFrame:
    """A moving average around each row; at the edges over the rows that there are. order is a column of whole numbers.

    Rows near the border of a part are lent to the part beside it.
    """
    back, ahead = width // 2, (width - 1) // 2
    if width >= PART:
        raise ValueError(f"a width below {PART} is needed")
    part = lambda r: F.floor(r / PART)
    lent = _parts(df, order).withColumn("__p", F.explode(F.array_distinct(F.array(part(F.col("__r")), part(F.col("__r") + back), part(F.col("__r") - ahead)))))
    w = Window.partitionBy("__p").orderBy("__r").rowsBetween(-back, ahead)
    return lent.withColumn("smooth", F.round(F.avg(value).over(w), 9)).where(F.col("__p") == part(F.col("__r"))).select(*df.columns, "smooth")


def period(df: DataFrame, value: str, order: str) -> DataFrame:
    """Rows by half the changes of sign around the mean, zeros left out; at least 1. order is a column of whole numbers."""
    mean = df.agg(F.avg(value).alias("__mean"), F.count(F.lit(1)).alias("n"))
    sign = df.join(F.broadcast(mean)).select(F.col(order).alias("o"), F.signum(F.round(F.col(value) - F.col("__mean"), 9)).alias("s")).where("s <> 0").withColumn("p", F.floor(F.col("o") / PART))
    inner = sign.withColumn("flip", (F.col("s") != F.lag("s").over(Window.partitionBy("p").orderBy("o"))).cast("int"))
    parts = inner.groupBy("p").agg(F.sum("flip").alias("flips"), F.min(F.struct("o", "s")).getField("s").alias("first"), F.max(F.struct("o", "s")).getField("s").alias("last"))
    # a row for PART steps
    border = (F.col("first") != F.lag("last").over(Window.partitionBy().orderBy("p"))).cast("int")
    got = parts.withColumn("border", border).agg((F.coalesce(F.sum("flips"), F.lit(0)) + F.coalesce(F.sum("border"), F.lit(0))).alias("flips")).join(F.broadcast(mean))
    return got.select("flips", F.greatest(F.lit(1), F.floor(F.col("n") / F.greatest(F.lit(1), F.floor(F.col("flips") / 2)))).alias("period"))


def churn(df: DataFrame) -> DataFrame:
    """step, adds, deletes: how many came and went up to each step."""
    own = df.select("step", F.col("decision").isin("add", "swap").cast("int").alias("a"), F.col("decision").isin("delete", "swap").cast("int").alias("d")).withColumn("__part", F.floor(F.col("step") / PART))
    before = Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for PART steps
    sums = own.groupBy("__part").agg(F.sum("a").alias("__a"), F.sum("d").alias("__d"))
    offsets = sums.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__a", "__d")])
    within = Window.partitionBy("__part").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumn("a", F.sum("a").over(within)).withColumn("d", F.sum("d").over(within)).join(offsets, "__part")
    return out.select("step", (F.col("__a") + F.col("a")).alias("adds"), (F.col("__d") + F.col("d")).alias("deletes"))


def epoch_starts(df: DataFrame) -> DataFrame:
    return df.groupBy("epoch").agg(F.min("step").alias("first_step"))


def lifetimes(alive: DataFrame) -> DataFrame:
    """Runs of consecutive steps of each expert, and whether it is in the last roster."""
    w = Window.partitionBy("expert_id").orderBy("step")
    runs = alive.withColumn("run", F.col("step") - F.row_number().over(w)).groupBy("expert_id", "run").agg(F.min("step").alias("from_step"), F.max("step").alias("to_step"))
    last = alive.agg(F.max("step").alias("last"))
    return runs.join(F.broadcast(last)).select("expert_id", "from_step", "to_step", (F.col("to_step") == F.col("last")).alias("in_final"))


def last_distinct(df: DataFrame, by: str, value: str, order: str, keep: int) -> DataFrame:
    """Of each group's values, by first appearance, the last `keep`."""
    first = df.groupBy(by, value).agg(F.min(order).alias("first"))
    w = Window.partitionBy(by).orderBy(F.desc("first"))
    return first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).select(by, value, "r")


def recurrence(df: DataFrame, value: str, order: str, most: int) -> DataFrame:
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(most)


def gate(steps: DataFrame, lam: float, scale: float, ref: float) -> DataFrame:
    """Utilities and the decision for each step.

    Needs n_roster, batch_n, hard_gain (what the candidate solves of what nobody did), niche_n
    (what only the worst solves), niche_recovered, and add_only.
    """
    base = F.exp(F.col("n_roster") * lam) * scale * (math.exp(lam) - 1) * (F.lit(float(ref)) / F.col("batch_n"))
    drop = F.exp((F.col("n_roster") - 1) * lam) * scale * (math.exp(lam) - 1) * (F.lit(float(ref)) / F.col("batch_n"))
    out = steps.withColumn("u_add", F.round(F.col("hard_gain") / F.col("batch_n") - base, 9)).withColumn("u_delete", F.round(drop - F.col("niche_n") / F.col("batch_n"), 9))
    add, delete = F.col("u_add") > 0, (F.col("n_roster") > 1) & (F.col("u_delete") > 0) & ~F.col("add_only")
    covered = F.col("niche_recovered") >= F.col("niche_n")
    decision = F.when(add & delete, F.when(covered, "swap").otherwise("add")).when(add, "add").when(delete, "delete").otherwise("noop")
    return out.withColumn("decision", decision)


def cooldown(steps: DataFrame, width: int, by: list[str] | None = None) -> DataFrame:
    """Deletes within `width` steps of the last delete that took effect become noop; swaps are exempt. by: the columns of a run."""

    def step(last: int | None, at: int, decision: str) -> tuple[int | None, str]:
        if decision != "delete":
            return last, decision
        return (last, "noop") if last is not None and at - last < width else (at, decision)

    return folded(steps, by or [], "step", ["decision"], lambda: None, step, "decision_", pa.string()).withColumnRenamed("decision_", "decision")


def action_summary(gated: DataFrame) -> DataFrame:
    """How often each decision was taken, with the mean utilities."""
    return gated.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("u_add"), 6).alias("mean_u_add"), F.round(F.avg("u_delete"), 6).alias("mean_u_delete"))
