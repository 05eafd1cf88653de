"""Id joins as evaluation pipelines use them: with fallbacks, strict, resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the last in order."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def with_reference(outputs: DataFrame, reference: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns come from the reference, or from the output's own row where it has none."""
    ref = reference.select(key, F.lit(True).alias("__in"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = outputs.join(ref, key, "left")
    return joined.select(*[F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in outputs.columns])


def strict(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that fails when a row of left has no partner."""
    joined = left.join(right.withColumn("__in", F.lit(True)), key, "left")
    return joined.withColumn("__in", F.when(F.col("__in"), True).otherwise(F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string"))).cast("boolean"))).where("__in").drop("__in")


def two_level(left: DataFrame, right: DataFrame, fine: list[str], coarse: list[str], value: str, order: str) -> DataFrame:
    """value by the fine key, else by the coarse one; of several the last in order."""
    a = keep_last(right, fine, order).select(*fine, F.col(value).alias("__a"))
    b = keep_last(right, coarse, order).select(*coarse, F.col(value).alias("__b"))
    return left.join(a, fine, "left").join(b, coarse, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def resume(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key), key, "left_anti")


def holdout(items: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The items with the ids; all items if none of them matches."""
    kept = items.join(ids.select(key), key, "left_semi")
    none = kept.limit(1).agg((F.count(F.lit(1)) == 0).alias("__none"))
    mark = ids.select(key).distinct().withColumn("__in", F.lit(True))
    return items.join(mark, key, "left").join(F.broadcast(none)).where("__in or __none").drop("__in", "__none")


def head(items: DataFrame, order: str, most: int) -> DataFrame:
    """The first items in order."""
    return items.orderBy(order).limit(most)


#: Rows that a side of a nested join may have at most.
SMALL = 10_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df for a broadcast: at most so many rows; more are an error, not a cut."""
    some = df.limit(most + 1)
    n = some.agg(F.count(F.lit(1)).alias("__n"))
    fits = F.when(F.col("__n") <= most, True).otherwise(F.raise_error(F.lit(f"more than {most} rows in the small side")).cast("boolean"))
    return some.join(F.broadcast(n)).where(fits).drop("__n")


def fan_out(items: DataFrame, roster: DataFrame, most: int = SMALL) -> DataFrame:
    """Every item for every expert; a roster of more than `most` rows is an error."""
    return items.join(F.broadcast(small(roster, most)))


def tagged(rows: DataFrame, tags: DataFrame, wanted: str, key: str = "id") -> DataFrame:
    """The rows with a tag that was read well and is in a list parted by commas."""
    names = F.filter(F.transform(F.split(F.lit(wanted), ","), lambda x: F.trim(x)), lambda x: x != "")
    good = tags.where((F.coalesce("parse_status", F.lit("ok")) == "ok") & F.array_contains(names, F.coalesce("primary_category", F.lit(""))))
    return rows.join(good.select(key), key, "left_semi")


def starter_codes(rows: DataFrame, references: DataFrame, code: str = "reference_code", into: str = "starter_code") -> DataFrame:
    """rows with the stub of their reference solution, found by problem_id, else by id; null without one."""
    from ..functions.text import starter_code

    ref = references.select(F.coalesce("problem_id", "id").alias("__ref"), F.col(code).alias("__code")).groupBy("__ref").agg(F.min("__code").alias("__code"))
    out = rows.join(ref, F.coalesce("problem_id", "id") == F.col("__ref"), "left")
    return out.withColumn(into, starter_code(F.col("eval_mode"), F.col("entry_point"), F.col("gfg_params"), F.col("__code"))).drop("__ref", "__code")


def bank_with_mapping(bank: DataFrame, mapping: DataFrame) -> DataFrame:
    """A router's models, in their order, with the system prompts of their source experts; a missing one is an error, models without a source keep null."""
    known = mapping.select(F.col("id").alias("__id"), "system_prompt")
    out = bank.join(F.broadcast(small(known)), F.col("source_expert_id") == F.col("__id"), "left")
    fine = F.col("__id").isNotNull() | (F.coalesce("source_expert_id", F.lit("")) == "")
    return out.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("no mapping for "), F.col("source_expert_id"))).cast("boolean"))).drop("__id")


def renamed(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """The key by its name where it has one, else as it is."""
    return rows.join(names.select(key, F.col(name).alias("__name")), key, "left").withColumn(key, F.coalesce("__name", key)).drop("__name")
