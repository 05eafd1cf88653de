"""Contest results: generations one by one and together again, grades, saved results, cached prompts, and orders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sandbox


def flattened(samples: DataFrame, key: str = "task_id", generations: str = "generations") -> DataFrame:
    """A row for each generation of each task, with its number."""
    rest = [c for c in samples.columns if c != generations]
    return samples.select(*rest, F.posexplode(generations).alias("generation", "code"))


def regrouped(results: DataFrame, key: str = "task_id", value: str = "results") -> DataFrame:
    """key, grades: the results of each task's generations, in order."""
    return results.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("generation", F.col(value).alias("v")))), lambda x: x["v"]).alias(value))


def grades(results: DataFrame, key: str = "task_id", value: str = "results") -> DataFrame:
    """key, graded: for each generation whether all its tests passed; with no test it passes."""
    return results.select(key, F.transform(value, lambda g: F.forall(g, lambda x: x > 0)).alias("graded"))


def execution_pass(samples: DataFrame, seconds: float = 3.0) -> DataFrame:
    """id, n, c, pass_at_1 of predictions of what a call returns: samples has id, code, input, output, generations.

    A generation that repeats the input doesn't count; if all do, the task has none right. The
    output that a generation gives is asserted behind the code, in the sandbox.
    """
    each = samples.select("id", "code", "output", F.posexplode(F.filter("generations", lambda g: ~F.contains(g, F.col("input")))).alias("n", "said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right = [sandbox.passes(code or "", f"assert {out} == {said}", seconds) == 100.0 for code, out, said in zip(*(b.column(c).to_pylist() for c in ("code", "output", "said")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(right, pa.bool_())], ["id", "ok"])

    got = each.select(F.col("id").cast("string").alias("id"), "code", "output", "said").mapInArrow(run, "id string, ok boolean")
    counts = got.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("c"))
    whole = samples.select(F.col("id").cast("string").alias("id"), F.size("generations").cast("long").alias("__all")).join(counts, "id", "left")
    n, c = F.coalesce("n", "__all"), F.coalesce("c", F.lit(0))
    return whole.select("id", n.alias("n"), c.alias("c"), F.coalesce(F.try_divide(c, n), F.lit(0.0)).alias("pass_at_1"))


def with_saved(benchmark: DataFrame, saved: DataFrame, key: str = "question_id") -> DataFrame:
    """The benchmark with its saved results; a question without any, or with several, is an error."""
    counted = saved.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    checked = benchmark.join(counted, key, "left").withColumn("__ok", F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.coalesce(F.col("__n"), F.lit(0)).cast("string"), F.lit(" saved results of "), F.col(key).cast("string"))).cast("boolean")))
    return checked.where("__ok").drop("__n", "__ok").join(saved, key)


def cached(prompts: DataFrame, cache: DataFrame, n: int, prompt: str = "prompt") -> DataFrame:
    """prompts with outputs where the cache has n of them for the same prompt, and hit.

    A prompt of messages is keyed by its JSON, a text by itself. cache has prompt_key and outputs;
    of several entries any that has n outputs will do, the smallest is taken.
    """
    kind = prompts.schema[prompt].dataType.typeName()
    key = F.col(prompt) if kind == "string" else F.to_json(prompt)
    whole = cache.where(F.size("outputs") == n).groupBy("prompt_key").agg(F.min("outputs").alias("outputs"))
    out = prompts.withColumn("__key", key).join(whole, F.col("__key") == F.col("prompt_key"), "left").drop("__key", "prompt_key")
    return out.withColumn("hit", F.col("outputs").isNotNull())


def ordered(rows: DataFrame, scenario: str) -> DataFrame:
    """Rows in the order of their scenario: by question (as text), by question and test, or by the number that ends the id."""
    if scenario == "testoutputprediction":
        return rows.orderBy("question_id", "test_id")
    if scenario == "codeexecution":
        return rows.orderBy(F.split("id", "_")[1].cast("int"))
    if scenario in ("codegeneration", "selfrepair"):
        return rows.orderBy("question_id")
    raise ValueError(f"unknown scenario {scenario}")
