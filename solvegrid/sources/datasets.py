"""Loaders that turn raw tables into items, and the resolution of a dataset's name.

A loader takes the raw rows as a DataFrame, so any source that Spark reads will do; an order
in the source is an explicit ordinal.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.extract import column
from ..functions.text import scoring_kind
from ..operators.splits import hash_key, ratio_head
from .readers import jsonl

#: Domain of items in local files by dataset; others are coding.
DOMAINS = {"math": "math", "bigmath": "math", "numina_cot": "math", "qasc": "qasc", "lbox": "lbox"}
#: Topics and splits that the collection of competition problems is made of.
MATH_TOPICS = ("algebra", "counting_and_probability", "geometry", "intermediate_algebra", "number_theory", "prealgebra", "precalculus")
#: Instructions of the legal tasks.
LBOX_INSTRUCTIONS = {"casename": "다음 사실관계에 해당하는 사건명 또는 죄명을 정확히 한 줄로 답하라.", "statute": "다음 사실관계에 적용되는 법조문을 모두 나열하라(예: 형법 제298조)."}


def numbered(rows: DataFrame, into: str = "ordinal") -> DataFrame:
    """rows with their place in the source, from 0. Partitions are counted first, so no row is moved."""
    placed = rows.withColumn("__at", F.monotonically_increasing_id())
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # a row for each partition of the source
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.withColumn("__part", part).join(offsets, F.col("__part") == F.col("__p")).withColumn(into, F.col("__before") + within).drop("__at", "__part", "__p", "__before")


def annotated(items: DataFrame, dataset: str) -> DataFrame:
    return items.withColumn("dataset", F.lit(dataset.lower())).withColumn("scoring_kind", scoring_kind(F.lit(dataset.lower())))


def humaneval(raw: DataFrame) -> DataFrame:
    out = raw.select(F.col("task_id").alias("id"), F.col("prompt").alias("instruction"), F.col("canonical_solution").alias("ground_truth"), "entry_point", F.col("test").alias("test_code"), F.lit("coding").alias("domain"))
    return annotated(out, "humaneval")


def mbpp(raw: DataFrame) -> DataFrame:
    said = F.coalesce(*[F.col(c) for c in ("prompt", "text") if c in raw.columns], F.lit(""))
    full = F.concat(said, F.lit("\nYour code should pass these tests:\n\n"), F.array_join("test_list", "\n"), F.lit("\n"))
    out = raw.select(F.concat(F.lit("mbpp_"), F.col("task_id").cast("string")).alias("id"), full.alias("instruction"), said.alias("prompt_text"), F.col("code").alias("ground_truth"), "test_list", F.lit("coding").alias("domain"))
    return annotated(out, "mbpp")


def competition(parts: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """All topics and splits, whichever are given; ids count within each. No scoring kind."""
    out = None
    for (topic, split), raw in parts.items():
        key = F.concat(F.lit(f"math_{topic}_{split}_"), F.col("ordinal").cast("string"))
        rows = raw.select(key.alias("id"), F.col("problem").alias("instruction"), F.col("solution").alias("ground_truth"), F.lit(topic).alias("topic"), "level", F.lit("math").alias("domain"))
        out = rows if out is None else out.unionByName(rows)
    return out


def bigmath(raw: DataFrame, split: str, categories: list[str] | str | None = None) -> DataFrame:
    """Ids go by the place before the filter."""
    kept = _of(raw, "categories", categories)
    key = F.concat(F.lit(f"bigmath_filtered_{split}_"), F.col("ordinal").cast("string"))
    out = kept.select(key.alias("id"), F.col("problem").alias("instruction"), F.col("answer").alias("ground_truth"), F.lit("math").alias("domain"), "categories", "source", "original_domain", "llama8b_solve_rate")
    return annotated(out, "bigmath")


def numina(raw: DataFrame, categories: list[str] | str | None = None) -> DataFrame:
    kept = _of(raw, "category", categories)
    return kept.select("id", F.col("problem").alias("instruction"), F.col("answer").alias("ground_truth"), "solution", F.lit("math").alias("domain"), "category", "source")


def ds1000(raw: DataFrame) -> DataFrame:
    return raw.select(F.concat(F.lit("ds1000_"), F.col("ordinal").cast("string")).alias("id"), F.col("prompt").alias("instruction"), F.col("reference_code").alias("ground_truth"), "code_context", "metadata", F.lit("ds").alias("domain"))


def _of(raw: DataFrame, column: str, categories: list[str] | str | None) -> DataFrame:
    wanted = [categories] if isinstance(categories, str) else categories
    return raw.where(F.col(column).isin(list(wanted))) if wanted else raw


def text_schema(*columns: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


CONTEST = text_schema("question_id", "question_content", "starter_code", "difficulty", "platform", "contest_date", "public_test_cases", "private_test_cases", "metadata")


def contest_files(version: str) -> list[str]:
    """test.jsonl, test2.jsonl and so on, up to the release."""
    return ["test.jsonl" if i == 1 else f"test{i}.jsonl" for i in range(1, int(version.rsplit("_v", 1)[1]) + 1)]


def contest(spark: SparkSession, folder: str, version: str = "release_v5", strict: bool = False) -> DataFrame:
    """Items of all files up to a release. Unless strict, a release that can't be read gives no items."""
    try:
        raw = jsonl(spark, [f"{folder}/{f}" for f in contest_files(version)], CONTEST)
    except Exception as e:
        if strict or "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], CONTEST)
    out = raw.select(F.col("question_id").alias("id"), F.col("question_content").alias("instruction"), "starter_code", "difficulty", "platform", F.lit("coding").alias("domain"))
    return annotated(out, "livecodebench")


#: What a contest problem's enumerations may be.
PLATFORMS, DIFFICULTIES, TEST_TYPES = ("leetcode", "codeforces", "atcoder"), ("easy", "medium", "hard"), ("stdin", "functional")
TESTS = "array<struct<input: string, output: string, testtype: string>>"


def decoded_tests(text: str) -> str | None:
    """Test cases as JSON: plain, or base64 of a deflated JSON text. Pickles are never loaded; they give null, as does anything else."""
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    try:
        plain = zlib.decompress(base64.b64decode(text, validate=True)).decode("utf-8")
        value = json.loads(plain)
        # a JSON text within a JSON text
        return value if isinstance(value, str) and isinstance(json.loads(value), list) else plain
    except (ValueError, zlib.error):
        return None


def _known(value: Column, names: tuple[str, ...], what: str) -> Column:
    return F.when(value.isin(*names), value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what} "), F.coalesce(value, F.lit("null")))).cast("string"))


def contest_problems(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Problems with parsed dates and tests, of an inclusive range of dates; private tests that can't be read are null."""
    out = raw.withColumn("contest_date", F.to_timestamp("contest_date"))
    if start is not None:
        out = out.where(F.col("contest_date") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("contest_date") <= F.lit(end).cast("timestamp"))
    out = out.withColumn("platform", _known(F.col("platform"), PLATFORMS, "platform")).withColumn("difficulty", _known(F.col("difficulty"), DIFFICULTIES, "difficulty"))
    return out.withColumn("public_test_cases", F.from_json("public_test_cases", TESTS)).withColumn("private_test_cases", F.from_json(column(decoded_tests)(F.col("private_test_cases")), TESTS))


def prediction_problems(raw: DataFrame) -> DataFrame:
    """Test output prediction: the question as input, the first test's output as what is expected."""
    return raw.withColumn("test", F.from_json("test", TESTS)).withColumn("contest_date", F.to_timestamp("contest_date")).withColumn("input", F.col("question_content")).withColumn("output", F.try_element_at("test", F.lit(1)).getField("output"))


def execution_problems(raw: DataFrame) -> DataFrame:
    """Code execution, with the number that ends each id, by which they are ordered."""
    return raw.withColumn("contest_date", F.to_timestamp("contest_date")).withColumn("number", F.split("id", "_")[1].cast("int")).withColumn("numsteps", F.col("numsteps").cast("int"))


def taco(raw: DataFrame, difficulties: list[str] | None = None, skills: list[str] | None = None) -> DataFrame:
    """By difficulty, and by an overlap of skills; the list of skills is read as JSON with either quote, never evaluated."""
    out = raw.where(F.col("difficulty").isin(difficulties)) if difficulties else raw
    if skills:
        listed = F.from_json(F.translate("skill_types", "'", '"'), "array<string>")
        out = out.where(F.coalesce(F.arrays_overlap(listed, F.array(*map(F.lit, skills))), F.lit(False)))
    return out


def lbox(parts: list[tuple[str, str, DataFrame]], split: str) -> tuple[DataFrame, DataFrame]:
    """Items of (task type, config, raw) parts, and how many of each part were kept and skipped.

    Rows without facts or without a gold answer are skipped. Gold statutes are a JSON list.
    """
    rows = None
    for kind, config, raw in parts:
        facts = F.trim(F.coalesce("facts", F.lit("")))
        if kind == "statute":
            gold = F.filter(F.transform("statutes", lambda s: F.trim(s)), lambda s: s != "")
            gold = F.when(F.size(gold) > 0, F.to_json(gold))
        else:
            gold = F.nullif(F.trim("casename"), F.lit(""))
        key = F.concat(F.lit(f"{kind}_{config}_{split}_"), F.col("id").cast("string"))
        own = raw.select(key.alias("id"), F.lit(kind).alias("task_type"), F.lit(config).alias("task_config"), F.col("casetype") if "casetype" in raw.columns else F.lit(None).cast("string").alias("casetype"), facts.alias("facts"), gold.alias("ground_truth"))
        rows = own if rows is None else rows.unionByName(own)
    good = (F.col("facts") != "") & F.col("ground_truth").isNotNull()
    tally = rows.groupBy("task_config").agg(F.count_if(good).alias("emitted"), F.count_if(~good).alias("skipped"))
    told = F.create_map(*[F.lit(x) for pair in LBOX_INSTRUCTIONS.items() for x in pair])
    kept = rows.where(good).withColumn("instruction", F.concat(told[F.col("task_type")], F.lit("\n\n사실관계:\n"), F.col("facts"))).withColumn("domain", F.lit("lbox"))
    return annotated(kept, "lbox"), tally


def qasc(raw: DataFrame, split: str) -> DataFrame:
    """Questions with a letter from A to H; a missing question or key is an error."""
    key = F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit(f"qasc_{split}_"), F.col("ordinal").cast("string")))
    said, gold = F.coalesce(F.nullif("formatted_question", F.lit("")), F.nullif("question", F.lit(""))), F.upper(F.trim(F.coalesce("answerKey", F.lit(""))))
    fail = lambda what: F.raise_error(F.concat(F.lit(f"no {what} for "), key)).cast("string")
    out = raw.select(key.alias("id"), F.coalesce(said, fail("question")).alias("instruction"), F.when(gold.rlike("^[A-H]$"), gold).otherwise(fail("answer key")).alias("ground_truth"), F.lit("qasc").alias("domain"), F.lit(8).alias("num_choices"))
    return annotated(out, "qasc")


def local_items(spark: SparkSession, path: str, dataset: str, schema: T.StructType) -> DataFrame:
    rows = jsonl(spark, path, schema)
    return annotated(rows.withColumn("domain", F.coalesce("domain", F.lit(DOMAINS.get(dataset.lower(), "coding")))), dataset)


def candidates(name: str, split: str, folder: str) -> list[str]:
    """Where a local file of a dataset may lie, in order."""
    low = name.lower()
    return [f"{folder}/{low}_{split}.jsonl", f"{folder}/{'Math' if low == 'math' else 'Coding'}/{low}_{split}.jsonl"]


def resolve(spark: SparkSession, name: str, split: str = "test", *, folder: str | None = None, schema: T.StructType | None = None, readers: dict[str, Callable[[str], DataFrame]] | None = None, ratio: float = 1.0, seed: int | None = 42) -> DataFrame:
    """Items of a dataset: a local file, else the reader of that name; an unknown name is an error.

    A ratio below 1 takes that share of the items in a seeded order of their ids; without a seed,
    that of seed 0. readers give the items of a split from wherever the caller keeps them.
    """
    items = None
    for path in candidates(name, split, folder) if folder else []:
        try:
            items = local_items(spark, path, name, schema or text_schema("id", "instruction", "ground_truth", "domain"))
            break
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if items is None:
        if name.lower() not in (readers or {}):
            raise ValueError(f"Unknown dataset: {name}")
        items = readers[name.lower()](split)
    return items if ratio >= 1.0 else ratio_head(items, "id", ratio, seed or 0, key=hash_key("id", seed or 0))
