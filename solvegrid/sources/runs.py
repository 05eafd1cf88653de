"""What a run keeps: merged configurations, names of outputs, the step log, snapshots of the roster, and where to resume."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract

#: The roster that a run begins with if it has none.
DEFAULT_ROSTER = (
    {"id": "array", "name": "Array Specialist", "strengths": "Fixed-size and dynamic arrays: index bounds, off-by-one, two-pointer, sliding window, prefix/suffix sums, in-place updates"},
    {"id": "string", "name": "String Specialist", "strengths": "String parsing, building, comparison, regex, formatting rules, empty and whitespace edge cases"},
    {"id": "dp", "name": "Dynamic Programming Specialist", "strengths": "State design, recurrence relations, base cases, memoization, tabulation, overlapping subproblems"},
    {"id": "graph", "name": "Tree & Graph Specialist", "strengths": "Graph representation, BFS/DFS, trees, shortest paths, connectivity, cycle detection, visited tracking"},
    {"id": "math_geom", "name": "Math & Geometry Specialist", "strengths": "Number theory, modular arithmetic, primes and divisibility, combinatorics, coordinate geometry, distances and angles"},
)
ROSTER = "ordinal long, id string, name string, strengths string, system_prompt string, approach string, total_war long, active_steps long, average_war double, lives int, recent_unique array<long>, history array<string>"


def merge_config(base: Mapping[str, object], over: Mapping[str, object] | None) -> dict[str, object]:
    """Values of over take the place of whole top-level values of base; null ones are left out."""
    return {**base, **{k: v for k, v in (over or {}).items() if v is not None}}


def name_part(value: str | None) -> str:
    """The last part of a path as a piece of a file name."""
    last = (value or "").strip().rstrip("/").rpartition("/")[2]
    return re.sub(r"[^A-Za-z0-9._-]+", "_", last).strip("._-") or "unknown"


def output_name(dataset: str, model: str, job: str, adapter: str | None = None, prompt: str | None = None) -> str:
    return "_".join(map(name_part, (dataset, adapter or model, prompt or "baseline", job))) + ".jsonl"


def persona(fields: Mapping[str, object], id_: str, ordinal: int, lives: int, history: list[str] | None = None) -> dict[str, object]:
    """A member of the roster with its counters at nothing; lists and objects among its texts become lines."""
    text = lambda k: None if fields.get(k) is None else extract.as_text(fields[k])
    name = text("name") if "name" in fields else text("persona_name")
    own = {"ordinal": ordinal, "id": id_, "name": name, "strengths": text("strengths"), "system_prompt": text("system_prompt"), "approach": text("approach")}
    return own | {"total_war": int(fields.get("total_war", 0)), "active_steps": int(fields.get("active_steps", 0)), "average_war": float(fields.get("average_war", 0.0)), "lives": int(fields.get("lives", lives)), "recent_unique": [], "history": (history or [])[-10:]}


def default_roster(spark: SparkSession, lives: int = 3) -> DataFrame:
    rows = [persona(p | {"system_prompt": f"You are a critic of {p['name'].removesuffix(' Specialist').lower()} algorithms. {p['strengths']}."}, p["id"], i, lives) for i, p in enumerate(DEFAULT_ROSTER)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ROSTER)


def load_roster(spark: SparkSession, path: str) -> DataFrame:
    """The roster of a folder or file of JSON lines; none if it isn't there or can't be read."""
    try:
        # a roster is a handful of rows; read at once, so that it may be written over
        return spark.createDataFrame(spark.read.schema(ROSTER).option("mode", "FAILFAST").json(path).collect(), ROSTER)
    except Exception as e:
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "MALFORMED", "FAILED_READ_FILE")):
            raise
        return spark.createDataFrame([], ROSTER)


def save_roster(roster: DataFrame, path: str) -> None:
    roster.coalesce(1).write.mode("overwrite").json(path)


def ensure_roster(spark: SparkSession, path: str) -> DataFrame:
    """The roster that is there, else the default one, which is written."""
    found = load_roster(spark, path)
    if found.isEmpty():
        found = default_roster(spark)
        save_roster(found, path)
    return found


def mapped_roster(spark: SparkSession, mapping: Mapping[str, Mapping[str, object]], experts: int | None = None, lives: int = 3) -> DataFrame:
    """A roster of a mapping by id; another number of experts than is wanted, or one without a system prompt, is an error."""
    if not mapping or (experts is not None and len(mapping) != experts):
        raise ValueError(f"{len(mapping)} experts, wanted {experts or 'some'}")
    bare = [k for k, v in mapping.items() if not v.get("system_prompt")]
    if bare:
        raise ValueError(f"no system prompt for {', '.join(bare)}")
    return spark.createDataFrame([tuple(persona(v, k, i, lives).values()) for i, (k, v) in enumerate(mapping.items())], ROSTER)


def best_expert(mapping: DataFrame, wanted: str | None = None) -> DataFrame:
    """The expert asked for, which must be known; else the one of the best rate, the first of equals."""
    if wanted in (None, "", "best"):
        return mapping.orderBy(F.desc(F.coalesce("train_pass_at_1", F.lit(0.0))), "ordinal").limit(1)
    named = mapping.where(F.col("id") == wanted)
    known = named.agg(F.count(F.lit(1)).alias("__n"))
    return known.withColumn("__ok", F.when(F.col("__n") == 0, F.raise_error(F.lit(f"unknown expert {wanted}")).cast("boolean")).otherwise(True)).join(named).where("__ok").drop("__n", "__ok")


def append_step(record: DataFrame, folder: str) -> None:
    """Adds a step's record to the log; records have step, epoch, batch_idx and roster_after besides what they tell."""
    record.coalesce(1).write.mode("append").json(f"{folder}/log")


def snapshot(roster: DataFrame, folder: str, step: int) -> None:
    save_roster(roster, f"{folder}/roster/step={step}")


def resume(spark: SparkSession, folder: str, schema: str = "step long, epoch long, batch_idx long") -> tuple[dict[str, int] | None, DataFrame]:
    """The last step that was logged and has a snapshot, with the roster after it; nothing without a log or its last step's snapshot."""
    none = None, spark.createDataFrame([], ROSTER)
    try:
        last = spark.read.schema(schema).json(f"{folder}/log").orderBy(F.desc("step")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return none
    if last is None:
        return none
    roster = load_roster(spark, f"{folder}/roster/step={last['step']}")
    return none if roster.isEmpty() else (last.asDict(), roster)


def same_digests(left: DataFrame, right: DataFrame, key: str, content: str) -> DataFrame:
    """key, same: whether the contents of both sides agree by sha256; a side that lacks the key differs."""
    a, b = (d.select(F.col(key), F.sha2(F.col(content).cast("binary"), 256).alias(f"__{n}")) for d, n in ((left, "a"), (right, "b")))
    return a.join(b, key, "full").select(key, F.coalesce(F.col("__a") == F.col("__b"), F.lit(False)).alias("same"))
