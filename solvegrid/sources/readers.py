"""Readers with declared schemas, resume, and writers of label packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "instruction", "ground_truth", "domain", "dataset", "scoring_kind")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType = ITEM, tolerant: bool = False) -> DataFrame:
    """One record a line. Strict: a malformed line fails. Tolerant: such lines are dropped; malformed() gives them."""
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return _permissive(spark, path, schema).where(F.col(_BAD).isNull()).drop(_BAD)


_BAD = "_corrupt"


def _permissive(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).json(path)


def malformed(spark: SparkSession, path: str | list[str], schema: T.StructType = ITEM) -> DataFrame:
    """file, line, n: the lines that a tolerant read drops, and how often each file has them; blank lines aren't records."""
    # the text is read, since a scan for the corrupt column alone isn't allowed
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    read = F.from_json("line", T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    return lines.withColumn("__bad", read[_BAD]).where("__bad is not null").groupBy("file", "line").agg(F.count(F.lit(1)).alias("n"))


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...], without: tuple[str, ...] = ()) -> list[str]:
    """The files of a folder with one of the suffixes, but for those that end in one of the others, in order; a file is itself."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        raise FileNotFoundError(path)
    if fs.getFileStatus(place).isFile():
        return [path]
    names = sorted(str(x.getPath().getName()) for x in fs.listStatus(place) if x.isFile())
    return [f"{path}/{n}" for n in names if n.endswith(suffixes) and not (without and n.endswith(without))]


def with_file_id(rows: DataFrame, pattern: str, into: str = "file_id") -> DataFrame:
    """The id that a pattern finds in the name of each row's file."""
    return rows.withColumn(into, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def append_new(rows: DataFrame, to: str, key: str = "id") -> None:
    """Appends the rows whose key isn't there yet."""
    spark = rows.sparkSession
    try:
        done = spark.read.schema(rows.schema).json(to).select(key)
        rows = rows.join(done, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").json(to)


def label_package(binned: DataFrame, mapping: DataFrame, to: str) -> None:
    """labels (JSON), mapping (JSON and CSV), solves of each expert, and a summary with counts of each expert, each in its own folder."""
    binned.write.mode("overwrite").json(f"{to}/labels")
    mapping.write.mode("overwrite").json(f"{to}/mapping")
    mapping.write.mode("overwrite").option("header", True).csv(f"{to}/mapping_csv")
    pairs = binned.select("problem_id", F.explode("per_expert").alias("expert_id", "solved"))
    pairs.where("solved = 1").select("expert_id", "problem_id").write.mode("overwrite").json(f"{to}/solves")
    each = pairs.groupBy("expert_id").agg(F.sum("solved").cast("long").alias("solved"), F.count(F.lit(1)).alias("total"))
    each = each.withColumn("train_pass_at_1", F.round(F.col("solved") * 100 / F.col("total"), 2))
    each.write.mode("overwrite").json(f"{to}/experts")
    binned.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_solved") > 0).alias("union_ub")).write.mode("overwrite").json(f"{to}/summary")


def summary(row: DataFrame, to: str) -> None:
    """A run's figures as one JSON record in one file."""
    row.coalesce(1).write.mode("overwrite").json(to)


def report(rows: DataFrame, to: str, order: list[str] | None = None) -> None:
    """A table of a report as one CSV file with a header, in order."""
    (rows.orderBy(*order) if order else rows).coalesce(1).write.mode("overwrite").option("header", True).csv(to)


def markdown(rows: DataFrame, order: list[str], most: int = 1000) -> str:
    """A report's table as Markdown; more rows than a reader would look at are an error."""
    got = rows.orderBy(*order).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "/")
    head = [f"| {' | '.join(rows.columns)} |", f"|{'-|' * len(rows.columns)}"]
    return "\n".join([*head, *[f"| {' | '.join(map(cell, r))} |" for r in got]])
