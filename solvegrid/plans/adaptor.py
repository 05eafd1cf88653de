"""The solve relation over the synthetic tables, the same in Spark and in SQL.

Labelled documents are problems, quality is the gold label, and six rules are the experts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table

EXPERTS = 6


def roster(spark: SparkSession) -> DataFrame:
    return spark.range(EXPERTS).select(F.col("id").alias("ordinal"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("expert_id"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("problem_id"), F.col("quality").alias("gold"), "toxic", "lang", "source", "n_chars")


def solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problem_id, lang, source, ordinal, expert_id, pred, solved, conf."""
    i = items(spark, sf_dir)
    rules = [F.col("n_chars") >= 500, F.col("n_chars") < 5000, F.col("lang") == "en", F.col("problem_id") % 3 != 0, F.col("toxic") == 0, F.col("n_chars") % 2 == 0]
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("ordinal"), F.lit(f"e{k}").alias("expert_id"), r.cast("int").alias("pred")) for k, r in enumerate(rules)]))
    conf = ((F.col("problem_id") * 7919 + F.col("ordinal") * 104729) % 1000) / F.lit(1000.0)
    return i.select("problem_id", "lang", "source", "gold", each.alias("e")).select("problem_id", "lang", "source", "gold", "e.*").withColumn("solved", (F.col("pred") == F.col("gold")).cast("int")).withColumn("conf", conf)


SOLVE = """
items AS (SELECT l.doc_id AS problem_id, l.quality AS gold, l.toxic, d.lang, d.source, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
solve AS (
  SELECT *, CASE WHEN pred = gold THEN 1 ELSE 0 END AS solved, ((problem_id * 7919 + ordinal * 104729) % 1000)::DOUBLE / 1000 AS conf FROM (
    SELECT problem_id, lang, source, gold, o.ordinal, 'e' || o.ordinal AS expert_id,
      (CASE o.ordinal WHEN 0 THEN n_chars >= 500 WHEN 1 THEN n_chars < 5000 WHEN 2 THEN lang = 'en' WHEN 3 THEN problem_id % 3 <> 0 WHEN 4 THEN toxic = 0 ELSE n_chars % 2 = 0 END)::INT AS pred
    FROM items CROSS JOIN (SELECT range AS ordinal FROM range(6)) o)),
per AS (SELECT problem_id, sum(solved) AS n_solved, max(solved) AS any_solved FROM solve GROUP BY problem_id)
"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a hundred events: step, expert_id, war (values over 50 that no other expert shares a type of), batch_n."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("step"), (F.col("user_id") % 7).alias("expert_id"), (F.col("value") > 50).cast("int").alias("hit"))
    return e.groupBy("step", "expert_id").agg(F.sum("hit").alias("war")).withColumn("batch_n", F.lit(100))


LOG = "log AS (SELECT event_id // 100 AS step, user_id % 7 AS expert_id, sum((value > 50)::INT) AS war, 100 AS batch_n FROM events GROUP BY ALL)"
