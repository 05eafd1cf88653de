"""Feature vectors by id: alignment, standardisation, linear and centroid routers."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import small


def aligned(features: DataFrame, ids: DataFrame, order: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """The features of the ids; with an order (ordinal, id) of its rows, where an id without features is an error."""
    if order is None:
        return features.join(ids.select(id_col), id_col, "left_semi")
    marked = features.withColumn("__has", F.lit(True))
    out = order.select("ordinal", id_col).join(marked, id_col, "left")
    return out.where(F.when(F.col("__has"), True).otherwise(F.raise_error(F.concat(F.lit("no features for "), F.col(id_col).cast("string"))).cast("boolean"))).drop("__has")


def concatenated(parts: list[DataFrame], id_col: str = "id", feature: str = "feature") -> DataFrame:
    """One vector of several, for the ids that all of them have."""
    out = parts[0].select(id_col, F.col(feature).alias("__0"))
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.select(id_col, F.col(feature).alias(f"__{i}")), id_col)
    return out.select(id_col, F.concat(*[f"__{i}" for i in range(len(parts))]).alias(feature))


def confidence_matrix(conf: DataFrame, experts: list[str], order: DataFrame) -> DataFrame:
    """ordinal, id, conf: the experts' confidences in their order; a pair that is missing is an error."""
    wide = conf.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("expert_id", "conf"))).alias("__by"))
    out = order.join(wide, "id", "left")
    value = lambda e: F.coalesce(F.try_element_at("__by", F.lit(e)), F.raise_error(F.concat(F.lit(f"no confidence of {e} for "), F.col("id").cast("string"))).cast("double"))
    return out.select("ordinal", "id", F.array(*[value(e) for e in experts]).alias("conf"))


def standardized(rows: DataFrame, train: Column, id_col: str = "id", feature: str = "feature", eps: float = 1e-6) -> DataFrame:
    """Each dimension less its mean over its population deviation, both of the training rows only."""
    each = rows.where(train).select(F.posexplode(feature).alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    stats = each.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
    # one row, as long as a vector
    one = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", "d"))).alias("__s"))
    z = F.zip_with(feature, "__s", lambda x, s: (x.cast("double") - s["m"]) / (s["d"] + eps))
    return rows.join(F.broadcast(one)).withColumn(feature, z).drop("__s")


def multihot_target(solve: DataFrame, special: Column, low: int, high: int) -> DataFrame:
    """problem_id, ordinal, target: special experts count on problems of at most `low` solvers, others on those of at least `high`."""
    n = solve.groupBy("problem_id").agg(F.sum("solved").alias("n_solved"))
    counts = (special & (F.col("n_solved") <= low)) | (~special & (F.col("n_solved") >= high))
    return solve.join(n, "problem_id").select("problem_id", "ordinal", F.when(counts, F.col("solved")).otherwise(0).alias("target"))


def nearest_centroid(rows: DataFrame, train: Column, label: str, id_col: str = "id", feature: str = "feature") -> DataFrame:
    """id, routed: the class whose mean of training vectors is nearest, the smaller of equals; more classes than a broadcast may have are an error."""
    each = rows.where(train).select(F.col(label).alias("routed"), F.posexplode(feature).alias("i", "v")).groupBy("routed", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centroids = each.groupBy("routed").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select("routed", F.col("c.m").alias("m"))
    far = F.aggregate(F.zip_with(feature, "m", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, y: s + y)
    best = rows.select(id_col, feature).join(F.broadcast(small(centroids))).groupBy(id_col).agg(F.min(F.struct(F.round(far, 6).alias("d"), "routed")).alias("b"))
    return best.select(id_col, "b.routed")


def linear_router(train: DataFrame, rows: DataFrame, targets: list[str], id_col: str = "id", feature: str = "feature", reg: float = 0.01, iterations: int = 50) -> DataFrame:
    """id, ordinal, logit: a logistic regression for each target column of train, applied to rows. The model of a target that has one value only gives null."""
    vector = array_to_vector(F.transform(feature, lambda x: x.cast("double")))
    known, out = train.withColumn("__x", vector), None
    asked = rows.select(id_col, vector.alias("__x"))
    for k, target in enumerate(targets):
        if known.agg(F.countDistinct(target)).first()[0] < 2:
            scored = asked.select(id_col, F.lit(k).alias("ordinal"), F.lit(None).cast("double").alias("logit"))
        else:
            model = LogisticRegression(featuresCol="__x", labelCol=target, regParam=reg, maxIter=iterations).fit(known.select("__x", F.col(target).cast("double").alias(target)))
            scored = model.transform(asked).select(id_col, F.lit(k).alias("ordinal"), vector_to_array("rawPrediction")[1].alias("logit"))
        out = scored if out is None else out.unionByName(scored)
    return out


def ensemble(logits: list[DataFrame], id_col: str = "id") -> DataFrame:
    """id, ordinal, logit: the mean of several routers' logits."""
    both = logits[0]
    for d in logits[1:]:
        both = both.unionByName(d)
    return both.groupBy(id_col, "ordinal").agg(F.avg("logit").alias("logit"))
