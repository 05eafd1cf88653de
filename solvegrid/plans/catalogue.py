"""The catalogue: each query over the synthetic tables, and its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import coverage, evolog, features, joins, ranking, relation, scores, splits
from ..sources.readers import table
from .adaptor import EXPERTS, SOLVE, items, log, roster, solve
from .registry import ORACLES, QUERIES, over_log, over_solve, query

# --- coverage -----------------------------------------------------------------------------


@over_solve("""SELECT s.ordinal, s.expert_id, sum(solved)::BIGINT AS n_solved, count(*) AS total, round(avg(solved) * 100, 6) AS pass_pct,
  count(*) FILTER (solved = 1 AND n_solved = 1) AS war, max(u.ub)::BIGINT AS union_ub
  FROM solve s JOIN per USING (problem_id), (SELECT sum(any_solved) AS ub FROM per) u GROUP BY s.ordinal, s.expert_id""")
def binning_summary(spark, sf):
    s = solve(spark, sf)
    union = coverage.union_ub(s).select("union_ub")
    return coverage.pass_at_1(s).join(coverage.war(s, roster(spark)).select("expert_id", "war"), "expert_id").join(F.broadcast(union))


@over_solve("SELECT n_solved::BIGINT AS n_solved, count(*) AS n_problems FROM per GROUP BY n_solved")
def coverage_histogram(spark, sf):
    return coverage.histogram(solve(spark, sf))


@over_solve("SELECT b.range AS n_solved, count(per.problem_id) AS n_problems FROM range(7) b LEFT JOIN per ON per.n_solved = b.range GROUP BY b.range")
def coverage_histogram_dense(spark, sf):
    return coverage.dense_histogram(solve(spark, sf), EXPERTS)


@over_solve("SELECT count(*) FILTER (n_solved = 6) AS solved_by_all, count(*) FILTER (n_solved = 0) AS solved_by_none FROM per")
def solved_by_all_or_none(spark, sf):
    return coverage.all_or_none(solve(spark, sf))


@over_solve("SELECT ordinal, expert_id, count(*) FILTER (solved = 1 AND n_solved = 1) AS war FROM solve JOIN per USING (problem_id) GROUP BY ordinal, expert_id")
def war_scores(spark, sf):
    return coverage.war(solve(spark, sf), roster(spark))


@over_solve("SELECT expert_id, problem_id FROM solve JOIN per USING (problem_id) WHERE solved = 1 AND n_solved = 1")
def exclusive_solves(spark, sf):
    return coverage.exclusive(solve(spark, sf))


@over_solve("SELECT problem_id FROM solve WHERE expert_id = 'e5' AND solved = 1 EXCEPT SELECT problem_id FROM solve WHERE expert_id <> 'e5' AND solved = 1")
def niche_of_worst(spark, sf):
    return coverage.niche(solve(spark, sf), "e5")


@over_solve("SELECT sum(any_solved)::BIGINT AS union_ub, count(*) AS total, round(avg(any_solved) * 100, 6) AS union_pct FROM per")
def union_ub(spark, sf):
    return coverage.union_ub(solve(spark, sf))


@over_solve("SELECT lang, sum(any_solved)::BIGINT AS union_ub, count(*) AS total, round(avg(any_solved) * 100, 6) AS union_pct FROM per JOIN items USING (problem_id) GROUP BY lang")
def union_ub_by_task(spark, sf):
    return coverage.union_ub(solve(spark, sf), ["lang"])


_BEST = "best AS (SELECT max(r) AS best, avg(r) AS random_route FROM (SELECT avg(solved) AS r FROM solve GROUP BY expert_id)), top AS (SELECT avg(any_solved) AS oracle FROM per)"


@over_solve(f""", {_BEST} SELECT round(best, 9) AS best_single, round(random_route, 9) AS random_route, round(oracle, 9) AS oracle,
  round((random_route - best) / (oracle - best + 1e-9), 6) AS headroom_recovery FROM best, top""")
def best_single_oracle(spark, sf):
    return coverage.best_and_oracle(solve(spark, sf))


@over_solve("SELECT ordinal, expert_id, round(avg(solved), 9) AS rate FROM solve GROUP BY ordinal, expert_id ORDER BY rate DESC, ordinal LIMIT 1")
def anchor_expert(spark, sf):
    return coverage.anchor(solve(spark, sf))


@over_solve("SELECT problem_id, string_agg(expert_id, ',' ORDER BY ordinal) FILTER (solved = 1) AS solved_by, sum(solved)::BIGINT AS n_solved FROM solve GROUP BY problem_id")
def binned_records(spark, sf):
    b = relation.to_binned(solve(spark, sf))
    return b.select("problem_id", F.nullif(F.array_join("solved_by", ","), F.lit("")).alias("solved_by"), F.col("n_solved").cast("long").alias("n_solved"))


@over_solve("SELECT problem_id, ordinal, expert_id, solved FROM solve")
def binned_round_trip(spark, sf):
    b = relation.to_binned(solve(spark, sf))
    return relation.from_binned(b, roster(spark)).select("problem_id", "ordinal", "expert_id", "solved")


@over_solve("""SELECT expert_id, row_number() OVER (ORDER BY f, o) - 1 AS place FROM (SELECT expert_id, min(problem_id) AS f, min(ordinal) AS o FROM solve WHERE solved = 1 GROUP BY expert_id)""")
def expert_key_union(spark, sf):
    return relation.key_union(relation.to_binned(solve(spark, sf)), "solved_by", "problem_id").withColumn("place", F.col("place").cast("long"))


def _sets(k: int) -> str:
    names = "abcd"[:k]
    members = " || ',' || ".join(f"'e' || {n}.o" for n in names)
    tables = ", ".join(f"(SELECT range AS o FROM range(6)) {n}" for n in names)
    order = " AND ".join(f"{a}.o < {b}.o" for a, b in zip(names, names[1:], strict=False)) or "true"
    return f"""SELECT members, count(DISTINCT problem_id) AS covered FROM (SELECT {members} AS members, [{', '.join(f'{n}.o' for n in names)}] AS l FROM {tables} WHERE {order}) c
      JOIN solve ON solved = 1 AND list_contains(l, ordinal) GROUP BY members, l ORDER BY covered DESC, l LIMIT 1"""


for _k in (2, 3, 4):
    QUERIES[f"best_fixed_{_k}set"] = lambda spark, sf, k=_k: coverage.best_fixed_set(solve(spark, sf), EXPERTS, k)
    ORACLES[f"best_fixed_{_k}set"] = f"WITH {SOLVE} {_sets(_k)}"


@over_solve(""", load AS (SELECT expert_id, sum(solved) AS load FROM solve GROUP BY expert_id),
  rare AS (SELECT problem_id, expert_id FROM solve JOIN load USING (expert_id) WHERE solved = 1 QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY load, ordinal) = 1)
  SELECT per.problem_id, CASE WHEN n_solved = 0 THEN '(all fail)' WHEN n_solved >= 5 THEN '(all solved)' ELSE expert_id END AS label FROM per LEFT JOIN rare USING (problem_id)""")
def expert_class_labels(spark, sf):
    return coverage.class_labels(solve(spark, sf), EXPERTS)


@query("""WITH t AS (SELECT lang AS a, source AS b FROM documents), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM t GROUP BY ALL), n AS (SELECT sum(n) AS t FROM c),
  r AS (SELECT a, sum(n) AS m FROM c GROUP BY a), s AS (SELECT b, sum(n) AS m FROM c GROUP BY b),
  p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS sc, (SELECT sum(m * (m - 1) / 2) FROM r) AS sa, (SELECT sum(m * (m - 1) / 2) FROM s) AS sb, t,
    (SELECT sum(-n / t * ln(n / t)) FROM c) AS hab, (SELECT sum(-m / t * ln(m / t)) FROM r) AS ha, (SELECT sum(-m / t * ln(m / t)) FROM s) AS hb FROM n)
  SELECT round((sc - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 4) AS ari, round((ha + hb - hab) / ((ha + hb) / 2), 4) AS nmi FROM p""")
def cluster_agreement(spark, sf):
    return coverage.agreement(table(spark, sf, "documents"), "lang", "source")


@over_solve("SELECT expert_id AS method, source AS subset, sum(solved)::BIGINT AS correct, count(*) AS n, round(avg(solved), 6) AS accuracy FROM solve GROUP BY ALL")
def method_subset_accuracy(spark, sf):
    s = solve(spark, sf)
    return coverage.method_subset_accuracy(s.select("problem_id", F.col("expert_id").alias("method"), F.col("solved").alias("correct")), s.select("problem_id", F.col("source").alias("subset")).distinct())


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS only_left, count(*) FILTER (d.doc_id IS NULL) AS only_right, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS both FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def id_coverage_check(spark, sf):
    return coverage.id_coverage(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@over_solve(""", v AS (SELECT problem_id, pred, round(sum(conf), 6) AS w FROM solve GROUP BY ALL), b AS (SELECT problem_id, pred AS plurality FROM v QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY w DESC, pred) = 1)
  SELECT problem_id, expert_id, plurality, round((pred = plurality)::INT::DOUBLE + 0.01::DOUBLE * conf, 6) AS score FROM solve JOIN b USING (problem_id)""")
def plurality_agreement(spark, sf):
    return coverage.plurality(solve(spark, sf))


@query("""WITH best AS (SELECT l_orderkey AS p, l_suppkey % 12 AS e, max((l_returnflag <> 'N')::INT) AS solved FROM lineitem GROUP BY ALL),
  n AS (SELECT p, sum(solved) AS n FROM best GROUP BY p), t AS (SELECT count(*) AS t, count(*) FILTER (n > 0) AS u FROM n)
  SELECT e AS ordinal, sum(solved)::BIGINT AS n_solved, max(t) AS total, count(*) FILTER (solved = 1 AND n = 1) AS war, max(u) AS union_ub FROM best JOIN n USING (p), t GROUP BY e""")
def lineitem_solve_matrix(spark, sf):
    """The relation at its largest: sparse pairs, missing ones counting as not solved without being made."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("problem_id"), (F.col("l_suppkey") % 12).alias("ordinal"), (F.col("l_returnflag") != "N").cast("int").alias("solved"))
    return coverage.sparse_summary(rows)


# --- routing ------------------------------------------------------------------------------


def _routed(score: str) -> str:
    return f""", {_BEST}, scored AS (SELECT *, {score} AS sc FROM solve), pick AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY sc DESC, ordinal) = 1), hit AS (SELECT avg(solved) AS routed FROM pick)
  SELECT round(routed, 9) AS routed, round(best, 9) AS best, round(oracle, 9) AS oracle, round((routed - best) / (oracle - best + 1e-9), 6) AS headroom_recovery FROM hit, best, top"""


@over_solve(_routed("conf"))
def conf_route_raw(spark, sf):
    s = solve(spark, sf)
    return ranking.routed(ranking.top_k(s, "conf", 1), s)


@over_solve(_routed("round((conf - avg(conf) OVER (PARTITION BY expert_id)) / (stddev_pop(conf) OVER (PARTITION BY expert_id) + 1e-6), 9)"))
def conf_route_znorm(spark, sf):
    s = ranking.znorm(solve(spark, sf), "conf", "expert_id", "z")
    return ranking.routed(ranking.top_k(s, F.round("z", 9), 1), s)


@over_solve(_routed("(rank() OVER (PARTITION BY expert_id ORDER BY conf) + (count(*) OVER (PARTITION BY expert_id, conf) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY expert_id)"))
def conf_route_rank(spark, sf):
    s = ranking.average_rank(solve(spark, sf), "conf", "expert_id", "r")
    return ranking.routed(ranking.top_k(s, "r", 1), s)


@over_solve(_routed("row_number() OVER (PARTITION BY expert_id ORDER BY conf, problem_id) - 1"))
def conf_route_ordinal_rank(spark, sf):
    s = ranking.ordinal_rank(solve(spark, sf), "conf", "expert_id", "problem_id", "r")
    return ranking.routed(ranking.top_k(s, "r", 1), s)


@over_solve(_routed("10 * solved + conf"))
def oracle_route(spark, sf):
    s = solve(spark, sf)
    return ranking.routed(ranking.top_k(s, 10 * F.col("solved") + F.col("conf"), 1), s)


@over_solve("SELECT problem_id, expert_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY conf DESC, ordinal) AS pick FROM solve) WHERE pick <= 2")
def topk_routing_top2(spark, sf):
    return ranking.top_k(solve(spark, sf), "conf", 2).select("problem_id", "expert_id", "pick")


@over_solve("""SELECT sum(t1)::BIGINT AS top1, sum(any2)::BIGINT AS topk, sum((any2 = 1 AND t1 = 0)::INT)::BIGINT AS recovered FROM (
  SELECT problem_id, max(solved) AS any2, max(CASE WHEN pick = 1 THEN solved ELSE 0 END) AS t1 FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY conf DESC, ordinal) AS pick FROM solve) WHERE pick <= 3 GROUP BY problem_id)""")
def recovered_by_extra_picks(spark, sf):
    return ranking.pick_summary(ranking.top_k(solve(spark, sf), "conf", 3))


@over_solve(""", a AS (SELECT expert_id FROM solve GROUP BY ordinal, expert_id ORDER BY round(avg(solved), 9) DESC, ordinal LIMIT 1),
  second AS (SELECT problem_id, solved FROM solve WHERE expert_id NOT IN (SELECT expert_id FROM a) QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY conf DESC, ordinal) = 1),
  picks AS (SELECT problem_id, solved FROM second UNION ALL SELECT problem_id, solved FROM solve WHERE expert_id IN (SELECT expert_id FROM a))
  SELECT sum(hit)::BIGINT AS covered, count(*) AS total FROM (SELECT max(solved) AS hit FROM picks GROUP BY problem_id)""")
def anchor_residual_union(spark, sf):
    s = solve(spark, sf)
    return ranking.union_of(ranking.anchor_and_residual(s, "conf", coverage.anchor(s)))


@over_solve(""", p AS (SELECT problem_id, solved FROM solve QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY conf DESC, ordinal) = 1 UNION ALL
  SELECT problem_id, solved FROM solve QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY (problem_id + ordinal * 37) % 11 DESC, ordinal) = 1)
  SELECT sum(hit)::BIGINT AS covered, count(*) AS total FROM (SELECT max(solved) AS hit FROM p GROUP BY problem_id)""")
def hybrid_route_union(spark, sf):
    return ranking.union_of(ranking.hybrid(solve(spark, sf), "conf", (F.col("problem_id") + F.col("ordinal") * 37) % 11))


@over_solve(""", m AS (SELECT expert_id, median(conf) AS mid FROM solve GROUP BY expert_id), s AS (SELECT expert_id, avg(solved) FILTER (conf >= mid) AS hi, avg(solved) FILTER (conf < mid) AS lo FROM solve JOIN m USING (expert_id) GROUP BY expert_id)
  SELECT round(avg(hi), 6) AS acc_high, round(avg(lo), 6) AS acc_low FROM s""")
def calibration_median_split(spark, sf):
    return ranking.median_split(solve(spark, sf))


@over_solve(""", p AS (SELECT problem_id, solved FROM solve QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY conf DESC, ordinal) = 1)
  SELECT count(*) FILTER (any_solved = 1 AND p.solved = 0) AS missed, count(*) AS total FROM per JOIN p USING (problem_id)""")
def missed_headroom(spark, sf):
    s = solve(spark, sf)
    return ranking.missed_headroom(ranking.top_k(s, "conf", 1), s)


@over_solve("SELECT problem_id, round(list_sort(list(conf), 'DESC')[1] - list_sort(list(conf), 'DESC')[2], 6) AS margin FROM solve GROUP BY problem_id")
def top1_margin(spark, sf):
    return ranking.margin(solve(spark, sf), "conf")


@over_solve(""", t AS (SELECT expert_id, ordinal, sum(solved) AS w FROM solve GROUP BY ALL) SELECT expert_id, ordinal % 3 AS lives, w / 399.0::DOUBLE AS average_war, ordinal + 1 AS active_steps
  FROM t WHERE ordinal % 3 <= 0 ORDER BY w, active_steps DESC, expert_id LIMIT 1""")
def worst_agent(spark, sf):
    own = solve(spark, sf).groupBy("expert_id", "ordinal").agg(F.sum("solved").alias("w"))
    r = own.select("expert_id", (F.col("ordinal") % 3).alias("lives"), (F.col("w") / F.lit(399.0)).alias("average_war"), (F.col("ordinal") + 1).alias("active_steps"))
    return ranking.worst_agent(r)


@query("""SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IN ('1','2','3') THEN json_extract_string(props, '$.k') ELSE '0' END AS picked FROM events""")
def routing_parse_default(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", F.when(k.isin("1", "2", "3"), k).otherwise("0").alias("picked"))


@over_solve("SELECT problem_id, ordinal, CASE WHEN ordinal < 3 AND n_solved <= 3 THEN solved WHEN ordinal >= 3 AND n_solved >= 4 THEN solved ELSE 0 END AS target FROM solve JOIN per USING (problem_id)")
def router_multihot_target(spark, sf):
    return features.multihot_target(solve(spark, sf), F.col("ordinal") < 3, 3, 4)


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x WHERE vec_id % 5 <> 0 GROUP BY ALL),
  d AS (SELECT x.vec_id, c.label, round(sum((v - m) * (v - m)), 6) AS d FROM x JOIN c ON x.i = c.i GROUP BY ALL) SELECT vec_id, label AS routed FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, label) = 1""")
def nearest_centroid_route(spark, sf):
    return features.nearest_centroid(table(spark, sf, "embeddings"), F.col("vec_id") % 5 != 0, "label", "vec_id", "embedding")


@query("""WITH g AS (SELECT a.lang AS gold, b.lang AS pred FROM (SELECT DISTINCT lang FROM documents) a, (SELECT DISTINCT lang FROM documents) b), r AS (SELECT lang AS gold, CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END AS pred FROM documents),
  c AS (SELECT g.gold, g.pred, count(r.gold) AS n FROM g LEFT JOIN r ON g.gold = r.gold AND g.pred = r.pred GROUP BY ALL)
  SELECT gold, pred, n, round(sum(CASE WHEN gold = pred THEN n ELSE 0 END) OVER (PARTITION BY gold) / sum(n) OVER (PARTITION BY gold), 9) AS accuracy FROM c""")
def confusion_matrix(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("g"), F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")).alias("p"))
    return scores.confusion(d, "g", "p", ["de", "en", "es", "fr"])


# --- splits -------------------------------------------------------------------------------

def _key(id_: str, seed: int) -> str:
    return f"(({id_} * 7919 + {seed * 104729 + 12345}) % 1000003)"


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_key('doc_id', 42)}, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents), c AS (SELECT *, min(n) OVER () AS cap FROM r)
  SELECT doc_id, lang, CASE WHEN rn <= cap // 12 THEN 'val' WHEN rn <= 2 * (cap // 12) THEN 'test' ELSE 'train' END AS split FROM c WHERE rn <= cap""")
def split_balanced_10_1_1(spark, sf):
    return splits.balanced(table(spark, sf, "documents"), "doc_id", "lang", 42)


@query(f"""SELECT doc_id, source, CASE WHEN rn <= 10 THEN 'train' WHEN rn <= 12 THEN 'val' WHEN rn <= 14 THEN 'test' ELSE 'leftover' END AS split FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_key('doc_id', 7)}, doc_id) AS rn FROM documents)""")
def split_quota(spark, sf):
    return splits.quota(table(spark, sf, "documents"), "doc_id", {"train": 10, "val": 2, "test": 2}, ["source"], 7)


@over_solve(f"""SELECT problem_id, n_solved::BIGINT AS n_solved, CASE WHEN row_number() OVER (PARTITION BY n_solved ORDER BY {_key('problem_id', 3)}, problem_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY n_solved) * 0.2::DOUBLE, 0)) THEN 'heldout' ELSE 'train' END AS split FROM per WHERE n_solved > 0""")
def split_stratified_80_20(spark, sf):
    return splits.stratified(relation.n_solved(solve(spark, sf)).where("n_solved > 0"), "problem_id", "n_solved", 3)


@query(f"SELECT o_orderkey, ntile(5) OVER (ORDER BY {_key('o_orderkey', 1)}, o_orderkey)::INT AS fold FROM orders")
def kfold_assign(spark, sf):
    return splits.folds(table(spark, sf, "orders"), "o_orderkey", 5, 1)


@query(f"SELECT doc_id FROM documents ORDER BY {_key('doc_id', 42)}, doc_id LIMIT (SELECT greatest(1, floor(count(*) * 0.1::DOUBLE))::BIGINT FROM documents)")
def shuffle_head_ratio(spark, sf):
    return splits.ratio_head(table(spark, sf, "documents"), "doc_id", 0.1, 42).select("doc_id")


@query("""SELECT epoch, (row_number() OVER (PARTITION BY epoch ORDER BY (doc_id * (7919 + 2 * epoch) + 5) % 1000003, doc_id) - 1) // 32 AS batch, doc_id FROM labels, (SELECT range AS epoch FROM range(3))""")
def epoch_batches(spark, sf):
    return splits.batches(table(spark, sf, "labels"), "doc_id", 3, 32, 5).select(F.col("epoch").cast("long").alias("epoch"), "batch", "doc_id")


@over_solve("SELECT problem_id, n_solved::BIGINT AS n_solved FROM solve JOIN per USING (problem_id) WHERE expert_id = 'e2' AND solved = 1 AND n_solved <= 3")
def sft_low_consensus(spark, sf):
    s = solve(spark, sf)
    return scores.select_for_expert(s, relation.n_solved(s).select("problem_id", "n_solved"), "e2", low=3)


@over_solve("SELECT problem_id, n_solved::BIGINT AS n_solved FROM solve JOIN per USING (problem_id) WHERE expert_id = 'e2' AND solved = 1 AND n_solved >= 5")
def sft_high_consensus(spark, sf):
    s = solve(spark, sf)
    return scores.select_for_expert(s, relation.n_solved(s).select("problem_id", "n_solved"), "e2", high=5)


@over_solve(f"""SELECT problem_id FROM solve JOIN per USING (problem_id) WHERE expert_id = 'e0' AND solved = 1 AND (n_solved < 6 OR {_key('problem_id', 149)} < 300000)""")
def sft_unanimous_sample(spark, sf):
    s = solve(spark, sf)
    seed = sum(map(ord, "e0")) + 0
    own = scores.select_for_expert(s, relation.n_solved(s).select("problem_id", "n_solved"), "e0")
    return own.where((F.col("n_solved") < EXPERTS) | (splits.arithmetic_key("problem_id", seed) < 300000)).select("problem_id")


@query("""SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) FILTER (turn < last) AS prompt, max(CASE WHEN turn = last THEN text END) AS completion FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id""")
def sft_rows(spark, sf):
    c = table(spark, sf, "conversations").withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    said = F.array_sort(F.collect_list(F.when(F.col("turn") < F.col("last"), F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("s")))))
    g = c.groupBy("conv_id").agg(said.alias("p"), F.max(F.when(F.col("turn") == F.col("last"), F.col("text"))).alias("completion"))
    return g.select("conv_id", F.nullif(F.array_join(F.col("p.s"), "\n"), F.lit("")).alias("prompt"), "completion")


# --- joins and filters --------------------------------------------------------------------


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'label' ELSE d.source END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def ref_left_fallback(spark, sf):
    ref = table(spark, sf, "labels").select("doc_id", F.lit("label").alias("source"))
    return joins.with_reference(table(spark, sf, "documents").select("doc_id", "source"), ref, "doc_id", ["source"])


@query("SELECT l.doc_id, quality, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def label_source_inner(spark, sf):
    return joins.strict(table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")


@query("""WITH p AS (SELECT *, row_number() OVER () FROM part), f AS (SELECT p_brand, p_size, arg_max(p_type, p_partkey) AS a FROM part WHERE p_size <= 25 GROUP BY ALL), c AS (SELECT p_brand, arg_max(p_type, p_partkey) AS b FROM part WHERE p_size <= 25 GROUP BY ALL)
  SELECT part.p_partkey, coalesce(a, b) AS p_type FROM part LEFT JOIN f ON part.p_brand = f.p_brand AND part.p_size = f.p_size LEFT JOIN c ON part.p_brand = c.p_brand""")
def two_level_category_lookup(spark, sf):
    p = table(spark, sf, "part")
    return joins.two_level(p.select("p_partkey", "p_brand", "p_size"), p.where("p_size <= 25").select("p_partkey", "p_brand", "p_size", "p_type"), ["p_brand", "p_size"], ["p_brand"], "p_type", "p_partkey").select("p_partkey", "p_type")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf):
    return joins.resume(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def holdout_semijoin(spark, sf):
    return joins.holdout(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id")


@query("SELECT r.range AS ordinal, i.item_id, 'e' || r.range AS expert_id FROM benchmark i, range(6) r")
def fanout_cross(spark, sf):
    return joins.fan_out(table(spark, sf, "benchmark").select("item_id"), roster(spark))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 300) || chr(10) || '...[truncated]...' || chr(10) || right(text, 100) ELSE text END AS text FROM documents")
def middle_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.middle_truncate(F.col("text"), 400).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '[TRUNCATED: ' || (length(text) - 120) || ' chars omitted]' ELSE text END AS text FROM documents")
def clip_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clip(F.col("text"), 120).alias("text"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), 'none') AS picked FROM documents")
def first_nonempty(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(X.first_nonempty(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.col("source")), F.lit("none")).alias("picked"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 20 THEN 'small' ELSE p_brand END AS category, CASE WHEN p_size < 10 THEN 'tiny' WHEN p_size < 20 THEN 'modest' END AS merged_from FROM part")
def category_merge(spark, sf):
    raw = F.when(F.col("p_size") < 10, "tiny").when(F.col("p_size") < 20, "modest").otherwise(F.col("p_brand"))
    p = table(spark, sf, "part").select("p_partkey", raw.alias("c"))
    merged = F.col("c").isin("tiny", "modest")
    return p.select("p_partkey", F.when(merged, "small").otherwise(F.col("c")).alias("category"), F.when(merged, F.col("c")).alias("merged_from"))


@query("""WITH m AS (SELECT DISTINCT doc_id, source AS c FROM documents UNION SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END FROM documents), n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id) SELECT doc_id, CASE WHEN n = 1 THEN 'single' ELSE 'leftover' END AS part FROM n""")
def single_label_filter(spark, sf):
    labels = F.array_distinct(F.array(F.col("source"), F.when(F.col("doc_id") % 4 == 0, F.col("lang")).otherwise(F.col("source"))))
    return table(spark, sf, "documents").select("doc_id", F.when(F.size(labels) == 1, "single").otherwise("leftover").alias("part"))


# --- text ---------------------------------------------------------------------------------

_PUNCT = "'[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]'"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), {_PUNCT}, '', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT item_id, {_norm('text')} AS text FROM benchmark")
def normalize_text(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.normalize(F.col("text")).alias("text"))


@query(f"""WITH a AS (SELECT conv_id, turn, string_split({_norm('text')}, ' ') AS x, string_split(lead({_norm('text')}) OVER (PARTITION BY conv_id ORDER BY turn), ' ') AS y FROM conversations),
  t AS (SELECT conv_id, turn, list_filter(x, lambda s: s <> '') AS x, list_filter(y, lambda s: s <> '') AS y FROM a WHERE y IS NOT NULL),
  ux AS (SELECT conv_id, turn, unnest(x) AS w FROM t), uy AS (SELECT conv_id, turn, unnest(y) AS w FROM t),
  cx AS (SELECT conv_id, turn, w, count(*) AS n FROM ux GROUP BY ALL), cy AS (SELECT conv_id, turn, w, count(*) AS n FROM uy GROUP BY ALL),
  s AS (SELECT cx.conv_id, cx.turn, sum(least(cx.n, cy.n))::DOUBLE AS same FROM cx JOIN cy ON cx.conv_id = cy.conv_id AND cx.turn = cy.turn AND cx.w = cy.w GROUP BY ALL)
  SELECT t.conv_id, t.turn, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 WHEN len(x) = 0 OR len(y) = 0 OR same IS NULL THEN 0 ELSE 2 * (same / len(x)) * (same / len(y)) / (same / len(x) + same / len(y)) END::DOUBLE, 9) AS f1
  FROM t LEFT JOIN s ON t.conv_id = s.conv_id AND t.turn = s.turn""")
def token_f1(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next"))
    return c.where("next is not null").select("conv_id", "turn", F.round(X.token_f1(F.col("text"), F.col("next")), 9).alias("f1"))


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN abs(l_tax) < 1e-9 THEN abs(l_discount - l_tax) ELSE abs(l_discount - l_tax) / abs(l_tax) END < 1e-3)::INT::DOUBLE AS m FROM (SELECT l_orderkey, l_linenumber, round(l_discount, 2) AS l_discount, round(l_tax, 2) AS l_tax FROM lineitem)""")
def numerical_match(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.numerical_match(F.format_number("l_discount", 2), F.format_number("l_tax", 2)).alias("m"))


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name, '[\"''`“”‘’]', '', 'g'), '[\\s·ㆍ・\\-()\\[\\]{}.,:;，。]', '', 'g')) AS name FROM part")
def lbox_normalize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.legal_plain(F.col("p_name")).alias("name"))


@query(r"""SELECT conv_id, turn, upper(coalesce(regexp_extract_all(text, '(?i)(?:final\s+answer|answer|choice|option)[ \t]*(?:is|:)?[ \t]*\(?[ \t]*([A-H])[ \t]*\)?', 1)[-1], regexp_extract_all(text, '(?m)^\s*\(?\s*([A-H])\s*\)?\s*(?:[.)])?\s*$', 1)[-1], regexp_extract_all(text, '\(([A-H])\)', 1)[-1])) AS letter FROM conversations WHERE text IS NOT NULL""")
def option_letter_in_turns(spark, sf):
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", X.option_letter(F.col("text")).alias("letter"))


@over_solve("SELECT round(avg(m), 9) AS expected FROM (SELECT avg(solved) AS m FROM solve GROUP BY expert_id)")
def random_route_expectation(spark, sf):
    return coverage.random_route(solve(spark, sf))


@over_solve(""", s AS (SELECT problem_id FROM solve WHERE expert_id = 'e1' AND solved = 0 ORDER BY problem_id LIMIT 20)
  SELECT sum(solved)::BIGINT AS n_passed, count(*) AS total, round(sum(solved) * 100.0::DOUBLE / count(*), 6) AS pass_pct, (SELECT string_agg(problem_id, ',' ORDER BY problem_id) FROM s) AS failures FROM solve WHERE expert_id = 'e1'""")
def pass_at_1_file(spark, sf):
    r = solve(spark, sf).where("expert_id = 'e1'").withColumn("score", F.col("solved") * 100.0)
    return coverage.score_file(r, "problem_id", "score").withColumn("failures", F.array_join("failures", ","))


@over_solve("SELECT lang, " + ", ".join(f"round(avg(solved) FILTER (expert_id = 'e{k}') * 100, 2) AS e{k}" for k in range(EXPERTS)) + " FROM solve GROUP BY lang")
def method_subset_report(spark, sf):
    return coverage.report(solve(spark, sf), [f"e{k}" for k in range(EXPERTS)], "lang")


@query("SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'named ' || source ELSE source END AS source FROM documents")
def codename_lookup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    names = spark.createDataFrame([("src0", "named src0"), ("src1", "named src1")], "source string, name string")
    return joins.renamed(d, names, "source", "name").select("doc_id", "source")


@query("""SELECT user_id, coalesce(max(CASE WHEN user_id % 3 = 0 AND event_id % 5 = 0 THEN event_id END), arg_max(event_id, (value, event_id)) FILTER (user_id % 3 = 1 AND event_type <> 'view'), max(event_id)) AS step,
  CASE WHEN max(CASE WHEN user_id % 3 = 0 AND event_id % 5 = 0 THEN event_id END) IS NOT NULL THEN 'recorded' WHEN count(*) FILTER (user_id % 3 = 1 AND event_type <> 'view') > 0 THEN 'accuracy' ELSE 'latest' END AS reason FROM events GROUP BY user_id""")
def best_checkpoint(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.when((F.col("user_id") % 3 == 0) & (F.col("event_id") % 5 == 0), F.col("event_id")).alias("recorded"), F.when((F.col("user_id") % 3 == 1) & (F.col("event_type") != "view"), F.col("value")).alias("accuracy"))
    return ranking.best_checkpoint(e, "user_id", "recorded", "event_id", "accuracy")


@over_solve(", x AS (SELECT problem_id, ordinal, conf, exp(conf) / sum(exp(conf)) OVER (PARTITION BY problem_id) AS p FROM solve) SELECT problem_id, ordinal AS choice, round(p, 9) AS share FROM x QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY conf DESC, ordinal) = 1")
def letter_confidence(spark, sf):
    return ranking.letter_confidence(solve(spark, sf), "problem_id", "ordinal", "conf")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate <= DATE '1996-12-31' AND o_orderstatus = 'F'")
def contest_window_filter(spark, sf):
    return table(spark, sf, "orders").where("o_orderdate between date '1995-01-01' and date '1996-12-31' and o_orderstatus = 'F'").select("o_orderkey")


# --- pass@k and metrics -------------------------------------------------------------------

_EACH = "each AS (SELECT user_id, any_value(user_id % 3) AS g, count(*) AS n, sum((value > 50)::INT) AS c FROM events GROUP BY user_id)"
_PASS = "CASE WHEN min(n) >= {k} THEN round(avg(CASE WHEN n - c < {k} THEN 1 WHEN c = 0 THEN 0 ELSE 1 - list_product(list_transform(range((n - c + 1)::BIGINT, n + 1), lambda i: 1 - {k}::DOUBLE / i)) END), 9) END AS pass_at_{k}"


@query(f"WITH {_EACH} SELECT {_PASS.format(k=1)}, {_PASS.format(k=5)}, count(*) AS tasks FROM each")
def pass_at_k(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("value") > 50).cast("int").alias("ok"))
    return scores.pass_table(e, "user_id", "ok", [1, 5])


@query(f"WITH {_EACH} SELECT coalesce(g::VARCHAR, 'overall') AS grp, {_PASS.format(k=1)}, {_PASS.format(k=5)}, count(*) AS tasks FROM each GROUP BY GROUPING SETS ((), (g))")
def pass_at_k_by_group(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("user_id") % 3).cast("string").alias("grp"), (F.col("value") > 50).cast("int").alias("ok"))
    return scores.pass_table(e, "user_id", "ok", [1, 5], "grp")


@query("SELECT event_type, round(avg(value), 9) AS mean, count(*) AS n FROM events GROUP BY event_type")
def weighted_metric_merge(spark, sf):
    e = table(spark, sf, "events")
    part = lambda c: e.where(c).groupBy("event_type").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return scores.merge_metrics(part("event_id < 4000"), part("event_id >= 4000"), "event_type")


@over_solve(", m AS (SELECT lang AS category, solved FROM solve UNION ALL SELECT source, solved FROM solve) SELECT category, count(*) AS n, round(avg(solved), 9) AS mean FROM m GROUP BY category")
def multi_label_category_mean(spark, sf):
    return scores.category_means(solve(spark, sf).withColumn("c", F.array("lang", "source")), "c", "solved")


@query("""WITH r AS (SELECT d.lang, (l.quality = 1)::INT AS before, (d.n_chars > 1000)::INT AS judge FROM labels l JOIN documents d ON l.doc_id = d.doc_id) SELECT coalesce(lang, 'all') AS lang, count(*) AS n, sum(before)::BIGINT AS before, sum(judge)::BIGINT AS judge, sum(greatest(before, judge))::BIGINT AS either FROM r GROUP BY ROLLUP (lang)""")
def judge_or_combine(spark, sf):
    i = items(spark, sf).select("lang", (F.col("gold") == 1).cast("int").alias("before"), (F.col("n_chars") > 1000).cast("int").alias("judge"))
    return scores.judged(i, "lang")


@query("SELECT source, lang, count(*) AS n, round(avg((n_chars < 500)::INT), 9) AS broken_rate FROM documents GROUP BY ALL")
def census_by_platform(spark, sf):
    return scores.census(table(spark, sf, "documents"), ["source", "lang"], F.col("n_chars") < 500)


@query("SELECT source, count(*) FILTER (lang = 'en') AS supported, count(*) FILTER (lang IN ('de', 'fr')) AS manual, count(*) FILTER (lang = 'xx') AS unsupported FROM documents GROUP BY source")
def exec_support_report(spark, sf):
    mode = F.when(F.col("lang") == "en", "supported").when(F.col("lang").isin("de", "fr"), "manual").otherwise("other")
    return scores.support_report(table(spark, sf, "documents"), "source", mode, ["supported", "manual", "unsupported"])


@query("SELECT json_extract_string(props, '$.k')::INT % 5 AS tag, count(*) AS n FROM events GROUP BY tag")
def tag_counts(spark, sf):
    return scores.tag_counts(table(spark, sf, "events"), F.get_json_object("props", "$.k").cast("int") % 5)


@over_solve(""", p AS (SELECT * FROM solve QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY conf DESC, ordinal) = 1)
  SELECT coalesce(lang, 'all') AS lang, coalesce(expert_id, 'all') AS expert_id, count(*) AS n, round(avg(solved), 9) AS accuracy FROM p GROUP BY GROUPING SETS ((), (lang), (expert_id))""")
def routed_summary(spark, sf):
    return ranking.routed_summary(ranking.top_k(solve(spark, sf), "conf", 1), "lang")


# --- logs ---------------------------------------------------------------------------------


@over_log("SELECT expert_id, step, war::BIGINT AS war, count(*) OVER w AS seen, round(sum(war) OVER w / (count(*) OVER w * batch_n), 9) AS rate FROM log WINDOW w AS (PARTITION BY expert_id ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def unique_rate_window(spark, sf):
    return evolog.unique_rate(log(spark, sf), 8).select("expert_id", "step", "war", "seen", "rate")


@over_log("SELECT expert_id, step, (sum(war) OVER w)::BIGINT AS total_war, count(*) OVER w AS active_steps, round(avg(war) OVER w, 9) AS average_war FROM log WINDOW w AS (PARTITION BY expert_id ORDER BY step)")
def cumulative_war(spark, sf):
    return evolog.cumulative_war(log(spark, sf))


_NUMBERED = "row_number() OVER (PARTITION BY expert_id ORDER BY step) AS i"


@over_log(f""", r AS (SELECT expert_id, step, {_NUMBERED}, count(*) OVER w AS seen, round(sum(war) OVER w / (count(*) OVER w * batch_n), 9) AS rate FROM log WINDOW w AS (PARTITION BY expert_id ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
  f AS (SELECT expert_id, 0::BIGINT AS i, 3 AS lives FROM (SELECT DISTINCT expert_id FROM log) UNION ALL
    SELECT f.expert_id, r.i, CASE WHEN seen < 8 THEN lives WHEN rate > 0.065 THEN least(lives + 1, 3) ELSE greatest(lives - 1, 0) END FROM f JOIN r ON r.expert_id = f.expert_id AND r.i = f.i + 1)
  SELECT r.expert_id, step, lives FROM f JOIN r ON r.expert_id = f.expert_id AND r.i = f.i""")
def lives_window_mode(spark, sf):
    return evolog.lives(log(spark, sf), 3, floor=0.065, width=8)


@over_log(f""", l2 AS (SELECT expert_id, step, CASE WHEN (step + expert_id) % 3 = 0 THEN war ELSE 0 END AS war FROM log), r AS (SELECT expert_id, step, war, max(war) OVER (PARTITION BY step) AS top, {_NUMBERED} FROM l2),
  f AS (SELECT expert_id, 0::BIGINT AS i, 3 AS lives FROM (SELECT DISTINCT expert_id FROM log) UNION ALL
    SELECT f.expert_id, r.i, CASE WHEN war > 0 THEN 3 WHEN top = 0 THEN lives ELSE greatest(lives - 1, 0) END FROM f JOIN r ON r.expert_id = f.expert_id AND r.i = f.i + 1)
  SELECT r.expert_id, step, lives FROM f JOIN r ON r.expert_id = f.expert_id AND r.i = f.i""")
def lives_legacy(spark, sf):
    thin = log(spark, sf).withColumn("war", F.when((F.col("step") + F.col("expert_id")) % 3 == 0, F.col("war")).otherwise(0))
    return evolog.lives(thin, 3)


def _steps(spark, sf):
    s = log(spark, sf).groupBy("step").agg(F.sum("war").alias("w"), F.max("war").alias("top"), F.min("war").alias("niche_n"))
    return s.select("step", F.lit(6).alias("n_roster"), F.lit(100).alias("batch_n"), (F.col("w") % 20).alias("hard_gain"), (F.col("niche_n") % 5).alias("niche_n"), (F.col("top") % 5).alias("niche_recovered"), (F.col("step") % 10 == 0).alias("add_only"))


_GATE = """, s AS (SELECT step, 6 AS n_roster, 100 AS batch_n, sum(war) % 20 AS hard_gain, min(war) % 5 AS niche_n, max(war) % 5 AS niche_recovered, step % 10 = 0 AS add_only FROM log GROUP BY step),
  u AS (SELECT *, round(hard_gain / batch_n - exp(6 * 0.05::DOUBLE) * 0.5 * (exp(0.05::DOUBLE) - 1) * (100.0::DOUBLE / batch_n), 9) AS u_add, round(exp(5 * 0.05::DOUBLE) * 0.5 * (exp(0.05::DOUBLE) - 1) * (100.0::DOUBLE / batch_n) - niche_n / batch_n, 9) AS u_delete FROM s),
  g AS (SELECT *, CASE WHEN u_add > 0 AND u_delete > 0 AND NOT add_only THEN CASE WHEN niche_recovered >= niche_n THEN 'swap' ELSE 'add' END WHEN u_add > 0 THEN 'add' WHEN u_delete > 0 AND NOT add_only THEN 'delete' ELSE 'noop' END AS decision FROM u)"""


@over_log(f"{_GATE} SELECT step, u_add, u_delete FROM g")
def gate_utilities(spark, sf):
    return evolog.gate(_steps(spark, sf), 0.05, 0.5, 100).select("step", "u_add", "u_delete")


@over_log(f"{_GATE} SELECT step, decision FROM g")
def gate_decision(spark, sf):
    return evolog.gate(_steps(spark, sf), 0.05, 0.5, 100).select("step", "decision")


@over_log(f"""{_GATE}, d AS (SELECT step, decision, row_number() OVER (ORDER BY step) AS i FROM g),
  f AS (SELECT 0::BIGINT AS i, -1000000000::BIGINT AS last, -1::BIGINT AS step, '' AS decision UNION ALL
    SELECT d.i, CASE WHEN d.decision = 'delete' AND d.step - last >= 5 THEN d.step ELSE last END, d.step, CASE WHEN d.decision = 'delete' AND d.step - last < 5 THEN 'noop' ELSE d.decision END FROM f JOIN d ON d.i = f.i + 1)
  SELECT step, decision FROM f WHERE i > 0""")
def delete_cooldown(spark, sf):
    return evolog.cooldown(evolog.gate(_steps(spark, sf), 0.05, 0.5, 100).select("step", "decision"), 5)


_SIZES = "t AS (SELECT event_id // 100 AS step, count(*) FILTER (value > 50) AS size FROM events GROUP BY ALL)"


def _sizes(spark, sf):
    return table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 100).alias("step")).agg(F.sum((F.col("value") > 50).cast("long")).alias("size"))


@query(f"WITH {_SIZES} SELECT step, size, round(avg(size) OVER (ORDER BY step ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 9) AS smooth FROM t")
def moving_average_centered(spark, sf):
    return evolog.centered_average(_sizes(spark, sf), "size", "step", 6)


@query(f"""WITH {_SIZES}, s AS (SELECT step, sign(round(size - avg(size) OVER (), 9)) AS s, count(*) OVER () AS n FROM t), f AS (SELECT n, (s <> lag(s) OVER (ORDER BY step))::INT AS flip FROM s WHERE s <> 0), g AS (SELECT coalesce(sum(flip), 0)::BIGINT AS flips, max(n) AS n FROM f)
  SELECT flips, greatest(1, n // greatest(1, flips // 2)) AS period FROM g""")
def period_estimate(spark, sf):
    return evolog.period(_sizes(spark, sf), "size", "step")


@over_log(f"{_GATE} SELECT step, (sum((decision IN ('add', 'swap'))::INT) OVER (ORDER BY step))::BIGINT AS adds, (sum((decision IN ('delete', 'swap'))::INT) OVER (ORDER BY step))::BIGINT AS deletes FROM g")
def cumulative_churn(spark, sf):
    return evolog.churn(evolog.gate(_steps(spark, sf), 0.05, 0.5, 100))


@over_log("SELECT step // 10 AS epoch, min(step) AS first_step FROM log GROUP BY ALL")
def epoch_boundaries(spark, sf):
    return evolog.epoch_starts(log(spark, sf).withColumn("epoch", F.floor(F.col("step") / 10)))


@over_log(""", a AS (SELECT expert_id, step FROM log WHERE (step // 7 + expert_id) % 3 <> 0), r AS (SELECT *, step - row_number() OVER (PARTITION BY expert_id ORDER BY step) AS run FROM a)
  SELECT expert_id, min(step) AS from_step, max(step) AS to_step, max(step) = (SELECT max(step) FROM a) AS in_final FROM r GROUP BY expert_id, run""")
def agent_lifetime(spark, sf):
    return evolog.lifetimes(log(spark, sf).where((F.floor(F.col("step") / 7) + F.col("expert_id")) % 3 != 0).select("expert_id", "step"))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first DESC) AS r FROM f QUALIFY r <= 2""")
def last_n_distinct_history(spark, sf):
    return evolog.last_distinct(table(spark, sf, "events"), "user_id", "event_type", "event_id", 2)


@query("SELECT user_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY user_id ORDER BY n DESC, first LIMIT 12")
def recurrence_top12(spark, sf):
    return evolog.recurrence(table(spark, sf, "events"), "user_id", "event_id", 12)


@over_log(f"{_GATE} SELECT decision, count(*) AS n, round(avg(u_add), 6) AS mean_u_add, round(avg(u_delete), 6) AS mean_u_delete FROM g GROUP BY decision")
def action_counts(spark, sf):
    return evolog.action_summary(evolog.gate(_steps(spark, sf), 0.05, 0.5, 100))


# --- events as a stream would see them ----------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_hourly(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")
