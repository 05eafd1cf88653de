"""Invariants of the solve relation, the gate's worked examples, and SQL on a small table."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from solvegrid.operators import coverage, evolog, relation
from solvegrid.plans import catalogue

SF = "/root/testdata/sf0.001"


def random_solve(spark, seed, problems=40, experts=5):
    rng = random.Random(seed)
    rows = [(p, e, f"e{e}", int(rng.random() < 0.4)) for p in range(problems) for e in range(experts)]
    return spark.createDataFrame(rows, "problem_id long, ordinal long, expert_id string, solved int"), rows


@pytest.mark.parametrize("seed", [1, 2])
def test_invariants(spark, seed):
    solve, rows = random_solve(spark, seed)
    roster = solve.select("ordinal", "expert_id").distinct()
    hist = {r.n_solved: r.n_problems for r in coverage.histogram(solve).collect()}
    per = {r.expert_id: r.n_solved for r in coverage.pass_at_1(solve).collect()}
    war = {r.expert_id: r.war for r in coverage.war(solve, roster).collect()}
    union = coverage.union_ub(solve).first().union_ub
    assert sum(hist.values()) == 40 and sum(k * n for k, n in hist.items()) == sum(per.values())
    assert 40 - hist.get(0, 0) == union and max(per.values()) <= union
    assert sum(war.values()) == hist.get(1, 0) and all(war[e] <= per[e] for e in per)
    solved = {e: {p for p, _, x, s in rows if x == e and s} for e in per}
    for e in per:
        rest = set().union(*(s for x, s in solved.items() if x != e))
        assert war[e] == len(solved[e] | rest) - len(rest)


def test_empty_and_missing(spark):
    empty = spark.createDataFrame([], "problem_id long, ordinal long, expert_id string, solved int")
    assert coverage.union_ub(empty).first().union_pct == 0.0
    roster = spark.createDataFrame([(0, "e0"), (1, "e1")], "ordinal long, expert_id string")
    pairs = spark.createDataFrame([(7, "e0", 1)], "problem_id long, expert_id string, solved int")
    dense = relation.densify(pairs, pairs, roster)
    assert {(r.expert_id, r.solved) for r in dense.collect()} == {("e0", 1), ("e1", 0)}


@pytest.mark.parametrize(
    ("roster", "hard", "niche", "recovered", "lam", "ref", "expected"),
    [(3, 1, 0, 0, 0.10, 10, "swap"), (3, 0, 1, 0, 0.10, 10, "noop"), (2, 0, 1, 0, 0.20, 10, "delete")],
)
def test_gate_examples(spark, roster, hard, niche, recovered, lam, ref, expected):
    rows = spark.createDataFrame([(1, roster, 10, hard, niche, recovered, False)], "step long, n_roster int, batch_n int, hard_gain int, niche_n int, niche_recovered int, add_only boolean")
    assert evolog.gate(rows, lam, 0.5, ref).first().decision == expected


@pytest.mark.parametrize("name", ["binning_summary", "war_scores", "lives_window_mode", "delete_cooldown", "tfidf_topk", "lineitem_solve_matrix"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "events", "benchmark", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(catalogue.ORACLES[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda d: sorted(map(str, d[cols].astype(object).values.tolist()))
    assert key(got.astype(want.dtypes.to_dict())) == key(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
