"""Loaders, files, the roster over the steps of a run, contest results and features."""

import base64
import json
import pickle
import zlib

import pytest
from pyspark.sql import functions as F

from solvegrid.operators import contest, coverage, evolog, evolution, features, joins, ranking, relation, splits
from solvegrid.sources import datasets, readers, runs


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_local_files(spark, tmp_path):
    lines(tmp_path / "Coding" / "mbpp_test.jsonl", [{"id": "a", "instruction": "i"}, {"id": "b", "domain": "ds"}])
    got = {r.id: (r.domain, r.dataset, r.scoring_kind) for r in datasets.resolve(spark, "MBPP", folder=str(tmp_path)).collect()}
    assert got == {"a": ("coding", "mbpp", "asserts"), "b": ("ds", "mbpp", "asserts")}
    lines(tmp_path / "qasc_test.jsonl", [{"id": str(i)} for i in range(40)])
    some = datasets.resolve(spark, "qasc", folder=str(tmp_path), ratio=0.25)
    assert some.count() == 10 and sorted(some.collect()) == sorted(datasets.resolve(spark, "qasc", folder=str(tmp_path), ratio=0.25).collect())
    with pytest.raises(ValueError, match="Unknown dataset"):
        datasets.resolve(spark, "nothing", folder=str(tmp_path))
    raw = spark.createDataFrame([("t/1", "p", "s", "f", "c")], "task_id string, prompt string, canonical_solution string, entry_point string, test string")
    assert datasets.resolve(spark, "humaneval", readers={"humaneval": lambda split: datasets.humaneval(raw)}).first().scoring_kind == "humaneval_check"


def test_malformed_lines(spark, tmp_path):
    path = lines(tmp_path / "x.jsonl", [{"id": "a"}, "", "{oops", {"id": "b"}, "{oops"])
    assert sorted(r.id for r in readers.jsonl(spark, path, tolerant=True).collect()) == ["a", "b"]
    assert [(r.line, r.n) for r in readers.malformed(spark, path).collect()] == [("{oops", 2)]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.jsonl(spark, path).collect()


def test_append_glob_and_packages(spark, tmp_path):
    to = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x long")
    readers.append_new(rows, to)
    readers.append_new(rows.unionByName(spark.createDataFrame([("c", 3)], rows.schema)), to)
    assert sorted(r.id for r in spark.read.json(to).collect()) == ["a", "b", "c"]
    for name in ("run_e1.jsonl", "run_e2.jsonl", "x.llm_judge.jsonl", "y.txt"):
        lines(tmp_path / "in" / name, [{"id": name}])
    named = readers.files(spark, str(tmp_path / "in"), (".jsonl",), (".llm_judge.jsonl",))
    assert [n.rpartition("/")[2] for n in named] == ["run_e1.jsonl", "run_e2.jsonl"]
    assert {(r.id, r.file_id) for r in readers.with_file_id(readers.jsonl(spark, named), r"run_(e\d)").collect()} == {("run_e1.jsonl", "e1"), ("run_e2.jsonl", "e2")}
    with pytest.raises(FileNotFoundError):
        readers.files(spark, str(tmp_path / "none"), (".jsonl",))
    solve = spark.createDataFrame([(1, 0, "e0", 1), (1, 1, "e1", 0), (2, 0, "e0", 0), (2, 1, "e1", 0)], "problem_id long, ordinal long, expert_id string, solved int")
    binned = relation.to_binned(solve)
    readers.label_package(binned, solve.select("expert_id").distinct(), str(tmp_path / "package"))
    assert spark.read.json(str(tmp_path / "package/summary")).first().asDict() == {"total": 2, "union_ub": 1}
    assert {(r.expert_id, r.train_pass_at_1) for r in spark.read.json(str(tmp_path / "package/experts")).collect()} == {("e0", 50.0), ("e1", 0.0)}


def test_contest_files(spark, tmp_path):
    assert datasets.contest_files("release_v3") == ["test.jsonl", "test2.jsonl", "test3.jsonl"]
    for i, name in enumerate(datasets.contest_files("release_v2")):
        lines(tmp_path / name, [{"question_id": f"q{i}", "question_content": "?", "platform": "leetcode"}])
    assert sorted(r.id for r in datasets.contest(spark, str(tmp_path), "release_v2").collect()) == ["q0", "q1"]
    assert datasets.contest(spark, str(tmp_path), "release_v3").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        datasets.contest(spark, str(tmp_path), "release_v3", strict=True)


def test_private_tests():
    cases = json.dumps([{"input": "1", "output": "2", "testtype": "stdin"}])
    packed = lambda b: base64.b64encode(zlib.compress(b)).decode()
    assert datasets.decoded_tests(cases) == cases == datasets.decoded_tests(packed(cases.encode()))
    assert datasets.decoded_tests(packed(json.dumps(cases).encode())) == cases
    assert datasets.decoded_tests(packed(pickle.dumps(cases))) is None and datasets.decoded_tests("%%") is None


def test_contest_problems_are_strict(spark):
    row = ("q", "2024-01-02T03:04:05", "leetcode", "odd", "[]", "[]")
    raw = spark.createDataFrame([row], "question_id string, contest_date string, platform string, difficulty string, public_test_cases string, private_test_cases string")
    with pytest.raises(Exception, match="unknown difficulty"):
        datasets.contest_problems(raw).collect()
    assert datasets.contest_problems(raw, start="2025-01-01").count() == 0
    ex = spark.createDataFrame([("sample_10", "2024-01-02", "3"), ("sample_9", "2024-01-02", "4")], "id string, contest_date string, numsteps string")
    assert [r.id for r in contest.ordered(datasets.execution_problems(ex), "codeexecution").collect()] == ["sample_9", "sample_10"]
    tests = spark.createDataFrame([("q", "c", "2024-01-02", '[{"input": "a", "output": "b", "testtype": "functional"}]')], "question_id string, question_content string, contest_date string, test string")
    assert datasets.prediction_problems(tests).select("input", "output").first()[:] == ("c", "b")


def test_builders(spark):
    raw = spark.createDataFrame([("f", "x", "A")], "formatted_question string, question string, answerKey string").withColumn("id", F.lit("")).withColumn("ordinal", F.lit(4))
    assert datasets.qasc(raw, "train").first().id == "qasc_train_4"
    with pytest.raises(Exception, match="no answer key"):
        datasets.qasc(raw.withColumn("answerKey", F.lit("Z")), "train").collect()
    mbpp = spark.createDataFrame([(7, "say", "code", ["a", "b"])], "task_id int, text string, code string, test_list array<string>")
    assert datasets.mbpp(mbpp).first().instruction == "say\nYour code should pass these tests:\n\na\nb\n"
    rows = spark.range(100, numPartitions=7)
    assert [r.ordinal for r in datasets.numbered(rows.select(F.col("id").alias("x"))).orderBy("x").collect()] == list(range(100))
    ds = spark.createDataFrame([("p", "r", "c", "m")], "prompt string, reference_code string, code_context string, metadata string")
    assert datasets.ds1000(datasets.numbered(ds)).first().id == "ds1000_0"


def test_names_and_configs():
    assert runs.merge_config({"a": 1, "b": {"c": 2}}, {"a": None, "b": {"d": 3}}) == {"a": 1, "b": {"d": 3}}
    assert runs.output_name("qasc", "org/Model 1", "7", prompt="--") == "qasc_Model_1_unknown_7.jsonl"


def test_rosters(spark, tmp_path):
    path = str(tmp_path / "roster")
    first = runs.ensure_roster(spark, path).orderBy("ordinal").collect()
    assert len(first) == 5 and first[0].id == "array" and runs.load_roster(spark, path).count() == 5
    lines(tmp_path / "bad.json", ["{oops"])
    assert runs.load_roster(spark, str(tmp_path / "bad.json")).count() == 0
    fresh = runs.persona({"persona_name": ["Test", "Critic"], "strengths": {"a": 1}}, "c_1", 3, 3)
    assert (fresh["name"], fresh["strengths"], fresh["total_war"], fresh["average_war"]) == ("Test, Critic", "a: 1", 0, 0.0)
    made = runs.mapped_roster(spark, {"a": {"system_prompt": "x"}, "b": {"system_prompt": "y"}}, 2)
    assert [r.id for r in made.orderBy("ordinal").collect()] == ["a", "b"]
    for bad, n in (({"a": {}}, 1), ({}, None), ({"a": {"system_prompt": "x"}}, 2)):
        with pytest.raises(ValueError):
            runs.mapped_roster(spark, bad, n)
    mapping = spark.createDataFrame([(0, "a", 10.0), (1, "b", 20.0), (2, "c", 20.0)], "ordinal long, id string, train_pass_at_1 double")
    assert runs.best_expert(mapping).first().id == "b" and runs.best_expert(mapping, "a").first().id == "a"
    with pytest.raises(Exception, match="unknown expert"):
        runs.best_expert(mapping, "z").collect()


def roster(spark, rows):
    return spark.createDataFrame([tuple((runs.persona({"name": i, "strengths": "s" * (9 - k)}, i, k, 3) | x).values()) for k, (i, x) in enumerate(rows)], runs.ROSTER)


def scored(spark, rows):
    return spark.createDataFrame(rows, "id string, war long, solved long")


def test_lives_over_batches(spark):
    r = roster(spark, [("agent_1", {}), ("agent_2", {}), ("away", {"lives": 1})])
    r = evolution.after_batch(r, scored(spark, [("agent_1", 0, 0), ("agent_2", 1, 1)]), 1)
    assert {x.id: x.lives for x in r.collect()} == {"agent_1": 2, "agent_2": 3, "away": 1}
    r = evolution.after_batch(r, scored(spark, [("agent_1", 1, 1), ("agent_2", 0, 0)]), 1)
    assert {x.id: (x.lives, x.total_war, x.active_steps, x.average_war) for x in r.collect()} == {"agent_1": (3, 1, 2, 0.5), "agent_2": (2, 1, 2, 0.5), "away": (1, 0, 0, 0.0)}
    same = evolution.after_batch(r, scored(spark, [("agent_1", 0, 0), ("agent_2", 0, 5)]), 5)
    assert {x.id: x.lives for x in same.collect()} == {"agent_1": 3, "agent_2": 2, "away": 1}
    spared = evolution.after_batch(r, scored(spark, [("agent_1", 1, 4), ("agent_2", 0, 3)]), 5, exempt_shared=True)
    assert {x.id: x.lives for x in spared.collect()}["agent_2"] == 2


def test_lives_over_a_window(spark):
    r = roster(spark, [("a", {}), ("b", {"lives": 1})])
    seen = []
    for war in ((0, 5), (0, 5), (0, 0), (9, 0)):
        r = evolution.after_batch(r, scored(spark, [("a", war[0], 9), ("b", war[1], 9)]), 10, window=2, floor=0.2)
        seen.append(tuple(x.lives for x in r.orderBy("id").collect()))
    assert seen == [(3, 1), (2, 2), (1, 3), (2, 2)]
    assert [x.recent_unique for x in r.orderBy("id").collect()] == [[0, 9], [0, 0]]


def test_the_worst_member(spark):
    all_ = scored(spark, [(i, 0, 0) for i in "ABC"])
    pick = lambda rows, **k: next((x.id for x in evolution.worst(roster(spark, rows), all_, **k).collect()), None)
    assert pick([("A", {"lives": 3}), ("B", {"lives": 1}), ("C", {"lives": 0})], tie="random") == "C"
    assert pick([("A", {"lives": 2}), ("B", {"lives": 1})]) is None
    tenure = [("A", {"lives": 0, "active_steps": 1}), ("B", {"lives": 0, "active_steps": 5}), ("C", {"lives": 3, "average_war": 0.5})]
    assert pick(tenure, tie="random") == "B"
    equal = [("C", {"lives": 0}), ("A", {"lives": 0}), ("B", {"lives": 0})]
    assert pick(equal) == "A" and pick(equal, tie="size") == "B" and pick(equal, tie="random", seed=1) == pick(equal, tie="random", seed=1)
    rate = spark.createDataFrame([("A", 0.5), ("B", 0.4), ("C", 0.1)], "id string, rate double")
    assert pick(equal, rate=rate) == "C"


def test_members_come_and_go(spark, tmp_path):
    r = roster(spark, [("a", {}), ("b", {})])
    new = {"persona_name": "N", "system_prompt": "p"}
    ids = lambda d: [x.id for x in d.orderBy("ordinal").collect()]
    assert ids(evolution.mutate(r, "noop", "b", new, "c")) == ["a", "b"] and ids(evolution.mutate(r, "delete", "b")) == ["a"]
    added = evolution.mutate(r, "add", "b", new, "c", history=[str(i) for i in range(12)])
    assert ids(added) == ["a", "b", "c"] and added.where("id = 'c'").first().lives == 3 and added.where("id = 'c'").first().history == [str(i) for i in range(2, 12)]
    swapped = evolution.mutate(r, "swap", "a", new, "c")
    assert ids(swapped) == ["b", "c"]
    folder = str(tmp_path / "run")
    assert runs.resume(spark, folder)[0] is None
    for step, d in enumerate((added, swapped)):
        record = d.agg(F.array_sort(F.collect_list("id")).alias("roster_after")).select(F.lit(step).cast("long").alias("step"), F.lit(0).cast("long").alias("epoch"), F.lit(step).cast("long").alias("batch_idx"), "roster_after")
        runs.append_step(record, folder)
        if step == 0:
            runs.snapshot(d, folder, step)
    # the last step has no snapshot yet
    assert runs.resume(spark, folder)[0] is None
    runs.snapshot(swapped, folder, 1)
    last, back = runs.resume(spark, folder)
    assert last == {"step": 1, "epoch": 0, "batch_idx": 1} and ids(back) == ["b", "c"]
    log = spark.read.schema("step long, roster_after array<string>").json(f"{folder}/log")
    assert [x.expert_id for x in evolution.latest(log).orderBy("ordinal").collect()] == ["b", "c"]
    steps = spark.createDataFrame([(1, 0, True, "add"), (2, 3, None, "add"), (3, 3, True, "add")], "step long, hard_error_n int, has_candidate boolean, decision string")
    assert [x.decision for x in evolution.decided(steps).orderBy("step").collect()] == ["noop", "noop", "add"]
    hit = coverage.recovered(spark.range(3).withColumnRenamed("id", "problem_id"), spark.range(2).withColumnRenamed("id", "problem_id")).first()
    assert (hit.niche_n, hit.recovered_n, hit.whole) == (3, 2, False)
    assert coverage.recovered(spark.range(0).withColumnRenamed("id", "problem_id"), spark.range(2).withColumnRenamed("id", "problem_id")).first().whole


def test_log_folds(spark):
    log = spark.createDataFrame([(1, s, int(s % 3 == 0), int(s % 2 == 0)) for s in range(9)] + [(2, s, 1, 1) for s in range(9)], "expert_id long, step long, war long, shared int")
    plain = {r.step: r.lives for r in evolog.lives(log, 3).where("expert_id = 1").collect()}
    assert plain == {0: 3, 1: 2, 2: 1, 3: 3, 4: 2, 5: 1, 6: 3, 7: 2, 8: 1}
    spared = {r.step: r.lives for r in evolog.lives(log, 3, shared="shared").where("expert_id = 1").collect()}
    assert spared == {0: 3, 1: 2, 2: 2, 3: 3, 4: 3, 5: 2, 6: 3, 7: 2, 8: 2}
    steps = spark.createDataFrame([(r, s, d) for r in (1, 2) for s, d in enumerate(["delete", "delete", "swap", "delete", "delete"])], "run long, step long, decision string")
    got = evolog.cooldown(steps, 3, ["run"]).where("run = 2").orderBy("step").collect()
    assert [r.decision for r in got] == ["delete", "noop", "swap", "delete", "noop"]
    away = spark.createDataFrame([(1, s, 1) for s in (0, 1, 4, 5)], "expert_id long, step long, war long")
    assert [r.total_war for r in evolog.cumulative_war(away, by_stay=True).orderBy("step").collect()] == [1, 2, 1, 2]


def test_contest_results(spark):
    samples = spark.createDataFrame([("b", ["x", "y"]), ("a", ["z"])], "task_id string, generations array<string>")
    flat = contest.flattened(samples).withColumn("results", F.when(F.col("code") == "y", F.array(F.lit(1), F.lit(-2))).otherwise(F.array(F.lit(1))))
    back = contest.grades(contest.regrouped(flat)).orderBy("task_id").collect()
    assert [(r.task_id, r.graded) for r in back] == [("a", [True]), ("b", [True, False])]
    assert contest.grades(spark.createDataFrame([("a", [[]])], "task_id string, results array<array<int>>")).first().graded == [True]
    ex = spark.createDataFrame([("1", "def f(x): return x + 1", "f(2)", "f(2)", ["3", "f(2)", "4"]), ("2", "def f(x): return x", "f(1)", "f(1)", ["f(1)"])], "id string, code string, input string, output string, generations array<string>")
    assert {r.id: (r.n, r.c, r.pass_at_1) for r in contest.execution_pass(ex).collect()} == {"1": (2, 1, 0.5), "2": (1, 0, 0.0)}
    bench, saved = spark.createDataFrame([("q",), ("r",)], "question_id string"), spark.createDataFrame([("q", 1)], "question_id string, x int")
    with pytest.raises(Exception, match="0 saved results of r"):
        contest.with_saved(bench, saved).collect()
    cache = spark.createDataFrame([("p", ["a"]), ("p", ["b", "c"]), ("s", ["d"])], "prompt_key string, outputs array<string>")
    got = contest.cached(spark.createDataFrame([("p",), ("s",), ("t",)], "prompt string"), cache, 2).collect()
    assert {r.prompt: (r.outputs, r.hit) for r in got} == {"p": (["b", "c"], True), "s": (None, False), "t": (None, False)}
    with pytest.raises(ValueError):
        contest.ordered(bench, "other")


def test_features(spark):
    f = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "id string, feature array<double>")
    order = spark.createDataFrame([(0, "b"), (1, "a")], "ordinal long, id string")
    assert [r.id for r in features.aligned(f, order, order).orderBy("ordinal").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="no features for c"):
        features.aligned(f, order, spark.createDataFrame([(0, "c")], "ordinal long, id string")).collect()
    conf = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.25), ("b", "x", 1.0)], "id string, expert_id string, conf double")
    assert features.confidence_matrix(conf, ["y", "x"], order.where("id = 'a'")).first().conf == [0.25, 0.5]
    with pytest.raises(Exception, match="no confidence of y"):
        features.confidence_matrix(conf, ["y", "x"], order).collect()
    rows = spark.createDataFrame([(i, [float(i), float(-i)], int(i > 10), 1) for i in range(20)], "id long, feature array<double>, t0 int, t1 int")
    got = {(r.id, r.ordinal): r.logit for r in features.linear_router(rows, rows, ["t0", "t1"]).collect()}
    assert got[0, 0] < 0 < got[19, 0] and got[0, 1] is None


def test_small_sides_and_masks(spark):
    with pytest.raises(Exception, match="more than 3 rows"):
        joins.fan_out(spark.range(2).withColumnRenamed("id", "x"), spark.range(5), 3).collect()
    assert joins.fan_out(spark.range(2).withColumnRenamed("id", "x"), spark.range(3), 3).count() == 6
    many = spark.createDataFrame([(1, 70, 1)], "problem_id long, ordinal long, solved int")
    with pytest.raises(Exception, match="don't fit a mask"):
        relation.bitmask(many).collect()
    with pytest.raises(ValueError, match="sets of"):
        coverage.best_fixed_set(many, 60, 6)
    with pytest.raises(Exception, match="no partner"):
        joins.strict(spark.range(3), spark.range(2), "id").collect()
    twice = spark.createDataFrame([(1, "e", 1, "x"), (1, "f", 0, "x")], "problem_id long, expert_id string, solved int, lang string")
    with pytest.raises(Exception, match="routed twice"):
        ranking.routed_summary(twice, "lang").collect()
    few = spark.createDataFrame([("a", "b")] * 10, "a string, b string")
    assert coverage.agreement(few, "a", "b").first().ari is None


def test_splits(spark):
    rows = spark.range(23)
    got = splits.train_holdout(rows, "id", 5, 1)
    assert got.where("split = 'train'").count() == 5
    short = splits.quota(rows.withColumn("g", F.lit("x")), "id", {"train": 20, "val": 2, "test": 4}, ["g"], 1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in short} == {"train": 20, "val": 2, "test": 1}
    folds = splits.folds(rows, "id", 5, 2).groupBy("fold").count().orderBy("fold").collect()
    assert [(r.fold, r["count"]) for r in folds] == [(1, 5), (2, 5), (3, 5), (4, 4), (5, 4)]
    assert splits.folds(rows.limit(2), "id", 5, 2).select("fold").distinct().count() == 2
    assert splits.ratio_head(rows, "id", 0.01, 3).count() == 1 and splits.ratio_head(rows.limit(0), "id", 0.5, 3).count() == 0
    members = spark.createDataFrame([("a", ["1", "2", "3"]), ("b", ["4"]), ("c", [])], "expert_id string, history array<string>")
    shots = splits.few_shot(members, 7).orderBy("place").collect()
    assert len(shots) == 3 and {s.expert_id for s in shots} == {"a", "b"} and [s.place for s in shots] == [1, 2, 3]
    ranks = spark.createDataFrame([("x", v) for v in (3.0, 1.0, 1.0, 2.0)] + [("y", 5.0)], "e string, v double")
    assert sorted((r.e, r.v, r.r) for r in ranking.average_rank(ranks, "v", "e", "r").collect()) == [("x", 1.0, 0.375), ("x", 1.0, 0.375), ("x", 2.0, 0.75), ("x", 3.0, 1.0), ("y", 5.0, 1.0)]


def test_streams(spark, tmp_path):
    from solvegrid.streaming import live

    events = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00", "a" if i % 2 else "b", float(i)) for i in [*range(50), 3, 4]], "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.json(str(tmp_path / "events"))
    read = lambda: spark.readStream.schema(events.schema).json(str(tmp_path / "events"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    hourly = run(live.windowed(read(), "30 minutes"), "hourly", "complete")
    assert sum(r.n for r in hourly) == 52 and len(hourly) == 4
    assert len(run(live.unique(read()), "once", "append")) == 50
    log = spark.createDataFrame([(1, s, 0.0 if s < 2 else 1.0) for s in range(4)], "expert_id long, step long, rate double")
    log.write.json(str(tmp_path / "log"))
    got = run(live.lives(spark.readStream.schema(log.schema).json(str(tmp_path / "log")), 3, 0.5), "lives", "append")
    assert sorted((r.step, r.lives) for r in got) == [(0, 2), (1, 1), (2, 2), (3, 3)]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2.0, None), ("a", 1.005, "x|y")], "m string, v double, t string")
    assert readers.markdown(rows, ["m"]) == "| m | v | t |\n|-|-|-|\n| a | 1.00 | x/y |\n| b | 2.00 |  |"
    with pytest.raises(ValueError, match="more than 1"):
        readers.markdown(rows, ["m"], 1)
    readers.report(rows, str(tmp_path / "csv"), ["m"])
    assert [r.m for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["a", "b"]
    readers.summary(rows.limit(1), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    seen = spark.createDataFrame([(2, ["c", "a"]), (1, ["b", "c"])], "o long, k array<string>")
    assert [r.expert_id for r in relation.key_union(seen, "k", "o").orderBy("place").collect()] == ["b", "c", "a"]


def test_long_logs(spark):
    import random

    rnd = random.Random(1)
    n = evolog.PART * 3 + 17
    steps = sorted(rnd.sample(range(n * 2), n))
    rows = [(s, rnd.randrange(9), rnd.choice(["add", "swap", "delete", "noop"])) for s in steps]
    log = spark.createDataFrame(rows, "step long, size long, decision string")
    for width in (1, 4, 7):
        got = [r.smooth for r in evolog.centered_average(log, "size", "step", width).orderBy("step").collect()]
        near = [[r[1] for r in rows[max(0, i - width // 2) : i + (width - 1) // 2 + 1]] for i in range(n)]
        assert got == pytest.approx([sum(x) / len(x) for x in near])
    adds = deletes = 0
    for r, (step, _, took) in zip(evolog.churn(log).orderBy("step").collect(), rows, strict=True):
        adds, deletes = adds + (took in ("add", "swap")), deletes + (took in ("delete", "swap"))
        assert (r.step, r.adds, r.deletes) == (step, adds, deletes)
    mean = sum(r[1] for r in rows) / n
    signs = [r[1] > mean for r in rows if r[1] != mean]
    flips = sum(a != b for a, b in zip(signs, signs[1:], strict=False))
    assert evolog.period(log, "size", "step").first()[:] == (flips, max(1, n // max(1, flips // 2)))
