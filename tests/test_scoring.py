"""Scores by kind, prompts and completions. Expected values are those of the behaviour that must be matched."""

import json

import pytest
from pyspark.sql import functions as F

from solvegrid.functions import extract, prompts, scoring

WEATHER = {"dataset": "qasc", "scoring_kind": "qasc", "instruction": "What affects rain? (A) Moon phase (B) local weather conditions (C) paint (D) music", "ground_truth": "B", "domain": "qasc"}
LISTED = "Let's evaluate each option:\n(A) Moon phase - no measurable effect.\n(B) local weather conditions - this drives precipitation.\n(C) paint - irrelevant.\n(D) music - irrelevant.\n\nFinal answer: B"
CASE = {"dataset": "lbox", "scoring_kind": "lbox", "task_type": "casename", "ground_truth": "감염병의예방및관리에관한법률위반", "domain": "lbox"}
LAWS = {"dataset": "lbox", "scoring_kind": "lbox", "task_type": "statute", "ground_truth": json.dumps(["형법 제298조", "형법 제299조"], ensure_ascii=False), "domain": "lbox"}
MBPP = {"dataset": "mbpp", "instruction": "dummy", "ground_truth": "def f():\n    return 1", "test_list": ["assert f()==1"], "domain": "coding"}
MATH = {"dataset": "numina_cot", "domain": "math", "instruction": "A) 3\nB) x = 7\nC) 9"}
CONTEST = {"scoring_kind": "lcb", "test_cases": json.dumps([{"input": "2", "output": "4"}, {"input": "3", "output": "6"}])}
TABLE = [
    (WEATHER, "The answer is (B) local weather conditions", 100.0),
    (WEATHER, "Final answer: C", 0.0),
    (WEATHER, "local  Weather conditions", 100.0),
    (WEATHER, LISTED, 100.0),
    (WEATHER, LISTED.replace("Final answer: B", "B"), 100.0),
    (WEATHER, "(A) Moon phase (B) local weather conditions", 100.0),
    (WEATHER, "<think>Final answer: B</think>paint", 0.0),
    (WEATHER | {"ground_truth": "Z"}, "B", 0.0),
    (WEATHER, None, 0.0),
    (CASE, "죄명: 감염병의 예방 및 관리에 관한 법률 위반", 100.0),
    (CASE, "절도", 0.0),
    (LAWS, "형법 제299조, 형법 제298조", 100.0),
    (LAWS, "형법 제298조", 0.0),
    (LAWS | {"ground_truth": "[]"}, "형법 제298조", 0.0),
    (CASE | {"task_type": "other", "ground_truth": '"a b"'}, "A B.", 100.0),
    (MBPP, "not python {{{", 0.0),
    (MBPP, "```python\ndef f():\n    return 1\n```", 100.0),
    (MBPP | {"scoring_kind": "humaneval_check", "test_list": None, "test_code": "def check(g):\n    assert g() == 1", "entry_point": "wanted"}, "def f(): return 1", 100.0),
    (MBPP | {"instruction": "import math\nclass Box:\n    x = 1", "test_list": ["assert f() == Box.x"]}, "def f(): return Box.x", 100.0),
    (MBPP | {"dataset": None, "test_list": None, "test_code": "while True: pass"}, "x = 1", 0.0),
    (MATH | {"ground_truth": "7"}, r"so \boxed{7}", 100.0),
    (MATH | {"ground_truth": "B"}, r"so \boxed{x = 7}", 100.0),
    (MATH | {"ground_truth": "x = 7"}, r"so \boxed{B}", 100.0),
    (MATH | {"ground_truth": "B"}, r"so \boxed{A}", 0.0),
    ({"eval_spec": '{"eval_mode": "stdin_stdout"}', "test_cases": '[{"input": {"value": "2"}, "expected_output": {"value": "4"}}]'}, "print(int(input()) * 2)", 100.0),
    ({"dataset": "acc", "test_cases": "oops"}, "print(4)", 0.0),
    (CONTEST, "```python\nprint(int(input()) * 2)\n```", 100.0),
    (CONTEST, "print(4)", 0.0),
    (CONTEST | {"test_cases": "[]"}, "print(4)", 0.0),
]


def test_score_one(spark):
    rows = [tuple([i, *[(item | {"prediction": said}).get(c) for c in scoring.ITEM]]) for i, (item, said, _) in enumerate(TABLE)]
    schema = "n int, " + ", ".join(f"{c} {'array<string>' if c == 'test_list' else 'string'}" for c in scoring.ITEM)
    got = {r.n: r.pass_score for r in scoring.score_one(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(TABLE)}


def test_score_one_with_few_columns(spark):
    d = spark.createDataFrame([("qasc", "(A) x (B) y (C) z", "A", "A")], "dataset string, instruction string, ground_truth string, prediction string")
    assert scoring.score_one(d).first().pass_score == 100.0
    assert scoring.score_one(d.limit(0)).count() == 0


def test_gold_answers(spark):
    rows = spark.createDataFrame([('["a ", "", "b"]',), ("plain",), ('"quoted"',), (" ",), (None,)], "g string")
    got = [r.l for r in rows.select(scoring.lbox_gold(F.col("g")).alias("l")).collect()]
    assert [(x.text, x["items"]) for x in got[:4]] == [("a, b", ["a", "b"]), ("plain", ["plain"]), ("quoted", ["quoted"]), ("", [])]
    one = lambda c: rows.limit(1).select(c.alias("x")).first().x
    assert one(scoring.finalize(F.lit("t\n```python\nx=1\n```"), F.lit("mbpp"), F.lit(None).cast("string"))) == "x=1"
    assert one(scoring.finalize(F.lit("<think>a</think> b "), F.lit("qasc"), F.lit(None).cast("string"))) == "b"


def test_completions_and_texts():
    assert extract.completion(["형법 제298조", "형법 제299조"]) == "형법 제298조, 형법 제299조"
    assert extract.completion({"b": 1, "answer": "B"}) == json.dumps({"b": 1, "answer": "B"}, sort_keys=True)
    assert extract.json_completion("7") == "7" and extract.json_text('["a", {"k": [1, 2], "n": null}]') == "a, k: 1, 2; n: "
    assert extract.best_method("def f(self, a: int, k=2): pass\ndef g(arr, n): pass", {"arr", "n"}) == ("g", ["arr", "n"])
    assert extract.best_method("x = 1", {"a"}) is None and extract.best_method("def f(a, b): 1", {"a"}) == ("f", ["a", "b"])
    said = json.loads(extract.tag_reply('ok {"primary_category": "TAX", "confidence": 1, "rationale": "r"}', {"tax": "tax law"}))
    assert said == {"status": "ok", "category": "tax", "confidence": 1.0, "rationale": "r"}
    assert json.loads(extract.tag_reply("none", {}))["status"] == "parse_failed"


@pytest.fixture(scope="module")
def one(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first().x


def test_prompts(one):
    build = lambda dataset, model="google/gemma", **k: one(prompts.build(F.lit("Q?"), F.lit(dataset), F.lit(None).cast("string"), F.lit(model), **k))
    assert [one(prompts.model_family(F.lit(m))) for m in ("Qwen/Qwen3-Coder", "meta-llama/Llama-3", "google/gemma-4", "vendor/x")] == ["qwen3", "llama31", "llama31", "generic"]
    system, user = build("qasc")
    assert system.role == "system" and "science multiple-choice" in system.content and "answer letter" in user.content
    assert "```python" not in system.content + user.content
    assert "Korean legal classification" in build("lbox")[0].content and "Korean legal classification" in build("lbox")[1].content
    assert build("numina_cot")[0].content == "You are a helpful math assistant."
    assert "```python" in build("mbpp")[0].content and "```python" not in build("mbpp", "vendor/x")[0].content
    assert build("mbpp", "x", starter=F.lit("def f"))[1].content.endswith("Q?\n\nStarter Code:\n```python\ndef f\n```")
    assert build("lbox", system=F.lit("P"), approach=F.lit("first"))[1].content.startswith("first\n\n") and build("lbox", system=F.lit("P"))[0].content == "P"
    assert build("livecodebench", "x", system=F.lit(""))[0].content == "You are an expert programmer."
    told = one(prompts.math_system(F.array(F.lit("Mathematics -> Number Theory"), F.lit("geometry"))))
    assert "elementary number theory" in told
    assert "projective geometry" in one(prompts.math_system(F.array(F.lit(None).cast("string"), F.lit("Geometry"))))
    assert "combinatorial proofs" in one(prompts.math_system(F.array(F.lit("Combinatorics"))))
    own = one(prompts.with_system(F.array(prompts.message("user", F.lit("u"))), F.lit("s")))
    assert [m.content for m in own] == ["s", "u"]
    assert one(prompts.chatml(F.array(prompts.message("system", F.lit("s"))))) == "<|im_start|>system\ns\n<|im_end|>\n<|im_start|>assistant\n```python\n"


def test_tables_and_repairs(one):
    member = lambda name, strengths, approach="": F.struct(F.lit(name).alias("name"), F.lit(strengths).alias("strengths"), F.lit("id").alias("system_prompt"), F.lit(approach).alias("approach"))
    assert one(prompts.roster_table(F.array(member("a", "x|y")))) == "| name | strengths |\n|------|-----------|\n| a | x/y |"
    assert one(prompts.roster_table(F.array(member("a", "x", "do"), member("b", "y")))).split("\n")[2:] == ["| a | id | do |", "| b | id |  |"]
    solves = lambda name, *s: F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, s)).cast("array<string>").alias("solves"))
    assert one(prompts.exclusive_list(F.array(solves("a", "1", "2", "3", "4" * 200), solves("b")))) == f"a:\n  • 2\n  • 3\n  • {'4' * 150}\n\nb:\n  • (none yet)"
    assert one(prompts.repair(F.lit('{"error_code": -2, "inputs": "1", "output": "2", "expected": "3"}'))) == "The above code is incorrect and got a wrong answer.\nInput: 1\nGenerated Output: 2\nExpected: 3"
    assert one(prompts.repair(F.lit("{}"))) == "" and "runtime error" in one(prompts.repair(F.lit('{"error_code": -4}')))
    with pytest.raises(Exception, match="unknown error code"):
        one(prompts.repair(F.lit('{"error_code": -9}')))


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (r"\frac{1}{2}", "0.5", True), ("1/2", r"$\dfrac12$", True), (r"2\sqrt{3}", r"\sqrt{12}", True), ("x^2-1", "(x-1)(x+1)", True), ("x^2-1", "(x-1)^2", False),
        ("x = 7", "7", True), ("1,000", "1000", True), ("(1, 2)", "(1,2)", True), ("(1, 2)", "(2, 1)", False), (r"\{1, 2\}", r"\{2, 1\}", True), ("[1, 2)", "(1, 2)", False), (r"(-\infty, 3]", r"(-\infty, \frac{9}{3}]", True),
        ("dog", "god", False), ("90^\\circ", "90", True), (r"\pi/2", r"\frac{\pi}{2}", True), ("3!", "6", True), ("2^{10}", "1024", True), (r"\sin^2 x+\cos^2 x", "1", True), ("a+b", "b+a", True), ("a", "b", False),
        ("2^{9999999999}", "1", False), ("(" * 500 + "1" + ")" * 500, "1", False), ("1/0", "1/0", False), ("", "1", False), (r"\sqrt[3]{-8}", "-2", True), ("0.333", "1/3", False), ("5\\%", "5", True),
    ],
)
def test_formulas(a, b, want):
    from solvegrid.functions import formula

    assert formula.same(a, b) is want and formula.same(b, a) is want


def test_judges_are_plug_ins(spark):
    from solvegrid.functions import grading

    def judge(prompts):
        if "fail" in prompts:
            raise OSError("no model")
        return ['{"score": 1}' if "right" in p else "?" for p in prompts]

    rows = spark.createDataFrame([("right",), ("wrong",), (None,)], "p string").coalesce(1)
    got = [r.j for r in rows.select(grading.asked(judge)(F.col("p")).alias("j")).collect()]
    assert [j and json.loads(j.parsed)["score"] for j in got] == [1, None, None]
    bad = spark.createDataFrame([("fail",)], "p string").select(grading.asked(judge)(F.col("p")).alias("j")).first().j
    assert bad.reply is None and "no model" in bad.error
