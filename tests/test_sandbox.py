"""Limits of the sandbox, and rows that can't be graded."""

import json
import os
import resource
import time

import pytest
from pyspark.sql import functions as F

from solvegrid.functions import grading, sandbox

CASES = json.dumps([{"input": {"value": "2"}, "expected_output": {"value": "4"}}])


def test_output_is_bounded():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    began = time.monotonic()
    got = sandbox.run("while True: print('x' * 100000)", seconds=3)
    assert got["status"] in ("failed", "timeout") and len(got["output"]) <= sandbox.OUTPUT
    assert time.monotonic() - began < 5 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000
    got = sandbox.run("import sys\nsys.stderr.write('e' * 9000)\nprint('y' * 300000)")
    assert got["status"] == "ok" and len(got["output"]) == sandbox.OUTPUT and len(got["error"]) == sandbox.ERRORS


def test_nothing_outlives_its_program(tmp_path):
    mark = tmp_path / "alive"
    code = f"import os, time\ntry:\n    child = os.fork()\nexcept OSError:\n    child = 1\nif child == 0:\n    time.sleep(3)\n    open({str(mark)!r}, 'w').close()\nelse:\n    time.sleep({{}})"
    assert sandbox.run(code.format(10), seconds=1)["status"] == "timeout"
    assert sandbox.run(code.format(0), seconds=5)["status"] == "ok"
    time.sleep(3.5)
    assert not mark.exists()


def test_environment_is_bare():
    os.environ["SECRET_OF_TEST"] = "1"
    assert sandbox.run("import os; print('SECRET_OF_TEST' in os.environ)")["output"].strip() == "False"


@pytest.mark.parametrize(("spec", "cases"), [("[]", CASES), ("not json", CASES), ('{"eval_mode": "stdin_stdout"}', '{"a": 1}'), ('{"eval_mode": "stdin_stdout"}', "[1]"), ('{"eval_mode": "stdin_stdout"}', '[{"input": 3}]'), ('{"eval_mode": "stdin_stdout", "timeout_seconds": "soon"}', CASES), ('{"eval_mode": "stdin_stdout"}', "oops")])
def test_a_malformed_row_fails_alone(spark, spec, cases):
    good = ("b", '{"eval_mode": "stdin_stdout"}', "print(int(input()) * 2)", CASES)
    rows = spark.createDataFrame([("a", spec, "print(4)", cases), good, ("c", None, None, None)], "id string, spec string, code string, cases string")
    got = {r.id: (r.status, r.passed) for r in grading.graded(rows, "id", "spec", "code", "cases").collect()}
    assert got == {"a": ("malformed", False), "b": ("accepted", True), "c": ("unsupported", False)}


def test_contest_runs():
    codes, known = grading.contest_run("def f(x): return x", ["1", "2"], ["1", "3"], "f")
    assert codes == [1, grading.WRONG] and known == {"inputs": "2", "expected": "3", "error_code": -2, "error_message": "Wrong Answer", "output": "2"}
    assert grading.contest_run("def f(x): return 1 / 0", ["1"], ["1"], "f")[1]["error_code"] == grading.FAILED
    # cases that can't be read, and more time than all cases have
    assert grading.contest_run("def f(x): return x", ["{"], ["1"], "f")[0] == [grading.WRONG]
    codes, known = grading.contest_run("import time; time.sleep(9)", ["1"] * 3, ["1"] * 3, seconds=6, budget=1)
    assert codes == [grading.WRONG] and known["error_code"] == grading.BROKEN


def test_calls_have_a_status(spark):
    def double(x):
        if x == "late":
            time.sleep(9)
        if x == "gone":
            os._exit(3)
        return str(int(x) * 2)

    got = [r.s for r in spark.createDataFrame([("4",), ("late",), ("gone",), ("x",), (None,)], "v string").select(sandbox.with_status(double, 1.0)(F.col("v")).alias("s")).collect()]
    assert [(s and s.status, s and s.result) for s in got] == [("SUCCESS", "8"), ("TIMEOUT", None), ("PROCESS_EXPIRED", None), ("EXCEPTION", None), (None, None)]
    assert "ValueError" in got[3].error


def test_scores_within_a_budget(spark):
    rows = spark.createDataFrame([("a", "x = 1", "assert x"), ("b", "import time; time.sleep(2)", ""), ("c", "x = 1", "assert x")], "id string, code string, check string").coalesce(1)
    assert [r.pass_score for r in sandbox.score(rows, "id", "code", "check").collect()] == [100.0, 100.0, 100.0]
    assert [r.pass_score for r in sandbox.score(rows, "id", "code", "check", budget=1.0).collect()] == [100.0, 100.0, 0.0]
    assert sandbox.checked("def g(a): return a", "def check(f):\n    assert f(2) == 2", "wanted") == 100.0
    assert sandbox.checked("def g(a): return H(a)", "assert g(1) == 1", helper="def H(a): return a") == 100.0
