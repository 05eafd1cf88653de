"""Grading of untrusted programs against test cases, in Arrow batches with one sandbox a case.

Specifications and cases are JSON. A row that runs out of time or can't be read fails alone.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract, sandbox

#: Modules that function solutions take for granted.
STANDARD = """from typing import List, Optional, Dict, Tuple, Set, Any, Union
import collections, math, bisect, heapq, itertools, functools, re, string
from collections import defaultdict, Counter, deque, OrderedDict
from functools import lru_cache, reduce
"""
#: What contest solutions take for granted.
CONTEST = """from string import *
from re import *
from datetime import *
from collections import *
from heapq import *
from bisect import *
from copy import *
from math import *
from random import *
from statistics import *
from itertools import *
from functools import *
from operator import *
from io import *
from sys import *
from json import *
from builtins import *
from typing import *
import string
import re
import datetime
import collections
import heapq
import bisect
import copy
import math
import random
import statistics
import itertools
import functools
import operator
import io
import sys
import json
sys.setrecursionlimit(2000)
"""
#: Codes of a failed case, and of a run that couldn't be made.
WRONG, LATE, FAILED, BROKEN = -2, -3, -4, -5
#: What the codes say.
MESSAGES = {WRONG: "Wrong Answer", LATE: "Time Limit Exceeded", FAILED: "Runtime Error", BROKEN: "TestRunnerError"}
_MARK = "\x1eresult:"
_CALL = """
import json as _json
_fn = getattr(globals()["Solution"](), {entry!r}) if {entry!r} not in globals() else globals()[{entry!r}]
_out = _fn(*_json.loads({args!r}), **_json.loads({kwargs!r}))
"""


def loads(text: object) -> object:
    """JSON in a text, else the text."""
    try:
        return json.loads(text) if isinstance(text, str) else text
    except ValueError:
        return text


def leaves(value: object) -> object:
    """The value with each text in it read as JSON if it is JSON."""
    if isinstance(value, list):
        return [leaves(x) for x in value]
    return {k: leaves(x) for k, x in value.items()} if isinstance(value, dict) else loads(value)


def _close(a: str, b: str, rel: float, absolute: float) -> bool:
    try:
        return math.isclose(float(a), float(b), rel_tol=rel, abs_tol=absolute)
    except ValueError:
        return a == b


def outputs_match(actual: object, expected: object, how: dict) -> bool:
    """text.outputs_match on Python values; how holds type, case_sensitive, strip_trailing_whitespace, numeric_tolerance."""
    kind, (a, b) = how.get("type", "exact_or_token_match"), (str(actual), str(expected))
    if kind == "special_judge_unresolved":
        return False
    if kind == "numeric_tolerance":
        t = how.get("numeric_tolerance") or {}
        rel, absolute = (float(t.get(f"{n}_tol", t.get(full, 1e-6))) for n, full in (("rel", "relative"), ("abs", "absolute")))
        return len(a.split()) == len(b.split()) and all(_close(x, y, rel, absolute) for x, y in zip(a.split(), b.split(), strict=True))
    shown = [x.replace("\r\n", "\n").replace("\r", "\n") for x in (a, b)]
    if how.get("strip_trailing_whitespace", True):
        shown = ["\n".join(map(str.rstrip, x.split("\n"))).strip() for x in shown]
    if kind == "case_insensitive" or not how.get("case_sensitive", True):
        shown = [x.lower() for x in shown]
    return shown[0] == shown[1] or (kind not in ("exact", "case_insensitive") and shown[0].split() == shown[1].split())


def _printed(spec: dict, code: str, case: dict) -> tuple[str, bool]:
    """(status, whether right) of a program that reads its standard input."""
    got = sandbox.run(code, str(_side(case, "input") or ""), *_limits(spec))
    return str(got["status"]), got["status"] == "ok" and outputs_match(got["output"], _side(case, "expected_output"), spec.get("comparison") or {})


def _returned(spec: dict, code: str, case: dict) -> tuple[str, bool]:
    """(status, whether right) of a function's JSON result."""
    given = _side(case, "input")
    given = given if isinstance(given, dict) else {}
    call = _CALL.format(entry=spec["entry_point"], args=json.dumps(leaves(given.get("args", []))), kwargs=json.dumps(leaves(given.get("kwargs", {}))))
    got = sandbox.run(f"{STANDARD}{code}\n{call}print(_json.dumps(_out, ensure_ascii=False))", "", *_limits(spec))
    if got["status"] != "ok":
        return str(got["status"]), False
    actual, want = loads(got["output"]), leaves(_side(case, "expected_output"))
    want = want[0] if isinstance(want, list) and len(want) == 1 else want
    return "ok", actual == want or outputs_match(actual, want, spec.get("comparison") or {})


def _named(spec: dict, code: str, case: dict) -> tuple[str, bool]:
    """(status, whether right) of a function whose arguments are written as name = value."""
    args = extract.arguments(spec.get("gfg_params") or [], extract.pseudo_input(str(_side(case, "input") or "")))
    if args is None:
        return "failed", False
    call = _CALL.format(entry=spec["entry_point"], args=json.dumps(args), kwargs="{}")
    show = "print(int(_out) if isinstance(_out, bool) else ' '.join(map(str, _out)) if isinstance(_out, (list, tuple)) else _out)"
    got = sandbox.run(f"{STANDARD}{code}\n{call}{show}", "", *_limits(spec))
    return str(got["status"]), got["status"] == "ok" and str(got["output"]).split() == str(_side(case, "expected_output")).split()


def _readable(spec: object, cases: object) -> bool:
    if not isinstance(spec, dict) or not isinstance(cases, list):
        return False
    try:
        _limits(spec)
    except (TypeError, ValueError):
        return False
    return all(isinstance(c, dict) and all(isinstance(c.get(k) or {}, dict) for k in ("input", "expected_output")) for c in cases)


def _side(case: dict, name: str) -> object:
    return (case.get(name) or {}).get("value")


def _limits(spec: dict) -> tuple[float, int]:
    return float(spec.get("timeout_seconds", 5)), int(spec.get("memory_limit_mb", 512))


#: How each mode checks a case, and whether it stops at the first failure.
RUNNERS = {"stdin_stdout": (_printed, False), "function_call": (_returned, False), "gfg_function": (_named, True)}
_STATUS = {"ok": "wrong_answer", "failed": "runtime_error", "timeout": "timeout"}


def grade(spec: dict, code: str, cases: list[dict]) -> dict[str, object]:
    """passed, status, n_passed, n_total. Without cases nothing passes; the last error that isn't a wrong answer names the status.

    A specification that isn't an object, or cases that aren't a list of objects with objects for
    their sides, have the status malformed.
    """
    if not _readable(spec, cases):
        return {"passed": False, "status": "malformed", "n_passed": 0, "n_total": len(cases) if isinstance(cases, list) else 0}
    mode = spec.get("eval_mode")
    if mode not in RUNNERS or (mode != "stdin_stdout" and not spec.get("entry_point")):
        return {"passed": False, "status": "unsupported", "n_passed": 0, "n_total": len(cases)}
    check, stops = RUNNERS[mode]
    status, right = "accepted", 0
    for case in cases:
        state, ok = check(spec, code, case)
        right += ok
        if not ok and (state != "ok" or status == "accepted"):
            status = _STATUS[state]
        if not ok and stops:
            break
    passed = right == len(cases) > 0
    return {"passed": passed, "status": "accepted" if passed else status, "n_passed": right, "n_total": len(cases)}


def same_lines(actual: str, expected: str) -> bool:
    """Line by line: equal, or equal as lists of decimal numbers of any precision."""
    a, b = ([x.strip() for x in t.strip().split("\n")] for t in (actual, expected))
    return len(a) == len(b) and all(x == y or _decimals(x) == _decimals(y) is not None for x, y in zip(a, b, strict=True))


def _decimals(line: str) -> list[Decimal] | None:
    try:
        return [Decimal(x) for x in line.split()]
    except InvalidOperation:
        return None


def contest_codes(code: str, inputs: list[str], outputs: list[str], entry: str | None = None, seconds: float = 6.0) -> list[int]:
    """1 for each case passed, up to the first that fails with its code. With an entry point a function is called with a JSON value a line, else the program reads its input."""
    return contest_run(code, inputs, outputs, entry, seconds)[0]


def contest_run(code: str, inputs: list[str], outputs: list[str], entry: str | None = None, seconds: float = 6.0, budget: float | None = None) -> tuple[list[int], dict[str, object]]:
    """contest_codes, and what is known of the failure: error_code, error_message, error, inputs, output, expected.

    All cases together have (seconds + 1) a case and 5 more, or the budget; a run beyond that, and
    one whose cases can't be read, gives WRONG alone with the error code BROKEN.
    """
    until = time.monotonic() + ((seconds + 1) * len(inputs) + 5 if budget is None else budget)
    codes: list[int] = []
    for given, want in zip(inputs, outputs, strict=False):
        left = until - time.monotonic()
        try:
            program, stdin = _contest_program(code, given, entry)
            wanted = json.loads(want) if entry else want
        except ValueError:
            return [WRONG], {"error_code": BROKEN, "error_message": MESSAGES[BROKEN], "error": "the case can't be read"}
        got = sandbox.run(program, stdin, min(seconds, left)) if left > 0 else {"status": "timeout"}
        if got["status"] == "timeout" and time.monotonic() >= until:
            return [WRONG], {"error_code": BROKEN, "error_message": MESSAGES[BROKEN], "error": "out of time for all cases"}
        known = {"inputs": given, "expected": want}
        if got["status"] != "ok":
            failed = LATE if got["status"] == "timeout" else FAILED
            return [*codes, failed], known | {"error_code": failed, "error_message": MESSAGES[failed], "error": got["error"]}
        shown = str(got["output"])
        right = loads(shown.rpartition(_MARK)[2].strip()) == wanted if entry else same_lines(shown, want)
        if not right:
            return [*codes, WRONG], known | {"error_code": WRONG, "error_message": MESSAGES[WRONG], "output": shown.rpartition(_MARK)[2].strip()}
        codes.append(1)
    return codes, {}


def _contest_program(code: str, given: str, entry: str | None) -> tuple[str, str]:
    """The program of a case and what it reads."""
    if entry:
        call = _CALL.format(entry=entry, args=json.dumps([json.loads(x) for x in given.split("\n")]), kwargs="{}")
        return f"{CONTEST}\n{code}\n{call}print({_MARK!r} + _json.dumps(_out))", ""
    return f"{CONTEST}\ntry:\n    exec(compile({code!r}, 'solution', 'exec'), globals() | {{'__name__': '__main__'}})\nexcept SystemExit:\n    pass\n", given


def graded(rows: DataFrame, id_col: str, spec_col: str, code_col: str, cases_col: str) -> DataFrame:
    """id, passed, status, n_passed, n_total; specification and cases are JSON texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [grade(loads(s or "{}"), c or "", loads(t or "[]")) for s, c, t in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([d[k] for d in done], kind) for k, kind in (("passed", pa.bool_()), ("status", pa.string()), ("n_passed", pa.int32()), ("n_total", pa.int32())))], ["id", "passed", "status", "n_passed", "n_total"])

    return rows.selectExpr(f"cast(`{id_col}` as string) as id", f"`{spec_col}`", f"`{code_col}`", f"`{cases_col}`").mapInArrow(each, "id string, passed boolean, status string, n_passed int, n_total int")


def _reference(listed: object) -> str | None:
    """The code of the first solution in Python that is known to be right."""
    good = (s for s in (listed if isinstance(listed, list) else []) if isinstance(s, dict) and s.get("is_known_correct") and s.get("language") == "python")
    return next((str(s.get("code") or "") for s in good), None)


def consistent(spec: object, cases: object, references: object, platform: str) -> tuple[str, str | None]:
    """(category, specification to keep as JSON): whether a problem's own reference passes its own cases.

    Problems whose cases are written as name = value are recovered as calls of the reference's best
    method, if it then passes. Categories: no_ref, kept, gfg_recovered, gfg_unrecovered, drop_<status>.
    """
    code = _reference(references)
    if not code or not cases:
        return "no_ref", None
    spec = spec if isinstance(spec, dict) else {}
    if "geeksforgeeks" in platform.lower() and spec.get("eval_mode") == "stdin_stdout":
        if not _readable(spec, cases):
            return "gfg_unrecovered", None
        picked = extract.best_method(code, extract.pseudo_input(str(_side(cases[0], "input") or "")))
        if picked is None:
            return "gfg_unrecovered", None
        spec = spec | {"eval_mode": "gfg_function", "entry_point": picked[0], "gfg_params": picked[1]}
        return ("gfg_recovered", json.dumps(spec, sort_keys=True)) if grade(spec, code, cases)["passed"] else ("gfg_unrecovered", None)
    got = grade(spec, code, cases)
    return ("kept", json.dumps(spec, sort_keys=True)) if got["passed"] else (f"drop_{got['status'] or 'fail'}", None)


def self_consistent(rows: DataFrame, id_col: str = "id", spec_col: str = "eval_spec", cases_col: str = "test_cases", references_col: str = "reference_solutions", platform_col: str = "source_platform") -> DataFrame:
    """id, category, eval_spec: eval_spec is null where the problem isn't kept."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [consistent(loads(s or "{}"), loads(c or "[]"), loads(r or "[]"), p or "") for s, c, r, p in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], ["id", "category", "eval_spec"])

    own = rows.selectExpr(f"cast(`{id_col}` as string) as id", *[f"`{c}`" for c in (spec_col, cases_col, references_col, platform_col)])
    return own.mapInArrow(each, "id string, category string, eval_spec string")


def asked(ask: Callable[[list[str]], list[str]], parse: Callable[[str], str] = extract.verdict) -> Callable[[Column], Column]:
    """A column of prompts to struct of reply, parsed and error: a judge or tagger as a plug-in.

    ask gets a batch of prompts and gives as many replies; a batch that fails has the error on each
    of its rows, and no reply.
    """
    kind = pa.struct([("reply", pa.string()), ("parsed", pa.string()), ("error", pa.string())])

    @F.arrow_udf("reply string, parsed string, error string")
    def run(prompts: pa.Array) -> pa.Array:
        listed = prompts.to_pylist()
        given = [p for p in listed if p is not None]
        try:
            replies = iter(zip(given, ask(given), strict=True))
            rows = [None if p is None else {"reply": (r := next(replies)[1]), "parsed": parse(r), "error": None} for p in listed]
        except Exception as e:
            rows = [None if p is None else {"reply": None, "parsed": None, "error": repr(e)} for p in listed]
        return pa.array(rows, kind)

    return run
