"""Untrusted code in a child process with limits on time, memory, processes, network, environment and output."""

from __future__ import annotations

import contextlib
import json
import multiprocessing
import os
import pickle
import resource
import signal
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of output and of errors that are kept, and that a file may have.
OUTPUT, ERRORS, FILE = 200_000, 2000, 1 << 20
#: States of a mapped call.
SUCCESS, TIMEOUT, EXCEPTION, EXPIRED = "SUCCESS", "TIMEOUT", "EXCEPTION", "PROCESS_EXPIRED"


def _limits(seconds: float, memory_mb: int) -> None:
    resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))
    resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1, int(seconds) + 1))
    resource.setrlimit(resource.RLIMIT_FSIZE, (FILE, FILE))
    resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
    resource.setrlimit(resource.RLIMIT_NPROC, (0, 0))
    # without network, where the system lets us
    for flags in (os.CLONE_NEWNET, os.CLONE_NEWUSER | os.CLONE_NEWNET):
        with contextlib.suppress(OSError):
            os.unshare(flags)
            return


def _end(pid: int) -> None:
    """Ends a process's whole group, so that nothing that it started outlives it."""
    with contextlib.suppress(ProcessLookupError, PermissionError):
        os.killpg(pid, signal.SIGKILL)


def run(code: str, stdin: str = "", seconds: float = 5.0, memory_mb: int = 512) -> dict[str, object]:
    """status (ok, failed, timeout), output, error.

    What the program writes goes to files of limited size, so the caller's memory doesn't depend on it.
    """
    with tempfile.TemporaryDirectory() as folder, tempfile.TemporaryFile() as given, tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as err:
        # a file: an argument has a length limit
        Path(folder, "main.py").write_text(code, encoding="utf-8", errors="replace")
        given.write(stdin.encode("utf-8", "replace"))
        given.seek(0)
        env = {"PATH": "/usr/bin:/bin", "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "PYTHONIOENCODING": "utf-8:replace"}
        child = subprocess.Popen([sys.executable, "-I", "main.py"], stdin=given, stdout=out, stderr=err, cwd=folder, env=env, start_new_session=True, preexec_fn=lambda: _limits(seconds, memory_mb))
        try:
            status = "ok" if child.wait(seconds) == 0 else "failed"
        except subprocess.TimeoutExpired:
            status = "timeout"
        finally:
            _end(child.pid)
            child.wait()
        if status == "timeout":
            return {"status": status, "output": "", "error": ""}
        out.seek(0)
        err.seek(max(0, err.seek(0, os.SEEK_END) - ERRORS))
        return {"status": status, "output": out.read(OUTPUT).decode("utf-8", "replace"), "error": err.read(ERRORS).decode("utf-8", "replace")}


def passes(code: str, check: str, seconds: float = 5.0) -> float:
    """100 if the code and then the check run without an error, else 0."""
    return 100.0 if run(f"{code}\n{check}\n", seconds=seconds)["status"] == "ok" else 0.0


#: Gives the first function of a program the name that a check calls.
_NAMED = "if {name!r} not in globals():\n    {name} = next(v for k, v in list(globals().items()) if callable(v) and k != 'check' and k[:2] != '__')\n"


def checked(code: str, tests: str, entry: str | None = None, helper: str = "", seconds: float = 3.0) -> float:
    """100 if tests hold for the code behind its helper code; a check function is called with the entry point."""
    program = f"{helper}\n\n{code}" if helper else code
    if "def check(" in tests and entry and entry.isidentifier():
        return passes(program, f"{_NAMED.format(name=entry)}{tests}\ncheck({entry})", seconds)
    return passes(program, tests, seconds)


def stdin_cases(code: str, cases: str, seconds: float = 5.0) -> tuple[int, int]:
    """(passed, total) of a JSON list of {"input", "output"}, compared by tokens."""
    listed = json.loads(cases)
    got = [run(code, c["input"], seconds) for c in listed]
    return sum(g["status"] == "ok" and str(g["output"]).split() == str(c["output"]).split() for g, c in zip(got, listed, strict=True)), len(listed)


def score(rows: DataFrame, id_col: str, code_col: str, check_col: str, seconds: float = 5.0, budget: float | None = None) -> DataFrame:
    """id, pass_score; a row that runs out of time gets 0 and holds up no other row for longer.

    With a budget, the rows that a task hasn't begun after so many seconds get 0 as well.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        until = None if budget is None else time.monotonic() + budget
        for b in batches:
            s = [0.0 if until is not None and time.monotonic() > until else passes(c or "", k or "", seconds) for c, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["id", "pass_score"])

    return rows.select(F.col(id_col).cast("string").alias("id"), code_col, check_col).mapInArrow(each, "id string, pass_score double")


def call(function: Callable[[str], str], value: str, seconds: float) -> tuple[str, str | None, str | None]:
    """(status, result, error) of a call in a process of its own."""
    ends, begins = multiprocessing.Pipe(duplex=False)
    pid = os.fork()
    if pid == 0:
        try:
            os.setsid()
            try:
                begins.send_bytes(pickle.dumps((SUCCESS, function(value), None)))
            except Exception as e:
                begins.send_bytes(pickle.dumps((EXCEPTION, None, repr(e)[:ERRORS])))
        finally:
            os._exit(0)
    begins.close()
    try:
        if not ends.poll(seconds):
            return TIMEOUT, None, None
        return pickle.loads(ends.recv_bytes())
    except EOFError:
        return EXPIRED, None, None
    finally:
        _end(pid)
        with contextlib.suppress(ProcessLookupError):
            os.kill(pid, signal.SIGKILL)
        os.waitpid(pid, 0)
        ends.close()


def with_status(function: Callable[[str], str], seconds: float) -> Callable[[Column], Column]:
    """A function of text over a column: struct of status, result and error, each row with its own time limit."""
    kind = pa.struct([("status", pa.string()), ("result", pa.string()), ("error", pa.string())])

    @F.arrow_udf("status string, result string, error string")
    def mapped(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else dict(zip(("status", "result", "error"), call(function, v, seconds), strict=True)) for v in values.to_pylist()], kind)

    return mapped
