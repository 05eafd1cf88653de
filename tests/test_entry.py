"""The driver's contract holds without the training-data operators' libraries."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize("missing", ["tiktoken", "regex", "public_tokenizers", "solvegrid.llm", "corpus_pipeline"])
def test_other_queries_stay(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'binning_summary' in q and set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 100
