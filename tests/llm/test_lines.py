"""Single lines as runs, against the rule in plain Python."""

from pyspark.sql import functions as F

import corpus_pipeline
from solvegrid.llm import linededup

LONG = " ".join(f"word{i}" for i in range(linededup.ALONE))
SHORT = LONG.rpartition(" ")[0]


def brute(rows, alone):
    """Later places of runs of two lines, and of single lines of alone words, go."""
    seen, gone = {}, set()
    lines = {d: [(i, s.strip()) for i, s in enumerate((t or "").split("\n")) if s.strip()] for d, t in sorted(rows)}
    for d, own in lines.items():
        runs = [(own[k : k + 2]) for k in range(len(own) - 1)] + [[x] for x in own if len(x[1].split()) >= alone]
        for run in sorted(runs, key=lambda r: r[0][0]):
            key = tuple(s for _, s in run)
            if key in seen:
                gone |= {(d, i) for i, _ in run}
            seen.setdefault(key, (d, run[0][0]))
    return {d: t and "\n".join(s for i, s in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


ROWS = [(1, LONG), (2, LONG), (3, f"a\n{LONG}\nb"), (4, f"c\n {LONG}\t\n\nd\n{LONG}"), (5, f"e\n{SHORT}\nf"), (6, f"g\n{SHORT}\nh"), (7, SHORT), (8, "a b\nc d"), (9, "x\na b\nc d\ny"), (10, None), (11, "")]


def test_long_single_lines_go(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r.text for r in linededup.dedup(docs, alone=linededup.ALONE).collect()}
    assert got == brute(ROWS, linededup.ALONE)
    assert got[1] == LONG and got[2] == "" and got[3] == "a\nb" and got[4] == "c\n\nd" and got[6] == f"g\n{SHORT}\nh"
    removed = {r.doc_id: r.n_removed for r in linededup.digests(docs, alone=linededup.ALONE).collect()}
    assert removed == {1: 0, 2: 1, 3: 1, 4: 2, 5: 0, 6: 0, 7: 0, 8: 0, 9: 2, 10: 0, 11: 0}
    assert {r.doc_id: r.text for r in linededup.dedup(docs, alone=None).collect()} == brute(ROWS, 1 << 30)


def test_the_stage_takes_single_lines(spark):
    docs = spark.createDataFrame(ROWS[:3], "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert got == {1: (LONG, len(LONG)), 2: ("", 0), 3: ("a\nb", 3)}
