"""Rows of one id with different texts, null ids too: no text's links are lost, and no text vanishes."""

import pytest

from solvegrid.llm import dartminhash


def text(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


A, B, C, D = (text(x) for x in "abcd")


@pytest.mark.parametrize("own", [5, None])
def test_texts_that_share_an_id(spark, own):
    near = A.rpartition(" ")[0] + " other"
    least = -(2**63) if own is None else 2
    rows = [(2, C), (own, A), (own, C), (own, B), (9, A), (10, B), (11, D), (12, near), (13, ""), (14, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dartminhash.classes(docs).collect()
    assert len(got) == len(rows)
    want = {2: least, own: least, 9: least, 10: least, 11: 11, 12: least, 13: 13, 14: 13}
    assert {r.doc_id: r.class_id for r in got} == want
    kept = {(r.doc_id, r.text) for r in dartminhash.keep_one(docs).collect()}
    one = (None, C) if own is None else (2, C)
    assert kept == {one, (own, A), (own, B), (11, D), (13, "")}
