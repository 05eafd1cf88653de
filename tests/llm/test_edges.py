"""Extra columns with clashing names, nulls in any column, repeated rows, ties and a long text, through every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from solvegrid.llm import bpe, chat, dartminhash, linededup, mixing, packing, quality, substring, topk, toxicity

CLASHES = ["n", "key", "x", "y", "id", "size", "source_size", "target", "taken", "class_id", "ids", "shard", "row", "score", "kept", "h", "line", "pos", "words", "label", "spans", "rank", "query_id", "turn_no", "i", "j", "a", "b", "quality", "toxic"]
LINES = "\n".join(f"line number {i} says the river rose by {i} feet in the spring" for i in range(12))
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
ROWS = [(None, None, None), (None, "only an id is missing here", "a"), (1, None, "a"), (2, "", None), (3, " \n\t ", "b"), (4, LINES, "b"), (4, LINES, "b"), (5, LINES, None), (6, LONG, "a"), (7, LONG + " more", "a"), (8, "x" * 20_000, "c"), (-9, LINES + "\nend", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return d.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])


def test_extra_columns_stay(spark, docs):
    """Operators that return documents return all their columns, untouched."""
    seen = {
        "lines": linededup.dedup(docs),
        "near": dartminhash.keep_one(docs),
        "mix": mixing.apply_mix(docs),
        "substring": substring.dedup(docs),
        "quality": quality.keep_good(docs, None),
    }
    for name, out in seen.items():
        assert out.columns[: len(docs.columns)] == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"extra {c}" for c in CLASHES), name


def test_lines_and_near_copies(spark, docs):
    left = [(r.doc_id, r.text) for r in linededup.dedup(docs).select("doc_id", "text").collect()]
    assert len(left) == len(ROWS) and sum(t is not None and "line number 3" in t for _, t in left) == 1
    one = sorted(r.doc_id for r in dartminhash.keep_one(docs).where("text is not null and doc_id is not null").collect() if r.text.startswith(("line", "w0x0")))
    assert one == [-9, 6]


def test_rows_are_kept(spark, docs):
    """One row a document from the digests, the classes, the scores and the encoder."""
    assert dartminhash.classes(docs).count() == linededup.digests(docs).count() == substring.digests(docs).count() == mixing.mix(docs).count() == len(ROWS)
    assert quality.annotate(docs, None).count() == toxicity.annotate(docs, None).count() == len(ROWS)
    scores = [r[0] for r in toxicity.annotate(docs, None).select("__toxicity.score").collect()]
    assert all(0 <= s <= 1 for s in scores)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r.d.n_tokens for r in docs.select("doc_id", bpe.digests(path)(F.col("text")).alias("d")).collect()}
    assert got[1] == got[2] == got[3] == 0 and got[4] > 100
    assert bpe.encode_column(docs, path).count() == len(ROWS)


def test_packing_is_lossless(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole = packing.packed(docs, path, public_tokenizers.PATTERN).agg(F.sum("n_tokens")).first()[0]
    codec = packing.encoder(path, public_tokenizers.PATTERN)
    texts = sum(len(codec.encode_ordinary(t)) for _, t, _ in ROWS if t)
    assert whole == texts


def test_topk_ties_and_chat_nulls(spark):
    v = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(30)] + [(40, [float("inf"), 0.0]), (None, None)], "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    got = topk.search(v, F.col("vec_id") % 20 == 0, 3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    t = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", None), (2, None, "assistant", "a\\<s>"), (2, 1, "user", "</s>")], "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("x"))
    assert {(r.conv_id, r.n_turns) for r in chat.digests(chat.conversations(t)).collect()} == {(1, 2), (2, 2)}
