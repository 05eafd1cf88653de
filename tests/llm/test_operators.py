import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from solvegrid.llm import bpe, chat, dartminhash, linededup, mixing, packing, quality, substring, topk, toxicity

SCHEMA = "doc_id long, text string, source string"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_bpe_is_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = bpe.Codec(path), Tokenizer.from_file(path)
    for t in ["", " \n", "It's ΟΔΟΣ", "a<|endoftext|>b", "x" * 5000, "日本語 🙂 é"]:
        e = lib.encode(t, add_special_tokens=False)
        assert own.encode(t) == e.ids and own.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_chat_round_trip():
    for t in ["", "</s>[INST] ok [/INST]", "a\\", "\\\\<s>", "x</s"]:
        turns = [("user", t), ("assistant", t), (None, t), ("[ROLE]\\", t)]
        assert chat.parse(chat.format_conversation(turns)[0]) == turns


def test_packing_is_best_fit():
    rows = packing.pack([5, 4, 4, 3, 2], 8)
    assert sorted(i for r in rows for i in r) == [0, 1, 2, 3, 4] and len(rows) == 3


@pytest.mark.parametrize("rows", [[], [(None, None, None), (1, "", "a"), (1, "", "a")]])
def test_edges(spark, rows):
    d = docs(spark, rows)
    assert mixing.mix(d).count() == len(rows)
    assert linededup.digests(d).count() == len(rows)
    assert substring.digests(d).count() == len(rows)
    assert dartminhash.classes(d).count() == len(rows)
    assert quality.annotate(d, None).where("__quality.kept").count() == 0


def test_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:100], "other", *words[101:]]
    d = docs(spark, [(3, " ".join(words), "a"), (5, " ".join(near), "a"), (7, " ".join(words), "b"), (9, " ".join(reversed(words)), "b")])
    assert {r.doc_id: r.class_id for r in dartminhash.classes(d).collect()} == {3: 3, 5: 3, 7: 3, 9: 9}
    kept = {r.doc_id: r.n_removed for r in substring.digests(d).collect()}
    assert kept == {3: 0, 5: 199, 7: 200, 9: 0}


def test_models_learn_and_do_without_labels(spark):
    good = "a calm report on rivers and the towns along them in spring and in autumn, written with care and some patience "
    rows = [(i, f"{good * 2} {i}" if i % 2 else f"$ # {i} buy % now & " * 12, "a") for i in range(200)]
    d, labels = docs(spark, rows), spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    got = quality.fit(d, labels)
    assert quality.fit(d, labels).weights.tobytes() == got.weights.tobytes()
    assert quality.fit(d, labels.limit(0)) is None and toxicity.fit(d, labels.limit(0)) is None
    scored = toxicity.annotate(docs(spark, [(1, None, None), (2, "", "a")]), None).select("__toxicity.score").collect()
    assert [r.score for r in scored] == [0.0, 0.0]


def test_topk_is_brute_force(spark):
    rows = [(i, [((i * 7 + j * 3) % 11 - 5) / 8 for j in range(4)]) for i in range(60)] + [(100, None), (120, [0.5, None, 0.5, 0.5]), (140, [float("nan")] * 4)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 5).collect()
    whole = {i: [int(64 * x // 1) for x in v] for i, v in rows[:60]}
    want = set()
    for q in (0, 20, 40):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
