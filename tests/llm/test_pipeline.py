"""The pipeline as a whole against a brute-force version of its five stages."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_brute import brute_classes, brute_lines, brute_rules, brute_targets
from tokenizers import Tokenizer

import corpus_pipeline
from solvegrid.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def seats(shares, total):
    """One at a time to the highest quotient; of equals the first."""
    out = [0] * len(shares)
    for _ in range(total if any(shares) else 0):
        out[max(range(len(shares)), key=lambda k: (shares[k] / (2 * out[k] + 1), -k))] += 1
    return out


def brute_mix(rows):
    """doc_id to words taken: the documents' words are laid out, and each quota is walked block by block."""
    block, seed = mixing.BLOCK, mixing.SEED
    size = {d: len((t or "").split()) for d, t, _ in rows}
    sources = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    total = Counter()
    for d, _, s in rows:
        total[s] += size[d]
    target = brute_targets(total, {s: 1 + i % 3 for i, s in enumerate(sources)})
    given = seats([target[s] for s in sources], math.floor((sum(target.values()) + block / 2) / block))
    taken = Counter()
    for s, n in zip(sources, given, strict=True):
        shards = max(1, math.floor(math.sqrt(total[s] / block)))
        cells = defaultdict(list)
        for d, _, own in rows:
            if own == s:
                key = hashlib.md5(f"{seed}:{d}:{size[d]}".encode()).hexdigest()
                cells[int(key[:8], 16) % shards].append((key, d))
        order = sorted(cells)
        for cell, quota in zip(order, seats([sum(size[d] for _, d in cells[c]) for c in order], n), strict=True):
            words = [d for _, d in sorted(cells[cell]) for _ in range(size[d])]
            spot = int(hashlib.md5(f"{seed}/{s or ''}/{cell}".encode()).hexdigest()[:8], 16)
            for i in range(min(quota * block, 3 * len(words))):
                taken[words[(spot * block + i) % len(words)]] += 1
    return size, taken


def brute(rows, kept):
    """rows: (doc_id, text, source); kept: whether the model keeps a text that the rules keep."""
    rows = [r for r in rows if not brute_rules(r[1])[-1] and kept(r[1])]
    texts = brute_lines([(d, t) for d, t, _ in rows], 2, 20)
    classes = brute_classes(list(texts.items()))
    rows = [(d, texts[d], s) for d, _, s in rows if classes[d] == d]
    size, taken = brute_mix(rows)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for d, t, s in rows:
        ids = lib.encode(t, add_special_tokens=False).ids
        if size[d]:
            out[d, s, tuple(ids), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += (2 * taken[d] + size[d]) // (2 * size[d])
    return +out


def corpus(seed):
    rnd = random.Random(seed)
    good = "the river report tells of calm towns along the valley in spring with care and patience".split()
    shared = [" ".join(rnd.choices(good, k=9)) for _ in range(6)] + [" ".join([*rnd.choices(good, k=24), str(k)]) for k in range(4)]
    rows = []
    for d in range(160):
        if d % 8 == 7:
            text = " ".join(f"buy{rnd.randrange(90)} now{rnd.randrange(90)} $ #" for _ in range(20))
        else:
            lines = [" ".join([*rnd.choices(good, k=rnd.choice([3, 7, 22])), f"no{rnd.randrange(10**6)}"]) for _ in range(rnd.randint(2, 7))]
            at = rnd.randrange(len(lines))
            lines[at:at] = rnd.sample(shared, rnd.randint(0, 3))
            text = rnd.choice(["\n", "\n\n"]).join(lines)
        rows.append((d, text, rnd.choices(["a", "b", None, "é"], [9, 2, 1, 1])[0]))
    for d in range(160, 190):
        words = rows[rnd.randrange(150)][1].split(" ")
        words[rnd.randrange(len(words))] = f"x{d}"
        rows.append((d, " ".join(words), rnd.choice(["a", "b"])))
    return [*rows, (190, None, "a"), (191, "", None), (192, " \n\t", "b"), (193, "the " * 400, "a"), (194, rows[0][1], "a")]


def written(spark, rows, labels, folder):
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA)
    # columns of any name go along
    docs = docs.select("*", *[F.lit(f"extra {c}").alias(c) for c in ("ids", "key", "size", "id", "a", "label", "n_tokens")])
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize(("seed", "labelled"), [(1, True), (2, False)])
def test_run_is_the_brute_force_version(spark, tmp_path, seed, labelled):
    rows = corpus(seed)
    labels = [(d, int("$" not in (t or "$")), 0) for d, t, _ in rows] if labelled else []
    folder = written(spark, rows, labels, tmp_path)
    got = Counter((r.doc_id, r.source, tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    want = brute(rows, (lambda t: "$" not in t) if labelled else (lambda t: True))
    assert len(want) > 60 and got == want


def test_an_empty_table(spark, tmp_path):
    folder = written(spark, [(1, "x", "a")], [(1, 1, 0)], tmp_path)
    assert corpus_pipeline.run(spark, folder).count() == 0
    empty = written(spark, [], [], tmp_path / "empty")
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "linededup", "minhash", "mixing", "bpe"]


def test_stages_keep_the_columns(spark, tmp_path):
    folder = written(spark, corpus(3)[:40], [], tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert out.where("ids <> 'extra ids' or id <> 'extra id'").count() == 0
