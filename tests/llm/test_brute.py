"""Operators against brute-force versions in plain Python."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from solvegrid.llm import bpe, chat, dartminhash, linededup, mixing, packing, quality, substring, toxicity
from solvegrid.llm import common as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- op1


def shingles(text):
    words = WORD.findall(text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    same = sum((a & b).values())
    return same, sum(a.values()) + sum(b.values()) - same


def brute_classes(rows):
    own = {d: shingles(t) for d, t in rows}
    least = {d: d for d in own}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for x, y in itertools.combinations(sorted(own), 2):
        same, whole = jaccard(own[x], own[y])
        if same * 5 >= whole * 4:
            a, b = root(x), root(y)
            least[max(a, b)] = min(a, b)
    return {d: root(d) for d in own}


def near_corpus(seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(25):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 8, 40, 150, 400]))]
        if rnd.random() < 0.3:
            words += words
        rows.append(" ".join(words))
        for _ in range(rnd.randrange(6)):
            copy = list(words)
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 9])):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(10**6)}"
            rows.append("  ".join(copy))
    return [(i, t) for i, t in enumerate(rnd.sample(rows, len(rows)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_are_all_linked(spark, seed):
    """Each pair at 0.8 or more is in one class, and no other pair is but by a chain of such."""
    rows = near_corpus(seed)
    got = {r.doc_id: r.class_id for r in dartminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_bands_meet_by_similarity():
    """The share of pairs that meet in a bucket, by similarity: all from 0.8 on."""
    rnd, words = random.Random(5), [f"v{i}" for i in range(300)]
    texts, truth = [], []
    for edits in (1, 4, 8, 14, 25):
        for _ in range(40):
            copy = list(words)
            for at in rnd.sample(range(300), edits):
                copy[at] = f"y{rnd.randrange(10**9)}"
            texts.append(" ".join(copy))
            same, whole = jaccard(shingles(" ".join(words)), shingles(texts[-1]))
            truth.append(same / whole)
    unit, first = dartminhash.units(next(C.chunks(pa.array([" ".join(words), *texts]), 1 << 30))[2])
    keys = dartminhash.band_keys(dartminhash.signatures(unit, first, dartminhash.BANDS * dartminhash.ROWS), dartminhash.BANDS, dartminhash.ROWS)
    meets = (keys[1:] == keys[0]).any(axis=1)
    assert all(m for m, s in zip(meets, truth, strict=True) if s >= 0.8)
    assert sum(s >= 0.8 for s in truth) >= 80


# --- op2


def brute_segments(scores, lo=0):
    """The best subsequence (the shortest, then the leftmost), then those of what lies beside it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            key = (sum(scores[i:j]), -(j - i), -i)
            if best is None or key > best[0]:
                best = (key, i, j)
    if best is None or best[0][0] <= 0:
        return []
    _, i, j = best
    return brute_segments(scores[:i], lo) + [(best[0][0], lo + i, lo + j)] + brute_segments(scores[j:], lo + j)


def test_maximal_segments():
    rnd = random.Random(3)
    for _ in range(300):
        scores = [Fraction(rnd.randint(-40, 30), 8) + Fraction(rnd.randint(1, 999), 10**6) for _ in range(rnd.randint(1, 25))]
        scores = [float(s) for s in scores]
        at = np.flatnonzero(np.array(scores) > 0)
        got = toxicity.segments(at, np.array(scores)[at], np.array(scores)) if len(at) else []
        want = brute_segments(scores)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert np.allclose([s for s, _, _ in got], [s for s, _, _ in want])


def test_log_odds_by_hand_and_lambda():
    toxic, clean, n_toxic, n_clean = 6, 2, 40, 120
    pull = 20 * (8 / 160 + 0.01)
    a, b = toxic + pull, clean + pull
    want = math.log(a / (n_toxic + 20.2 - a)) - math.log(b / (n_clean + 20.2 - b))
    odds, deviation = toxicity.log_odds(np.array([toxic, 0]), np.array([clean, 9]), n_toxic, n_clean)
    assert odds[0] == pytest.approx(want) and deviation[0] == pytest.approx(math.sqrt(1 / a + 1 / b))
    scores = toxicity.token_scores(np.array([30, 0]), np.array([0, 90]), n_toxic, n_clean)
    # evidence against a toxic text is kept as it is
    odds, deviation = toxicity.log_odds(np.array([30, 0]), np.array([0, 90]), n_toxic, n_clean)
    assert scores[1] == pytest.approx(odds[1] - toxicity.COST) and odds[1] < 0 < scores[0] < odds[0]
    # a score of 1 with chance p, else -1: lambda is ln((1 - p) / p)
    counts = toxicity.histogram(np.array([1.0] * 20 + [-1.0] * 80))
    assert toxicity.decay(counts) == pytest.approx(math.log(4), abs=1e-6)


def test_toxic_passages_are_found(spark):
    rnd = random.Random(8)
    bad = ["idiot", "scum", "moron", "trash"]
    rows, labels = [], []
    for i in range(1600):
        words = [f"w{rnd.randrange(300)}" for _ in range(60)]
        if i % 4 == 0:
            words[20:20] = [rnd.choice(bad) for _ in range(4)]
            words[50:50] = [rnd.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.t for r in toxicity.annotate(docs, model, into="t").select("doc_id", "t").collect()}
    assert all((got[i].score >= 0.3) == bool(y) for i, y in labels)
    spans = [(s.start, s.end) for s in got[0].segments]
    assert spans and all(s.evidence > toxicity.SIGNIFICANT for s in got[0].segments)
    assert all(any(a <= k < b for a, b in spans) for k in (20, 21, 22, 23))
    # labels of held-out rows make no difference
    import zlib

    held = [(i, 1 - y) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, y) for i, y in labels]
    other = toxicity.fit(docs, spark.createDataFrame(held, "doc_id long, toxic int"))
    assert other.words.scores.tobytes() == model.words.scores.tobytes() and other.slope == model.slope


def test_toxicity_fit_on_empty_and_long_texts(spark):
    rows = [(i, None if i % 5 == 0 else "" if i % 5 == 1 else "bad " * (30_000 if i == 7 else 3) if i % 2 else "good day to all") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    scored = toxicity.annotate(docs, toxicity.fit(docs, labels)).select("__toxicity.score").collect()
    assert len(scored) == 120 and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.fit(docs.limit(0), labels) is None
    assert toxicity.annotate(docs.limit(0), None).count() == 0


# --- op3


def test_bpe_is_the_library_on_every_character():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = bpe.Codec(path), Tokenizer.from_file(path)
    points = [chr(c) for c in [*range(0x30000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 64):
        text = " ".join(f"a{c}b {c} 1{c}" for c in points[i : i + 64])
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids, hex(ord(points[i]))


def test_bpe_is_the_library_on_sequences():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = bpe.Codec(path), Tokenizer.from_file(path)
    rnd = random.Random(4)
    pool = [chr(c) for c in range(0x2FFFF) if not 0xD800 <= c < 0xE000]
    for _ in range(1500):
        text = "".join(rnd.choice(pool) if rnd.random() < 0.5 else rnd.choice(["a", "A", " ", "1", "'s", "Σ", "é", "é", "̂", "İ", "ß", "<|endoftext|>", "\r\n"]) for _ in range(rnd.randint(1, 40)))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_merges_are_lowest_rank_then_leftmost():
    rnd = random.Random(6)
    for _ in range(300):
        pairs, ids = {}, 3
        for rank in range(rnd.randint(1, 12)):
            a, b = rnd.randrange(ids), rnd.randrange(ids)
            if (a, b) not in pairs:
                pairs[a, b] = (rank, ids)
                ids += 1
        word = [rnd.randrange(3) for _ in range(rnd.randint(0, 70))]
        want = list(word)
        while found := min(((pairs[p][0], i) for i, p in enumerate(itertools.pairwise(want)) if p in pairs), default=None):
            i = found[1]
            want[i : i + 2] = [pairs[want[i], want[i + 1]][1]]
        assert bpe.merge_word(word, pairs) == want


def test_bpe_replaces_a_column_of_the_result_s_name(spark):
    d = spark.createDataFrame([("a b", "mine"), (None, "mine")], "text string, ids string")
    got = bpe.encode_column(d, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert [len(r.ids) for r in got] == [2, 0]


# --- op4


def brute_pack(lengths, room):
    rows = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rows if sum(lengths[j] for j in r) + lengths[i] <= room]
        if fits:
            max(fits, key=lambda r: sum(lengths[j] for j in r)).append(i)
        else:
            rows.append([i])
    return rows


def test_best_fit_decreasing():
    rnd = random.Random(9)
    for _ in range(200):
        room = rnd.choice([8, 17, 64])
        lengths = [rnd.randint(1, room) for _ in range(rnd.randint(0, 40))]
        got = packing.pack(lengths, room)
        # rows of equal fill may be taken in any order, so fills are compared
        fill = lambda rows: sorted(sorted(lengths[i] for i in r) for r in rows)
        assert sorted(i for r in got for i in r) == list(range(len(lengths)))
        assert sorted(sum(x) for x in fill(got)) == sorted(sum(x) for x in fill(brute_pack(lengths, room)))


def test_written_rows_unpack_to_the_encodings(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, " ".join(f"word{rnd.randrange(999)}" for _ in range(rnd.choice([0, 1, 20, 400])))) for i in range(60)] + [(60, None), (61, ""), (5, "again the same id")]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    to = str(tmp_path / "packed")
    packing.write(packing.packed(docs, path, public_tokenizers.PATTERN, length=128, shard_tokens=5000), to)
    back = spark.read.parquet(to)
    codec = packing.encoder(path, public_tokenizers.PATTERN)
    want = Counter((d, at, tuple(ids[at : at + 128])) for d, t in rows for ids in [codec.encode_ordinary(t or "")] for at in range(0, len(ids), 128))
    got = Counter((r.doc_id, r.doc_offset, tuple(np.frombuffer(r.ids, "<i4").tolist())) for r in packing.unpack(back).collect())
    assert got == want
    for r in back.collect():
        cuts, ids, positions = r.cu_seqlens, np.frombuffer(r.ids, "<i4"), np.frombuffer(r.positions, "<i4")
        assert cuts[0] == 0 and cuts[-1] == r.n_tokens <= len(ids) == len(positions) == 128
        assert (ids[r.n_tokens :] == packing.PAD).all()
        for a, b in itertools.pairwise([*cuts, 128]):
            assert positions[a:b].tolist() == list(range(b - a))
    # the same splits give the same rows
    again = packing.packed(docs, path, public_tokenizers.PATTERN, length=128, shard_tokens=5000)
    assert sorted(again.collect()) == sorted(back.select(again.columns).collect())
    assert packing.packed(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


# --- op5


def test_seats_by_the_highest_quotient(spark):
    rnd = random.Random(7)
    groups = [(g, [rnd.choice([0, 1, 5, rnd.random() * 100]) for _ in range(rnd.randint(1, 9))], rnd.choice([0, 1, 7, 50])) for g in range(30)]
    rows = [(g, k, float(x), n) for g, shares, n in groups for k, x in enumerate(shares)]
    got = {(r.g, r.k): r.seats for r in mixing.seats(spark.createDataFrame(rows, "g int, k int, share double, total long"), ["g"], ["k"], "share", "total").collect()}
    for g, shares, n in groups:
        seats = [0] * len(shares)
        for _ in range(n if any(shares) else 0):
            k = max(range(len(shares)), key=lambda k: (shares[k] / (2 * seats[k] + 1), -k))
            seats[k] += 1
        assert [got[g, k] for k in range(len(shares))] == seats, (g, shares, n)


def brute_targets(sizes, weights):
    """Water filling: full sources leave, the rest share what is left, until none is above."""
    left, open_, out = sum(sizes.values()), dict(weights), {}
    while open_:
        level = Fraction(left, sum(open_.values()))
        full = [s for s in open_ if level * open_[s] > 3 * sizes[s]]
        if not full:
            return out | {s: float(level * w) for s, w in open_.items()}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
            del open_[s]
    return out


def test_mix_targets_and_words(spark):
    rnd = random.Random(11)
    sources = ["a", "b", "B", "é", None, "zz", "m"]
    rows = [(i, " ".join("w" * rnd.randint(1, 4) for _ in range(rnd.choice([0, 3, 40, 90]))), s) for i in range(400) for s in [rnd.choices(sources, [60, 9, 3, 1, 4, 20, 2])[0]]] + [(400, None, "a")]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    ordered = sorted([s for s in sizes if s is not None]) + [None]
    want = brute_targets(sizes, {s: 1 + i % 3 for i, s in enumerate(ordered)})
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = docs.select("doc_id", "source").join(mixing.mix(docs), "doc_id").collect()
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in sizes)
    assert sorted(mixing.mix(docs.repartition(5)).collect()) == sorted(mixing.mix(docs).collect())


# --- op6


def brute_lines(rows, span, alone):
    """Later places of runs of span lines, and of single lines of alone words, go."""
    seen, gone = set(), set()
    for d, t in sorted(rows):
        own = [(i, s.strip(" \t\r\x0b\x0c")) for i, s in enumerate((t or "").split("\n")) if s.strip(" \t\r\x0b\x0c")]
        runs = [own[k : k + span] for k in range(len(own) - span + 1)]
        runs += [[x] for x in own if alone and len(x[1].split()) >= alone]
        for run in sorted(runs, key=lambda r: r[0][0]):
            key = tuple(s for _, s in run)
            if key in seen:
                gone |= {(d, i) for i, _ in run}
            seen.add(key)
    return {d: t and "\n".join(s for i, s in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


@pytest.mark.parametrize(("gram", "window", "alone"), [(1, 2, 20), (1, 4, None), (2, 3, None), (3, 1, 4), (1, 1, None)])
def test_lines_for_any_window(spark, gram, window, alone):
    rnd = random.Random(gram * 10 + window)
    passages = [[f"{rnd.choice('abcd')} line {rnd.randrange(30)}" for _ in range(rnd.randint(1, 9))] for _ in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rnd.randint(0, 4)):
            part = list(rnd.choice(passages))
            a = rnd.randrange(len(part))
            lines += part[a:] if rnd.random() < 0.5 else [f"own {rnd.randrange(10**6)}", *part[: a + 1], "", " \t"]
        rows.append((d, "\n".join(lines)))
    rows.append((60, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    options = {"gram": gram, "window": window, "alone": alone}
    want = brute_lines(rows, gram + window - 1, alone)
    assert {r.doc_id: r.text for r in linededup.dedup(docs, **options).collect()} == want
    digests = {r.doc_id: r for r in linededup.digests(docs, **options).collect()}
    for d, t in rows:
        n = sum(bool(s.strip()) for s in (t or "").split("\n"))
        left = sum(bool(s.strip()) for s in (want[d] or "").split("\n"))
        assert (digests[d].n_lines, digests[d].n_removed, digests[d].kept_sha256) == (n, n - left, sha(want[d] or ""))


def test_line_matches_are_extended_both_ways(spark):
    run = [f"line {i}" for i in range(9)]
    rows = [(1, "\n".join(["a", *run, "b"])), (2, "\n".join(["c", "", *run, "d"]))]
    got = linededup.matches(spark.createDataFrame(rows, "doc_id long, text string"), gram=1, window=4).collect()
    assert [(r.id, r.j, r.source, r.source_j, r.n_lines, r.a, r.b) for r in got] == [(2, 1, 1, 1, 9, 2, 10)]


# --- op8


def brute_words(rows, span):
    first, out = {}, {}
    texts = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(texts):
        for i in range(len(texts[d]) - span + 1):
            first.setdefault(tuple(texts[d][i : i + span]), (d, i))
    for d, words in texts.items():
        gone = {i + k for i in range(len(words) - span + 1) if first[tuple(words[i : i + span])] < (d, i) for k in range(span)}
        out[d] = (len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_windows_go(spark, seed):
    rnd = random.Random(seed)
    pool = [[f"w{rnd.randrange(50)}" for _ in range(rnd.randint(20, 120))] for _ in range(8)]
    rows = []
    for d in range(50):
        words = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p) - 5)
            words += [*p[a : a + rnd.randint(5, 100)], *[f"o{rnd.randrange(10**6)}" for _ in range(rnd.choice([0, 0, 1, 12]))]]
        rows.append((d, "\t".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs).collect()} == brute_words(rows, 20)
    # factors are copies of what they name, from an earlier start, and can't be longer to the right
    words = {d: WORD.findall(t) for d, t in rows}
    for r in substring.factors(docs).collect():
        for f in r.factors:
            assert f.n_words >= 20 and (f.source, f.source_at) < (r.id, f.at)
            assert words[r.id][f.at : f.at + f.n_words] == words[f.source][f.source_at : f.source_at + f.n_words]


def test_texts_of_one_id_are_told_apart(spark):
    a = " ".join(f"a{i}" for i in range(200))
    base = " ".join(f"b{i}" for i in range(120))
    rows = [(1, base), (9, f"{a} {base} {a[::-1]}"), (9, "one two three four five six seven eight"), (9, base + " z")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 120, 0), (9, 8, 0), (9, 121, 120), (9, 520, 120)]


# --- op9


def test_conversations_round_trip(spark):
    rnd = random.Random(12)
    bits = [*chat.CONTROL, "\\", "<", "[", "ok", " ", "\n", "é🙂", "</s", "[/INST"]
    say = lambda: None if rnd.random() < 0.1 else "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", None, "[ROLE]\\"]), say()) for c in [None, *range(40)] for t in range(rnd.choice([1, 2, 30]))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    want = {}
    for c in {r[0] for r in rows}:
        own = [(r, x or "") for _, _, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        loss = "".join(x for r, x in own if r == "assistant")
        want[c] = (len(own), sha("".join(f"{r or ''}\n{x}\n" for r, x in own)), len(loss), sha(loss))
    for part in (chat.PART, 40):
        parts = chat.conversations(turns, part=part)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(parts).collect()}
        assert got == want
        whole = {}
        for r in sorted(parts.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.part)):
            assert len(whole.get(r.conv_id, "")) == r["at"]
            whole[r.conv_id] = whole.get(r.conv_id, "") + r.formatted
        for c, text in whole.items():
            own = [(r, x or "") for _, _, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
            assert chat.parse(text) == own
            spans = [s for r in parts.where(F.col("conv_id").eqNullSafe(F.lit(c))).collect() for s in r.loss] if c in (None, 0) else []
            assert [chat.unescape(text[a:b]) for a, b in spans] == ([x for r, x in own if r == "assistant"] if spans else [])
    assert chat.digests(chat.conversations(turns.limit(0))).count() == 0


# --- op10


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = {i + k for i in range(len(words) - 7) if n[tuple(words[i : i + 8])] > 1 for k in range(8)}
    stats = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat))
    return (*stats, stats[0] < 20 or 100 * stats[4] > 30 * stats[0])


def test_quality_rules_and_model(spark):
    rnd = random.Random(13)
    texts = [None, "", " \n", "a\n\na\n a\n"]
    for _ in range(200):
        part = [rnd.choice(["rivers", "a", "#", "é&", " ", "x|y", "🙂"]) + str(rnd.randrange(40)) for _ in range(rnd.choice([3, 9, 30]))]
        texts.append(rnd.choice([" ", "\n", " \n"]).join(part * rnd.choice([1, 1, 2, 3])))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in quality.annotate(docs, None, into="q").collect():
        got = (r.q.n_words, r.q.word_chars, r.q.n_symbols, r.q.n_dup_lines, r.q.n_repeat_words, r.q.base_failed)
        assert got == brute_rules(r.text), r.text
        assert r.q.kept == (not r.q.base_failed)
    good = "a calm report on rivers and the towns along them in spring and in autumn, written with care and patience by"
    rows = [(i, f"{good} author{rnd.randrange(10**6)} in year {i}" if i % 2 else " ".join(f"buy{rnd.randrange(60)} now{i}" for _ in range(15))) for i in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(402)], "doc_id long, quality int"))
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {i for i in range(400) if i % 2}
    assert quality.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")) is None


def test_samples_are_bounded_in_bytes(spark):
    rows = [(i, "x" * 1000) for i in range(50)] + [(50, "y" * 5000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(51)], "doc_id long, quality int")
    got = quality.sample(docs, labels, "quality", {0: 20, 1: 20}, most_bytes=6000, longest=2000).groupBy("label").count().collect()
    assert {r.label for r in got} == {0, 1} and all(2 <= r["count"] <= 6 for r in got)
