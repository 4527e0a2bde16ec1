"""Operators 11 to 13 against brute-force versions, on small tables with the awkward cases in them."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import hard_negatives, spelling, suffix_repeats

from .test_operators import ODD, table

# 11 -----------------------------------------------------------------------------------------------------


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_truth(counts):
    near = {w: [x for x in counts if distance_one(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("frequent", [0, 3, 64])
def test_spelling_variants(spark, frequent):
    rng = random.Random(frequent)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(150)}
    for w in list(words)[:60]:
        k = rng.randrange(len(w))
        words |= {w[:k] + "c" + w[k:], w[:k] + "ç" + w[k + 1 :]} | ({w[:k] + w[k + 1 :]} if len(w) > 5 else set())
    words |= {"aaaaa" * 300, "aaaaa" * 300 + "a", "aaaaa", "aaaaaa", "aaaaaaa", "bcdef", "xbcdef", "bcdefx"}
    counts = {w: rng.choice([3, 3, 4, 6, 7, 12, 30]) for w in sorted(words)}
    got = spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), frequent=frequent)
    assert sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == variants_truth(counts)


def test_spelling_without_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_long_chains_of_forms_take_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(spelling, "cut", lambda df, inner=spelling.cut: tables.append(1) or inner(df))
    links = [(f"w{i:03}", f"w{i + 1:03}") for i in range(100)]
    got = spelling.last_forms(spark.createDataFrame(links, "word string, form string"))
    assert {r["root"] for r in got.collect()} == {"w100"} and len(tables) <= 10


def test_affected_grams_bound_every_edit(spark):
    """No edit of a word changes more of its grams than `affected` says, whatever the dictionary."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(5, 8))) for _ in range(60)})
    rows = spelling.variable_grams(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), frequent=4)
    rows = rows.withColumn("bound", spelling.affected(F.col("grams"), F.length("word"))).collect()
    grams = {r["word"]: Counter(g["gram"] for g in r["grams"]) for r in rows}
    for r in rows:
        for other in words:
            if distance_one(r["word"], other):
                assert (grams[r["word"]] & grams[other]).total() >= len(r["grams"]) - r["bound"] > 0


def test_corpus_words(spark):
    rng = random.Random(2)
    vocabulary = ["Quality", "quality", "ÉCOLE", "naïve", "straße", "tiny", "x" * 20, "a×b÷cde"]
    texts = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "1", "-"]) for _ in range(30))) for i in range(150)] + ODD + [(3, "quality quality")]
    want = Counter()
    for i, t in texts:
        for run in spelling.re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    got = spelling.corpus_words(table(spark, texts), every=7)
    assert {r["word"]: r["n"] for r in got.collect()} == want
    assert spelling.corpus_words(table(spark, texts).limit(0)).count() == 0


# 12 -----------------------------------------------------------------------------------------------------


def repeats_truth(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    held = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (one, _), t in zip(rows, texts):
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if held[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        runs = sum(1 for k, _ in itertools.groupby(covered) if k)
        out.append((one, len(t), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(t, covered) if not c)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("most", [1, 3, suffix_repeats.MOST])
def test_remove_repeats(spark, most):
    rng = random.Random(most)
    line = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    passages = [line(n) for n in (25, 40, 60, 200)]
    texts = [line(rng.randrange(40)) + rng.choice(passages) + line(rng.randrange(40)) for _ in range(60)]
    texts += [t[: len(t) // 2] + "#" + t[len(t) // 2 :] for t in texts[:10]] + texts[:5] + [passages[0] * 3, line(24), line(24), "ab" * 40, "a" * 30_000]
    rows = list(enumerate(texts)) + [r for r in ODD if r[0] != 1005] + [(7, texts[7])]
    got = suffix_repeats.remove_repeats(table(spark, rows), length=24, gram=10, most=most)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == repeats_truth(rows, 24)


def test_repeats_keep_the_remaining_bytes(spark):
    passage = "".join(random.Random(1).choice("abcdefgh") for _ in range(50))
    rows = [(1, f"uno {passage} two"), (2, f"tres {passage} four"), (3, "five")]
    got = {r["doc_id"]: r["kept"] for r in suffix_repeats.remove_repeats(table(spark, rows), length=52, gram=20).collect()}
    assert got == {1: b"unotwo", 2: b"tresfour", 3: None}


def test_no_documents_no_repeats(spark):
    assert suffix_repeats.remove_repeats(table(spark, []), length=24, gram=10).count() == 0
    assert suffix_repeats.remove_repeats(table(spark, [(1, None), (None, "")]), length=24, gram=10).count() == 2


@pytest.mark.parametrize("seed", range(40))
def test_interval_tree_finds_the_widest_repeats(seed):
    rng = random.Random(seed)
    piece = lambda n: bytes(rng.choice(b"ab") for _ in range(rng.randrange(n)))
    contexts = list({(piece(8), b"gram" + piece(10), rng.choice([1, 1, 1, 2])) for _ in range(25)})
    contexts = list({x[:2]: x for x in contexts}.values())
    want = []
    for k, (left, right, copies) in enumerate(contexts):
        best = (len(left), len(right)) if copies > 1 and len(left) + len(right) >= 12 else (0, 0)
        for j, (other_left, other_right, _) in enumerate(contexts):
            back, ahead = suffix_repeats.lcp(left[::-1], other_left[::-1]), suffix_repeats.lcp(right, other_right)
            if j != k and back + ahead >= 12:
                best = (max(best[0], back), max(best[1], ahead))
        want.append(best)
    assert suffix_repeats.widest(contexts, 12) == want


def test_contexts_of_a_gram_need_not_meet(spark, monkeypatch):
    """Contexts are told where they are whether their gram has too many; a join by gram had a common passage's rows in one task."""
    asked, meet = [], suffix_repeats.meet
    monkeypatch.setattr(suffix_repeats, "meet", lambda texts, lists, *rest: asked.append(lists) or meet(texts, lists, *rest))
    passage = "".join(random.Random(2).choice("abcdefgh") for _ in range(30))
    rows = [(k, f"{k:05d}{passage}{k:05d}") for k in range(50)]
    got = suffix_repeats.remove_repeats(table(spark, rows), length=24, gram=20, most=10).drop("kept").collect()
    assert Counter(map(tuple, got)) == repeats_truth(rows, 24)
    assert [x["hot"] for r in asked[0].collect() for x in r["asked"]].count(True) >= 50
    assert "MergeJoin" not in asked[0]._jdf.queryExecution().sparkPlan().toString()


def test_pieces_of_a_long_text(monkeypatch):
    """Anchors do not depend on how a long text is cut, or on what lies beside it."""
    rng = random.Random(3)
    text = bytes(rng.choice(b"abc") for _ in range(5000))
    find = lambda texts: suffix_repeats.anchors(texts, suffix_repeats.Hashes(10, suffix_repeats.PIECE + 24), 24)
    whole = find([text])[0]
    monkeypatch.setattr(suffix_repeats, "PIECE", 300)
    assert {**dict(zip(*find([b"x" * 70, text, text[:40]])[1]))} == dict(zip(*whole))


# 13 -----------------------------------------------------------------------------------------------------


def mined_truth(rows, every, positives=5, negatives=10):
    taken = {}
    for one, label, v in rows:
        if one is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            key = (label, [math.floor(256 * x) for x in v])
            taken[one] = min(taken.get(one, key), key)
    out = []
    for a, (label, v) in taken.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(v, w)) for b, (_, w) in taken.items() if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if taken[b][0] == label][:positives]:
            fit = [b for b in order if taken[b][0] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("block", [200, hard_negatives.BLOCK])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 4)) if i % 3 else 0, [round(float(x), 2) for x in rng.normal(0.02, 0.2, 6)]) for i in range(300)]
    rows += [(300 + i, i % 2, [0.1] * 6) for i in range(30)]  # equal vectors: ties
    rows += [(400, None, [0.1] * 6), (401, 1, None), (402, 1, [0.1, None]), (403, 1, [0.1, math.nan]), (404, 1, [math.inf]), (None, 1, [0.1]), (405, 1, []), (410, 2, [0.5])]
    rows += [(420, 9, [0.0] * 6), (421, 9, [0.0] * 6), (20, 3, [0.2] * 6), (20, 3, [0.2] * 6), (-10, 1, [0.1] * 6)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<double>, id string, v string")
    got = hard_negatives.hard_negatives(hard_negatives.clean(frame), F.col("id") % 10 == 0)
    want = mined_truth(rows, 10)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100
    assert hard_negatives.hard_negatives(hard_negatives.clean(frame.limit(0)), F.col("id") % 10 == 0).count() == 0


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[1 << 40, 3]]), np.array([[1 << 20, 5], [1 << 40, 1], [-(1 << 40), 0]])
    assert hard_negatives.products(a, b).tolist() == [[(1 << 60) + 15, hard_negatives.LIMIT, -hard_negatives.LIMIT]]


def test_zero_scores_tie_before_and_after_the_positive(spark):
    """A positive of score 0 has the negatives of score 0, whichever id is smaller."""
    rows = [(0, 1, [1.0, 0.0]), (5, 1, [0.0, 1.0]), (3, 2, [0.0, 1.0]), (7, 2, [0.0, 2.0]), (8, 2, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.hard_negatives(hard_negatives.clean(frame), F.col("id") == 0)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 5, 1, 3, 0, 0), (0, 5, 2, 7, 0, 0)]
