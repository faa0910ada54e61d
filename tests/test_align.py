"""Alignment of many pairs against a plain table of one pair, filled cell by cell."""

import random

import pytest
from pyspark.sql import functions as F

from corrigenda.operators import extract as K
from corrigenda.operators.align import Texts, align_many, op_name


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [max(row[j], new) for j, new in enumerate(_next(row, x, b), 1)]
        for j in range(1, len(row)):
            row[j] = max(row[j], row[j - 1])
    return row[-1]


def _next(row, x, b):
    return [row[j] + 1 if x == y else row[j] for j, y in enumerate(b)]


def replacing(a, b):
    if a[0].lower() == b[0].lower():
        return 0.0
    pos = 0.0 if a[2] == b[2] else 0.25 if {a[2], b[2]} <= {"ADJ", "ADV", "NOUN", "VERB"} else 0.5
    both = len(a[0]) + len(b[0])
    return (0.0 if a[1] == b[1] else 0.499) + pos + (1 - 2 * lcs(a[0], b[0]) / both)


def plain(src, tgt, standard):
    cost, how = {(0, 0): 0.0}, {}
    for i in range(len(src) + 1):
        for j in range(len(tgt) + 1):
            if i == j == 0:
                continue
            if not i or not j:
                cost[i, j], how[i, j] = float(i + j), ("I", 1) if not i else ("D", 1)
                continue
            if src[i - 1][0] == tgt[j - 1][0]:
                cost[i, j], how[i, j] = cost[i - 1, j - 1], ("M", 1)
                continue
            choice = [(cost[i, j - 1] + 1, 2, "I", 1), (cost[i - 1, j] + 1, 3, "D", 1), (cost[i - 1, j - 1] + (1 if standard else replacing(src[i - 1], tgt[j - 1])), 1, "S", 1)]
            w = 2
            while not standard and w <= min(i, j) and cost[i - w + 1, j - w + 1] != cost[i - w, j - w]:
                if sorted(t[0].lower() for t in src[i - w : i]) == sorted(t[0].lower() for t in tgt[j - w : j]):
                    choice.append((cost[i - w, j - w] + (w - 1), 0, "T", w))
                    break
                w += 1
            best = min(choice)
            cost[i, j], how[i, j] = best[0], best[2:]
    out, i, j = [], len(src), len(tgt)
    while i or j:
        op, w = how[i, j]
        a, b = i - (op != "I") * w, j - (op != "D") * w
        out.append((op if op != "T" else f"T{w}", a, i, b, j))
        i, j = a, b
    return out[::-1]


def some_pairs(rng, n):
    def token():
        word = rng.choice(["a", "A", "b", "the", "The", "thing", "things", "Thing", "walk", "walked", "x" * 70, "y" * 70 + "z", "", "é", "\U0001f600"])
        return word, word.lower().rstrip("s"), rng.choice(["NOUN", "VERB", "DET"])

    for _ in range(n):
        src = [token() for _ in range(rng.randint(0, 12))]
        tgt = list(src) if rng.random() < 0.6 else [token() for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 4)):
            if tgt:
                k = rng.randrange(len(tgt))
                tgt[k] = token() if rng.random() < 0.5 else rng.choice(tgt)
                if rng.random() < 0.5:
                    part = tgt[k : k + 4]
                    rng.shuffle(part)
                    tgt[k : k + 4] = part
        yield src, tgt


@pytest.mark.parametrize("standard", [False, True])
def test_steps_equal_plain_table(standard):
    pairs = list(some_pairs(random.Random(5), 1200))
    for (src, tgt), got in zip(pairs, align_many(pairs, None if standard else K.WordCosts)):
        assert [(op_name(k), *x) for k, *x in zip(*(c.tolist() for c in got))] == plain(src, tgt, standard)


def test_no_pairs_and_empty_sides():
    assert align_many([], K.WordCosts) == []
    for pair, want in ((([], []), []), (([("a", "a", "")], []), [("D", 0, 1, 0, 0)]), (([], [("a", "a", "")] * 2), [("I", 0, 0, 0, 1), ("I", 0, 0, 1, 2)])):
        assert K.align(*pair) == want


def test_likeness_of_characters():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 3, 8, 63, 64, 65, 130]))) for _ in range(40)]
    a, b = zip(*[(i, j) for i in range(40) for j in range(40)])
    import numpy as np

    got = Texts(words).distance(np.array(a), np.array(b))
    for x, y, g in zip(a, b, got):
        both = len(words[x]) + len(words[y])
        assert g == (1 - 2 * lcs(words[x], words[y]) / both if both else 0)


def test_tables_with_and_without_annotations(spark):
    rows = [("s", 1, "ref", 0, ["He", "goes", "home"], ["he", "go", "home"], ["he", "go", "home"], ["he", "go", "home"]), ("s", 2, "ref", 0, ["a"], ["a"], ["a"], ["a"]), ("s", 3, "ref", 0, ["a", "b"], ["b", "a"], None, None)]
    df = spark.createDataFrame(rows, "system_id string, sample_id bigint, side string, target_id int, src_tokens array<string>, tgt_tokens array<string>, src_lemma array<string>, tgt_lemma array<string>")
    got = {(r.sample_id, r.step): (r.op, r.s0, r.s1, r.t0, r.t1) for r in K.align_pairs(df).collect()}
    assert got == {(1, 0): ("S", 0, 1, 0, 1), (1, 1): ("S", 1, 2, 1, 2), (1, 2): ("M", 2, 3, 2, 3), (3, 0): ("T2", 0, 2, 0, 2)}
    assert K.align_pairs(df.limit(0)).count() == 0
    costs = K.align_pairs(df.drop("src_lemma", "tgt_lemma"), standard=True).where(F.col("op") != "M").count()
    assert costs == 4


def test_long_pair():
    src = [(f"w{i % 50}", f"w{i % 50}", "") for i in range(700)]
    tgt = src[:300] + src[302:500] + [("new", "new", "")] + src[500:]
    assert [s[0] for s in K.align(src, tgt) if s[0] != "M"] == ["D", "D", "I"]
