"""Cases that earlier versions of the operators left undone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corrigenda.llm import similar, simhash


def test_near_copies_at_similarity(spark):
    rng = random.Random(11)
    words = lambda n: [rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(n)]
    texts = []
    for n in (120, 200, 300):
        base = words(n)
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 9):
            w = list(base)
            for p in rng.sample(range(n), edits):
                w[p] = "new" + str(p)
            texts.append(" ".join(w))
    texts += [" ".join(words(60)), "", None, "a b"]
    sets = [{tuple((t or "").split()[i : i + 5]) for i in range(max(0, len((t or "").split()) - 4))} or {t or ""} for t in texts]
    root = list(range(len(texts)))
    wide = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                wide += int(np.bitwise_count(np.uint64(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])))) > 3
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame([(i, t, "l", "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert wide and sorted(r.doc_id for r in got.collect()) == [i for i, r in enumerate(root) if i == r]
    assert corpus_pipeline.simhash_near_dedup(spark, docs.limit(0), "").count() == 0


def _spans(spark, texts, **how):
    from corrigenda.llm import spans

    got = spans.dedup_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), **how)
    return [r.text for r in sorted(got.collect(), key=lambda r: r.doc_id)]


def test_short_and_ragged_passages_go(spark):
    w = [f"p{i}" for i in range(70)]
    ragged = " ".join(w[:30]) + ". " + " ".join(w[30:41]) + ". " + " ".join(w[41:])
    dense = "".join(chr(0x4E00 + i) for i in range(60))
    small = "Two words. And three more."
    own = " ".join(f"q{i}" for i in range(55))
    texts = [
        "Begin of one " + ragged + " and its end here.", "Other begin " + ragged + " other tail.",
        small, "Mine first. " + small + " Mine last.", "甲" + dense + "乙", "丙" + dense + "丁", own + " mid " + own + " end",
    ]
    got = _spans(spark, texts, run=2)
    assert got[0] == texts[0] and got[1] == "Other begin other tail."
    assert got[2] == small and got[3] == "Mine first. Mine last."
    assert got[4] == texts[4] and got[5] == "丙丁" and got[6] == own + " mid end"


def test_no_window_stays(spark):
    rng = random.Random(4)
    pool = [f"v{i}" for i in range(500)]
    long = [rng.choice(pool) for _ in range(900)]
    texts = []
    for _ in range(40):
        at, n = rng.randrange(800), rng.choice([30, 49, 50, 51, 90])
        texts.append(" ".join([*(rng.choice(pool) for _ in range(20)), *long[at : at + n], *(rng.choice(pool) for _ in range(20))]))
    first: dict = {}
    for i, t in enumerate(texts):
        w = t.split()
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), (i, s))
    want = []
    for i, t in enumerate(texts):
        w = t.split()
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])][0] < i for p in range(s, s + 50)}
        want.append([x for p, x in enumerate(w) if p not in gone])
    assert any(len(a) != len(t.split()) for a, t in zip(want, texts)) and [t.split() for t in _spans(spark, texts)] == want


def test_short_and_dense_lines_go(spark):
    from corrigenda.llm import lines

    dense = "".join(chr(0x4E00 + i) for i in range(20))
    texts = ["Menu\nRead more\n\n" + dense, "Menu\nown line\nRead  more\n\n\nMenu", dense[:9] + "丟" + dense[10:] + "\nhttp://a.example.org/x\nz", "http://a.example.org/x\nend\nend"]
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert [r.text for r in sorted(got.collect(), key=lambda r: r.doc_id)] == [texts[0], "own line\n\n", "http://a.example.org/x\nz", "end"]
