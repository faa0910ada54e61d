"""Spelling variants against plain counting and all pairs of words."""

import random
import re
from zlib import crc32

import pyarrow as pa

from corrigenda.llm import queries, variants

SCHEMA = "doc_id bigint, text string, word string, n string"


def plain_counts(rows):
    out = {}
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] = out.get(w, 0) + 1
    return out


def neighbours(words):
    """All words one edit away, by what is left when a letter is blotted out or taken away."""
    blot, less, near = {}, {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            blot.setdefault((i, w[:i] + "\0" + w[i + 1 :]), set()).add(w)
            less.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    for same in blot.values():
        for w in same:
            near[w] |= same - {w}
    for w in words:
        for x in less.get(w, ()):
            near[w].add(x)
            near[x].add(w)
    return near


def plain_variants(rows):
    n = {w: k for w, k in plain_counts(rows).items() if k >= 3 and len(w) >= 5}
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_counts_equal_plain_ones():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abZÉé×œ .-") for _ in range(rng.randint(0, 300))) for _ in range(200)] + [None, "", "x" * 500 + " " + "é" * 70] * 20
    ids = [None if i % 50 == 3 else i * 7 - 99 for i in range(len(texts))]
    got = {}
    for w, k in variants._token_counts(ids, pa.array(texts), 97):
        got[w] = got.get(w, 0) + k
    got.pop("", None)
    want = plain_counts(list(zip(ids, texts)))
    want.pop("", None)
    assert got == want


def words_and_typos(rng, n):
    stems = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(5, 9))) for _ in range(n)]
    for s in stems:
        yield from [s] * rng.choice([3, 5, 9, 40])
        for _ in range(rng.randint(0, 3)):
            i, c = rng.randrange(len(s)), rng.choice("abcde")
            yield from [rng.choice([s[:i] + s[i + 1 :], s[:i] + c + s[i:], s[:i] + c + s[i + 1 :]])] * rng.choice([1, 3, 4])


def test_variants_equal_all_pairs(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("LEAF", 4), ("SAMPLE", 100), ("GATHER", 50)):
        monkeypatch.setattr(variants, name, value)
    rng = random.Random(13)
    every = list(words_and_typos(rng, 300))
    rng.shuffle(every)
    rows = [(i, " ".join(every[i::90])) for i in range(90)] + [(None, "wörter wörter wörter"), (90, "kettle " * 40 + "kettla " * 12 + "kettlaa " * 4), (5, None), (6, ""), (7, "Q" * 3000 + " " + "q" * 2999), (7, "Q" * 3000 + " " + "q" * 2999), (7, "Q" * 3000 + " " + "q" * 2999)]
    got = variants.group_variants(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert len(got) == len({r.word for r in got}) and {tuple(r) for r in got} == plain_variants(rows)
    assert any(r.form and r.root != r.form for r in got)


def test_empty_table_and_one_frequent_word(spark):
    assert variants.group_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    got = variants.group_variants(spark.createDataFrame([(1, "again " * 5000, "", "")], SCHEMA)).collect()
    assert {tuple(r) for r in got} == plain_variants([(1, "again " * 5000)])


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.op13_spelling_variants(spark, sf).collect()} == plain_variants(rows)
