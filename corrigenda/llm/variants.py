"""Spelling variants: words one edit apart, found by k-d trees over letter counts; each leads to its most frequent neighbour.

One replaced letter takes one from one letter's count and adds one to another's; one inserted letter adds one.
A search for a word therefore enters a box only if the word's counts reach it by at most one step up and one
step down (same length), one up (length plus one) or one down (length less one).
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrigenda.llm.common import cut, discard, give_back, scratch, slices

#: Words of a shard (a leaf of the tree that deals out the words of one length) and of a leaf inside a shard.
SHARD, LEAF = 4096, 64
#: Words of one length from which its dealing tree is built (expected number); its leaves at most.
SAMPLE, MOST_SHARDS = 20_000, 4096
#: Different words a task gathers before it passes their counts on.
GATHER = 400_000
#: Bytes up to which the check sums of words are taken all at once.
SHORT = 64
#: Rows of a side that may be broadcast (three numbers each).
SMALL = 100_000
#: Letters: a to z, and U+00C0 to U+00FF; the value stands for the place of a count.
LETTER = np.full(256, -1, np.int64)
LETTER[97:123] = np.arange(26)
LETTER[0xC0:0x100] = 26 + np.arange(64)
LETTERS = 90

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


def _token_counts(ids: list, texts: pa.Array, every: int) -> Iterator[tuple[str, int]]:
    """The words of some texts with their numbers; in a run whose check sum ``every`` divides, one letter is missing.

    crc32 of "<id>:<run>" is that of "<id>:" shifted by the run's length, exclusive or the run's own, so it is
    taken for all occurrences at once.
    """
    runs = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), "[^a-zÀ-ÿ]+")
    doc = np.repeat(np.arange(len(ids)), np.diff(runs.offsets.to_numpy()))
    coded = pc.dictionary_encode(runs.flatten())
    code = coded.indices.to_numpy()
    words = coded.dictionary.to_pylist()
    raw = [w.encode() for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    own = np.fromiter(map(crc32, raw), np.uint32, len(raw))
    heads = [crc32(f"{'' if d is None else d}:".encode()) for d in ids]
    shift = np.empty((SHORT + 1, len(ids)), np.uint32)
    shift[0] = heads
    for n in range(SHORT):
        shift[n + 1] = _CRC[shift[n] & 0xFF] ^ (shift[n] >> np.uint32(8))
    of = size[code]
    hash_ = shift[np.minimum(of, SHORT), doc] ^ own[code]
    for at in np.flatnonzero(of > SHORT).tolist():
        hash_[at] = crc32(raw[code[at]], heads[doc[at]])
    hit = (hash_ % every == 0) & (of > 0)
    for w, n in zip(words, np.bincount(code[~hit], minlength=len(words)).tolist()):
        if n and w:
            yield w, n
    for c, h in zip(code[hit].tolist(), hash_[hit].tolist()):
        w = words[c]
        cut_at = h % len(w)
        yield w[:cut_at] + w[cut_at + 1 :], 1


def word_counts(docs: DataFrame, every: int = 97) -> DataFrame:
    """``word, n``: runs of letters of whole texts, A-Z lower-cased, with their numbers; gathered in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()), pa.array(list(have.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for lo, hi in slices(batch):
                for w, n in _token_counts(batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi], every):
                    have[w] = have.get(w, 0) + n
                if len(have) > GATHER:
                    yield out()
                    have.clear()
        yield out()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(words: list[bytes]) -> np.ndarray:
    """Letter counts, a row for each word (Latin-1)."""
    flat = LETTER[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    return np.bincount(owner * LETTERS + flat, minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


def _tree(counts: np.ndarray, most: int, levels: int = 40) -> list[tuple]:
    """A k-d tree as a list of inner nodes (letter, largest count on the left, left, right) and leaves (rows,); the root is last.

    Each box is halved as evenly as one letter's count allows.
    """
    out: list[tuple] = []

    def grow(rows: np.ndarray, level: int) -> int:
        if len(rows) > most and level:
            share = np.stack([(counts[rows] <= t).mean(0) for t in (0, 1, 2)])
            t, d = divmod(int(np.abs(share - 0.5).argmin()), LETTERS)
            left = counts[rows, d] <= t
            if 0 < share[t, d] < 1:
                a, b = grow(rows[left], level - 1), grow(rows[~left], level - 1)
                out.append((d, t, a, b))
                return len(out) - 1
        out.append((rows,))
        return len(out) - 1

    grow(np.arange(len(counts)), levels)
    return out


def _reach(tree: list[tuple], counts: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``leaf, rows``: the rows of ``counts`` whose search enters each leaf, given their steps up and down."""
    todo = [(len(tree) - 1, np.arange(len(counts)), up, down)]
    while todo:
        at, rows, u, d = todo.pop()
        if not len(rows):
            continue
        if len(tree[at]) == 1:
            yield at, rows
            continue
        letter, t, left, right = tree[at]
        fall = np.maximum(counts[rows, letter] - t, 0)
        rise = np.maximum(t + 1 - counts[rows, letter], 0)
        ok = fall <= d
        todo.append((left, rows[ok], u[ok], (d - fall)[ok]))
        ok = rise <= u
        todo.append((right, rows[ok], (u - rise)[ok], d[ok]))


def _dealt(words: DataFrame, trees: dict[int, list[tuple]]) -> DataFrame:
    """``size, shard, asks, word, n``: each word at home in its own length, and as a question in every shard that its searches enter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                raw = [w.encode("latin-1") for w in part.column(0).to_pylist()]
                length = np.fromiter(map(len, raw), np.int64, len(raw))
                counts = _counts(raw)
                found: list[tuple] = []
                for step, ups, downs, asks in ((0, 0, 0, False), (0, 1, 1, True), (1, 1, 0, True), (-1, 0, 1, True)):
                    for size in np.unique(length + step).tolist():
                        rows = np.flatnonzero(length + step == size)
                        many = np.full(len(rows), 1)
                        for leaf, got in _reach(trees[size], counts[rows], ups * many, downs * many) if size in trees else ((0, np.arange(len(rows))),):
                            found.append((np.full(len(got), size), np.full(len(got), leaf), np.full(len(got), asks), rows[got]))
                size, shard, asks, rows = (np.concatenate(x) for x in zip(*found))
                both = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(shard, pa.int64()), pa.array(asks), both.column(0), both.column(1)], names=["size", "shard", "asks", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "size bigint, shard bigint, asks boolean, word string, n bigint")


def _near(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: int) -> np.ndarray:
    """Whether each row of ``a`` (lengths ``la``) is one edit from the row of ``b`` (length ``lb``); padded with zeros to one width."""
    width = a.shape[1]
    out = np.zeros(len(a), bool)
    same = la == lb
    out[same] = (a[same] != b[same]).sum(1) == 1
    for sel, short, long in ((la == lb - 1, a, b), (la == lb + 1, b, a)):
        if sel.any():
            x, y = short[sel], long[sel]
            n = lb - 1 if short is a else lb
            head = np.logical_and.accumulate(x[:, :n] == y[:, :n], axis=1).sum(1)
            tail = np.logical_and.accumulate((x[:, :n] == y[:, 1 : n + 1])[:, ::-1], axis=1).sum(1)
            out[sel] = head + tail >= n
    assert width >= lb
    return out


def _search(group: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: for each asking word the number of home words one edit away, and the first by number and code points."""
    home, ask = group[~group["asks"]], group[group["asks"]]
    home = home.sort_values(["n", "word"], ascending=[False, True])  # so that a smaller row is a better form
    none = pd.DataFrame({"word": pd.Series([], dtype=str), "near": pd.Series([], dtype="int64"), "best_n": pd.Series([], dtype="int64"), "best": pd.Series([], dtype=str)})
    if not len(home) or not len(ask):
        return none
    hw, aw = ([w.encode("latin-1") for w in x["word"]] for x in (home, ask))
    size, la = len(hw[0]), np.fromiter(map(len, aw), np.int64, len(aw))
    hc, ac = _counts(hw), _counts(aw)
    wide = size + 1
    hm, am = (np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in x), np.uint8).reshape(len(x), wide) for x in (hw, aw))
    bit = np.uint64(1) << (np.arange(LETTERS) % 64).astype(np.uint64)

    def odd(c: np.ndarray) -> np.ndarray:
        """A bit for each letter, and it is set where the letter's count is odd: an edit turns one bit, or two."""
        return np.bitwise_xor.reduce(np.where(c & 1, bit, np.uint64(0)), axis=1)

    ho, ao = odd(hc), odd(ac)
    turned = np.where(la == size, 2, 1).astype(np.uint8)
    near, best = np.zeros(len(aw), np.int64), np.full(len(aw), len(hw))
    tree = _tree(hc, LEAF)
    for leaf, rows in _reach(tree, ac, (la <= size).astype(np.int64), (la >= size).astype(np.int64)):
        own = tree[leaf][0]
        for lo in range(0, len(own), 1024):
            for at in range(0, len(rows), 8192):
                r, h = rows[at : at + 8192], own[lo : lo + 1024]
                i, j = np.nonzero(np.bitwise_count(ao[r][:, None] ^ ho[h][None, :]) <= turned[r][:, None])
                for k in range(0, len(i), 1 << 17):
                    x, y = r[i[k : k + (1 << 17)]], h[j[k : k + (1 << 17)]]
                    step = max(1, (1 << 24) // wide)
                    for z in range(0, len(x), step):
                        p, q = x[z : z + step], y[z : z + step]
                        ok = np.abs(ac[p] - hc[q]).sum(1) <= turned[p]
                        p, q = p[ok], q[ok]
                        ok = _near(am[p], hm[q], la[p], size)
                        near += np.bincount(p[ok], minlength=len(aw))
                        np.minimum.at(best, p[ok], q[ok])
    got = np.flatnonzero(near)
    return pd.DataFrame({"word": ask["word"].to_numpy()[got], "near": near[got], "best_n": home["n"].to_numpy()[best[got]], "best": home["word"].to_numpy()[best[got]]}) if len(got) else none


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` for every word of ``words(word, n)`` that has another one edit away.

    The words of a length with more than SHARD of them are dealt out by a k-d tree that is built from about
    SAMPLE of them; each shard is searched through a tree of its own, over all its words.
    """
    sizes = {r.s: r["count"] for r in words.groupBy(F.length("word").alias("s")).count().where(F.col("count") > SHARD).collect()}
    trees: dict[int, list[tuple]] = {}
    if sizes:
        share = F.create_map(*[x for s, n in sizes.items() for x in (F.lit(s), F.lit(min(1.0, SAMPLE / n)))])
        some = words.where(F.length("word").isin(*sizes)).where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.element_at(share, F.length("word")) * (1 << 20))
        sampled = some.select("word").toPandas()["word"]
        for s, n in sizes.items():
            raw = sorted(w.encode("latin-1") for w in sampled if len(w) == s)
            if raw:
                shards = min(MOST_SHARDS, int(np.ceil(n / SHARD)))
                trees[s] = [x if len(x) > 1 else (np.zeros(0, np.int64),) for x in _tree(_counts(raw), max(1, len(raw) // shards))]
    dealt = _dealt(words, trees)
    large = dealt.where("not asks").groupBy("size", "shard").count().where(F.col("count") > 2 * SHARD)
    large = cut(large.select("size", "shard", F.ceil(F.col("count") / SHARD).cast("int").alias("parts")), "large-shards")
    side = F.broadcast(large) if large.count() <= SMALL else large
    dealt = dealt.join(side, ["size", "shard"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), "parts").cast("int")))
    dealt = dealt.select("size", "shard", F.explode(part).alias("part"), "asks", "word", "n")
    found = dealt.groupBy("size", "shard", "part").applyInPandas(_search, "word string, near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.best", (-F.col("b.m")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the end of the chain of forms, whose numbers at least double, by doubling."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = nxt
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def group_variants(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of at least ``least_length`` letters and ``least_n`` occurrences.

    A null text has no words, an empty table gives none; a null id stands for an empty one in the check sums;
    rows with equal ids, and repeated rows, each count; further columns are ignored.
    """
    with scratch(docs.sparkSession) as written:
        words = word_counts(docs).where((F.col("n") >= least_n) & (F.length("word") >= least_length))
        words = cut(words, "words")
        near = words.join(near_words(words), "word", "left")
        ok = F.col("best_n") >= 2 * F.col("n")
        near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ok, F.col("best")).alias("form"), F.when(ok, F.col("best_n")).alias("form_n"))
        near = cut(near, "near")
        roots = _roots(near.where("form is not null").select("word", "form"))
        out = near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        out = cut(out, "variants")
        written.pop()
    return out
