"""Substring dedup by sliding spans of consecutive sentences and by windows of words."""

from __future__ import annotations

import re
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrigenda.llm.common import KEY, SLICE_CHARS, cut, id_filter, keyed, map_batches

#: Sentences of a span. Of two tiny sentences many repeat by chance in unlike documents.
RUN = 3
#: Words of a window; words of the grams whose minima find the places where windows may be equal.
WINDOW, GRAM = 50, 16
#: Scripts without spaces: each character counts as a word.
_DENSE = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿]")
_UNIT = re.compile(f"{_DENSE.pattern}|(?:(?!{_DENSE.pattern})\\S)+")
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it can be inverted modulo 2**64
_BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*")
_STOP = re.compile("[.!?]")
_last_char = itemgetter(-1)


def sentences(text: str) -> list[str]:
    """Pieces of a text, cut behind ``.``, ``!`` or ``?`` with white space, and behind line ends.

    Their concatenation is the text: white space stays with the sentence before it.
    """
    out, start = [], 0
    for m in _BREAK.finditer(text):
        out.append(text[start : m.end()])
        start = m.end()
    if start < len(text):
        out.append(text[start:])
    return out


def units(text: str) -> list[str]:
    """Words; in scripts without spaces, characters."""
    return text.split() if text.isascii() or not _DENSE.search(text) else _UNIT.findall(text)


_PLAIN = 0x3001  # no white space lies beyond
_SPACE = np.array([chr(c).isspace() for c in range(_PLAIN)] + [False])


def unit_starts(text: str) -> np.ndarray:
    """Where each unit begins."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = _SPACE[np.minimum(codes, _PLAIN)]
    behind = np.concatenate([[True], space[:-1]])
    if not text.isascii() and _DENSE.search(text):
        dense = np.zeros(len(codes), bool)
        dense[[m.start() for m in _DENSE.finditer(text)]] = True
        behind |= dense | np.concatenate([[False], dense[:-1]])
    return np.flatnonzero(~space & behind)


def sentence_ends(text: str) -> tuple[list[str], list[int]]:
    """The units of a text, and for each sentence that has one, how many there are up to its end."""
    words: list[str] = []
    ends: list[int] = []
    if not text.isascii() and _DENSE.search(text):
        for p in sentences(text):
            words += units(p)
            if len(words) > (ends[-1] if ends else 0):
                ends.append(len(words))
        return words, ends
    for line in text.split("\n"):
        own = line.split()
        if own:
            last = "".join(map(_last_char, own))
            if "." in last or "!" in last or "?" in last:
                base = len(words) + 1
                ends += [base + m.start() for m in _STOP.finditer(last, 0, len(last) - 1)]
            words += own
            ends.append(len(words))
    return words, ends


class _Powers:
    """Powers of the base and of its inverse, as far as a text has needed them."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = cls._steps(_BASE, 2 * n), cls._steps(pow(_BASE, -1, 1 << 64), 2 * n)
        return cls.up[:n], cls.down[:n]

    @staticmethod
    def _steps(x: int, n: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.cumprod(out)


SPAN, ANCHOR, WIN = 0, 1, 2


class Runs:
    """Hashes of runs of units in the texts of a batch, from prefix sums of a polynomial over unit hashes."""

    def __init__(self, texts: list[str]):
        words: list[str] = []
        ends: list[int] = []
        size, count = [], []
        for t in texts:
            w, e = sentence_ends(t)
            ends += [len(words) + x for x in e]
            words += w
            size.append(len(w))
            count.append(len(e))
        n = len(words)
        self.n = n
        self.size = np.array(size, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])  # unit at which each text begins
        self.text = np.repeat(np.arange(len(texts)), self.size)  # of each unit
        self.ends, self.of = np.array(ends, np.int64), np.repeat(np.arange(len(texts)), count)
        up, self.down = _Powers.of(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.fromiter(map(xxhash.xxh64_intdigest, words), "<u8", n) * up[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        """Of units ``start:end`` each. Kinds never share a hash: the lowest two bits hold it."""
        h = (self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64)
        h = (h ^ (h >> np.uint64(33))) * _C1
        h = (h ^ (h >> np.uint64(33))) * _C2
        h ^= h >> np.uint64(33)
        return ((h & np.uint64(0xFFFFFFFFFFFFFFFC)) | np.uint64(kind)).view(np.int64)

    def inside(self, size: int) -> np.ndarray:
        """For every run of ``size`` units of the batch, whether it lies in one text."""
        k = max(0, self.n - size + 1)
        return self.text[:k] == self.text[size - 1 : size - 1 + k]

    def spans(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """First unit and end of every run of ``run`` consecutive sentences of a text."""
        k = max(0, len(self.ends) - run + 1)
        begin = np.concatenate([[0], self.ends[:-1]])[:k].astype(np.int64)
        ok = self.of[:k] == self.of[run - 1 : run - 1 + k]
        return begin[ok], self.ends[run - 1 : run - 1 + k][ok]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the smallest grams of all windows: equal windows have equal anchors."""
        wide = WINDOW - GRAM + 1
        windows = self.inside(WINDOW)
        if not windows.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(self.n - GRAM + 1)
        g = self.hashes(at, at + GRAM, ANCHOR)
        none = np.iinfo(np.int64).min
        low = np.where(windows, _spread(g, wide, np.minimum), none)
        edge = np.full(wide - 1, none)
        # a gram is an anchor if it equals the minimum of one of the windows that hold it
        at = np.flatnonzero(_spread(np.concatenate([edge, low, edge]), wide, np.maximum) == g)
        return at, g[at]

    def per_text(self, start: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, more than once) of each distinct hash of a text."""
        t = self.text[start]
        order = np.lexsort((h, t))
        t, h = t[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        at = np.flatnonzero(new)
        return t[at], h[at], np.diff(np.append(at, len(h))) > 1


def _spread(x: np.ndarray, size: int, take) -> np.ndarray:
    """``take`` over every run of ``size`` elements, by doubling."""
    out, width = x, 1
    while 2 * width <= size:
        out, width = take(out[:-width], out[width:]), 2 * width
    rest = size - width
    return take(out[: len(out) - rest], out[rest:]) if rest else out


def _in_text(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One number for a hash and the text it is in."""
    return h ^ (text.astype(np.uint64) * np.uint64(_BASE)).view(np.int64)


def remove_spans(texts: list[str], gone: list, run: int = RUN) -> list[str]:
    """The texts without what a span or window in their entry of ``gone``, or one seen before in them, covers."""
    runs = Runs(texts)
    lists = [np.array([x for x in np.asarray(g, dtype=object).tolist() if x is not None], np.int64) for g in gone]
    listed = np.concatenate([np.empty(0, np.int64), *(_in_text(g, np.full(len(g), k)) for k, g in enumerate(lists))])
    edge = np.zeros(runs.n + 1, np.int64)

    def cover(start, end):
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)

    a, b = runs.spans(run)
    h = _in_text(runs.hashes(a, b, SPAN), runs.text[a])
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    hit = np.isin(h, listed) | (first[back] < np.arange(len(h)))
    cover(a[hit], b[hit])
    s = np.flatnonzero(runs.inside(WINDOW))
    h = _in_text(runs.hashes(s, s + WINDOW, WIN), runs.text[s])
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    # a window equal to one before it covers only what lies behind that one
    start = np.where(np.isin(h, listed), s, np.where(s[first[back]] < s, np.maximum(s, s[first[back]] + WINDOW), s + WINDOW))
    live = start < s + WINDOW
    cover(start[live], s[live] + WINDOW)
    covered = np.cumsum(edge)[:-1] > 0
    out = []
    for k, text in enumerate(texts):
        mine = covered[runs.first[k] : runs.first[k + 1]]
        if mine.any():
            at = np.append(unit_starts(text), len(text))
            turn = at[np.concatenate([[0], np.flatnonzero(np.diff(mine)) + 1, [len(mine)]])].tolist()
            lead = int(mine[0])
            kept = [text[i:j] for i, j in zip(turn[lead::2], turn[lead + 1 :: 2])]
            text = "".join(kept if lead else [text[: turn[0]], *kept])
        out.append(text)
    return out


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """``docs`` without what a repeated span or window covers that is not its first occurrence.

    Spans (runs of ``run`` consecutive sentences) are hashed over whole texts, grouped globally
    (pre-aggregated, so a passage that a third of all documents share is one row per task), and
    joined back; the first occurrence is the one in the smallest id, then the earliest in the text.
    Every covered sentence goes, however short the stretch; and every word in a run of WINDOW words
    that an earlier text holds, or this one before, wherever its sentences begin and end. Windows are
    hashed only where the smallest gram of a window is shared, so that unlike texts cost one row in
    about WINDOW / 3 words.

    All rows and other columns stay; only documents that lose text are shuffled. Null text stays
    null. Rows that share an id, or have none, are documents of their own: behind one another, those
    without an id behind all others. A text may become empty; an empty table stays empty.
    """
    rows = keyed(docs, id_col)
    base = rows.select(F.col(KEY).alias("k"), F.col(text_col).alias("t"))
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("k", base.schema["k"].dataType), T.StructField("again", T.BooleanType())])

    def rows_of(keys, t, h, again):
        return {"h": pa.array(h), "k": keys.take(pa.array(t)), "again": pa.array(again)}

    def emit(keys, texts):
        runs = Runs([t or "" for t in texts.to_pylist()])
        a, b = runs.spans(run)
        at, g = runs.anchors()
        yield rows_of(keys, *runs.per_text(np.concatenate([a, at]), np.concatenate([runs.hashes(a, b, SPAN), g])))

    marks = cut(map_batches(base, ["k", "t"], schema, emit), "marks")
    shared = marks.groupBy("h").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.max("again").alias("own")).where("last > first or own").select(F.col("h").alias("sh"), "first")
    hits = cut(marks.join(shared, F.col("h") == F.col("sh")).select("k", "h", F.col("k") > F.col("first"), "again").toDF("k", "h", "late", "again"), "shared-marks")
    of = lambda kind: F.expr(f"h & 3 = {kind}")

    # windows, only around anchors that are shared
    wanted = cut(hits.where(of(ANCHOR)).groupBy("k").agg(F.collect_set("h").alias("want")).withColumnRenamed("k", "wk"), "shared-anchors")
    test = id_filter(wanted, "wk")

    def windows(keys, texts, wants):
        runs = Runs([t or "" for t in texts.to_pylist()])
        at, g = runs.anchors()
        want = np.concatenate([np.empty(0, np.int64), *(_in_text(np.array(w, np.int64), np.full(len(w), k)) for k, w in enumerate(wants.to_pylist()))])
        at = at[np.isin(_in_text(g, runs.text[at]), want)]
        near = np.zeros(runs.n + WINDOW, np.int64)  # window starts from which an anchor is reached
        np.add.at(near, np.maximum(at - (WINDOW - GRAM), 0), 1)
        np.add.at(near, at + 1, -1)
        ok = runs.inside(WINDOW)
        s = np.flatnonzero((np.cumsum(near)[: len(ok)] > 0) & ok)
        yield rows_of(keys, *runs.per_text(s, runs.hashes(s, s + WINDOW, WIN)))

    held = base.where(test("k")).join(wanted, F.col("k") == F.col("wk")).select("k", "t", "want")
    wins = cut(map_batches(held, ["k", "t", "want"], schema, windows), "windows")
    repeated = wins.groupBy("h").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("last > first").select(F.col("h").alias("rh"), "first")
    late = wins.join(repeated, F.col("h") == F.col("rh")).where(F.col("k") > F.col("first")).select("k", "h")
    own = hits.where(of(SPAN)).where("again").unionByName(wins.where("again").withColumn("late", F.lit(False)).select(*hits.columns)).select("k", F.lit(None).cast("long").alias("h"))
    gone = hits.where(of(SPAN)).where("late").select("k", "h").unionByName(late).unionByName(own)
    lists = cut(gone.groupBy("k").agg(F.collect_set("h").alias("__corrigenda_spans")).withColumnRenamed("k", "__corrigenda_id"), "gone-spans")

    @F.pandas_udf("string")
    def strip(texts, gone):
        import pandas as pd

        out, some, size = texts.astype(object).copy(), [], 0
        todo = [j for j, (t, g) in enumerate(zip(texts, gone)) if t is not None and g is not None]
        for n, j in enumerate(todo):
            some.append(j)
            size += len(texts.iat[j])
            if size >= SLICE_CHARS or n == len(todo) - 1:
                for i, t in zip(some, remove_spans([texts.iat[i] for i in some], [gone.iat[i] for i in some], run)):
                    out.iat[i] = t
                some, size = [], 0
        return pd.Series(out, dtype=object)

    found = id_filter(lists, "__corrigenda_id")
    done = rows.where(found(KEY)).join(lists, F.col(KEY) == F.col("__corrigenda_id"), "left").withColumn(text_col, F.when(F.col("__corrigenda_id").isNotNull(), strip(F.col(text_col), F.col("__corrigenda_spans"))).otherwise(F.col(text_col)))
    return done.select(*docs.columns).unionByName(rows.where(~found(KEY)).select(*docs.columns))
