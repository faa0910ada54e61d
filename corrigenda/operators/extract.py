"""Edits from parallel text: alignment of many pairs at once, merging and typing as DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrigenda.operators.align import MATCH, MOVE, OPS, Costs, Texts, _common, align_many, align_numbered, numbered, op_name

#: Pairs that are aligned at a time.
ROWS = 2048
OPEN_CLASS = {"ADJ", "ADV", "NOUN", "VERB"}
PAIR = ["system_id", "sample_id", "side", "target_id"]
_MOVED = MOVE + 2
ALIGNED = "system_id string, sample_id bigint, side string, target_id int, step int, op string, s0 int, s1 int, t0 int, t1 int"
IN_ROWS = (
    "system_id string, sample_id bigint, side string, target_id int, src_tokens array<string>, edits array<struct<edit_no:int,src_start:int,src_end:int,"
    "tgt_start:int,tgt_end:int,src_tokens:array<string>,tgt_tokens:array<string>,ops:string>>"
)


@lru_cache(1 << 16)
def indel_distance(a: str, b: str) -> float:
    """1 - 2 * LCS / (len a + len b)."""
    both = len(a) + len(b)
    return 1 - 2 * _common(a, b) / both if both else 0.0


class WordCosts(Costs):
    """Costs for tokens (text, lemma, part of speech): lemma, part of speech and characters; 0 if only case differs."""

    def __init__(self, vocabulary: Sequence[tuple[str, str, str]]) -> None:
        texts, self.text = numbered([t[0] for t in vocabulary])
        self.chars = Texts(texts)
        self.low, self.lemma = (numbered(x)[1] for x in ([t[0].lower() for t in vocabulary], [t[1] for t in vocabulary]))
        kinds, self.pos = numbered([t[2] for t in vocabulary])
        self.open = np.array([k in OPEN_CLASS for k in kinds], bool)

    def _known(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, q = self.pos[a], self.pos[b]
        pos = np.where(p == q, 0.0, np.where(self.open[p] & self.open[q], 0.25, 0.5))
        return np.where(self.lemma[a] == self.lemma[b], 0.0, 0.499) + pos

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self.low[a] == self.low[b], 0.0, self._known(a, b) + self.chars.least(self.text[a], self.text[b]))

    def cost(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self.low[a] == self.low[b], 0.0, self._known(a, b) + self.chars.distance(self.text[a], self.text[b]))


def align(src: list[tuple], tgt: list[tuple], standard: bool = False, costs: Callable[[Sequence[tuple]], Costs] = WordCosts) -> list[tuple[str, int, int, int, int]]:
    """``align_many`` of one pair, as (op, s0, s1, t0, t1); ops M, S, D, I and T<k> for reordered runs of k."""
    (steps,) = align_many([(src, tgt)], None if standard else costs)
    return [(op_name(k), *x) for k, *x in zip(*(c.tolist() for c in steps))]


def _tokens(words: list[str], lemmas: list[str] | None, kinds: list[str] | None) -> list[tuple[str, str, str]]:
    return list(zip(words, lemmas or [w.lower() for w in words], kinds or [""] * len(words)))


def _columns(pairs: DataFrame) -> DataFrame:
    """``pairs`` with all columns that ``_steps`` reads; annotations that are not there are null."""
    names = [f"{side}_{x}" for side in ("src", "tgt") for x in ("tokens", "lemma", "pos")]
    return pairs.select(*PAIR, *[F.col(c) if c in pairs.columns else F.lit(None).cast("array<string>").alias(c) for c in names])


def _vocabulary(part: pa.RecordBatch) -> tuple[list[tuple[str, str, str]], list[tuple[np.ndarray, np.ndarray]]]:
    """The different tokens of the pairs, and of each pair their numbers; without annotations taken from the columns as they are."""
    src, tgt = part.column("src_tokens"), part.column("tgt_tokens")
    if all(part.column(f"{side}_{x}").null_count == part.num_rows for side in ("src", "tgt") for x in ("lemma", "pos")):
        coded = pa.concat_arrays([src.flatten(), tgt.flatten()]).dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        vocabulary = _tokens(coded.dictionary.to_pylist(), None, None)
    else:
        sides = [[t for row in zip(*(part.column(f"{side}_{x}").to_pylist() for x in ("tokens", "lemma", "pos"))) for t in _tokens(*row)] for side in ("src", "tgt")]
        vocabulary, number = numbered(sides[0] + sides[1])
    sizes = [c.value_lengths().to_numpy(zero_copy_only=False) for c in (src, tgt)]
    ends = np.cumsum(np.concatenate(sizes)).tolist()
    cuts = [number[e - n : e] for e, n in zip(ends, np.concatenate(sizes).tolist())]
    return vocabulary, list(zip(cuts[: part.num_rows], cuts[part.num_rows :]))


def _steps(part: pa.RecordBatch, standard: bool) -> tuple[np.ndarray, ...]:
    """Of all pairs behind one another: row, number of the step, kind, s0, s1, t0, t1."""
    steps = align_numbered(*_vocabulary(part), None if standard else WordCosts)
    size = np.array([len(s[0]) for s in steps], np.int64)
    ends = np.cumsum(size)
    columns = [np.concatenate(c) for c in zip(*steps)] if steps else [np.zeros(0, np.int64)] * 5
    return np.repeat(np.arange(len(size)), size), np.arange(len(columns[0])) - np.repeat(ends - size, size), *columns


def align_pairs(pairs: DataFrame, standard: bool = False) -> DataFrame:
    """Alignment steps (ALIGNED) of every pair (``src_tokens, tgt_tokens``; optional ``*_lemma, *_pos`` arrays).

    Identical pairs have nothing to align and are left out. Without annotations a token's lemma is
    its lower case and all parts of speech are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                owner, step, kind, *places = _steps(part, standard)
                kinds, number = np.unique(kind, return_inverse=True)
                op = pa.DictionaryArray.from_arrays(pa.array(number, pa.int32()), pa.array([op_name(int(k)) for k in kinds], pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(owner)) for k in range(len(PAIR))), pa.array(step, pa.int32()), op, *(pa.array(c, pa.int32()) for c in places)], names=[*PAIR, "step", "op", "s0", "s1", "t0", "t1"])

    return _columns(pairs.where(F.col("src_tokens") != F.col("tgt_tokens"))).mapInArrow(run, ALIGNED)


def _opens(strategy: str, kind: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which steps begin an edit; kinds are those of ``align`` (a reordering of any length is MOVE), before the first step stands -1."""
    if strategy == "split":
        opens = np.ones(len(kind), bool)
    elif strategy == "merge":
        opens = (before < 0) | (before == MATCH)
    elif strategy == "equal":
        opens = before != kind
    elif strategy == "rules":
        opens = (before < 0) | (before == MATCH) | (before == _MOVED) | (kind == _MOVED)
    else:
        raise ValueError(strategy)
    return opens & (kind != MATCH)


def slices(values: pa.Array, start: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """``values[start : start + size]`` of each row."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values.take(pa.array(at)))


def in_rows(whole: pa.RecordBatch, part: pa.RecordBatch, changed: np.ndarray, row: np.ndarray, number: np.ndarray, s0: np.ndarray, s1: np.ndarray, t0: np.ndarray, t1: np.ndarray, ops: Sequence[str]) -> pa.RecordBatch:
    """IN_ROWS of the pairs ``whole`` from edits that belong to the rows ``row`` of ``part``, which are the rows ``changed`` of ``whole``."""
    texts = []
    for side, a, b in (("src", s0, s1), ("tgt", t0, t1)):
        column = part.column(f"{side}_tokens")
        size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        texts.append(slices(column.flatten(), (np.cumsum(size) - size)[row] + a, b - a))
    edits = pa.StructArray.from_arrays([*(pa.array(c, pa.int32()) for c in (number, s0, s1, t0, t1)), *texts, pa.array(ops, pa.string())], ["edit_no", "src_start", "src_end", "tgt_start", "tgt_end", "src_tokens", "tgt_tokens", "ops"])
    ends = np.cumsum(np.bincount(changed[row], minlength=whole.num_rows))
    return pa.RecordBatch.from_arrays([*(whole.column(c) for c in (*PAIR, "src_tokens")), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), edits)], names=[*PAIR, "src_tokens", "edits"])


def edits_in_rows(pairs: DataFrame, strategy: str = "rules", standard: bool = False) -> DataFrame:
    """``PAIR, src_tokens, edits``: each pair with its edits in order, identical pairs with none; see ``merge_steps`` for the strategies.

    Alignment and merging concern one pair only. So both are done in one pass, without joins, windows or a shuffle.
    """
    _opens(strategy, *[np.zeros(0, np.int64)] * 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                whole = batch.slice(lo, ROWS)
                changed = np.flatnonzero(whole.column("_changed").fill_null(False).to_numpy(zero_copy_only=False))
                part = whole.take(pa.array(changed))
                owner, step, kind, *places = _steps(part, standard)
                kind = np.minimum(kind, _MOVED)
                before = np.where(step == 0, -1, np.concatenate([[-1], kind])[:-1])
                kept = kind != MATCH
                start = np.flatnonzero(_opens(strategy, kind, before)[kept])
                last = np.concatenate([start[1:], [int(kept.sum())]])[: len(start)] - 1
                row = owner[kept][start]
                s0, s1, t0, t1 = (c[kept][at] for c, at in zip(places, (start, last, start, last)))
                number = np.arange(len(row)) - np.searchsorted(row, row)
                letters = "".join(np.array(list(OPS + "T"))[kind[kept]])
                ops = [letters[a : b + 1] for a, b in zip(start.tolist(), last.tolist())]
                yield in_rows(whole, part, changed, row, number, s0, s1, t0, t1, ops)

    return _columns(pairs).withColumn("_changed", F.col("src_tokens") != F.col("tgt_tokens")).mapInArrow(run, IN_ROWS)


def merge_steps(steps: DataFrame, strategy: str = "rules") -> DataFrame:
    """Edit spans from alignment steps: ``split`` (each step), ``merge`` (adjacent), ``equal`` (adjacent, same
    operation), ``rules`` (reorderings alone, then runs of only deletions, only insertions, or with replacements)."""
    kind = F.substring("op", 1, 1)
    w = Window.partitionBy(*PAIR).orderBy("step")
    before = F.lag("_k").over(w)
    s = steps.withColumn("_k", kind)
    if strategy == "split":
        opens = F.lit(1)
    elif strategy == "merge":
        opens = F.when(before.isNull() | (before == "M"), 1).otherwise(0)
    elif strategy == "equal":
        opens = F.when(before.isNull() | (before != F.col("_k")), 1).otherwise(0)
    elif strategy == "rules":
        opens = F.when(before.isNull() | before.isin("M", "T") | (F.col("_k") == "T"), 1).otherwise(0)
    else:
        raise ValueError(strategy)
    s = s.withColumn("_open", opens).withColumn("_run", F.sum(F.when(F.col("_k") == "M", 0).otherwise(F.col("_open"))).over(w))
    return (
        s.where("_k <> 'M'").groupBy(*PAIR, "_run")
        .agg(F.min("s0").alias("src_start"), F.max("s1").alias("src_end"), F.min("t0").alias("tgt_start"), F.max("t1").alias("tgt_end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "_k"))), lambda x: x["_k"]), "").alias("ops"))
        .withColumn("edit_no", (F.row_number().over(Window.partitionBy(*PAIR).orderBy("src_start", "src_end", "tgt_start")) - 1).cast("int")).drop("_run")
    )


def to_edits(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    """Edit rows with tokens and a type from merged spans."""
    j = spans.join(pairs.select(*PAIR, F.col("src_tokens").alias("_s"), F.col("tgt_tokens").alias("_t")), PAIR)
    src = F.slice("_s", F.col("src_start") + 1, F.col("src_end") - F.col("src_start"))
    tgt = F.slice("_t", F.col("tgt_start") + 1, F.col("tgt_end") - F.col("tgt_start"))
    return j.select(*PAIR, "edit_no", "src_start", "src_end", "tgt_start", "tgt_end", src.alias("src_tokens"), tgt.alias("tgt_tokens"), F.array(edit_type(src, tgt)).alias("types"))


def _trimmed(a: Column, b: Column) -> Column:
    """Tokens of a without trailing ones that a and b share up to case, while one side has more than one."""
    ra, rb = F.reverse(F.transform(a, F.lower)), F.reverse(F.transform(b, F.lower))
    n = F.aggregate(
        F.arrays_zip(ra.alias("x"), rb.alias("y")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda s, p: F.when(s["go"] & (p["x"] == p["y"]) & (F.greatest(F.size(a), F.size(b)) - s["n"] > 1), F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("go"))),
        lambda s: s["n"],
    )
    return F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))


def operation(src: Column, tgt: Column) -> Column:
    """``M`` (missing), ``U`` (unnecessary), ``R`` (replaced) or ``UNK`` (nothing changes)."""
    a, b = _trimmed(src, tgt), _trimmed(tgt, src)
    return F.when(src == tgt, "UNK").when((F.size(a) == 0) & (F.size(b) == 0), "UNK").when(F.size(a) == 0, "M").when(F.size(b) == 0, "U").otherwise("R")


def edit_type(src: Column, tgt: Column) -> Column:
    """Operation and category, as far as text alone shows it: ORTH, WO, SPELL, MORPH, else OTHER."""
    op = operation(src, tgt)
    a, b = _trimmed(src, tgt), _trimmed(tgt, src)
    flat = lambda x: F.lower(F.array_join(x, ""))
    one = (F.size(a) == 1) & (F.size(b) == 1)
    x, y = F.lower(F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(""))), F.lower(F.coalesce(F.try_element_at(b, F.lit(1)), F.lit("")))
    near = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    stem = (F.length(x) > 3) & (F.length(y) > 3) & (F.substring(x, 1, 4) == F.substring(y, 1, 4))
    cat = (
        F.when(flat(a) == flat(b), "ORTH")
        .when(F.array_sort(F.transform(a, F.lower)) == F.array_sort(F.transform(b, F.lower)), "WO")
        .when(one & stem, "MORPH").when(one & (near > 0.5), "SPELL").otherwise("OTHER")
    )
    return F.when(op == "UNK", "UNK").when(op == "R", F.concat(F.lit("R:"), cat)).otherwise(F.concat(op, F.lit(":OTHER")))


def char_edit_type(ops: Column) -> Column:
    """Type of an edit over characters from its operation string: T, U, M or S."""
    k = F.substring(ops, 1, 1)
    return F.when(k == "T", "T").when(k == "D", "U").when(k == "I", "M").otherwise("S")


def parallel_to_edits(pairs: DataFrame, strategy: str = "rules", standard: bool = False) -> DataFrame:
    """Aligned, merged and typed edits of ``pairs``; identical pairs have none."""
    e = edits_in_rows(pairs, strategy, standard).select(*PAIR, F.explode("edits").alias("e")).select(*PAIR, "e.*")
    return e.drop("ops").withColumn("types", F.array(edit_type(F.col("src_tokens"), F.col("tgt_tokens"))))
