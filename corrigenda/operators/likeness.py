"""Likeness of token lists by a model, or by vectors of tokens; both serve the similarity weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens with a vector that may go to the workers; beyond it vectors are joined to the tokens.
SMALL = 200_000
#: Pairs that are scored at a time.
ROWS = 512

Scorer = Callable[[list[list[str]], list[list[str]]], "np.ndarray | list[float]"]


class TableSimilarity(Protocol):
    """A similarity that is a job over a table of pairs instead of a column: ``scores(pairs(a, b)) -> (a, b, s)``."""

    def scores(self, pairs: DataFrame) -> DataFrame: ...


def model_similarity(load: Callable[[], Scorer], batch: int = 128) -> Callable[[Column, Column], Column]:
    """A column function of two token arrays from a model: ``load`` runs once in each worker's task, its result scores lists of ``batch`` pairs.

    A null array scores as an empty one. Pairs of about one length are scored together.
    """

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = None
        for a, b in batches:
            scorer = scorer or load()
            x, y = ([[] if v is None else list(v) for v in s] for s in (a, b))
            order = sorted(range(len(x)), key=lambda k: len(x[k]) + len(y[k]))
            out = np.zeros(len(x))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                out[part] = np.asarray(scorer([x[k] for k in part], [y[k] for k in part]), np.float64)
            yield pd.Series(out)

    # the types are given by hand: names in annotations are not resolved inside this function
    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(score, T.DoubleType())
    return lambda a, b: udf(a, b)


def greedy_f1(sim: np.ndarray) -> float:
    """F1 of each side's mean of the largest likeness to a token of the other side."""
    if not sim.shape[0] or not sim.shape[1]:
        return 1.0 if sim.shape[0] == sim.shape[1] else 0.0
    p, r = sim.max(1).mean(), sim.max(0).mean()
    return float(2 * p * r / (p + r)) if p > 0 and r > 0 else 0.0


class VectorSimilarity:
    """Greedy matching by largest cosine over ``vectors(token, vec)``.

    A token without a usable vector (none, zero, or of null or non-finite numbers) is like itself only. Of
    several vectors of a token the smallest counts. Up to SMALL vectors go to the workers; more are joined
    to the tokens of each pair, which are put together again by pair.
    """

    def __init__(self, vectors: DataFrame, small: int = SMALL, key: Callable[[Column], Column] | None = None) -> None:
        """``key`` makes of an array of tokens the array of what ``vectors.token`` holds, where many tokens share a vector; else that is the token."""
        v = vectors.select("token", F.col("vec").cast("array<double>").alias("vec")).where("token is not null and vec is not null")
        v = v.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
        self.vectors = v.groupBy("token").agg(F.min("vec").alias("vec"))
        self.key = key or (lambda tokens: tokens)
        rows = self.vectors.limit(small + 1).collect()
        self.few = len(rows) <= small
        self.given = None
        if self.few:
            matrix = np.array([r.vec for r in rows], np.float64) if rows else np.zeros((0, 1))
            matrix = matrix / np.maximum(np.abs(matrix).max(1, keepdims=True, initial=0), 1e-300)
            matrix = matrix / np.maximum(np.sqrt((matrix * matrix).sum(1, keepdims=True)), 1e-300)
            self.given = vectors.sparkSession.sparkContext.broadcast(({r.token: k for k, r in enumerate(rows)}, matrix))

    def scores(self, pairs: DataFrame) -> DataFrame:
        """``a, b, s`` for each different pair of token arrays."""
        pairs = pairs.select("a", "b").distinct()
        if self.few:
            return self.in_rows(pairs)
        for side in ("a", "b"):
            each = pairs.select("a", "b", F.posexplode(self.key(F.col(side))).alias("at", "token")).join(self.vectors, "token", "left")
            known = each.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "vec"))), lambda x: x["vec"]).alias(f"vec_{side}"))
            pairs = pairs.join(known, ["a", "b"], "left")
        return pairs.mapInArrow(_scored(_by_vectors), "a array<string>, b array<string>, s double")

    def in_rows(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``s`` of their ``a, b``: row by row where the vectors go to the workers, else joined by pair."""
        if not self.few:
            return pairs.join(self.scores(pairs), ["a", "b"])
        given, names = self.given, pairs.columns
        places = [names.index("a"), names.index("b")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    columns = [part.column(k).to_pylist() for k in (*places, len(names), len(names) + 1)]
                    s = [_by_table(*row, *given.value) for row in zip(*columns)]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(s, pa.float64())], names=[*names, "s"])

        keyed = pairs.select(*names, *[self.key(F.col(c)).alias(f"_key_{c}") for c in ("a", "b")])
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
        return keyed.mapInArrow(run, f"{kinds}, s double")


def _scored(score: Callable[[tuple], float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                s = [score(row) for row in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64())], names=["a", "b", "s"])

    return run


def _same(a: list[str], b: list[str], known_a: np.ndarray, known_b: np.ndarray, sim: np.ndarray) -> float:
    """``sim`` completed for tokens without a vector: 1 for equal ones."""
    for i in np.flatnonzero(~known_a).tolist():
        sim[i] = [x == a[i] for x in b]
    for j in np.flatnonzero(~known_b).tolist():
        sim[:, j] = [x == b[j] for x in a]
    return greedy_f1(sim)


def _by_table(a: list[str], b: list[str], key_a: list, key_b: list, table: dict, matrix: np.ndarray) -> float:
    x, y = (np.array([table.get(t, -1) for t in side], np.int64) for side in (key_a, key_b))
    sim = matrix[x] @ matrix[y].T if len(matrix) else np.zeros((len(x), len(y)))
    return _same(a, b, x >= 0, y >= 0, sim)


def _by_vectors(row: tuple) -> float:
    a, b, va, vb = row
    va, vb = va or [None] * len(a), vb or [None] * len(b)
    width = max((len(v) for v in (*va, *vb) if v), default=1)
    unit = []
    for side in (va, vb):
        m = np.array([v or [0.0] * width for v in side], np.float64).reshape(-1, width)
        m = m / np.maximum(np.abs(m).max(1, keepdims=True, initial=0), 1e-300)
        unit.append(m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300))
    return _same(a, b, np.array([v is not None for v in va], bool), np.array([v is not None for v in vb], bool), unit[0] @ unit[1].T)


def score_pairs(pairs: DataFrame, sim: Callable[[Column, Column], Column] | TableSimilarity) -> DataFrame:
    """``a, b, s`` for each different pair, by a column function or by a job."""
    if hasattr(sim, "scores"):
        return sim.scores(pairs)
    return pairs.select("a", "b").distinct().withColumn("s", sim(F.col("a"), F.col("b")))
