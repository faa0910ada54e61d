"""Quality rules: rule statistics of whole texts, judged by an isolation forest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrigenda.llm.common import cut, field_of, map_batches

#: Trees of the forest; rows per tree, which the method draws anew for each tree.
TREES, TREE_ROWS = 200, 256
#: Weight of all labelled bad rows in the draw of a tree's rows, as a share of the good ones: what is
#: to stand out has to be rare. All labelled rows calibrate the threshold.
RARE = 0.02
#: Share of good labelled rows that the threshold has to keep.
KEEP_GOOD = 0.998

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_len", "symbol_share", "mark_share", "distinct_share", "top_word_share"]


def rule_stats(text: str | None) -> tuple[list[int], list[float]]:
    """The five base counts of a whole text, and the features of the forest."""
    text = text or ""
    raw = text.encode().split()
    n = len(raw)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    dup = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in raw), np.int64, n)
    repeat = 0
    if n >= 3:
        m = len(number)
        two = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
        _, at, count = np.unique(two[:-1] * np.int64(m) + ids[2:], return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[at] > 1)
        mark = np.zeros(n, bool)
        for k in range(3):
            mark[again + k] = True
        repeat = int(mark.sum())
    w, c = max(n, 1), max(chars, 1)
    marks = text.count("!") + text.count("?") + text.count("|")
    features = [chars / w, symbols / c, marks / w, len(number) / w**0.9, np.bincount(ids).max() / w if n else 0.0]
    return [n, chars, symbols, dup, repeat], features


def rule_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``id``, columns ``also``, the base counts and the feature vector of every row, over whole texts; null text has no words."""
    names = [id_col, *also]
    schema = T.StructType([*(field_of(docs, c) for c in names), *(T.StructField(c, T.LongType()) for c in BASE), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(*cols):
        got = [rule_stats(t.as_py()) for t in cols[-1]]
        yield {**dict(zip(names, cols)), **{c: [b[k] for b, _ in got] for k, c in enumerate(BASE)}, "features": [f for _, f in got]}

    return map_batches(docs, [*names, text_col], schema, run)


class IsolationForest:
    """Random splits over row samples; rows that few splits set apart have short paths."""

    def __init__(self, trees: list[np.ndarray], rows: int):
        self.trees, self.rows, self.depth = trees, rows, tree_depth(rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): higher is odder."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth + 1):
                f = t[at, 0].astype(int)
                live = f >= 0
                if not live.any():
                    break
                go = np.where(x[rows, np.maximum(f, 0)] < t[at, 1], t[at, 2], t[at, 3]).astype(int)
                at = np.where(live, go, at)
            total += t[at, 1]
        return 2.0 ** (-total / len(self.trees) / max(mean_path(self.rows), 1e-9))


def tree_depth(rows: int) -> int:
    return max(1, int(np.ceil(np.log2(max(rows, 2)))))


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Nodes of a tree over the rows of ``x``: feature (-1: leaf), split or path length, left, right."""
    most = tree_depth(len(x))
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        open_ = np.flatnonzero(high > low)
        if depth >= most or len(rows) <= 1 or not len(open_):
            nodes.append([-1, depth + mean_path(len(rows)), 0, 0])
            return at
        f = int(rng.choice(open_))
        split = rng.uniform(low[f], high[f])
        nodes.append([f, split, 0, 0])
        left = rows[:, f] < split
        nodes[at][2] = grow(rows[left], depth + 1)
        nodes[at][3] = grow(rows[~left], depth + 1)
        return at

    grow(x, 0)
    return np.array(nodes)


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def draw_times(key: np.ndarray, weight: np.ndarray, tree: int) -> np.ndarray:
    """Waiting times, exponential with rate ``weight``, from the rows' hashes: the rows with the
    smallest ones are a draw without replacement by weight, another one for each tree."""
    x = key ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return -np.log(((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 + 2.0**-54) / weight


def grow_forest(labelled: DataFrame, n_good: int, n_bad: int, trees: int = TREES, rows: int = TREE_ROWS, rare: float = RARE) -> IsolationForest:
    """A forest over all of ``labelled`` (``key``, ``features``, ``good``): every row takes part in the draw of every tree.

    The rows of a tree are drawn without replacement, bad ones by a weight that makes them ``rare``.
    Rows that wait longer than those drawn are dropped in the tasks, by a time that leaves some more
    than needed; should a tree get too few, all are drawn again with a longer one. Trees grow in
    tasks, only their nodes are gathered.
    """
    light = min(1.0, max(1.0, rare * n_good) / max(1, n_bad))
    size = min(rows, int(n_good + light * n_bad))
    if not size:
        return IsolationForest([], 0)
    drawn_schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("time", T.DoubleType()), T.StructField("features", T.ArrayType(T.DoubleType()))])
    wanted = size + 8.0 * size**0.5 + 8.0
    while True:
        longest = _time_for(wanted, n_good, n_bad, light)

        def draw(key, features, good):
            x = np.array(features.to_pylist(), dtype=float).reshape(-1, len(FEATURES))
            k = np.asarray(key).astype(np.int64).view(np.uint64)
            weight = np.where(np.asarray(good.to_numpy(zero_copy_only=False), bool), 1.0, light)
            at, times = [], []
            for t in range(trees):
                time = draw_times(k, weight, t)
                at.append(np.flatnonzero(time <= longest))
                times.append(time[at[-1]])
            yield {"tree": np.repeat(np.arange(trees), [len(a) for a in at]), "time": np.concatenate(times), "features": list(x[np.concatenate(at)])}

        def grow(pdf):
            import pandas as pd

            x = np.array(pdf["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
            x = x[np.lexsort((*x.T, pdf["time"].to_numpy()))[:size]]
            tree = int(pdf["tree"].iloc[0])
            return pd.DataFrame({"tree": [tree], "n": [len(x)], "nodes": [grow_tree(x, np.random.default_rng([7, tree])).ravel()]})

        drawn = map_batches(labelled, ["key", "features", "good"], drawn_schema, draw)
        grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, n int, nodes array<double>").toPandas().sort_values("tree")
        if len(grown) == trees and (grown["n"] == size).all():
            return IsolationForest([np.array(x).reshape(-1, 4) for x in grown["nodes"]], size)
        wanted *= 2


def _time_for(wanted: float, n_good: int, n_bad: int, light: float) -> float:
    """The time by which ``wanted`` rows are to be expected."""
    if wanted >= n_good + n_bad:
        return float("inf")
    low, high = 0.0, 1.0
    expected = lambda t: n_good * -np.expm1(-t) + n_bad * -np.expm1(-light * t)
    while expected(high) < wanted and high < 1e9:
        high *= 2
    for _ in range(60):
        low, high = ((low + high) / 2, high) if expected((low + high) / 2) < wanted else (low, (low + high) / 2)
    return high


def calibrate(scores: DataFrame, n_good: int, n_bad: int, keep_good: float = KEEP_GOOD) -> float:
    """Highest score still kept: the one with the best balance of kept good and rejected bad rows,
    among those that keep at least ``keep_good`` of the good ones; of several the middle.

    Over all rows of ``scores`` (``score``, ``good``), exactly: running counts along ranges of scores,
    of which only the totals are gathered.
    """
    if not n_good or not n_bad:
        return float("inf")
    spark = scores.sparkSession
    at = scores.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    at = cut(at.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    before, g, b = [], 0, 0
    for r in sorted(at.groupBy("part").agg(F.min("score").alias("low"), F.sum("g").alias("g"), F.sum("b").alias("b")).collect(), key=lambda r: r.low):
        before.append((r.part, g, b))
        g, b = g + r.g, b + r.b
    before = spark.createDataFrame(before, "in_part int, g0 bigint, b0 bigint")
    up_to = Window.partitionBy("part").orderBy("score")
    at = at.join(F.broadcast(before), F.col("part") == F.col("in_part")).select(
        "score", (F.sum("g").over(up_to) + F.col("g0")).alias("g"), (F.sum("b").over(up_to) + F.col("b0")).alias("b")
    )
    at = at.where(F.col("g") > F.lit(int(np.ceil(keep_good * (n_good - 1)))))
    value = (F.col("g").cast("decimal(18,0)") * F.lit(n_bad).cast("decimal(18,0)") - F.col("b").cast("decimal(18,0)") * F.lit(n_good).cast("decimal(18,0)")).alias("value")
    at = at.select(value, "score", (-F.col("score")).alias("back"))
    best = at.agg(F.max(F.struct("value", "score")).alias("last"), F.max(F.struct("value", "back")).alias("first")).first()
    return (best.last.score - best.first.back) / 2


def judge_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality",
    trees: int = TREES, keep_good: float = KEEP_GOOD, rare: float = RARE, also: tuple[str, ...] = (),
) -> DataFrame:
    """``id``, columns ``also``, base counts, ``base_failed``, ``score``, ``kept`` for every row.

    base_failed: under 50 words, or more than half of all words in repeated 3-word windows. The
    trees of the forest draw their rows from all labelled ones, and all of these calibrate its
    threshold; every row is scored by its path lengths. ``kept`` is false for
    base_failed rows and for scores above the threshold. Without labelled rows of both kinds only
    the base rules decide. Labels that are null or name no document are left out; null text has no
    words and fails; null and repeated ids keep their rows; an empty table stays empty.
    """
    rows = cut(rule_table(docs, id_col, text_col, also), "rules")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("_l")).agg(F.min(label_col).alias("_good"))
    labelled = rows.where(~base_failed).join(known, F.col(id_col) == F.col("_l")).select("_l", "features", (F.col("_good") > 0).alias("good")).distinct()
    labelled = cut(labelled.select(F.xxhash64("_l", "features").alias("key"), "features", "good"), "labelled")
    n_good, n_bad = labelled.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    forest = grow_forest(labelled, n_good, n_bad, trees, rare=rare)

    def score_labelled(features, good):
        yield {"score": forest.score(np.array(features.to_pylist(), dtype=float).reshape(-1, len(FEATURES))), "good": good}

    form = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("good", T.BooleanType())])
    limit = calibrate(map_batches(labelled, ["features", "good"], form, score_labelled), n_good, n_bad, keep_good)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def score(*cols):
        x = np.array(cols[-1].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
        yield {f.name: c for f, c in zip(schema.fields, cols[:-1])} | {"score": forest.score(x)}

    scored = map_batches(rows, rows.columns, schema, score)
    return scored.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") <= F.lit(limit)))
