"""Counts per reference, sentence scores, and corpus scores by an ordered fold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrigenda.model import KEYS
from corrigenda.tables import removed, saved

COUNTS = ["tp", "fp", "fn", "tn", "fp_ne", "fp_un"]
BETA = 0.5
#: hit, err, und, ove
CORPUS_FACTORS, SENTENCE_FACTORS = (0.45, 0.35, 0.15, 0.05), (0.35, 0.25, 0.20, 0.20)
#: Open samples that are folded behind one another.
FOLD_ROWS = 50_000


def ref_counts(matches: DataFrame, pairs: DataFrame, weight: Column | None = None) -> DataFrame:
    """Counts (or sums of weights) per (sample, reference); ``pairs`` lists all, also those without a match.

    A null or zero weight counts 1, as for the plain scores.
    """
    w = F.lit(1.0) if weight is None else F.when(weight.isNull() | (weight == 0), 1.0).otherwise(weight)
    is_ = F.col("outcome")
    kind = F.col("fp_kind") if "fp_kind" in matches.columns else F.lit(None).cast("string")
    agg = [F.sum(F.when(is_ == o, w).otherwise(0.0)).alias(o) for o in COUNTS[:4]]
    agg += [F.sum(F.when((is_ == "fp") & (kind == k), w).otherwise(0.0)).alias(f"fp_{k}") for k in ("ne", "un")]
    got = matches.groupBy(*KEYS, "ref_id").agg(*agg)
    return pairs.select(*KEYS, "ref_id").join(got, [*KEYS, "ref_id"], "left").fillna(0.0, COUNTS)


def reference_pairs(targets: DataFrame) -> DataFrame:
    return targets.where("side = 'ref'").select(*KEYS, F.col("target_id").alias("ref_id"))


def with_prf(df: DataFrame, beta: float = BETA) -> DataFrame:
    """Adds ``p, r, f, acc``, rounded to four places; empty denominators give 1, 1, 0 and 0."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS[:4])
    p = F.when(fp == 0, F.lit(1.0)).otherwise(tp / (tp + fp))
    r = F.when(fn == 0, F.lit(1.0)).otherwise(tp / (tp + fn))
    b = beta * beta
    f = F.when(p + r == 0, F.lit(0.0)).otherwise((1 + b) * p * r / (b * p + r))
    total = tp + fp + fn + tn
    acc = F.when(total == 0, F.lit(0.0)).otherwise((tp + tn) / total)
    return df.withColumns({"p": F.round(p, 4), "r": F.round(r, 4), "f": F.round(f, 4), "acc": F.round(acc, 4)})


def with_heuo(df: DataFrame, factors: tuple[float, float, float, float] = CORPUS_FACTORS) -> DataFrame:
    """Adds ``hit, err, und, ove, com``; empty denominators give 0. Factors have to sum to 1."""
    if abs(sum(factors) - 1) > 1e-5:
        raise ValueError("factors must sum to 1")
    tp, fn, ne, un = (F.col(c) for c in ("tp", "fn", "fp_ne", "fp_un"))
    need, made = tp + ne + fn, tp + ne + un
    part = lambda x, n: F.when(n == 0, F.lit(0.0)).otherwise(x / n)
    h, e, u, o = part(tp, need), part(ne, need), part(fn, need), part(un, made)
    com = factors[0] * h + factors[1] * (1 - e) + factors[2] * (1 - u) + factors[3] * (1 - o)
    return df.withColumns({"hit": h, "err": e, "und": u, "ove": o, "com": com})


def _first_best(df: DataFrame, keys: list[Column]) -> DataFrame:
    """The row of each sample that is greatest by ``keys``; the first reference wins ties."""
    order = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], (-F.col("ref_id")).alias("kr"))
    rest = [c for c in df.columns if c not in KEYS]
    best = df.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(*KEYS, "_b.*")


def with_need(df: DataFrame, weighted: bool = False) -> DataFrame:
    """Adds ``necessary, unnecessary`` of the disentangled indicators; the latter is another sum for weighted counts."""
    return df.withColumns({"necessary": F.col("tp") + F.col("fp_ne") + F.col("fn"), "unnecessary": F.col("fp_un") if weighted else F.col("tp") + F.col("fp")})


def prf_sentence(counts: DataFrame, beta: float = BETA) -> DataFrame:
    """Best reference of each sample by (f, p, r, acc), then plain means and sums of counts."""
    best = _first_best(with_prf(counts, beta), [F.col(c) for c in ("f", "p", "r", "acc")])
    return best.groupBy("system_id").agg(F.count("*").alias("num_sample"), *[F.avg(c).alias(c) for c in ("p", "r", "f", "acc")], *[F.sum(c).alias(c) for c in COUNTS[:4]])


def heuo_sentence(counts: DataFrame, factors=SENTENCE_FACTORS) -> DataFrame:
    """Best reference by (com, hit, -err, -und, -ove), then means of indicators and sums of counts."""
    best = _first_best(with_heuo(counts, factors), [F.col("com"), F.col("hit"), -F.col("err"), -F.col("und"), -F.col("ove")])
    return best.groupBy("system_id").agg(F.count("*").alias("num_sample"), *[F.avg(c).alias(c) for c in ("hit", "err", "und", "ove", "com")], *[F.sum(c).alias(c) for c in COUNTS])


def _prf(c, beta: float = BETA) -> float:
    tp, fp, fn = c[0], c[1], c[2]
    p = tp / (tp + fp) if fp else 1.0
    r = tp / (tp + fn) if fn else 1.0
    return round((1 + beta**2) * p * r / (beta**2 * p + r), 4) if p + r else 0.0


def _com(c, k) -> float:
    tp, fn, ne, un = c[0], c[2], c[4], c[5]
    need, made = tp + ne + fn, tp + ne + un
    h, e, u = (tp / need, ne / need, fn / need) if need else (0.0, 0.0, 0.0)
    return k[0] * h + k[1] * (1 - e) + k[2] * (1 - u) + k[3] * (1 - (un / made if made else 0.0))


SEGMENTS = "system_id string, block bigint, seq bigint, n bigint, c array<array<double>>, s array<double>"
FOLDED = "system_id string, block bigint, n bigint, s array<double>"


def _segments(fold_rows: int):
    """Rows ``system_id, c, part`` in order as segments: an open sample and the sum of the decided ones behind it, in blocks of ``fold_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, key, now = 0, None, None
        for batch in batches:
            out: list[tuple] = []
            for system, part, cands in zip(*(batch.column(c).to_pylist() for c in ("system_id", "part", "c"))):
                if len(cands) > 1 or now is None or key != system:
                    if now is not None:
                        out.append(now)
                    now = (system, (part << 32) + made // fold_rows, made, 1, cands if len(cands) > 1 else None, cands[0] if len(cands) == 1 else [0.0] * len(COUNTS))
                    key, made = system, made + 1
                else:
                    now = (*now[:3], now[3] + 1, now[4], [x + y for x, y in zip(now[5], cands[0])])
            yield _rows(out, SEGMENTS)
        if now is not None:
            yield _rows([now], SEGMENTS)

    return run


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
    fields = [f.split(" ") for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _folded(start: dict[tuple[str, int], list[float]], rank: Callable[[list[float]], float]):
    """What each block of segments, read in order, adds to the totals it starts from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, first, total = None, 0, [], []
        done: list[tuple] = []
        for batch in batches:
            for system, block, more, cands, decided in zip(*(batch.column(c).to_pylist() for c in ("system_id", "block", "n", "c", "s"))):
                if key != (system, block):
                    if key:
                        done.append((*key, n, [x - y for x, y in zip(total, first)]))
                    key, n = (system, block), 0
                    total = first = start.get(key, [0.0] * len(COUNTS))
                best = None
                for v in cands or ():
                    new = [x + y for x, y in zip(total, v)]
                    order = (rank(new), v[0], -v[1], -v[2], v[3])
                    if best is None or order > best[0]:
                        best = (order, new)
                total = [x + y for x, y in zip(best[1] if best else total, decided)]
                n += more
        if key:
            done.append((*key, n, [x - y for x, y in zip(total, first)]))
        yield _rows(done, FOLDED)

    return run


def corpus_totals(counts: DataFrame, by: str = "prf", factors=CORPUS_FACTORS, beta: float = BETA, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Totals of the ordered fold: sample by sample the reference that makes the best running score.

    Only samples whose references differ need the running score. Equal candidates collapse; for the
    plain score a candidate no better in any count than one that also wins ties is dropped. Samples are
    dealt out by ranges of their ids; in each, the decided ones behind an open one are summed. What
    remains is folded in blocks of ``fold_rows`` rows in parallel, a row at a time: each block starts
    from a guess of the totals before it. The blocks whose start is not what those before them came to
    are folded again, until there are none. That is the ordered fold; each round settles one more block
    at least, and mostly all of them within a few, since a choice seldom depends on small changes of the
    totals. Starts count as equal within a billionth: sums of weights depend on the order of adding.
    A row for each block comes to the driver.
    """
    row = F.struct(*[F.col(c) for c in COUNTS], (-F.col("ref_id")).alias("r"))
    t = counts.groupBy(*KEYS).agg(F.sort_array(F.collect_list(row)).alias("c"))
    same = lambda x, y: F.expr("true") & (x["tp"] == y["tp"]) & (x["fp"] == y["fp"]) & (x["fn"] == y["fn"]) & (x["tn"] == y["tn"]) & (x["fp_ne"] == y["fp_ne"]) & (x["fp_un"] == y["fp_un"])
    t = t.withColumn("c", F.filter("c", lambda x: ~F.exists("c", lambda y: same(x, y) & (y["r"] > x["r"]))))
    if by == "prf":
        key = lambda x: F.struct(x["tp"].alias("a"), (-x["fp"]).alias("b"), (-x["fn"]).alias("c"), x["tn"].alias("d"), x["r"].alias("e"))
        t = t.withColumn("c", F.filter("c", lambda x: ~F.exists("c", lambda y: (y["tp"] >= x["tp"]) & (y["fp"] <= x["fp"]) & (y["fn"] <= x["fn"]) & (key(y) > key(x)))))
    by_reference = F.array_sort(F.col("c"), lambda x, y: F.when(x["r"] > y["r"], -1).when(x["r"] < y["r"], 1).otherwise(0))
    t = t.withColumn("c", F.transform(by_reference, lambda x: F.array(*[x[k] for k in COUNTS])))
    dealt = t.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).select("system_id", "c", F.spark_partition_id().alias("part"))
    segs = saved(dealt.mapInArrow(_segments(fold_rows), SEGMENTS), "fold")
    rank = (lambda v: _prf(v, beta)) if by == "prf" else (lambda v: _com(v, factors))
    start: dict[tuple[str, int], list[float]] = {}
    made: dict[tuple[str, int], tuple[int, list[float]]] = {}
    stale = segs
    while True:
        # the order of blocks is that of their numbers; rows of a block stay in order
        todo = stale.repartition("system_id", "block").sortWithinPartitions("system_id", "block", "seq").select("system_id", "block", "n", "c", "s")
        made |= {(r.system_id, r.block): (r.n, list(r.s)) for r in todo.mapInArrow(_folded(start, rank), FOLDED).collect()}
        sums: dict[str, list[float]] = {}
        again = []
        for system, block in sorted(made):
            total = sums.setdefault(system, [0.0] * len(COUNTS))
            if any(abs(x - y) > 1e-9 * max(1.0, abs(x)) for x, y in zip(total, start.get((system, block), [0.0] * len(COUNTS)))):
                start[system, block] = total
                again.append((system, block))
            sums[system] = [x + y for x, y in zip(total, made[system, block][1])]
        if not again:
            break
        stale = segs.join(F.broadcast(segs.sparkSession.createDataFrame(again, "system_id string, block bigint")), ["system_id", "block"], "left_semi")
    removed(segs)
    size: dict[str, int] = {}
    for (system, _), (n, _) in made.items():
        size[system] = size.get(system, 0) + n
    rows = [(system, size[system], *total) for system, total in sums.items()]
    return counts.sparkSession.createDataFrame(rows, "system_id string, num_sample bigint, " + ", ".join(f"{c} double" for c in COUNTS))


def prf_corpus(counts: DataFrame, beta: float = BETA) -> DataFrame:
    return with_prf(corpus_totals(counts, "prf", beta=beta), beta)


def heuo_corpus(counts: DataFrame, factors=CORPUS_FACTORS) -> DataFrame:
    return with_heuo(corpus_totals(counts, "heuo", factors), factors)
