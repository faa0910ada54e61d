"""Chunk weights by length, and by similarity of pseudo-hypotheses to the references."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrigenda.model import KEYS
from corrigenda.operators import grouped as R
from corrigenda.operators.likeness import score_pairs


@dataclass(frozen=True)
class LengthPreset:
    """Steepness, and bounds by outcome; untouched chunks always weigh 1."""

    alpha: float = 2.0
    tp: tuple[float, float] = (0.75, 1.25)
    fp: tuple[float, float] = (0.75, 1.25)
    fn: tuple[float, float] = (0.75, 1.25)


CORPUS = LengthPreset()
SENTENCE_DEPENDENT = LengthPreset(10.0, (1.0, 10.0), (0.25, 1.0), (1.0, 1.0))
SENTENCE_INDEPENDENT = LengthPreset(10.0, (2.5, 10.0), (0.25, 1.0), (1.0, 1.0))


def length_bias(chunks: DataFrame) -> DataFrame:
    """``bias, plain``: mean length of marked and of unmarked reference chunks, per system."""
    size = F.greatest(F.size("src_tokens"), F.size("tgt_tokens"))
    return chunks.where("side = 'ref'").groupBy("system_id").agg(
        F.avg(F.when(F.col("is_marked"), size)).alias("bias"), F.avg(F.when(~F.col("is_marked"), F.size("src_tokens"))).alias("plain")
    )


def length_weight(length: Column, bias: Column, outcome: Column, p: LengthPreset = CORPUS) -> Column:
    """Longer chunks weigh more; wrong ones less. Without a bias (no marked reference) 1."""
    x = F.when(outcome == "fp", length - bias).otherwise(bias - length)
    w = F.lit(p.alpha) / (1 + (p.alpha - 1) * F.exp(x))
    clip = lambda low, high: F.least(F.greatest(w, F.lit(low)), F.lit(high))
    by_role = F.when(outcome == "tp", clip(*p.tp)).when(outcome == "fp", clip(*p.fp)).otherwise(clip(*p.fn))
    return F.when((outcome == "tn") | bias.isNull(), F.lit(1.0)).otherwise(by_role)


def length_weight_of(bias: float | None, p: LengthPreset = CORPUS):
    """``length_weight`` for one system, as a function of outcome and length."""
    bounds = {"tp": p.tp, "fp": p.fp, "fn": p.fn}

    def weight(outcome: str, length: int) -> float:
        if outcome == "tn" or bias is None:
            return 1.0
        low, high = bounds[outcome]
        x = length - bias if outcome == "fp" else bias - length
        return min(max(p.alpha / (1 + (p.alpha - 1) * math.exp(min(x, 700.0))), low), high)

    return weight


def weigh_by_length(matches: DataFrame, chunks: DataFrame, preset: LengthPreset = CORPUS) -> DataFrame:
    """Adds ``weight``. The statistic has one row per system."""
    m = matches.join(length_bias(chunks).select("system_id", "bias"), "system_id", "left")
    return m.withColumn("weight", length_weight(F.col("length"), F.col("bias"), F.col("outcome"), preset)).drop("bias")


def token_f1(a: Column, b: Column) -> Column:
    """Multiset overlap F1 of two token arrays; two empty ones are alike."""
    common = F.aggregate(
        F.array_distinct(a), F.lit(0),
        lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))),
    )
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common / total)


def token_f1_of(a: list[str], b: Counter, size: int) -> float:
    """``token_f1`` of tokens and counted tokens, ``size`` in number."""
    total = len(a) + size
    return 2.0 * sum(min(c, b[t]) for t, c in Counter(a).items() if t in b) / total if total else 1.0


def _candidates(g: DataFrame, schema: str, make: Callable, independent: bool, detection: bool, distance: int) -> DataFrame:
    """Rows ``ref_id, chunk_idx, outcome, ...`` of touched chunks: ``make(outcome, i, source, chunks of the source, hypothesis and reference, tokens of the reference)`` gives what follows."""
    judge = R._judged(independent, detection, distance)

    def rows(src, targets):
        live = R.live_targets(targets)
        if got := judge(src, live):
            ids, bounds, hyp, found = got
            plain = [src[a:b] for a, b, _ in bounds]
            edits = {t[1]: t[2:] for t in live if t[0] == "ref"}
            for ref, row in zip(ids, found):
                own = R.chunks_of(src, bounds, edits[ref][0])
                one = make(src, plain, hyp, own, edits[ref][1])
                for i, (outcome, _) in enumerate(row):
                    if outcome != "tn":
                        yield ref, i, outcome, *one(outcome, i)

    return R.mapped(g, f"system_id string, sample_id bigint, ref_id int, chunk_idx int, outcome string, {schema}", rows, "all")


def similarity_rows(g: DataFrame, sim=token_f1, assumption: str = "dependent", detection: bool = False, distance: int = 0) -> DataFrame:
    """``keys, ref_id, chunk_idx, outcome, weight`` of touched chunks as ``weigh_by_similarity`` has them, made in the row of their sample.

    ``sim`` is a column function. A similarity that is a job over pairs needs tables of pairs: see ``weigh_by_similarity``.
    """
    own_sim = sim is token_f1

    def make(src, plain, hyp, own, ref):
        counted, size = Counter(ref), len(ref)
        base = token_f1_of(src, counted, size) if own_sim else 0.0

        def one(outcome, i):
            chunk = own[i] if outcome == "fn" else hyp[i]
            cand = (R.with_chunk(plain, i, chunk[0]) if chunk[2] else []) or src
            return (abs(base - token_f1_of(cand, counted, size)),) if own_sim else (src, cand, ref)

        return one

    rows = _candidates(g, "weight double" if own_sim else "s array<string>, c array<string>, r array<string>", make, assumption == "independent", detection, distance)
    return rows if own_sim else rows.withColumn("weight", F.abs(sim(F.col("s"), F.col("r")) - sim(F.col("c"), F.col("r")))).drop("s", "c", "r")


def replacement_rows(g: DataFrame, sim=token_f1, assumption: str = "dependent", detection: bool = False, distance: int = 0) -> DataFrame:
    """``keys, ref_id, chunk_idx, outcome, weight`` of touched chunks as ``weigh_by_replacement`` has them, made in the row of their sample; see ``similarity_rows``."""
    own_sim = sim is token_f1

    def make(src, plain, hyp, own, ref):
        counted = Counter(ref)
        chunks = [c[0] for c in own]

        def one(outcome, i):
            if outcome == "tp":
                a, b = src, (R.with_chunk(plain, i, hyp[i][0]) if hyp[i][2] else []) or src
                return (1 - token_f1_of(a, Counter(b), len(b)),) if own_sim else (a, b)
            a = R.with_chunk(chunks, i, hyp[i][0])
            return (1 - token_f1_of(a, counted, len(ref)),) if own_sim else (a, ref)

        return one

    rows = _candidates(g, "weight double" if own_sim else "a array<string>, b array<string>", make, assumption == "independent", detection, distance)
    return rows if own_sim else rows.withColumn("weight", 1 - sim(F.col("a"), F.col("b"))).drop("a", "b")


def pseudo_hypotheses(chunks: DataFrame, side: str = "hyp") -> DataFrame:
    """The source with exactly one marked chunk replaced, per (target, chunk): ``tokens``."""
    t = chunks.where(F.col("side") == side).groupBy(*KEYS, "target_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk_idx", "src_tokens", "tgt_tokens", "is_marked"))).alias("c")
    )
    one = t.select(*KEYS, "target_id", "c", F.explode(F.filter("c", lambda x: x["is_marked"])).alias("k"))
    tokens = F.flatten(F.transform("c", lambda x: F.when(x["chunk_idx"] == F.col("k.chunk_idx"), x["tgt_tokens"]).otherwise(x["src_tokens"])))
    return one.select(*KEYS, "target_id", F.col("k.chunk_idx").alias("chunk_idx"), F.filter(tokens, lambda x: x != "").alias("tokens"))


def weigh_by_similarity(matches: DataFrame, samples: DataFrame, targets: DataFrame, chunks: DataFrame, sim=token_f1) -> DataFrame:
    """Adds ``weight`` = |sim(source, reference) - sim(pseudo, reference)|, 1 for untouched chunks.

    The pseudo-hypothesis carries the hypothesis' chunk, or the reference's where one was missed;
    an empty one counts as the source. Equal (candidate, reference) pairs are scored once.
    """
    src = samples.select(*KEYS, F.col("src_tokens").alias("_src"))
    ref = targets.where("side = 'ref'").select(*KEYS, F.col("target_id").alias("ref_id"), F.col("tgt_tokens").alias("_ref"))
    hyp = pseudo_hypotheses(chunks, "hyp").select(*KEYS, "chunk_idx", F.col("tokens").alias("_h"))
    own = pseudo_hypotheses(chunks, "ref").select(*KEYS, F.col("target_id").alias("ref_id"), "chunk_idx", F.col("tokens").alias("_r"))
    m = matches.where("outcome <> 'tn'").join(src, KEYS).join(ref, [*KEYS, "ref_id"])
    m = m.join(hyp, [*KEYS, "chunk_idx"], "left").join(own, [*KEYS, "ref_id", "chunk_idx"], "left")
    cand = F.when(F.col("outcome") == "fn", F.col("_r")).otherwise(F.col("_h"))
    m = m.withColumn("_cand", F.when(F.size(F.coalesce(cand, F.array())) > 0, cand).otherwise(F.col("_src")))
    pairs = m.select(F.col("_cand").alias("a"), F.col("_ref").alias("b")).unionByName(m.select(F.col("_src").alias("a"), F.col("_ref").alias("b")))
    scored = score_pairs(pairs, sim)
    m = m.join(scored.select(F.col("a").alias("_cand"), F.col("b").alias("_ref"), F.col("s").alias("_s1")), ["_cand", "_ref"])
    m = m.join(scored.select(F.col("a").alias("_src"), F.col("b").alias("_ref"), F.col("s").alias("_s0")), ["_src", "_ref"])
    touched = m.select(*matches.columns, F.abs(F.col("_s0") - F.col("_s1")).alias("weight"))
    return touched.unionByName(matches.where("outcome = 'tn'").withColumn("weight", F.lit(1.0)))


def reverted_targets(chunks: DataFrame, side: str = "ref") -> DataFrame:
    """A target with exactly one of its marked chunks put back to the source, per (target, chunk): ``tokens``."""
    t = chunks.where(F.col("side") == side).groupBy(*KEYS, "target_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk_idx", "src_tokens", "tgt_tokens", "is_marked"))).alias("c")
    )
    one = t.select(*KEYS, "target_id", "c", F.explode(F.filter("c", lambda x: x["is_marked"])).alias("k"))
    tokens = F.flatten(F.transform("c", lambda x: F.when(x["chunk_idx"] == F.col("k.chunk_idx"), x["src_tokens"]).otherwise(x["tgt_tokens"])))
    return one.select(*KEYS, "target_id", F.col("k.chunk_idx").alias("chunk_idx"), F.filter(tokens, lambda x: x != "").alias("tokens"))


def replaced_references(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each reference with one chunk taken from the hypothesis, per false positive or negative: ``tokens``."""
    ref = chunks.where("side = 'ref'").groupBy(*KEYS, F.col("target_id").alias("ref_id")).agg(
        F.sort_array(F.collect_list(F.struct("chunk_idx", "tgt_tokens"))).alias("_c")
    )
    own = chunks.where("side = 'hyp'").select(*KEYS, "chunk_idx", F.col("tgt_tokens").alias("_h"))
    m = matches.where("outcome in ('fp', 'fn')").join(ref, [*KEYS, "ref_id"]).join(own, [*KEYS, "chunk_idx"])
    tokens = F.flatten(F.transform("_c", lambda x: F.when(x["chunk_idx"] == F.col("chunk_idx"), F.col("_h")).otherwise(x["tgt_tokens"])))
    return m.select(*matches.columns, F.filter(tokens, lambda x: x != "").alias("tokens"))


def weigh_by_replacement(matches: DataFrame, samples: DataFrame, targets: DataFrame, chunks: DataFrame, sim=token_f1) -> DataFrame:
    """Adds ``weight``: 1 - sim(source, source with the chunk) for hits, 1 - sim(reference with the
    hypothesis' chunk, reference) for wrong and missed chunks, 1 for untouched ones.

    An empty pseudo-hypothesis counts as the source. Equal pairs are scored once.
    """
    src = samples.select(*KEYS, F.col("src_tokens").alias("_a"))
    hyp = pseudo_hypotheses(chunks, "hyp").select(*KEYS, "chunk_idx", F.col("tokens").alias("_p"))
    ref = targets.where("side = 'ref'").select(*KEYS, F.col("target_id").alias("ref_id"), F.col("tgt_tokens").alias("_b"))
    hits = matches.where("outcome = 'tp'").join(src, KEYS).join(hyp, [*KEYS, "chunk_idx"], "left")
    hits = hits.withColumn("_b", F.when(F.size(F.coalesce("_p", F.array())) > 0, F.col("_p")).otherwise(F.col("_a")))
    wrong = replaced_references(matches, chunks).withColumnRenamed("tokens", "_a").join(ref, [*KEYS, "ref_id"])
    m = hits.select(*matches.columns, "_a", "_b").unionByName(wrong.select(*matches.columns, "_a", "_b"))
    scored = score_pairs(m.select(F.col("_a").alias("a"), F.col("_b").alias("b")), sim).toDF("_a", "_b", "_s")
    touched = m.join(scored, ["_a", "_b"]).select(*matches.columns, (1 - F.col("_s")).alias("weight"))
    return touched.unionByName(matches.where("outcome = 'tn'").withColumn("weight", F.lit(1.0)))


def source_similarity(samples: DataFrame, targets: DataFrame, sim=token_f1) -> DataFrame:
    """``sim_src_tgt`` per reference."""
    r = targets.where("side = 'ref'").join(samples.select(*KEYS, "src_tokens"), KEYS).select(*KEYS, F.col("target_id").alias("ref_id"), F.col("src_tokens").alias("a"), F.col("tgt_tokens").alias("b"))
    return _scored(r, sim)


def source_similarity_rows(g: DataFrame, sim=token_f1) -> DataFrame:
    """``source_similarity`` of a grouped dataset: no source is joined to its references."""
    r = g.select(*KEYS, F.col("src_tokens").alias("a"), F.explode(F.filter("t", lambda t: t["side"] == "ref")).alias("t"))
    return _scored(r.select(*KEYS, F.col("t.target_id").alias("ref_id"), "a", F.col("t.tgt_tokens").alias("b")), sim)


def _scored(r: DataFrame, sim) -> DataFrame:
    if hasattr(sim, "in_rows"):
        r = sim.in_rows(r)
    elif hasattr(sim, "scores"):
        r = r.join(sim.scores(r), ["a", "b"])
    else:
        r = r.withColumn("s", sim(F.col("a"), F.col("b")))
    return r.select(*KEYS, "ref_id", F.col("s").alias("sim_src_tgt"))
