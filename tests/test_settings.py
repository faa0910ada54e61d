"""Settings and functions that no query uses: sampled and smoothed n-gram scores, refreshed edits, presets, roles, characters."""

import math

import pytest
from pyspark.sql import functions as F

from corrigenda.functions import text as X
from corrigenda.operators import gleu as G
from corrigenda.operators import grouped as R
from corrigenda.operators import scores as S
from corrigenda.operators import weights as W
from corrigenda.operators.extract import char_edit_type
from corrigenda.plans.evaluate import evaluate, with_edits
from corrigenda.plans.testbed import tables

SF = "/root/testdata/sf0.001"
PARTS = "system_id string, sample_id bigint, ref_id int, n int, numerator bigint, denominator bigint, hyp_len int, ref_len int"


def few(spark):
    return {k: v.where("sample_id % 89 = 2") for k, v in tables(spark, SF).items()}


def plain_gleu(total, hyp, ref, smooth=False):
    fix = lambda x: x or 1.0 if smooth else x
    return math.exp(min(0.0, 1 - ref / hyp) + sum(math.log(fix(a) / fix(b)) for a, b in total) / 4)


def test_sampled_score_nears_its_expectation(spark):
    parts = G.gleu_parts(few(spark)["grouped"]).cache()
    expected = G.gleu_corpus(parts).first().score
    got = G.gleu_corpus_sampled(parts, num_iter=300, seed=1).first().score
    assert got == pytest.approx(expected, abs=0.01) and got == G.gleu_corpus_sampled(parts, num_iter=300, seed=1).first().score
    assert G.gleu_corpus_sampled(parts, num_iter=3, seed=2).first().score != G.gleu_corpus_sampled(parts, num_iter=3, seed=3).first().score


def test_smoothing_turns_zero_counts_into_one(spark):
    counts = [(4, 5), (2, 4), (0, 3), (0, 0)]
    parts = spark.createDataFrame([("s", 0, 0, n + 1, a, b, 5, 6) for n, (a, b) in enumerate(counts)], PARTS)
    assert G.gleu_corpus(parts, smoothing=True).first().score == pytest.approx(plain_gleu(counts, 5, 6, True))
    sure = spark.createDataFrame([("s", 0, r, n + 1, 4 - n - r % 2, 5 - n, 5, 6 - r) for n in range(4) for r in (0, 2)], PARTS)
    assert G.gleu_corpus(sure, smoothing=True).first().score == G.gleu_corpus(sure).first().score == pytest.approx(plain_gleu([(4 - n, 5 - n) for n in range(4)], 5, 5))


def test_refresh_extracts_all_edits(spark):
    d = few(spark)
    data = {k: d[k] for k in ("samples", "targets", "edits")}
    kept = with_edits(data)["edits"]
    assert kept.where("types[0] like '%:X'").count() == data["edits"].count()
    fresh = with_edits(data, refresh=True)["edits"]
    assert fresh.where("types[0] like '%:X'").count() == 0 and fresh.count() > 0


def test_presets_and_bounds_by_outcome(spark):
    bias = 2.0
    for preset in (W.CORPUS, W.SENTENCE_DEPENDENT, W.SENTENCE_INDEPENDENT):
        by_rows = W.length_weight_of(bias, preset)
        rows = [(o, n) for o in ("tp", "fp", "fn", "tn") for n in range(8)]
        df = spark.createDataFrame(rows, "o string, n int").select("o", "n", W.length_weight(F.col("n"), F.lit(bias), F.col("o"), preset).alias("w"))
        for r in df.collect():
            low, high = {"tp": preset.tp, "fp": preset.fp, "fn": preset.fn, "tn": (1.0, 1.0)}[r.o]
            x = r.n - bias if r.o == "fp" else bias - r.n
            want = min(max(preset.alpha / (1 + (preset.alpha - 1) * math.exp(x)), low), high)
            assert r.w == pytest.approx(want) and by_rows(r.o, r.n) == pytest.approx(want)
    assert W.length_weight_of(None)("tp", 5) == 1.0
    d = few(spark)
    weighed = {W.CORPUS: None, W.SENTENCE_DEPENDENT: None}
    for preset in weighed:
        weighed[preset] = {r.weight for r in evaluate(d, weigher="length", preset=preset)[1].select("weight").distinct().collect()}
        assert all(min(preset.fp[0], preset.fn[0], 1.0) <= w <= max(preset.tp[1], 1.0) for w in weighed[preset])
    assert weighed[W.CORPUS] != weighed[W.SENTENCE_DEPENDENT]


def test_needed_and_unneeded_corrections(spark):
    one = spark.createDataFrame([(3.0, 5.0, 2.0, 1.0, 4.0, 1.0)], "tp double, fp double, fn double, tn double, fp_ne double, fp_un double")
    assert S.with_need(one).select("necessary", "unnecessary").first() == (9.0, 8.0)
    assert S.with_need(one, weighted=True).select("necessary", "unnecessary").first() == (9.0, 1.0)


def test_grouped_counts_follow_the_tables(spark):
    """The columns of ``outcomes`` and ``chunks`` say what the pass over grouped rows has to count."""
    from corrigenda.operators import chunks as C
    from corrigenda.operators import outcomes as O

    d = few(spark)
    live = R.drop_empty_refs(d["grouped"])
    t = R.ungroup(live)
    ch = C.chunks(t["samples"], t["targets"], t["edits"])
    for assumption, fn in (("dependent", O.dependent_outcomes), ("independent", O.independent_outcomes)) if hasattr(O, "dependent_outcomes") else ():
        want = sorted((r.sample_id, r.ref_id, r.chunk_idx, r.outcome) for r in fn(ch).collect())
        assert sorted((r.sample_id, r.ref_id, r.chunk_idx, r.outcome) for r in R.match_rows(live, assumption).collect()) == want
    assert sorted(map(str, ch.select("sample_id", "side", "target_id", "chunk_idx", "tgt_tokens").collect())) == sorted(map(str, R.chunk_rows(live).select("sample_id", "side", "target_id", "chunk_idx", "tgt_tokens").collect()))


def test_characters(spark):
    df = spark.createDataFrame([("T2",), ("D",), ("I",), ("S",), ("DI",)], "ops string")
    assert [r[0] for r in df.select(char_edit_type(F.col("ops"))).collect()] == ["T", "U", "M", "S", "U"]
    r = spark.range(1).select(X.simplify(F.lit("漢語和文"), "漢語", "汉语").alias("s"), X.same_spelling(F.lit("高兴"), F.lit("兴高")).alias("a"), X.same_spelling(F.lit("高"), F.lit("心")).alias("b"), X.same_spelling(F.lit("高"), F.lit("心"), F.lit(0.8)).alias("c"), X.same_spelling(F.lit("高"), F.lit("心心"), F.lit(1.0)).alias("d")).first()
    assert (r.s, r.a, r.b, r.c, r.d) == ("汉语和文", True, False, True, False)
