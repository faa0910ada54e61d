"""Whole-input cases that the rounds before left to samples or to another method."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corrigenda.llm import quality, similar, simhash


def test_all_labelled_rows_set_the_threshold(spark):
    n = 24_000
    words = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", k), F.lit(40) + F.col("doc_id") % 400).cast("string"), F.when(F.pmod(F.xxhash64(k, "doc_id"), F.lit(50)) < F.col("doc_id") % 7 + 25 * (F.col("doc_id") % 9 == 0).cast("int"), "!").otherwise("")))
    docs = spark.range(n).toDF("doc_id").withColumn("text", F.array_join(words, " ")).repartition(8)
    labels = docs.select("doc_id", (F.col("doc_id") % 9 != 0).cast("int").alias("quality"))
    got = quality.judge_quality(docs, labels, trees=20).join(labels, "doc_id").where("not base_failed").toPandas()
    good, score = got["quality"].to_numpy() > 0, got["score"].to_numpy()
    assert len(got) > 20_000 and good.any() and not good.all()
    cuts = np.unique(score[score >= np.quantile(score[good], quality.KEEP_GOOD, method="higher")])
    value = [int((good & (score <= c)).sum()) * int((~good).sum()) - int((~good & (score <= c)).sum()) * int(good.sum()) for c in cuts]
    best = np.flatnonzero(np.array(value) == max(value))
    assert (got["kept"].to_numpy() == (score <= (cuts[best[0]] + cuts[best[-1]]) / 2)).all()


def test_every_labelled_row_takes_part_in_the_draws(spark):
    rng = random.Random(5)
    rows = [(rng.getrandbits(62), [float(i), 0.0, 0.0, 0.0, 0.0], i % 2 == 0) for i in range(2_000)]
    table = spark.createDataFrame(rows, "key bigint, features array<double>, good boolean")
    forest = quality.grow_forest(table, 1_000, 1_000, trees=8, rows=64, rare=0.1)
    assert len(forest.trees) == 8 and forest.rows == 64
    key, weight = np.array([r[0] for r in rows]).view(np.uint64), np.array([1.0 if r[2] else 0.1 for r in rows])
    drawn = [np.argsort(quality.draw_times(key, weight, t))[:64] for t in range(3_000)]
    share = np.mean([(d % 2).mean() for d in drawn])
    assert len({int(i) for d in drawn for i in d}) == 2_000 and 0.07 < share < 0.12
    again = quality.grow_forest(table.repartition(5), 1_000, 1_000, trees=8, rows=64, rare=0.1)
    assert all((a == b).all() for a, b in zip(forest.trees, again.trees))
    assert quality.grow_forest(table.limit(0), 0, 0).score(np.zeros((2, 5))).tolist() == [0, 0]


def _near_texts(rng, groups, n=80):
    """Texts with one to five words changed; tiny ones with a word more or less."""
    texts = []
    for g in range(groups):
        w = [f"g{g}w{rng.randint(0, 10_000)}" for _ in range(n)]
        for _ in range(6):
            v = list(w)
            for at in rng.sample(range(n), rng.randint(0, 3)):
                v[at] = f"x{rng.randint(0, 10_000)}"
            texts.append(" ".join(v[: rng.randint(n - 5, n)]))
        texts += [" ".join(w[:9]), " ".join(w[:8]), " ".join(w[1:9])]
    return texts


def test_the_stage_finds_near_copies_by_simhash(spark, monkeypatch):
    texts = _near_texts(random.Random(21), 12)
    sets = [set(similar.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    asked = []
    monkeypatch.setattr(similar, "near_edges", lambda *a, **k: asked.append(1) or simhash.near_edges(*a, **k))
    docs = spark.createDataFrame([(i, t, "l", "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert asked and sorted(r.doc_id for r in got.collect()) == [i for i, r in enumerate(root) if i == r] and len(set(root)) < len(root)


def test_buckets_and_dealt_crowds_lose_no_pair(spark):
    texts = sorted(set(_near_texts(random.Random(4), 25)))
    sets = [similar.shingle_set(t) for t in texts]
    prints = np.array([similar.set_print(s) for s in sets])
    table = spark.createDataFrame([(i, p.view(np.int64).tolist()) for i, p in enumerate(prints)], "d bigint, p array<bigint>")
    near = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if min(len(a), len(b)) > similar.TINY and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))}
    assert max(int(np.bitwise_count(prints[i] ^ prints[j]).sum()) for i, j in near) > 3 * similar.WORDS
    for bucket_rows, task_rows in ((4_096, 32_768), (16, 32_768), (64, 40)):
        keys = {}
        for r in similar.wide_groups(table, 0.8, bucket_rows, task_rows).collect():
            keys.setdefault(r.d, set()).add(r.key)
        assert all(keys.get(i, set()) & keys.get(j, set()) for i, j in near)
        strange = [(i, j) for i in keys for j in keys if i < j and texts[i].split("w")[0] != texts[j].split("w")[0] and keys[i] & keys[j]]
        assert len(strange) < len(near)
    assert similar.wide_groups(table.limit(0), 0.8).count() == 0
