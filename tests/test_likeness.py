"""Likeness by a model and by vectors of tokens, as columns, as jobs, and as weights."""

import math
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from corrigenda.operators import likeness as V
from corrigenda.operators import weights as W
from corrigenda.plans.evaluate import evaluate
from corrigenda.plans.testbed import tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file
SF = "/root/testdata/sf0.001"
TEXTS = [(["a", "b"], ["a", "c"]), (["a"], ["a"]), ([], []), (["a"], []), (["zz", "a"], ["a", "zz", "yy"]), (["d"], ["c"])]
VECTORS = {"a": [1.0, 0.0], "b": [0.0, 2.0], "c": [1.0, 1.0], "d": [-1.0, -1.0]}


def plain(a, b):
    if not a or not b:
        return float(a == b)

    def cosine(x, y):
        if x not in VECTORS or y not in VECTORS:
            return float(x == y)
        u, v = VECTORS[x], VECTORS[y]
        return sum(p * q for p, q in zip(u, v)) / math.hypot(*u) / math.hypot(*v)

    p = sum(max(cosine(x, y) for y in b) for x in a) / len(a)
    r = sum(max(cosine(x, y) for x in a) for y in b) / len(b)
    return 2 * p * r / (p + r) if p > 0 and r > 0 else 0.0


def test_vectors_given_and_joined(spark):
    pairs = spark.createDataFrame(TEXTS * 2, "a array<string>, b array<string>")
    bad = [("q", None), ("a", [5.0, 5.0]), ("n", [0.0, 0.0]), ("m", [float("nan"), 1.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame([*VECTORS.items(), *bad], "token string, vec array<double>")
    for small in (100, 0):
        got = {(tuple(r.a), tuple(r.b)): r.s for r in V.VectorSimilarity(vectors, small).scores(pairs).collect()}
        assert len(got) == len(TEXTS)
        for a, b in TEXTS:
            assert abs(got[tuple(a), tuple(b)] - plain(a, b)) < 1e-12


def counted_loads(path):
    def load():
        with open(path, "a") as f:
            f.write("x")
        return lambda a, b: [plain(x, y) for x, y in zip(a, b)]

    return load


def test_model_is_loaded_once_a_task(spark, tmp_path):
    log = tmp_path / "loads"
    pairs = spark.createDataFrame(TEXTS * 50, "a array<string>, b array<string>").repartition(2)
    sim = V.model_similarity(counted_loads(str(log)), batch=7)
    got = pairs.select("a", "b", sim(F.col("a"), F.col("b")).alias("s")).collect()
    assert len(got) == 300 and all(abs(r.s - plain(r.a, r.b)) < 1e-12 for r in got)
    assert 1 <= len(log.read_text()) <= 2


def test_weights_by_model_equal_weights_by_vectors(spark, tmp_path):
    data = tables(spark, SF)
    few = {k: v.where("sample_id % 97 = 1") for k, v in data.items()}
    words = few["samples"].select(F.explode("src_tokens").alias("token")).distinct()
    vectors = words.select("token", F.array((F.length("token") * 1.0), (F.ascii("token") % 7 + 1.0)).alias("vec"))
    table = {r.token: list(r.vec) for r in vectors.collect()}

    def load():
        VECTORS.clear()
        VECTORS.update(table)
        return lambda a, b: [plain(x, y) for x, y in zip(a, b)]

    out = []
    for sim in (V.VectorSimilarity(vectors), V.model_similarity(load)):
        for weigher in ("similarity", "replacement"):
            m = evaluate(few, "heuo", weigher=weigher, sim=sim)[1]
            out.append(sorted((r.sample_id, r.ref_id, r.chunk_idx, r.outcome, round(r.weight, 9)) for r in m.collect()))
    assert out[0] and out[0] == out[2] and out[1] == out[3] and out[0] != out[1]


def test_target_with_one_chunk_put_back(spark):
    rows = [("s", 1, "ref", 0, 0, ["a"], ["b"], True), ("s", 1, "ref", 0, 1, ["c"], ["c"], False), ("s", 1, "ref", 0, 2, ["d"], [], True)]
    chunks = spark.createDataFrame(rows, "system_id string, sample_id bigint, side string, target_id int, chunk_idx int, src_tokens array<string>, tgt_tokens array<string>, is_marked boolean")
    assert {r.chunk_idx: r.tokens for r in W.reverted_targets(chunks).collect()} == {0: ["a", "c"], 2: ["b", "c", "d"]}
