"""Work that concerns one sample is done beside it: no shuffles, the same rows as the plain forms."""

import gc
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrigenda import queries as Q
from corrigenda.operators import align as A
from corrigenda.operators import chinese as Z
from corrigenda.operators import edits as E
from corrigenda.operators import english as N
from corrigenda.operators import extract as K
from corrigenda.operators import gleu as G
from corrigenda.operators import grouped as R
from corrigenda.operators import likeness as L
from corrigenda.operators import outcomes as O
from corrigenda.operators import scores as S
from corrigenda.operators import weights as W
from corrigenda.operators.grouped import GROUPED, ungroup
from corrigenda.plans import evaluate as V
from corrigenda.plans import reports as P
from corrigenda.plans.testbed import tables
from corrigenda.queries import QUERIES, _pairs
from corrigenda.sources import blocks as B
from corrigenda.sources import nested as J

SF = "/root/testdata/sf0.001"


def exchanges(df):
    """Shuffles in the plan, less the one that deals the documents out."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ") - 1


def few_pairs(spark):
    return _pairs(spark, SF).where("sample_id % 53 = 3")


@pytest.mark.parametrize("strategy", ["equal", "merge", "rules", "split"])
def test_edits_in_rows(spark, strategy):
    p = few_pairs(spark)
    plain = K.to_edits(p, K.merge_steps(K.align_pairs(p), strategy))
    got = K.parallel_to_edits(p, strategy)
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert exchanges(QUERIES[f"merge_{strategy}"](spark, SF)) == 0


def test_targets_rebuilt_in_rows(spark):
    got, want = QUERIES["extract_round_trip"](spark, SF), QUERIES["apply_edits"](spark, SF)
    assert exchanges(got) == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_common_ends_are_not_aligned(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [(w, w, "") for w in "abcdef"]
    pairs = []
    for _ in range(300):
        end = [words[k] for k in rng.integers(0, 6, rng.integers(0, 9))]
        pairs.append(tuple([words[k] for k in rng.integers(0, 6, rng.integers(0, 7))] + end for _ in "ab"))
    got = A.align_many(pairs, K.WordCosts)
    cells = []
    blocks = A._blocks
    monkeypatch.setattr(A, "_blocks", lambda order, size: (cells.append(int(size.sum())), blocks(order, size))[1])
    A.align_many(pairs, K.WordCosts)
    assert cells[0] < sum(len(s) + len(t) for s, t in pairs)
    monkeypatch.setattr(A, "_common_end", lambda a, b: 0)
    for one, other in zip(got, A.align_many(pairs, K.WordCosts)):
        assert all(np.array_equal(x, y) for x, y in zip(one, other))


def test_english_round_trip_in_rows(spark):
    got, want = QUERIES["english_round_trip"](spark, SF), QUERIES["apply_edits"](spark, SF)
    assert exchanges(got) == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_english_edits_in_rows(spark):
    rng = random.Random(5)
    tags = {"NN": "NOUN", "VBD": "VERB", "MD": "AUX", "DT": "DET", "POS": "PART", ".": "PUNCT"}

    def sentence(words):
        return [(w, w[:3], tags[tag], tag, rng.choice(["aux", "auxpass", "det", "dobj", None]), rng.randrange(len(words))) for w in words for tag in [rng.choice(list(tags))]]

    rows = []
    for k in range(400):
        src = [rng.choice(["was", "were", "been", "the", "walks", "walked", "a", "A", "."]) for _ in range(rng.randrange(1, 9))]
        tgt = [w for w in src if rng.random() > 0.2] + [rng.choice(["has", "walked", "dog"])] * rng.randrange(2)
        for _ in range(rng.randrange(3)):
            tgt.insert(rng.randrange(len(tgt) + 1), rng.choice(["had", "be", "walks"]))
        rows.append(("s", k, "ref", 0, src, sentence(src), sentence(tgt)))
    pairs = spark.createDataFrame(rows, f"system_id string, sample_id bigint, side string, target_id int, src_tokens array<string>, src_ann array<{N.TOKEN}>, tgt_ann array<{N.TOKEN}>")
    plain = N.annotated_edits(pairs, N.merge_annotated(pairs))
    got = N.english_edits(pairs)
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect())) != []
    assert {True, False} == {r.aux for r in N.edits_in_rows(pairs).select(F.explode("edits.aux").alias("aux")).collect()}
    assert exchanges(QUERIES["merge_english"](spark, SF)) == 0


def test_chinese_edits_in_rows(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for k in range(300):
        src = ["".join(rng.choices("他她己已巳大家", k=rng.randrange(1, 3))) for _ in range(rng.randrange(1, 7))]
        tgt = [rng.choice(["家", "她", "己已"]) if rng.random() < 0.3 else w for w in src if rng.random() > 0.1]
        rng.random() < 0.2 and rng.shuffle(tgt)
        rows.append(("s", k, "ref", 0, src, tgt))
    pairs = spark.createDataFrame(rows, "system_id string, sample_id bigint, side string, target_id int, src_tokens array<string>, tgt_tokens array<string>")
    classes = spark.createDataFrame([("他", "Aa01"), ("她", "Aa02"), ("己已", "Bb02"), ("她", "Aa01")], "word string, code string")
    confusions = spark.createDataFrame([("己", ["已", "巳"])], "char string, alike array<string>")
    sounds = spark.createDataFrame([("他", ["ta"]), ("她", ["ta"]), ("家", ["jia"]), ("大", ["da"])], "char string, sounds array<string>")
    tables_ = Z.Lexical(classes, confusions, sounds)
    plain = sorted(map(str, Z.merge_chinese(pairs, Z.lexicon(pairs, classes, confusions, sounds), words=True).collect()))
    assert sorted(map(str, Z.merge_chinese(pairs, tables_, words=True).collect())) == plain
    got = sorted(map(str, Z.edits_in_rows(pairs, tables_, words=True).collect()))
    back = E.applied(Z.edits_in_rows(pairs, tables_, words=True))
    assert {r.sample_id: r.tgt_tokens for r in back.collect()} == {r[1]: r[5] for r in rows}
    monkeypatch.setattr(Z, "SMALL", 1)  # joined
    assert sorted(map(str, Z.edits_in_rows(pairs, tables_, words=True).collect())) == got


def test_chinese_round_trip_in_rows(spark):
    assert exchanges(QUERIES["chinese_round_trip"](spark, SF)) == 0


def test_ngrams_of_a_row(spark):
    rng = random.Random(7)
    rows = [(k // 2, rng.choices("abc", k=rng.randrange(9))) for k in range(200)] + [(1000, None), (1001, ["a", None, "a"])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    want = Counter((k, n, tuple(t[i : i + n])) for k, t in rows if t for n in range(1, 5) for i in range(len(t) + 1 - n))
    assert {(r.id, r.n, tuple(r.gram)): r.c for r in G.ngram_counts(df, ["id"], "t").collect()} == want
    one = df.where("id >= 1000")
    assert {(r.id, r.n, tuple(r.gram)): r.c for r in G.ngram_counts(one, ["id"], "t", unique=True).collect()} == {k: c for k, c in want.items() if k[0] >= 1000}
    assert exchanges(QUERIES["ngram_counts"](spark, SF)) == 0


def test_json_row_by_row(spark, tmp_path, monkeypatch):
    t = {k: v.where("sample_id % 41 = 2") for k, v in tables(spark, SF).items()}
    plain, paths = J.to_nested(t["samples"], t["targets"], t["edits"]), []
    got = J.grouped_to_nested(t["grouped"])
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert exchanges(J.grouped_to_nested(t["grouped"])) == 0
    monkeypatch.setattr(Q, "shared_path", lambda spark, name: paths.append(str(tmp_path / name)) or paths[-1])
    back = QUERIES["json_round_trip"](spark, SF)
    assert {p.suffix for p in (tmp_path / "json").glob("part-*")} == {".gz"}
    assert back.count() == QUERIES["edits_scan"](spark, SF).count()


def lines_of(spark, path):
    return [r.value for r in spark.read.text(path).withColumn("_f", F.col("_metadata.file_path")).orderBy("_f", F.monotonically_increasing_id()).collect()]


@pytest.mark.parametrize("flatten", [True, False])
def test_blocks_row_by_row(spark, tmp_path, flatten):
    t = {k: v.where("sample_id % 61 = 2") for k, v in tables(spark, SF).items()}
    for texts in (True, False):
        B.write_blocks(t["samples"], t["targets"], t["edits"], str(tmp_path / f"plain{texts}"), texts=texts, flatten=flatten)
        B.write_blocks(t["samples"], t["targets"], t["edits"], str(tmp_path / f"rows{texts}"), texts=texts, flatten=flatten, grouped=t["grouped"], compression="gzip")
        assert lines_of(spark, str(tmp_path / f"rows{texts}")) == lines_of(spark, str(tmp_path / f"plain{texts}")) != []
    got = B.read_block_rows(spark, str(tmp_path / "rowsTrue"), "s", "ref")
    # lines are not dealt by split, and only blocks at the borders of splits by their numbers
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(_f#\d+, _b", plan) and len(re.findall(r"hashpartitioning\(.*sample_id", plan)) <= 1
    tables_ = B.read_blocks(spark, str(tmp_path / "rowsTrue"), "s", "ref", remove_unchanged=True)
    rows = ungroup(B.read_block_rows(spark, str(tmp_path / "rowsTrue"), "s", "ref", remove_unchanged=True))
    for name in ("samples", "targets", "edits"):
        assert sorted(map(str, rows[name].collect())) == sorted(map(str, tables_[name].collect()))


def test_block_that_is_one_split_and_many(spark, tmp_path):
    (tmp_path / "in").write_bytes(b"\n\nS a b\nA 0 1|||R|||x|||REQUIRED|||-NONE-|||1\n\nS c\n" + b"".join(b"A 0 1|||R|||%d|||REQUIRED|||-NONE-|||%d\n" % (k, k) for k in range(40)) + b"\nS d")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = {r.sample_id: r for r in B.read_block_rows(spark, str(tmp_path / "in"), "s").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [got[k].src_tokens for k in range(3)] == [["a", "b"], ["c"], ["d"]]
    assert [t.tgt_tokens for t in got[0].t] == [["a", "b"], ["x", "b"]] and [t.tgt_tokens for t in got[1].t] == [[str(k)] for k in range(40)]


def few(spark):
    return {k: v.where("sample_id % 37 = 2") for k, v in tables(spark, SF).items()}


def same_rows(got, want):
    rounded = lambda df: sorted(map(str, df.select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in sorted(want.dtypes)]).collect()))
    assert rounded(got) == rounded(want) != []


@pytest.mark.parametrize("detection", [True, False])
def test_edit_outcomes_in_rows(spark, detection):
    t = few(spark)
    same_rows(R.edit_rows(t["grouped"], detection), O.edit_outcomes(t["targets"], t["edits"], detection))
    assert exchanges(QUERIES["edit_detection"](spark, SF)) == 0


def test_reverted_targets_in_rows(spark):
    t = few(spark)
    live = R.drop_empty_refs(t["grouped"])
    same_rows(R.reverted_rows(live), W.reverted_targets(R.chunk_rows(live)))
    assert exchanges(QUERIES["reverted_refs"](spark, SF)) == 0


def test_weighted_counts_in_rows(spark):
    t = few(spark)
    live = R.drop_empty_refs(t["grouped"])
    weights = {r.system_id: W.length_weight_of(r.bias) for r in R.length_bias(live).collect()}
    want = S.ref_counts(W.weigh_by_length(R.match_rows(live), R.chunk_rows(live)), S.reference_pairs(t["targets"]), F.col("weight"))
    same_rows(R.all_counts(t["grouped"], weights), want)
    assert exchanges(QUERIES["ref_counts_weighted"](spark, SF)) == 0


def test_four_scores_from_one_table_of_counts(spark, monkeypatch):
    t, passes = few(spark), []
    for metric in ("chunk", "heuo"):
        got = V.evaluate_all(t, metric)
        for level, weighted in P.KEYS:
            one = V.evaluate(t, metric, level=level, weigher="length" if weighted else "none")[0]
            same_rows(got.where((F.col("level") == level) & (F.col("weighted") == weighted)).select(*one.columns), one)
    all_counts = R.all_counts
    monkeypatch.setattr(V.G, "all_counts", lambda *a, **b: passes.append(1) or all_counts(*a, **b))
    V.evaluate_all(t, "chunk")
    assert passes == [1]


@pytest.mark.parametrize("assumption", ["dependent", "independent"])
def test_weights_in_rows(spark, assumption):
    t = few(spark)
    live = R.drop_empty_refs(t["grouped"])
    own = lambda a, b: W.token_f1(a, b)
    for rows, plain, name in ((W.similarity_rows, W.weigh_by_similarity, "similarity_weights"), (W.replacement_rows, W.weigh_by_replacement, "replacement_weights")):
        m = R.match_rows(live, assumption)
        want = plain(m, t["samples"], t["targets"], R.chunk_rows(live)).where("outcome <> 'tn'").drop("fp_kind", "length")
        for sim in (W.token_f1, own):
            same_rows(rows(t["grouped"], sim, assumption), want)
        assert exchanges(QUERIES[name](spark, SF)) == 0


def test_vectors_of_keys_in_rows(spark):
    t = few(spark)
    key = lambda tokens: F.transform(tokens, lambda x: F.ascii(x) % 5)
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "token int, vec array<double>")
    words = t["samples"].select(F.explode("src_tokens").alias("t")).unionByName(t["targets"].select(F.explode("tgt_tokens").alias("t"))).distinct()
    by_token = words.select(F.col("t").alias("text"), (F.ascii("t") % 5).alias("token")).join(table, "token").select(F.col("text").alias("token"), "vec")
    plain = lambda sim: W.source_similarity(t["samples"], t["targets"], sim)
    for small in (100_000, 1):
        want = plain(L.VectorSimilarity(by_token, small))
        same_rows(W.source_similarity_rows(t["grouped"], L.VectorSimilarity(table, small, key)), want)
    got = W.source_similarity_rows(t["grouped"], L.VectorSimilarity(table, key=key))
    assert exchanges(got) == 0


def test_repeated_grams_are_clipped(spark):
    rng = random.Random(8)
    rows = [("s", k, rng.choices("ab", k=rng.randrange(7)), [("hyp", 0, rng.choices("abc", k=rng.randrange(8)), [])] + [("ref", r, rng.choices("ac", k=rng.randrange(7)), []) for r in range(2)]) for k in range(300)]
    got = {(r.sample_id, r.ref_id, r.n): r.numerator for r in G.gleu_parts(spark.createDataFrame(rows, GROUPED)).collect()}
    for _, k, src, targets in rows:
        for _, ref, tokens, _ in targets[1:]:
            for n in range(1, 5):
                h, s, r = (Counter(tuple(t[i : i + n]) for i in range(len(t) + 1 - n)) for t in (targets[0][2], src, tokens))
                assert got[k, ref, n] == max(sum(min(c, r[g]) if g in r else -min(c, s[g]) for g, c in h.items()), 0)


def test_no_search_for_cycles_within_a_batch():
    assert gc.isenabled()
    with pytest.raises(ZeroDivisionError), R.uncollected():
        assert not gc.isenabled()
        1 / 0
    assert gc.isenabled()
