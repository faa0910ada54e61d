"""Small hand-made corpora against a plain Python evaluation, format edge cases, and the SQL oracles."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corrigenda import model, oracles, queries
from corrigenda.functions import text as X
from corrigenda.operators import chunks as C
from corrigenda.operators import edits as E
from corrigenda.operators import extract as K
from corrigenda.operators import scores as S
from corrigenda.sources.blocks import read_blocks, write_blocks
from corrigenda.sources.nested import read_parallel

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["prf_corpus_dependent", "chunks", "outcome_independent", "edit_detection", "gleu_parts", "block_round_trip", "subword_align", "replacement_weights"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(oracles.ORACLES[name]).df()
    rows = lambda d: sorted(repr([None if v != v else round(v, 5) if isinstance(v, float) else v for v in r]) for r in d[sorted(d.columns)].astype(object).values.tolist())
    plain = lambda d: d.apply(lambda c: c.astype(float) if c.dtype.kind in "if" else c)
    assert sorted(got.columns) == sorted(want.columns) and rows(plain(got)) == rows(plain(want))


BLOCKS = """S a b c d
A 1 2|||R:X|||x y|||REQUIRED|||-NONE-|||0
A 3 4|||U:X||||||REQUIRED|||-NONE-|||0
A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||1



S e f
A 1 1|||M:X|||g|||REQUIRED|||-NONE-|||0

S a b c d
T0-A1 other
A 0 1|||R:X|||z|||REQUIRED|||-NONE-|||0
"""


def test_blocks(spark, tmp_path):
    (tmp_path / "in").write_text(BLOCKS)
    got = read_blocks(spark, str(tmp_path / "in"), "s", "ref")
    t = {(r.sample_id, r.target_id): " ".join(r.tgt_tokens) for r in got["targets"].collect()}
    assert t == {(0, 0): "a x y c", (0, 1): "a b c d", (1, 0): "e g f", (2, 0): "a b c d"}
    assert E.invalid_edits(got["samples"], got["targets"], got["edits"]).count() == 0
    write_blocks(got["samples"], got["targets"], got["edits"], str(tmp_path / "out"))
    again = read_blocks(spark, str(tmp_path / "out"), "s", "ref")
    key = lambda d: sorted(map(str, d["targets"].collect()))
    assert key(again) == key(got)


def test_parallel_and_extraction(spark, tmp_path):
    (tmp_path / "s").write_text("This are a test\nsame line\nA b c\n")
    (tmp_path / "t").write_text("This is a test\tThis are test\nsame line\nA c b\n")
    d = read_parallel(spark, str(tmp_path / "s"), str(tmp_path / "t"), "x")
    pairs = d["targets"].join(d["samples"], model.KEYS)
    e = K.parallel_to_edits(pairs)
    back = E.apply_edits(d["samples"], d["targets"], e)
    assert sorted(map(str, back.select(*model.TARGET, "tgt_tokens").collect())) == sorted(map(str, d["targets"].select(*model.TARGET, "tgt_tokens").collect()))
    kinds = {(r.sample_id, r.target_id): r.types for r in e.collect()}
    assert kinds[2, 0] == ["R:WO"] and kinds[0, 1] == ["U:OTHER"] and (1, 0) not in kinds


def _fold(samples, score):
    total = [0.0] * 6
    for refs in samples:
        best = None
        for v in refs:
            new = [a + b for a, b in zip(total, v)]
            rank = (score(new), v[0], -v[1], -v[2], v[3])
            if best is None or rank > best[0]:
                best = (rank, new)
        total = best[1]
    return total


@pytest.mark.parametrize("by", ["prf", "heuo"])
def test_pruned_fold_equals_full_fold(spark, by):
    rng = random.Random(5)
    data = []
    for i in range(400):
        refs = []
        for _ in range(rng.choice([1, 2, 2, 3])):
            tp, ne, un, fn = (rng.choice([0, 0, 1, 2]) for _ in range(4))
            refs.append([float(x) for x in (tp, ne + un, fn, rng.choice([3, 4]), ne, un)])
        data.append(refs)
    rows = [("a", i * 7001, k, *v) for i, refs in enumerate(data) for k, v in enumerate(refs)]
    df = spark.createDataFrame(rows, "system_id string, sample_id bigint, ref_id int, tp double, fp double, fn double, tn double, fp_ne double, fp_un double")
    got = S.corpus_totals(df, by).first()
    score = S._prf if by == "prf" else (lambda c: S._com(c, S.CORPUS_FACTORS))
    assert [got[c] for c in S.COUNTS] == _fold(data, score) and got["num_sample"] == 400


def test_chunks_concatenate_and_handle_no_edits(spark):
    s = spark.createDataFrame([("a", 0, ["x", "y"]), ("a", 1, []), ("a", 2, ["p", "q", "r"])], model.SAMPLES)
    t = spark.createDataFrame([("a", i, side, 0, []) for i in range(3) for side in ("hyp", "ref")], model.TARGETS)
    e = spark.createDataFrame([("a", 2, "hyp", 0, 0, 1, 1, 1, 2, [], ["n"], ["M:X"]), ("a", 2, "ref", 0, 0, 1, 2, 1, 1, ["q"], [], ["U:X"])], model.EDITS)
    ch = C.chunks(s, t, e).collect()
    text = {}
    for r in sorted(ch, key=lambda r: (r.sample_id, r.side, r.chunk_idx)):
        text.setdefault((r.sample_id, r.side), []).extend(r.tgt_tokens)
    assert text[2, "hyp"] == ["p", "n", "q", "r"] and text[2, "ref"] == ["p", "r"] and text[0, "hyp"] == ["x", "y"] and text[1, "ref"] == []
    assert {r.chunk_idx for r in ch if r.sample_id == 2} == {0, 1, 2}


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a[缺失成分] b", "你好。再见！好")], "a string, b string")
    r = df.select(X.char_tokens(F.col("a")).alias("c"), X.split_sentences(F.col("b"), "zho", 2).alias("s"), X.all_cjk(F.lit("你好")).alias("k"), X.is_rotation(F.lit("abc"), F.lit("cab")).alias("r"), X.truncate(F.lit("abcdef"), 5).alias("t"), X.is_punct(F.lit("!，")).alias("p")).first()
    assert r.c == ["a", "[缺失成分]", "b"] and r.s == ["你好", "。", "再见", "！", "好"] and r.k and r.r and r.t == "ab..." and r.p
